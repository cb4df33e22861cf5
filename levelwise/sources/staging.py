"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """The shared folder the session names.

    A local session without one gets a temporary folder; a cluster session
    without one is an error, since a machine-local folder would not be shared.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if not configured:
        context = spark.sparkContext
        configured = context.getCheckpointDir()
        if not configured:
            if context.master.split("[")[0] != "local":
                raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="levelwise-"))
            configured = context.getCheckpointDir()
    return configured.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{staging_root(spark)}/levelwise/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later reads prune columns.
    The files stay as long as the folder does.
    """
    return _write_and_read(df, staging_path(df.sparkSession, name))


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A staged table for the length of a ``with`` block; its files go afterwards."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    try:
        yield _write_and_read(df, path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _write_and_read(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
