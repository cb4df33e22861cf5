"""Logit, probability and prediction expressions over array columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


# Weights of a head that is written out term by term.
SCALAR_TERMS = 128


def linear_head(
    features: Column | str,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float] | None = None,
) -> Column:
    """Affine map ``W x + b`` as an array with one logit per row of ``weights``.

    Up to :data:`SCALAR_TERMS` weights become plain scalar products, so that the head is generated code without
    lambdas. More of them would not fit one generated method; each logit is then an aggregate over the array.
    """
    features = _col(features)
    bias = [0.0] * len(weights) if bias is None else bias
    if len(bias) != len(weights):
        raise ValueError("bias needs one value per row of weights")
    widths = {len(row) for row in weights}
    if len(widths) != 1:
        raise ValueError("all rows of weights need the same length")
    width = widths.pop()
    if width * len(weights) <= SCALAR_TERMS:
        entries = [F.get(features, i).cast("double") for i in range(width)]

        def logit(row: Sequence[float], intercept: float) -> Column:
            return balanced_sum([entry * float(w) for entry, w in zip(entries, row)] + [F.lit(float(intercept))])
    else:
        doubles = features.cast("array<double>")

        def logit(row: Sequence[float], intercept: float) -> Column:
            products = F.zip_with(doubles, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w)
            return F.aggregate(products, F.lit(float(intercept)), add)

    return of_length(features, width, F.array(*[logit(row, b) for row, b in zip(weights, bias)]))


def balanced_sum(terms: Sequence[Column]) -> Column:
    """Sum as a tree, which stays shallow for many terms."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return balanced_sum(terms[:half]) + balanced_sum(terms[half:])


def of_length(values: Column, length: int, result: Column) -> Column:
    """``result`` where ``values`` has ``length`` entries, NULL where it is NULL; any other length fails the job."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {length} values, got "), F.size(values).cast("string")))
    return F.when(values.isNull(), F.lit(None)).when(F.size(values) == length, result).otherwise(wrong)


def softmax(logits: Column | str, num_classes: int | None = None) -> Column:
    """Probabilities from logits, shifted by the maximum.

    With a class count each exponential is a plain scalar expression: it stays
    in generated code and is computed once, and other lengths fail. Without one
    the length of each array is used.
    """
    logits = _col(logits)
    peak = F.array_max(logits)
    if num_classes is None:
        powers = F.transform(logits, lambda x: F.exp(x - peak))
        shares = F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), add)))
        return F.when(logits.isNotNull(), F.get(shares, 0))
    parts = [F.exp(F.get(logits, k) - peak) for k in range(num_classes)]
    total = reduce(add, parts)
    return of_length(logits, num_classes, F.array(*[part / total for part in parts]))


def confidence(probability: Column | str) -> Column:
    """Largest probability."""
    return F.array_max(_col(probability))


def argmax_label(logits: Column | str) -> Column:
    """Index of the largest value; the lowest index wins a tie."""
    logits = _col(logits)
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def correct_flag(predicted: Column | str = "p", truth: Column | str = "y") -> Column:
    return _col(predicted) == _col(truth)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
