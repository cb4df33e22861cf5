"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from levelwise.llm import (
    chat, clustering, decontaminate, line_dedup, maxscore, packing, pii, quality, simhash, suffix_dedup, toxicity, warc,
    whitening,
)
from levelwise.llm.common import Query

QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_exact_top_k": maxscore.op7_exact_top_k,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_warc": warc.op10_warc,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_centroid_clustering": clustering.op12_centroid_clustering,
    "op13_pii": pii.op13_pii,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op7_exact_top_k": maxscore.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_warc": warc.SQL,
    "op12_centroid_clustering": clustering.SQL,
}
