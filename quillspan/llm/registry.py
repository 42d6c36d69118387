"""The corpus operators' queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, divergence, html_text, infill, near_duplicates, pii, quality, repeats, secrets, token_counts, toxicity, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_decontamination": decontaminate.query,
    "op3_ngram_jaccard": near_duplicates.query,
    "op4_html_text": html_text.query,
    "op5_wavelet_tokens": wavelet.query,
    "op6_secrets": secrets.query,
    "op7_token_counts": token_counts.query,
    "op8_quality": quality.query,
    "op9_byte_bpe": bpe.query,
    "op10_toxicity": toxicity.query,
    "op11_infill": infill.query,
    "op12_source_divergence": divergence.query,
    "op13_substring_dedup": repeats.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_decontamination": decontaminate.SQL, "op8_quality": quality.SQL, "op11_infill": infill.SQL, "op12_source_divergence": divergence.SQL, "op13_substring_dedup": repeats.SQL}
