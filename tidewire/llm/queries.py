"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import ann, decontamination, fill_in_middle, licenses, ngram_join, packing, pii, quality, secrets, token_counts, toxicity, url_filters, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
        pii.op1_pii, toxicity.op2_toxicity, decontamination.op3_decontamination, ngram_join.op4_ngram_join, packing.op5_packing,
        ann.op6_ann, quality.op7_quality, url_filters.op8_url_filters, licenses.op9_licenses, secrets.op10_secrets,
        token_counts.op11_token_counts, whitening.op12_whitening, fill_in_middle.op13_fill_in_middle,
    )}
ORACLE_SQL: dict[str, str] = {"op8_url_filters": url_filters.SQL, "op13_fill_in_middle": fill_in_middle.SQL}
