"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import benchmark_decontamination, best_fit_packing, context_mixing, embedding_dedup, embedding_whitening, filter_audit, hilbert_sharding, language_id, line_dedup, ngram_join, quality_classifier, source_mixing, token_counts

MODULES = (hilbert_sharding, context_mixing, ngram_join, quality_classifier, benchmark_decontamination, line_dedup, token_counts, language_id, source_mixing, embedding_dedup, filter_audit, best_fit_packing, embedding_whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
