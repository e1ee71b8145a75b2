"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import ann, byte_bpe, html_text, licences, near_dedup, packing, quality, secrets, token_counts, token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multiprobe_neighbours": ann.query,
    "op2_dart_near_dedup": near_dedup.query,
    "op3_licence_scan": licences.query,
    "op4_shuffled_byte_bpe": byte_bpe.query,
    "op5_secret_scan": secrets.query,
    "op6_token_counts": token_counts.query,
    "op7_bound_certified_packing": packing.query,
    "op8_main_text": html_text.query,
    "op9_host_quality": quality.query,
    "op10_keyed_token_shards": token_shards.query,
    "secret_base_spans": secrets.base,
}

#: The others can't be written in DuckDB's SQL with the same method's results; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_dart_near_dedup": near_dedup.SQL, "op9_host_quality": quality.SQL, "secret_base_spans": secrets.SQL_BASE}
