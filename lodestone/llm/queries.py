"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, fill_middle, licenses, line_dedup, merkle, packing, secrets, simhash, substring_dedup, token_counts, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.query,
    "op2_topk_search": topk.query,
    "op3_simhash": simhash.query,
    "op4_decontaminate": decontaminate.query,
    "op5_packing": packing.query,
    "op6_license_scan": licenses.query,
    "op7_line_dedup": line_dedup.query,
    "op8_secret_scan": secrets.query,
    "op9_warc": warc.query,
    "op10_toxicity": toxicity.query,
    "op11_fill_middle": fill_middle.query,
    "op12_merkle_manifest": merkle.query,
    "op13_substring_dedup": substring_dedup.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": topk.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op6_license_scan": licenses.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_warc": warc.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_substring_dedup": substring_dedup.SQL,
}
