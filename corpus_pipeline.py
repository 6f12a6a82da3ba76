"""The corpus pipeline: filters and edits documents, then packs them for training.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of ``documents``. ``run`` writes each stage's result as Parquet in the shared folder, reads it
again as the next one's documents and deletes it when that one is written.

Defined cases: null texts pass the filters as texts without words; null doc_ids are ordered last;
empty tables give empty results; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, line_dedup, packing, simhash, toxicity
from lodestone.llm.common import dropped, table, written


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, does not reject."""
    fit = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, [_row(docs)], "doc_id", "text", fit, twice=True).where("score < 0.5").select("c0.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which no word is left go."""
    flag = "changed"
    while flag in docs.columns:
        flag += "_"
    cut = line_dedup.deduplicated(docs, "doc_id", "text", changed=flag)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    kept = cut.where(~F.col(flag) | F.col("text").rlike(word))
    size = F.when(F.col(flag), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id."""
    return simhash.one_of_each(docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contamination rule allows."""
    found = decontaminate.contaminated_words(docs, [_row(docs)], "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.where(f"not ({decontaminate.CONTAMINATED})").select("c0.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences that the documents fill."""
    return packing.packed(docs, F.col("doc_id"), "text", **packing.public_files()).withColumnRenamed("c0", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokenisation, the classifier and 64-bit XXH64 fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
