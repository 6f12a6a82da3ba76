"""The driver tables in the roles of the engine's inputs.

Vectors are chunks, their labels sources; benchmark items whose id is a vector's id are queries; events are
the feedback log, a user being a conversation; conversations are chats; pages are crawled pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("source"))


def texted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the text and source of the document of the same id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_path"), "lang")
    return chunks(spark, sf_dir).join(docs, "chunk_id")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question, vectors): benchmark items with the vector of the same id as their only variant."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.array("embedding").alias("vectors"), F.col("label").alias("gold"))
    return items.join(vectors, "query_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback log: purchases and clicks are up, views side, errors down, signups withdraw."""
    e = table(spark, sf_dir, "events")
    thumb = F.when(F.col("event_type").isin("purchase", "click"), "up").when(F.col("event_type") == "view", "side").when(F.col("event_type") == "error", "down").otherwise("none")
    turn = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("line_no"), F.unix_timestamp("ts").alias("timestamp"), F.col("user_id").cast("string").alias("conversation_id"), turn.alias("turn_id"),
        F.when(F.col("value") >= 50, "answer").otherwise("citation").alias("feedback_type"), thumb.alias("thumb"), F.array(turn).alias("cited_chunk_ids"), turn.alias("target"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation run per user: the mean event value of each type as a metric."""
    e = table(spark, sf_dir, "events")
    names = {"click": "retrieval_gold_doc_recall_at_k_mean", "view": "retrieval_gold_doc_mrr_mean", "purchase": "retrieval_noise_rate_mean", "error": "answer_forbidden_violation_rate", "signup": "answer_abstention_accuracy"}
    metric = F.lit(None).cast("string")
    for kind, name in names.items():
        metric = F.when(F.col("event_type") == kind, name).otherwise(metric)
    rows = e.groupBy(F.col("user_id").alias("run_id"), metric.alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return rows.where("metric is not null")


def retrieved(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id, source, gold, score): the k best chunks of each query but its own."""
    from lodestone.operators.scoring import dense_topk, ranked

    q = queries(spark, sf_dir)
    found = dense_topk(chunks(spark, sf_dir), q, k + 1).where("chunk_id != query_id")
    best = ranked(found, "score", "chunk_id", limit=k)
    return best.join(q.select("query_id", "gold"), "query_id").join(chunks(spark, sf_dir).select("chunk_id", "source"), "chunk_id")
