"""Vote weights and summaries over the feedback log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.feedback import STATE, folded, latest
from lodestone.streaming.tables import Buckets, union

EVENT = "line_no long, conversation_id string, target string, feedback_type string, thumb string, cited_chunk_ids array<string>, timestamp long"
_CITED = "conversation_id string, target string, chunk_id string"


def read_log(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """The log's JSON files as a stream of typed events."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def weights(spark: SparkSession, table: str) -> DataFrame:
    """(conversation_id, chunk_id, weight) as the stream has left them."""
    return _states(spark, table).read().where("weight is not null").select("conversation_id", "chunk_id", "weight")


def _states(spark: SparkSession, table: str) -> Buckets:
    return Buckets(spark, f"{table}/states", STATE, ("conversation_id", "chunk_id"))


def _cited(spark: SparkSession, table: str) -> Buckets:
    return Buckets(spark, f"{table}/cited", _CITED, ("conversation_id", "target"))


def stream_weights(events: DataFrame, table: str):
    """A foreachBatch sink that keeps in ``table`` the state of every chunk in every conversation; ``weights`` reads it.

    A vote undoes its target's earlier ones on every chunk that the target has ever cited, so those are kept too, and a batch's
    votes reach them all. Within a batch events apply in log order; a batch must not hold events older than those
    before it, as in an append-only log. A batch rewrites the buckets that it changes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("feedback_type = 'citation'").select("conversation_id", "target", "line_no", "thumb", "cited_chunk_ids").persist()
        if rows.isEmpty():
            return
        cited, states = _cited(spark, table), _states(spark, table)
        known = cited.read(number, cited.touched(rows))
        all_ = union(known, rows.select("conversation_id", "target", F.explode("cited_chunk_ids").alias("chunk_id"))).distinct().persist()
        met = rows.join(all_, ["conversation_id", "target"])
        votes = met.select("conversation_id", "chunk_id", "line_no", "target", "thumb", F.array_contains("cited_chunk_ids", F.col("chunk_id")).alias("cites")).persist()
        states.write(folded(votes, states.read(number, states.touched(votes))), number)
        cited.write(all_, number)
        for df in (rows, all_, votes):
            df.unpersist()

    return events.writeStream.foreachBatch(merge)


def stream_counts(events: DataFrame, *, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Votes per kind, thumb and window of event time; late events are counted within the watermark."""
    timed = events.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "feedback_type", "thumb").agg(F.count("*").alias("n"))


def stream_latest(events: DataFrame, table: str):
    """A foreachBatch sink that keeps each target's last event in ``table``; ``latest_events`` reads it."""

    def merge(batch: DataFrame, number: int) -> None:
        kept = _latest(batch.sparkSession, table)
        rows = batch.persist()
        if not rows.isEmpty():
            kept.write(latest(union(kept.read(number, kept.touched(rows)), rows), "conversation_id", "target"), number)
        rows.unpersist()

    return events.writeStream.foreachBatch(merge)


def _latest(spark: SparkSession, table: str) -> Buckets:
    return Buckets(spark, table, EVENT, ("conversation_id", "target"))


def latest_events(spark: SparkSession, table: str) -> DataFrame:
    """Each target's last event as the stream has left it."""
    return _latest(spark, table).read()
