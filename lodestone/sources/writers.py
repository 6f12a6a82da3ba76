"""Writers of documents, caches, manifests, logs and run artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(doc_type: Column, url: Column) -> Column:
    """A stable name: the type and ten digits of the URL's hash."""
    return F.concat(doc_type, F.lit("_"), F.substring(F.sha1(url), 1, 10), F.lit(".txt"))


def file_payload(documents: DataFrame) -> Column:
    """A document with its header."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    dated = F.when(F.col("date_modified").isNotNull(), line("DATE_MODIFIED", "date_modified"))
    head = F.concat_ws("\n", line("TITLE", "title"), line("SOURCE_URL", "url"), line("CANONICAL_URL", "canonical_url"), line("DOC_TYPE", "doc_type"), line("AUTHORITY_RANK", "authority_rank"), dated)
    return F.concat(head, F.lit("\n---\n"), F.col("text"), F.lit("\n"))


def write_documents(documents: DataFrame, path: str) -> None:
    """New and changed documents, partitioned by type."""
    rows = documents.where("status != 'unchanged'") if "status" in documents.columns else documents
    rows.withColumns({"file_name": file_name(F.col("doc_type"), F.col("canonical_url")), "payload": file_payload(rows)}).write.mode("append").partitionBy("doc_type").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object with all documents, in the manifest's order."""
    rows = manifest.select(F.struct("authority_rank", "canonical_url", F.struct(*manifest.columns).alias("d")).alias("x"))
    rows.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]).alias("documents")).coalesce(1).write.mode("overwrite").json(path)


def append_feedback(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_run(summary: DataFrame, path: str) -> None:
    """A run artifact as one JSON row."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def cache_key(model: str, metadata: bool, chunk_id: Column, text: Column) -> Column:
    """The hash under which a chunk's vector is kept."""
    return F.sha1(F.concat_ws("\n", F.lit(model), F.lit(str(metadata)), chunk_id.cast("string"), text))


def cache_missing(chunks: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Chunks whose key has no vector yet, one of each key."""
    return chunks.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def append_cache(vectors: DataFrame, path: str) -> None:
    vectors.select("key", "embedding").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The kept vectors; none if the table is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("key string, embedding array<float>").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "key string, embedding array<float>")


def conversation_title(text: Column) -> Column:
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)


def without_conversation(conversations: DataFrame, messages: DataFrame, conversation_id: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without a conversation and its messages."""
    return conversations.where(F.col("id") != conversation_id), messages.where(F.col("conversation_id") != conversation_id)


def report(rows: DataFrame, most: int = 200) -> str:
    """A comparison (metric, base, trial, delta, tone) as a plain HTML table; ``most`` bounds the rows of the page."""
    from html import escape

    cells = lambda r: "".join(f"<td>{escape(str(v))}</td>" for v in r)
    body = "".join(f"<tr>{cells(r)}</tr>" for r in rows.orderBy("metric").limit(most).collect())
    return f"<table><tr>{''.join(f'<th>{c}</th>' for c in rows.columns)}</tr>{body}</table>"
