"""Conversations as an append-only log: starts, messages, languages and deletions are rows, tables are read from it.

A chat's turn is one appended row or two, a deletion a row of its own, so writers never rewrite what others have written and two of them
cannot lose each other's rows. What stands now is a fold over the log: a deleted conversation takes its messages with it, whenever they were written,
and of a user's languages the last one counts. Ids follow from a row's content, so a task run again makes the same ones.

Defined cases: a turn without a user is not kept; a turn with a conversation goes there, one without starts a new one; of rows of equal
id one counts; rows of equal time are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.writers import conversation_title

LOG = "kind string, id string, user_id string, conversation_id string, role string, text string, language string, citations array<struct<title:string,link:string,chunk_id:string>>, created_at double"
START, MESSAGE, LANGUAGE, DELETE = "start", "message", "language", "delete"


def _id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def _logged(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    none = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in LOG.replace(", ", "\n").split("\n")}
    return rows.select(*[(F.lit(kind) if c == "kind" else columns.get(c, F.lit(None))).cast(t).alias(c) for c, t in none.items()])


def asked(turns: DataFrame) -> DataFrame:
    """Log rows of turns (user_id, conversation_id, text, language, created_at): the user's message, and the start of a conversation where there is none."""
    rows = turns.where(F.col("user_id").isNotNull())
    new = F.col("conversation_id").isNull()
    rows = rows.withColumn("_c", F.when(new, _id(F.lit(START), F.col("user_id"), F.col("text"), F.col("created_at"))).otherwise(F.col("conversation_id").cast("string")))
    starts = _logged(rows.where(new), START, id=F.col("_c"), user_id=F.col("user_id"), conversation_id=F.col("_c"), text=conversation_title(F.col("text")), created_at=F.col("created_at"))
    return starts.unionByName(messages_logged(rows.withColumn("conversation_id", F.col("_c")).withColumn("role", F.lit("user"))))


def messages_logged(rows: DataFrame) -> DataFrame:
    """Log rows of messages (conversation_id, role, text, language, created_at, and citations if there are any)."""
    cited = F.col("citations") if "citations" in rows.columns else F.lit(None)
    own = _id(F.lit(MESSAGE), F.col("conversation_id"), F.col("role"), F.col("text"), F.col("created_at"))
    return _logged(rows, MESSAGE, id=own, conversation_id=F.col("conversation_id"), role=F.col("role"), text=F.col("text"), language=F.coalesce("language", F.lit("en")), citations=cited, created_at=F.col("created_at"))


def deleted(rows: DataFrame) -> DataFrame:
    """Log rows that delete conversations (conversation_id, created_at)."""
    return _logged(rows, DELETE, id=_id(F.lit(DELETE), F.col("conversation_id")), conversation_id=F.col("conversation_id"), created_at=F.col("created_at"))


def languages_logged(rows: DataFrame) -> DataFrame:
    """Log rows that set users' languages (user_id, language, created_at)."""
    return _logged(rows, LANGUAGE, id=_id(F.lit(LANGUAGE), F.col("user_id"), F.col("language"), F.col("created_at")), user_id=F.col("user_id"), language=F.coalesce("language", F.lit("en")), created_at=F.col("created_at"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def _standing(log_: DataFrame, kind: str) -> DataFrame:
    """The rows of a kind, once each, whose conversation is not deleted."""
    gone = log_.where(F.col("kind") == DELETE).select("conversation_id").distinct()
    return log_.where(F.col("kind") == kind).dropDuplicates(["id"]).join(gone, "conversation_id", "left_anti")


def conversations(log_: DataFrame) -> DataFrame:
    """(id, user_id, title, created_at) of the conversations that stand."""
    return _standing(log_, START).select("id", "user_id", F.col("text").alias("title"), "created_at")


def messages(log_: DataFrame) -> DataFrame:
    """(id, conversation_id, role, text, language, citations, created_at, place): messages of conversations that stand, in order from 1."""
    held = _standing(log_, MESSAGE).join(_standing(log_, START).select("conversation_id"), "conversation_id", "left_semi")
    place = F.row_number().over(W.partitionBy("conversation_id").orderBy("created_at", "id"))
    return held.select("id", "conversation_id", "role", "text", "language", "citations", "created_at", place.alias("place"))


def languages(log_: DataFrame) -> DataFrame:
    """(user_id, language): the last that each user has set."""
    last = F.max_by("language", F.struct("created_at", "id"))
    return log_.where(F.col("kind") == LANGUAGE).groupBy("user_id").agg(last.alias("language"))
