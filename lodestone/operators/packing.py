"""Packing retrieved documents into a token budget, and the citations drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import token_count, truncated
from lodestone.settings import Settings

DEFAULTS = Settings()
#: A document cut short is kept only if so many tokens are left for it.
LEAST_PARTIAL = 80


def budget(fixed: Column | int = 0, settings: Settings = DEFAULTS) -> Column:
    """Tokens for documents: what the input limit leaves after the reserve and the fixed texts."""
    used = F.lit(fixed) if isinstance(fixed, int) else fixed
    return F.greatest(F.lit(256), F.lit(settings.max_input_tokens - settings.reserved_tokens) - used)


def packed(retrieved: DataFrame, available: Column, *, by: str = "query_id", text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of ``retrieved`` (by, rank, text) that fit, with packed_text, n_tokens, partial and trimmed.

    A running sum of trimmed sizes decides: rows before the first overflow stay whole, that one stays in part if
    enough room is left, later ones go.
    """
    most = settings.max_doc_tokens
    if settings.max_packed_docs > 0:  # no later row can stay, so the others are cut before their texts are shuffled
        first = retrieved.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy("rank")))
        retrieved = first.where(F.col("_i") <= settings.max_packed_docs).drop("_i")
    rows = retrieved.withColumn("_fit", F.when(token_count(text) > most, truncated(text, most)).otherwise(F.col(text)))
    rows = rows.withColumn("_t", token_count("_fit")).withColumn("_budget", available)
    order = W.partitionBy(by).orderBy("rank")
    rows = rows.withColumn("_c", F.sum("_t").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    before = F.col("_c") - F.col("_t")
    room = F.col("_budget") - before
    visited = rows.where(before <= F.col("_budget"))
    whole = F.col("_c") <= F.col("_budget")
    kept = visited.withColumns({"partial": ~whole, "packed_text": F.when(whole, F.col("_fit")).otherwise(truncated("_fit", room)), "trimmed": F.col("_fit") != F.col(text)})
    kept = kept.where(whole | (room >= LEAST_PARTIAL)).withColumn("n_tokens", F.when(F.col("partial"), room).otherwise(F.col("_t")).cast("long"))
    return kept.drop("_fit", "_t", "_c", "_budget")


def packing_stats(packed_rows: DataFrame, by: str = "query_id") -> DataFrame:
    """Documents, tokens and cuts per query."""
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return packed_rows.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (one("trimmed") + one("partial")).alias("truncated_docs"))


def short_doc_id(chunk_id: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha1(chunk_id.cast("string")), 1, 16))


def top_citations(packed_rows: DataFrame, *, by: str = "query_id", link: str = "source_url", most: int = DEFAULTS.top_citations) -> DataFrame:
    """The first ``most`` distinct links per query in packed order, each at its first rank."""
    linked = packed_rows.where(F.col(link).isNotNull() & ~F.col(link).isin("", "Unknown URL"))
    first = linked.withColumn("_first", F.row_number().over(W.partitionBy(by, link).orderBy("rank"))).where("_first = 1").drop("_first")
    return first.withColumn("citation", F.row_number().over(W.partitionBy(by).orderBy("rank"))).where(F.col("citation") <= most)


def history_tail(messages: DataFrame, most: int, *, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``most`` messages of each conversation; all if ``most`` is 0."""
    if most <= 0:
        return messages
    return messages.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(turn)))).where(F.col("_n") <= most).drop("_n")


def history_text(messages: DataFrame, *, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, history): ``ROLE: text`` lines in order, blanks dropped, ``(none)`` without any."""
    line = F.concat_ws(": ", F.upper("role"), F.trim("text"))
    kept = F.when((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.trim(F.coalesce("role", F.lit(""))) != ""), F.struct(turn, line.alias("line")))
    rows = messages.groupBy(by).agg(F.array_sort(F.collect_list(kept)).alias("rows"))
    joined = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return rows.select(by, F.when(F.size("rows") == 0, "(none)").otherwise(joined).alias("history"))


def with_previous(messages: DataFrame, *, by: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Add ``previous``, the text before each message of a conversation."""
    return messages.withColumn("previous", F.lag("text").over(W.partitionBy(by).orderBy(turn)))


def serialised(retrieved: DataFrame, text: str = "text", most: int = 320) -> DataFrame:
    """Retrieved rows as a run artifact keeps them: rounded scores and one-line snippets."""
    snippet = F.substring(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), 1, most)
    return retrieved.withColumns({"score": F.round("score", 6), "snippet": snippet}).drop(text)
