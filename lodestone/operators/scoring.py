"""Hybrid retrieval scores: dense, lexical, routing modes, rerank and feedback blends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.functions.text import contains_any, content_tokens, distinct_ignoring_case, dot, normalized, strip
from lodestone.operators import grid
from lodestone.operators.hybrid import TokenSets
from lodestone.settings import Settings
from lodestone.sources.shared import checkpoint

DEFAULTS = Settings()


def small(queries: DataFrame, limit: int = grid.MAX_BROADCAST_BYTES) -> DataFrame:
    """``queries`` marked for broadcast if the sizes of its rows allow it."""
    total = queries.agg(F.sum(grid.sizes(queries))).first()[0] or 0
    return F.broadcast(queries) if total <= limit else queries


def merged_queries(question: Column, expansions: Column) -> Column:
    """The question, then its expansions without blanks and repeats."""
    merged = distinct_ignoring_case(F.concat(F.array(question), F.coalesce(expansions, F.array().cast("array<string>"))))
    return F.when(F.size(merged) > 0, merged).otherwise(F.array(question))


def dense_scores(chunks: DataFrame, queries: DataFrame, chunk_key: str = "chunk_id", vector: str = "embedding", *, carry: Sequence[str] = (), asked: Sequence[str] = ()) -> DataFrame:
    """(query_id, chunk, dense): the best cosine over a query's variants, moved to 0..1, with the columns ``carry`` of chunks and ``asked`` of queries.

    ``queries`` has query_id and vectors, an array of variants, so the best variant is found
    within a row and nothing is shuffled. All pairs of a query set and the chunks are the operator's result.
    """
    rows = queries.select("query_id", "vectors", *asked)
    best = F.array_max(F.transform("vectors", lambda v: dot(v, vector)))
    return chunks.join(small(rows)).select("query_id", chunk_key, ((best + 1) / 2).alias("dense"), *carry, *asked)


class _Nearest:
    """The k best chunks of each query by rounded score, then smaller key, of all batches so far."""

    def __init__(self, table: pa.Table, k: int, digits: int, names: Sequence[str]) -> None:
        self.k, self.digits, self.names = k, digits, ["query_id", *names, "score"]
        self.ids = table.column("query_id").combine_chunks()
        variants = table.column("vectors").combine_chunks()
        starts = variants.offsets.to_numpy() - variants.offsets[0].as_py()
        self.starts = starts[:-1]
        self.vectors = variants.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(starts[-1]), -1)
        self.held: list[pa.Table] = []
        self.at_once = grid.at_once(len(self.vectors))

    def add(self, chunks: pa.Table) -> None:
        key, vector = chunks.column_names[:2]
        own = chunks.sort_by(key).combine_chunks()
        vectors = own.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1).astype(float)
        scores = np.round((np.maximum.reduceat(self.vectors @ vectors.T, self.starts, axis=0) + 1) / 2, self.digits)
        n = min(self.k, own.num_rows)
        at = np.argsort(-scores, axis=1, kind="stable")[:, :n]  # rows are in key order, so ties go to smaller keys
        keys = own.column(key).combine_chunks().take(pa.array(at.ravel()))
        query = pa.array(np.repeat(np.arange(len(at)), n))
        self.held.append(pa.table([query, keys, pa.array(np.take_along_axis(scores, at, 1).ravel())], names=self.names))
        if sum(t.num_rows for t in self.held) > 8 * self.k * len(at):
            self.held = [self._best()]

    def _best(self) -> pa.Table:
        query, key, score = self.names
        rows = pa.concat_tables(self.held).sort_by([(query, "ascending"), (score, "descending"), (key, "ascending")])
        of = rows.column(query).to_numpy()
        begins = np.searchsorted(of, of)
        return rows.filter(pa.array(np.arange(len(of)) - begins < self.k))

    def rows(self) -> pa.Table:
        if not self.held:
            return pa.schema([]).empty_table()
        best = self._best()
        return best.set_column(0, "query_id", self.ids.take(best.column(0).combine_chunks()))


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int, *, chunk_key: str = "chunk_id", vector: str = "embedding", digits: int = 9, limit: int = grid.MAX_BROADCAST_BYTES, tile: int = grid.TILE_BYTES) -> DataFrame:
    """(query_id, chunk, score): at least the ``k`` best chunks of each query, by rounded score and then smaller key.

    A batch of chunks meets the vectors of all queries, or of a tile of them, in one product, and a task, or a cell of the grid, sends its own
    k best per query only, so what is shuffled is k rows per query and task instead of all pairs.
    """
    asked = queries.select("query_id", "vectors").where(F.size("vectors") > 0)
    wide = asked.agg(F.max(F.size(F.get("vectors", F.lit(0))))).first()[0] or 0
    wanted = chunks.where(F.size(vector) == wide).select(chunk_key, vector)
    kinds = {f.name: f.dataType.simpleString() for f in (*wanted.schema.fields, *asked.schema.fields)}
    schema = f"query_id {kinds['query_id']}, `{chunk_key}` {kinds[chunk_key]}, score double"
    if not wide:
        return chunks.sparkSession.createDataFrame([], schema)
    return grid.reduced(wanted, asked, lambda table: _Nearest(table, k, digits, [chunk_key]), schema, limit=limit, tile=tile)


def vocabulary(*texts: Column) -> Column:
    """The distinct content tokens of a chunk's texts."""
    return F.array_distinct(content_tokens(F.concat_ws("\n", *texts)))


def lexical_scores(chunks: DataFrame, queries: DataFrame, chunk_key: str = "chunk_id", *, limit: int = grid.MAX_BROADCAST_BYTES, tile: int = grid.PAIR_TILE_BYTES) -> DataFrame:
    """(query_id, chunk, overlap): the share of a query's distinct tokens in a chunk's vocabulary, which has no repeats.

    Pairs without a common token are left out; they have an overlap of 0. Words of a batch of chunks are looked up among those of all queries, or
    of a tile of them, and counted where the chunks lie, so a word that is everywhere makes no large group. ``chunks`` has vocab, ``queries`` has query_id and tokens.
    """

    class Shared:
        streams = True

        def __init__(self, table: pa.Table) -> None:
            self.ids, self.sets = table.column("query_id").combine_chunks(), TokenSets(table.column("tokens").to_pylist())
            self.parts: list[pa.Table] = []
            self.at_once = grid.at_once(len(self.ids))

        def add(self, table: pa.Table) -> None:
            shares = self.sets.shares(table.column("vocab").combine_chunks())
            query, chunk = np.nonzero(shares)
            keys = table.column(0).combine_chunks()
            self.parts.append(pa.table([self.ids.take(pa.array(query)), keys.take(pa.array(chunk)), pa.array(shares[query, chunk])], names=["query_id", chunk_key, "overlap"]))

        def rows(self) -> pa.Table:
            out, self.parts = self.parts, []
            return pa.concat_tables(out) if out else pa.schema([]).empty_table()

    kinds = {f.name: f.dataType.simpleString() for f in (*chunks.schema.fields, *queries.schema.fields)}
    asked = checkpoint(queries.select("query_id", "tokens"))  # read twice, to be summed and to be sent
    return grid.reduced(chunks.select(chunk_key, "vocab"), asked, Shared, f"query_id {kinds['query_id']}, `{chunk_key}` {kinds[chunk_key]}, overlap double", limit=limit, tile=tile)


def modes_of(text: Column, phrases: Mapping[str, Sequence[str]] = V.MODE_PHRASES) -> Column:
    """The sorted modes that a text's phrases hint at."""
    plain = normalized(text)
    found = [F.when(contains_any(plain, phrases[mode]), F.lit(mode)) for mode in sorted(phrases)]
    return F.array_compact(F.array(*found))


def hybrid(dense: Column, lexical: Column, alpha: float = DEFAULTS.retrieval_alpha) -> Column:
    weight = min(1.0, max(0.0, alpha))
    return weight * dense + (1 - weight) * lexical


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def mode_adjustment(query_modes: Column, chunk_modes: Column, settings: Settings = DEFAULTS, strict: str = "acan") -> Column:
    """What routing adds to a score; ``strict`` is the mode whose chunks are unwelcome unless asked for."""
    broad = F.when(F.size(query_modes) >= 2, 0.4).otherwise(1.0)
    return (
        F.when(F.size(query_modes) == 0, 0.0)
        .when(F.arrays_overlap(query_modes, chunk_modes), settings.mode_match_bonus)
        .when(F.array_contains(chunk_modes, strict), -settings.acan_mismatch_penalty)
        .when(F.size(chunk_modes) > 0, -settings.mode_mismatch_penalty * broad)
        .otherwise(0.0)
    )


def ranked(scores: DataFrame, score: str, *ties: str, by: str = "query_id", limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 by falling score within ``by``; with ``limit`` only the first ones, cut before the shuffle."""
    order = W.partitionBy(by).orderBy(F.desc(score), *ties)
    out = scores.withColumn(name, F.row_number().over(order))
    return out.where(F.col(name) <= limit) if limit else out


def rerank_blend(scores: DataFrame, *, alpha: float = DEFAULTS.rerank_alpha, by: str = "query_id") -> DataFrame:
    """Blend ``score`` with ``rerank`` (null where a row was no candidate), min-max normalised within ``by``."""
    w = W.partitionBy(by)
    low, high = F.min("rerank").over(w), F.max("rerank").over(w)
    scaled = (F.col("rerank") - low) / (high - low + 1e-12)
    weight = min(1.0, max(0.0, alpha))
    mixed = clipped(weight * scaled + (1 - weight) * F.col("score"))
    return scores.withColumn("score", F.when(F.col("rerank").isNull(), F.col("score")).otherwise(mixed))


def reweighted(retrieved: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """``retrieved`` (query_id, rank, score, keys) with feedback weights applied and ranked anew, ties by old rank."""
    met = retrieved.join(weights.select(*keys, "weight"), list(keys), "left")
    scored = met.withColumn("score", F.col("score") * F.coalesce("weight", F.lit(1.0))).drop("weight").withColumnRenamed("rank", "old_rank")
    return ranked(scored, "score", "old_rank")


def subqueries(question: Column, most: int = DEFAULTS.max_subqueries) -> Column:
    """Clauses of a question that stand after ``and`` and a question word, 20 characters or more; none if there is one only."""
    cut = r"\band\s+(?=(?:" + "|".join(V.QUESTION_WORDS) + r")\b)"
    parts = F.filter(F.transform(F.split(normalized(question), cut), strip), lambda p: F.length(p) >= 20)
    once = F.array_distinct(parts)
    return F.when(F.size(once) > 1, F.slice(once, 1, max(1, most))).otherwise(F.array().cast("array<string>"))


def expansion_queries(question: Column, clauses: Column, modes: Column, most: int = DEFAULTS.max_expansion_queries, terms: Sequence[str] = V.COMPLIANCE_TERMS) -> Column:
    """Queries synthesised from a question's terms, its first long clause and its modes."""
    text = normalized(question)
    compliance, reciprocal = contains_any(text, terms), text.contains(V.RECIPROCAL_TERM)
    long = F.get(F.filter(F.transform(clauses, lambda c: content_tokens(c)), lambda t: F.size(t) >= 4), F.lit(0))
    fixed = F.array(
        F.when(compliance | contains_any(text, V.PRE_AWARD_TERMS), V.COMPLIANCE_QUERY),
        F.when(reciprocal | contains_any(text, V.PARTNER_TERMS), V.RECIPROCAL_QUERY),
        F.when(reciprocal & compliance, V.RECIPROCAL_EXCEPTION_QUERY),
        F.when(text.contains("exception") & compliance, V.EXCEPTION_QUERY),
        F.array_join(F.slice(long, 1, 12), " "),
        *[F.when(F.array_contains(modes, mode), V.MODE_QUERIES[mode]) for mode in sorted(V.MODE_QUERIES)],
    )
    return F.slice(F.array_distinct(F.array_compact(fixed)), 1, max(0, most))
