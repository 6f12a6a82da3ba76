"""Exact inner-product top-k search by a pivot-distance index.

Vectors are lifted by one coordinate to equal norm, so that the greatest inner product is the least
distance. Each vector is keyed by its nearest pivot and the distance to it; sorted by that key, vectors are cut
into blocks, each an annulus around a pivot. A query block first searches the annuli around its own
distance, which bounds the k-th score from below. By the triangle inequality a vector at distance r from a pivot p is no
nearer to the query than |d(q, p) - r|. Each block keeps its least and greatest distance from every pivot, and only blocks that can still hold a vector
within the bound by all of them are searched, all of those. ``blocks_read`` tells how many that are.

The number of pivots follows the square root of the number of vectors between two bounds. They are fitted on a bounded sample (``SAMPLE`` vectors by hash of the id); every vector is indexed.
A query's own id takes no place: it is left out at the end, so all earlier cuts keep at most k rows of one id and, of those,
the first 2k, of which k are of other ids, or where that is less the rows of k + 1 ids. Equal vectors share their scores, so such a cut of
each distinct vector's ids is indexed; equal queries are searched once. Scores are integers and exact: distances, in floating point, only
decide which annuli are read, with a margin above their rounding error.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate; shorter
vectors count as padded with zeros; null ids take no part; repeated ids are one candidate each; queries
without candidates give no rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, table, written

K, SCALE = 5, 256
#: Vectors that the pivots are fitted on at most, fewest and most pivots, vectors in a block, queries in a block.
SAMPLE, PIVOTS, BLOCK, QUERIES = 4_096, (16, 128), 512, 128
#: Results that a task of the search holds before it keeps the best of each query alone.
HELD = 200_000


def quantised(vectors: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vectors, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vectors: Column) -> Column:
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.isNotNull() & ~F.coalesce(bad, F.lit(False))


class Pivots:
    """Pivots in the lifted space and the common norm to which vectors are lifted."""

    def __init__(self, points: np.ndarray, square: float) -> None:
        self.points, self.square = points, square

    @staticmethod
    def fit(sample: np.ndarray, square: float, count: int, rounds: int = 4) -> Pivots:
        lifted = _lifted(sample.astype(float), square)
        points = lifted[np.linspace(0, len(lifted) - 1, min(count, len(lifted))).astype(int)]
        for _ in range(rounds):
            near = _distances(lifted, points).argmin(1)
            points = np.stack([lifted[near == i].mean(0) if (near == i).any() else points[i] for i in range(len(points))])
        return Pivots(points, square)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Distances from lifted vectors to all pivots."""
        return _distances(_lifted(vectors.astype(float), self.square), self.points)

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each vector and the distance to it."""
        far = self.distances(vectors)
        near = far.argmin(1)
        return near, far[np.arange(len(far)), near]

    def query_distances(self, vectors: np.ndarray) -> np.ndarray:
        """Distances from queries, whose lifted coordinate is 0, to all pivots."""
        flat = vectors.astype(float)
        return _distances(np.column_stack([flat, np.zeros(len(flat))]), self.points)


def _lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(0, square - (vectors**2).sum(1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every sum stays below 2^53."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of longs, padded with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    if len(column):
        out[np.arange(dims)[None] < sizes[:, None]] = flat
    return out


def _unpacked(raw: bytes, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, dims).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best, by score and then smaller id; ids ascend."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.size and int(np.abs(scores).max()) < (1 << 62) // n:
        ranked = scores * n - np.arange(n)  # one number holds score and place, so no two are equal
        some = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(ranked, some, 1), axis=1), 1)
    return np.stack([np.lexsort((ids, -row))[:k] for row in scores])


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions of each row's best of which k have another id than any one: k + 1, or with repeated ids 2k, k of an id at most."""
    if (ids[1:] != ids[:-1]).all():
        best = _best(scores, ids, k + 1)
        return np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
    out = []
    for row in scores:
        order = np.lexsort((np.arange(len(ids)), -row, ids))
        start = np.r_[True, ids[order][1:] != ids[order][:-1]]
        some = order[np.arange(len(ids)) - np.flatnonzero(start)[np.cumsum(start) - 1] < k]
        out.append(some[np.lexsort((ids[some], -row[some]))[: 2 * k]])
    return np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate(out)


@dataclass
class _Search:
    """All rows, the distinct query vectors, the blocks of queries and of the index, pairs of blocks to search, and the search."""

    rows: DataFrame
    asked: DataFrame
    queries: DataFrame
    index: DataFrame
    pairs: DataFrame
    best: Callable[[DataFrame], DataFrame]


def _search(df: DataFrame, key: str, vector: str, is_query: Column, k: int, scale: int, pivots: int | tuple[int, int], block: int, queries: int) -> _Search | None:
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    facts = rows.agg(F.max(squares).alias("square"), F.max(F.size("v")).alias("dims"), F.max(most).alias("most"), F.count("*").alias("n")).first()
    if not facts.dims:
        return None
    dims = facts.dims
    kind = "<i2" if facts.most < 1 << 15 else "<i4" if facts.most < 1 << 31 else "<i8"
    count = pivots if isinstance(pivots, int) else max(pivots[0], min(pivots[1], int(facts.n**0.5 / 2)))
    # equal vectors are indexed with their smallest ids; equal queries are one with all query ids kept beside
    few = rows.select("id", "v", F.row_number().over(W.partitionBy("v", "id").orderBy("id")).alias("t")).where(F.col("t") <= k)
    same = few.select("id", "v", F.row_number().over(W.partitionBy("v").orderBy("id")).alias("n"), F.dense_rank().over(W.partitionBy("v").orderBy("id")).alias("d"))
    index_rows = checkpoint(same.where((F.col("n") <= 2 * k) & (F.col("d") <= k + 1)).select("id", "v"))
    sample = index_rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    fit = Pivots.fit(_matrix(sample, dims), facts.square, count)
    sent = spark.sparkContext.broadcast(fit)
    asked = rows.where("q").groupBy("v").agg(F.min("id").alias("id"))

    def keyed(batches):
        for batch in batches:
            near, far = sent.value.keys(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(far)], names=["id", "v", "pivot", "r"])

    def blocks(size: int):
        def run(batches):
            held: list[pa.RecordBatch] = []

            def cut(some: pa.Table, pivot: int) -> pa.RecordBatch:
                ids, r = some.column("id").to_numpy(), some.column("r").to_numpy()
                rows_ = _matrix(some.column("v").combine_chunks(), dims)
                order = np.argsort(ids, kind="stable")
                name = f"{pivot}:{r[0].hex()}:{int(ids[0])}"
                far = sent.value.distances(rows_)
                columns = [pa.array([name]), pa.array([pivot], pa.int32()), pa.array([float(r.min())]), pa.array([float(r.max())]), pa.array([far.min(0).tolist()]), pa.array([far.max(0).tolist()])]
                columns += [pa.array([ids[order].tobytes()], pa.binary()), pa.array([rows_[order].astype(kind).tobytes()], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["block", "pivot", "low", "high", "lows", "highs", "ids", "vectors"])

            def drain(last: bool):
                rows_ = pa.Table.from_batches(held)
                held.clear()
                at, of = 0, rows_.column("pivot").to_numpy()
                while at < len(of):
                    end = min(at + size, int(np.searchsorted(of, of[at], "right")))
                    if end == len(of) and not last and end - at < size:
                        held.extend(rows_.slice(at).to_batches())
                        return
                    yield cut(rows_.slice(at, end - at), int(of[at]))
                    at = end

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= 8 * size:
                    yield from drain(False)
            if held:
                yield from drain(True)

        return run

    keyed_schema, block_schema = "id long, v array<long>, pivot int, r double", "block string, pivot int, low double, high double, lows array<double>, highs array<double>, ids binary, vectors binary"

    def cut(some: DataFrame, size: int, name: str) -> DataFrame:
        ordered = some.mapInArrow(keyed, keyed_schema).repartitionByRange("pivot", "r", "id").sortWithinPartitions("pivot", "r", "id")
        return written(ordered.mapInArrow(blocks(size), block_schema), name)

    index, query_blocks = cut(index_rows, block, "index"), cut(asked.select("id", "v"), queries, "queries")

    def bounded(batches):  # distances from all pivots that vectors for a query block must have, from the k-th scores so far
        for batch in batches:
            out = []
            for name, raw, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                vectors = _unpacked(raw, dims, kind)
                far = sent.value.query_distances(vectors)
                bound = np.array([np.inf] * len(vectors)) if low is None else np.sqrt(np.maximum(0, (vectors.astype(float) ** 2).sum(1) + sent.value.square - 2 * np.frombuffer(low, "<i8").astype(float)))
                slack = 1e-6 * (1 + far.max() + sent.value.square**0.5)
                lows, highs = (far - bound[:, None]).min(0) - slack, (far + bound[:, None]).max(0) + slack
                out.append((name, lows.tolist(), highs.tolist()))
            kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind_) for i, kind_ in enumerate(kinds)], names=["qblock", "froms", "tos"])

    def searched(batches):  # the best of each query within the blocks that a task meets
        names: dict[str, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def merged() -> np.ndarray:
            rows_ = np.concatenate(held, axis=1)
            return rows_[:, _kept(rows_, k)]

        for batch in batches:
            for name, qids, qraw, ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                scores = _products(_unpacked(qraw, dims, kind), _unpacked(raw, dims, kind))
                ids_, queries_ = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                of, best = _first(scores, ids_, k)
                held.append(np.stack([np.full(len(best), names.setdefault(name, len(names))), queries_[of], ids_[best], scores[of, best]]))
                size += len(best)
                if size >= HELD:
                    held[:] = [merged()]
                    size = held[0].shape[1]
                    if size >= HELD // 2:
                        yield found_batch(held[0], list(names))
                        held.clear()
                        size = 0
        if held:
            yield found_batch(merged(), list(names))

    def found_batch(rows_: np.ndarray, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(rows_[0])), *(pa.array(c) for c in rows_[1:])], names=["qblock", "qid", "id", "score"])

    marks = index.select("block", "pivot", "low", "high", "lows", "highs")
    q = query_blocks.select(F.col("block").alias("qblock"), F.col("pivot").alias("qpivot"), ((F.col("low") + F.col("high")) / 2).alias("at"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))

    def search(pairs: DataFrame) -> DataFrame:
        # a block of the index is moved once; what meets it is a block of queries for each pair
        met = pairs.join(q.select("qblock", "qids", "qvectors"), "qblock").join(index.select("block", "ids", "vectors"), "block")
        found = met.select("qblock", "qids", "qvectors", "ids", "vectors").mapInArrow(searched, "qblock string, qid long, id long, score long")
        few = found.select("*", F.row_number().over(W.partitionBy("qid", "id").orderBy(F.desc("score"))).alias("t")).where(F.col("t") <= k)
        best = few.select("*", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")).alias("n"))
        return best.where(F.col("n") <= 2 * k)

    gap = F.greatest(F.col("low") - F.col("at"), F.col("at") - F.col("high"), F.lit(0.0))
    home = q.join(marks, F.col("qpivot") == F.col("pivot")).select("qblock", "block", F.row_number().over(W.partitionBy("qblock").orderBy(gap, "block")).alias("n")).where("n <= 2").select("qblock", "block")
    # k rows of other ids than any one score at least as much as the best of the (k + 1)th id, and as the 2k-th row
    near = search(home).select("*", F.count_if(F.col("t") == 1).over(W.partitionBy("qid").orderBy("n")).alias("d"))
    first = near.where(((F.col("t") == 1) & (F.col("d") == k + 1)) | (F.col("n") == 2 * k)).groupBy("qblock", "qid").agg(F.max("score").alias("score"))
    lows = first.groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct("qid", "score"))).alias("m"))

    def lowest(batches):  # scores in the order of a block's queries; null unless all have a bound
        for batch in batches:
            out = []
            for qids, held in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                scores = dict(held or ())
                order = np.frombuffer(qids, "<i8").tolist()
                out.append(np.array([scores[i] for i in order], "<i8").tobytes() if all(i in scores for i in order) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["qblock", "vectors", "low"])

    known = q.join(lows, "qblock", "left").select("qblock", "qvectors", "qids", "m").mapInArrow(lowest, "qblock string, vectors binary, low binary")
    ranges = known.mapInArrow(bounded, "qblock string, froms array<double>, tos array<double>")
    own = ranges.select("qblock", "froms", "tos", F.posexplode(F.arrays_zip("froms", "tos")).alias("pivot", "at"))
    met = own.join(marks, "pivot").where("low <= at.tos and high >= at.froms")
    reached = F.forall(F.zip_with("lows", "tos", lambda a, b: a <= b), lambda x: x) & F.forall(F.zip_with("highs", "froms", lambda a, b: a >= b), lambda x: x)
    return _Search(rows, asked, query_blocks, index, met.where(reached).select("qblock", "block"), search)


def blocks_read(df: DataFrame, key: str, vector: str, is_query: Column, *, k: int = K, scale: int = SCALE, pivots: int | tuple[int, int] = PIVOTS, block: int = BLOCK, queries: int = QUERIES) -> tuple[int, int]:
    """How many pairs of a query block and an index block are searched, and how many there are."""
    found = _search(df, key, vector, is_query, k, scale, pivots, block, queries)
    return (found.pairs.count(), found.queries.count() * found.index.count()) if found else (0, 0)


def _kept(rows: np.ndarray, k: int) -> np.ndarray:
    """Columns of (block, query, id, score) to keep: of each query k of an id at most, and of those the first 2k."""
    _, query_, id_, score = rows
    order = np.lexsort((-score, id_, query_))
    new = np.r_[True, (query_[order][1:] != query_[order][:-1]) | (id_[order][1:] != id_[order][:-1])]
    order = order[np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]
    order = order[np.lexsort((id_[order], -score[order], query_[order]))]
    new = np.r_[True, query_[order][1:] != query_[order][:-1]]
    return order[np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] < 2 * k]


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, *, k: int = K, scale: int = SCALE, pivots: int | tuple[int, int] = PIVOTS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best candidates of each query, itself excluded."""
    found = _search(df, key, vector, is_query, k, scale, pivots, block, queries)
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = found.best(found.pairs).select("qid", "id", "score")
    # equal queries take the results of the one searched, each without itself
    named = found.rows.where("q").select(F.col("id").alias("query_id"), "v").join(found.asked.withColumnRenamed("id", "qid"), "v").select("query_id", "qid")
    own = named.join(best, "qid").where("query_id != id")
    ranked = own.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    return ranked.where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.c, x.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def brute_force(ids: list[int], vectors: list[list[int]], queries: list[int], k: int = K) -> list[tuple[int, int, int, int]]:
    """All result rows by comparing each query with every vector; for tests."""
    out = []
    for i, q in zip(ids, vectors, strict=True):
        if i in queries:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in zip(ids, vectors, strict=True) if j != i)
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return out
