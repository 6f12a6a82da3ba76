"""Merkle manifest of a dataset: leaves, one tree per group, a tree over the groups, and a proof per row.

A partition of leaves is a sparse forest: a set of nodes keyed by tree, level and index. As the
number of leaves of every tree is known, so is the arity of every run of siblings, and a node whose
run is complete is replaced by the run's digest. Uniting two forests and completing runs is associative
and commutative, so partitions reduce their leaves where they lie and a tree of merges, ``MERGED`` forests at a
time, does the rest. As leaves lie in order, a forest keeps only the unfinished runs at its two ends on each level.

For proofs the runs above level ``HEIGHT`` are kept as a table when they complete, each is joined with the path of
its parent run (a run has at most ``FAN`` children), and the rows of a block of FAN ** HEIGHT leaves meet the
one path above it. No step gathers a tree: groups of rows are blocks, whatever the size of a tree.

Order and ties: groups ascend as UTF-8 bytes with null first, leaves of a group by key with null first, then by
leaf; equal leaves keep the order in which they were numbered, which no digest shows.
Defined cases: null columns are a dash in a leaf; a row with null key is never tampered with; empty and very long texts are
leaves like any other; repeated rows are leaves each; an empty table has no root and no rows; columns that are not listed are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import dropped, modest_batches, table, written

FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
#: Forests merged by one task of a round.
MERGED = 32
#: The number of the tree over all groups.
TOP = -1
_PENDING, _RUN, _ROOT = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = T.StructType([
    T.StructField("forest", T.LongType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("tree", T.LongType()),
    T.StructField("leaves", T.LongType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("index", T.LongType()),
    T.StructField("nodes", T.ArrayType(T.BinaryType())),
])
_ARROW = pa.schema([("forest", pa.int64()), ("kind", pa.int32()), ("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("nodes", pa.list_(pa.binary()))])


def joined(nodes: Sequence[bytes]) -> bytes:
    """Digests as hex text, one after the other."""
    return b"".join(nodes).hex().encode()


def parent(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(joined(nodes)).digest()


def width(leaves: int, level: int) -> int:
    """How many nodes a tree of ``leaves`` leaves has on a level."""
    return -(-leaves // FAN**level)


class Forest:
    """Nodes whose runs are not complete, and the runs completed from level ``HEIGHT`` on and above trees."""

    def __init__(self, trees: int) -> None:
        self.trees = trees
        self.pending: dict[tuple[int, int, int, int], dict[int, bytes]] = {}
        self.runs: list[tuple[int, int, int, int, list[bytes]]] = []
        self.root: bytes | None = None

    def add(self, tree: int, leaves: int, level: int, index: int, node: bytes) -> None:
        while True:
            of = width(leaves, level)
            if of == 1:
                if tree == TOP:
                    self.root = node
                    return
                tree, leaves, level, index = TOP, self.trees, 0, tree
                continue
            run, slot = divmod(index, FAN)
            key = tree, leaves, level, run
            held = self.pending.setdefault(key, {})
            held[slot] = node
            if len(held) < min(FAN, of - run * FAN):
                return
            del self.pending[key]
            nodes = [held[i] for i in range(len(held))]
            if tree == TOP or level >= HEIGHT:
                self.runs.append((*key, nodes))
            level, index, node = level + 1, run, parent(nodes)

    def rows(self, forest: int) -> pa.RecordBatch:
        rows = [(forest, _PENDING, *key[:3], key[3] * FAN + slot, [node]) for key, held in self.pending.items() for slot, node in held.items()]
        rows += [(forest, _RUN, *run) for run in self.runs]
        if self.root is not None:
            rows.append((forest, _ROOT, TOP, self.trees, 0, 0, [self.root]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW.types)], schema=_ARROW)


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields: a dash where null, else the number of UTF-8 bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


@dataclass
class Manifest:
    """``ranked``: a row per leaf with its place; ``runs``: completed runs of siblings; ``trees``: a row per group."""

    root: str | None
    n_trees: int
    n_leaves: int
    ranked: DataFrame
    runs: DataFrame
    trees: DataFrame


def manifest(df: DataFrame, key: str, group: str, digest: Column, probe: Column | None = None, *, merged: int = MERGED) -> Manifest:
    """The trees over ``digest`` (hex) of all rows; ``probe`` is a leaf to check against a row's proof, null: its own."""
    spark = df.sparkSession
    modest_batches(spark)
    own, seen = F.unhex(digest), F.unhex(probe) if probe is not None else F.lit(None).cast("binary")
    leaves = written(df.select(F.col(key).alias("key"), F.col(group).alias("grp"), own.alias("leaf"), seen.alias("probe"), F.monotonically_increasing_id().alias("row")), "leaves")
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")]
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = written(ordered.select("key", "grp", "leaf", "probe", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "ordered")

    # a group's rows of a partition lie together: of each such stretch the first place and the length
    stretches = ordered.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy("grp")
    placed = stretches.select(
        "part", "grp", "first", F.sum("n").over(of_group).alias("leaves"), F.min("first").over(of_group).alias("begins"),
        F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = placed.withColumn("start", F.shiftright("begins", 33))
    placed = written(placed.withColumn("nth", F.dense_rank().over(Window.partitionBy("start").orderBy("begins")) - 1), "placed")
    # one number per partition of the range shuffle, which the session's settings bound
    starts = placed.where("first = begins").groupBy("start").agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves")).orderBy("start").collect()
    n_trees, n_leaves = sum(r.n for r in starts), sum(r.leaves for r in starts)
    base = np.cumsum([0, *[r.n for r in starts]]).tolist()
    bases = spark.createDataFrame([(r.start, b) for r, b in zip(starts, base, strict=False)], "start long, base long")
    placed = placed.join(F.broadcast(bases), "start").withColumn("tree", F.col("base") + F.col("nth"))
    trees = placed.where("first = begins").select("tree", "grp", "leaves")
    spans = placed.select(F.col("part").alias("p"), F.col("grp").alias("g"), "tree", "leaves", "before", "first")
    ranked = ordered.join(spans, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    ranked = written(ranked.select("key", "leaf", "probe", "part", "tree", "leaves", (F.col("at") - F.col("first") + F.col("before")).alias("index")), "ranked")
    for read in (leaves, ordered):
        dropped(read)
    rounds = _reduced(ranked, n_trees, 1 + (placed.agg(F.max("part")).first()[0] or 0), merged)
    root = rounds.where(F.col("kind") == _ROOT).select("nodes").first()
    runs = rounds.where(F.col("kind") == _RUN).drop("forest", "kind")
    return Manifest(root.nodes[0].hex() if root else None, n_trees, n_leaves, ranked, runs, trees)


def _reduced(ranked: DataFrame, n_trees: int, forests: int, merged: int) -> DataFrame:
    """Completed runs and the root, from the forests of all partitions, merged in rounds."""

    def grown(batches):
        forest, number = Forest(n_trees), None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for part, tree, leaves, index, node in zip(*columns, strict=True):
                number = part if number is None else min(number, part)
                forest.add(tree, leaves, 0, index, node)
        if number is not None:
            yield forest.rows(number)

    def united(key: tuple, rows: pa.Table) -> pa.Table:
        forest = Forest(n_trees)
        for row in zip(*(rows.column(c).to_pylist() for c in ("tree", "leaves", "level", "index", "nodes")), strict=True):
            forest.add(*row[:4], row[4][0])
        return pa.Table.from_batches([forest.rows(key[0].as_py())])

    done = written(ranked.select("part", "tree", "leaves", "index", "leaf").mapInArrow(grown, NODES), "forests")
    out = done
    while forests > 1:
        forests = -(-forests // merged)
        pending = done.where(F.col("kind") == _PENDING).withColumn("forest", F.floor(F.col("forest") / merged))
        done = written(pending.groupBy("forest").applyInArrow(united, NODES), "forests")
        out = out.unionByName(done)
    return out


def _above(n_trees: int, level, index, leaves, tree) -> tuple[Column, ...]:
    """Tree, level, index of the run above a node, and the node's slot there; null above the root."""
    inside = leaves > F.pow(F.lit(float(FAN)), level)
    over = ~inside & (tree != TOP) & F.lit(n_trees > 1)
    pick = lambda a, b: F.when(inside, a).when(over, b)
    at = pick(index, tree)
    return pick(tree, F.lit(TOP).cast("long")), pick(level, F.lit(0)).cast("int"), F.floor(at / FAN), (at % FAN).cast("int")


def paths(made: Manifest) -> DataFrame:
    """Rows (tree, block, path): of each block of leaves the runs above it, the lowest first, with its slot in each."""
    up_tree, up_level, up_index, slot = _above(made.n_trees, F.col("level") + 1, F.col("index"), F.col("leaves"), F.col("tree"))
    runs = made.runs.select("tree", "level", "index", "nodes", up_tree.alias("up_tree"), up_level.alias("up_level"), up_index.alias("up_index"), slot.alias("slot"))
    step = F.array(F.struct(F.col("up_nodes").alias("nodes"), "slot"))
    named = {"tree": "up_tree", "level": "up_level", "index": "up_index", "nodes": "up_nodes", "path": "up_path"}
    empty = F.array().cast("array<struct<nodes:array<binary>,slot:int>>")
    reached = written(runs.where("up_tree is null").select("tree", "level", "index", "nodes", empty.alias("path")), "paths")
    every = reached
    while not reached.isEmpty():  # as many rounds as the trees have levels
        below = runs.join(reached.withColumnsRenamed(named), ["up_tree", "up_level", "up_index"])
        reached = written(below.select("tree", "level", "index", "nodes", F.concat(step, "up_path").alias("path")), "paths")
        every = every.unionByName(reached)
    blocks = made.trees.select("tree", "leaves", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("leaves") - 1) / BLOCK))).alias("block"))
    up_tree, up_level, up_index, slot = _above(made.n_trees, F.lit(HEIGHT), F.col("block"), F.col("leaves"), F.col("tree"))
    blocks = blocks.select("tree", "block", up_tree.alias("up_tree"), up_level.alias("up_level"), up_index.alias("up_index"), slot.alias("slot"))
    found = blocks.join(every.withColumnsRenamed(named), ["up_tree", "up_level", "up_index"], "left")
    return found.select("tree", "block", F.when(F.col("up_path").isNull(), empty).otherwise(F.concat(step, "up_path")).alias("path"))


def folded(node: bytes, steps: Sequence[tuple[bytes, int]]) -> str:
    """The root that ``node`` leads to through runs, given as joined digests with the node's slot in each."""
    text = node.hex().encode()
    for run, slot in steps:
        text = hashlib.sha256(run[: 64 * slot] + text + run[64 * slot + 64 :]).hexdigest().encode()
    return text.decode()


def _proved(leaves: Sequence[bytes], total: int, path: Sequence[tuple[bytes, int]]) -> tuple[bytes, list[list[tuple[bytes, int]]], list[bytes]]:
    """The top node of a block, of each leaf its runs up to the root, and of each leaf all siblings, joined."""
    levels, runs = [list(leaves)], []
    while len(runs) < HEIGHT and width(total, len(runs)) > 1:
        nodes = levels[-1]
        runs.append([joined(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        levels.append([hashlib.sha256(r).digest() for r in runs[-1]])
    others = lambda run, slot: run[: 64 * slot] + run[64 * slot + 64 :]
    siblings, steps = [b"".join(others(*step) for step in path)], [list(path)]
    for level in range(len(runs) - 1, -1, -1):
        nodes = range(len(levels[level]))
        siblings = [others(runs[level][i // FAN], i % FAN) + siblings[i // FAN] for i in nodes]
        steps = [[(runs[level][i // FAN], i % FAN), *steps[i // FAN]] for i in nodes]
    return levels[-1][0], steps, siblings


def proofs(made: Manifest, key_type: T.DataType, *, siblings: bool = False) -> DataFrame:
    """Rows (key, leaf, subroot, root, proof_sha256, folded_root), all hex; with ``siblings`` also the proof itself, joined.

    ``folded_root`` starts from the row's probe, if it has one, and goes through the siblings of its leaf.
    """
    fields = [T.StructField("key", key_type), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]]
    if siblings:
        fields.append(T.StructField("siblings", T.StringType()))
    out, root = T.StructType(fields), made.root
    units = max(1, -(-made.n_leaves // BLOCK))
    unit = lambda df: df.withColumn("unit", F.pmod(F.xxhash64("tree", "block"), F.lit(units)))

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        over = {}
        for tree, block, path in zip(*(above.column(c).to_pylist() for c in ("tree", "block", "path")), strict=True):
            over[tree, block] = [(joined(step["nodes"]), step["slot"]) for step in path]
        rows = rows.sort_by([("tree", "ascending"), ("index", "ascending")])
        tree, block, total = (rows.column(c).to_numpy() for c in ("tree", "block", "leaves"))
        leaves, probes = rows.column("leaf").to_pylist(), rows.column("probe").to_pylist()
        turns = np.flatnonzero((np.diff(tree, prepend=-2) != 0) | (np.diff(block, prepend=-1) != 0)).tolist()
        columns: list[list[str]] = [[] for _ in fields[1:]]
        for a, b in zip(turns, [*turns[1:], len(tree)], strict=True):
            n, path = int(total[a]), over[int(tree[a]), int(block[a])]
            top, steps, beside = _proved(leaves[a:b], n, path)
            within = HEIGHT
            while width(n, within) > 1:
                within += 1
            crossing = path[within - HEIGHT :]  # the steps above the group's tree
            subroot = top.hex() if n <= BLOCK else crossing[0][0][64 * crossing[0][1] :][:64].decode() if crossing else root
            for i in range(b - a):
                own, probe = leaves[a + i], probes[a + i]
                values = (own.hex(), subroot, root, hashlib.sha256(beside[i]).hexdigest(), folded(own if probe is None else probe, steps[i]))
                for column, value in zip(columns, (*values, beside[i].decode()), strict=False):
                    column.append(value)
        return pa.Table.from_arrays([rows.column("key"), *[pa.array(c, pa.string()) for c in columns]], names=out.names)

    ranked = unit(made.ranked.select("key", "leaf", "probe", "tree", "leaves", "index", F.floor(F.col("index") / BLOCK).alias("block")))
    return ranked.groupBy("unit").cogroup(unit(paths(made)).groupBy("unit")).applyInArrow(prove, out)


def tampered(key: Column, text: Column) -> Column:
    """``text`` with A-Z in lower case where 5 divides the CRC-32 of the key."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    changed = tampered(F.col("doc_id"), text)
    other = leaf([changed if c == "text" else F.col(c) for c in FIELDS])
    made = manifest(docs, "doc_id", "source", leaf([F.col(c) for c in FIELDS]), F.when(changed != text, other))
    rows = proofs(made, docs.schema["doc_id"].dataType)
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         -- CRC-32 bit by bit: a byte, then seven times nothing
         list_reduce(flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
           lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END, CAST(4294967295 AS BIGINT)) AS crc
  FROM documents
), h AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0
           THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM f
), l AS (
  SELECT *, coalesce(changed, leaf) AS seen, row_number() OVER () AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM h
), t AS (
  SELECT tree, 0 AS level, idx, leaf AS d, n FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)), (min(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY tree, level, idx // 16
), u AS (
  SELECT 0 AS level, tree AS idx, d, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)), (min(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY level, idx // 16
), nodes AS (
  SELECT tree, level, idx, d, n FROM t WHERE n > 1 UNION ALL SELECT -1, 100 + level, idx, d, n FROM u WHERE n > 1
), levels AS (
  SELECT DISTINCT tree, level FROM nodes
), p AS (
  SELECT r, v.tree, v.level, CASE WHEN v.tree < 0 THEN l.tree // CAST(pow(16, v.level - 100) AS BIGINT) ELSE l.idx // CAST(pow(16, v.level) AS BIGINT) END AS pos,
         row_number() OVER (PARTITION BY r ORDER BY v.level) AS k
  FROM l JOIN levels v ON v.tree = l.tree OR v.tree < 0
), proof AS (
  SELECT r, sha256(string_agg(d, '' ORDER BY p.level, nodes.idx)) AS proof FROM p JOIN nodes USING (tree, level) WHERE nodes.idx // 16 = pos // 16 AND nodes.idx <> pos GROUP BY r
), climb AS (
  SELECT r, CAST(0 AS BIGINT) AS k, seen AS d FROM l
  UNION ALL
  SELECT climb.r, min(climb.k) + 1, sha256(string_agg(CASE WHEN nodes.idx = pos THEN climb.d ELSE nodes.d END, '' ORDER BY nodes.idx))
  FROM climb JOIN p ON p.r = climb.r AND p.k = climb.k + 1 JOIN nodes ON nodes.tree = p.tree AND nodes.level = p.level AND nodes.idx // 16 = pos // 16 GROUP BY climb.r
), ends AS (
  SELECT r, arg_max(d, k) AS d FROM climb GROUP BY r
), root AS (
  SELECT d FROM u WHERE n = 1
)
SELECT doc_id, leaf, s.d AS subroot, root.d AS root, coalesce(proof, sha256('')) AS proof_sha256, ends.d AS folded_root, ends.d = root.d AS verified
FROM l JOIN ends USING (r) LEFT JOIN proof USING (r) JOIN (SELECT tree, d FROM t WHERE n = 1) s USING (tree) CROSS JOIN root
"""


def brute_force(rows: list[dict]) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; for tests. Equal keys and leaves may change places."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: h(*[shown(r[c]) for c in FIELDS])

    def tree(nodes: list[str]) -> list[list[str]]:
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
        return levels

    def climb(levels, at, node, proof):
        for level in levels[:-1]:
            begin = at // FAN * FAN
            run = level[begin : begin + FAN]
            proof += run[: at - begin] + run[at - begin + 1 :]
            node = h(*run[: at - begin], node, *run[at - begin + 1 :])
            at //= FAN
        return node

    nulls = lambda v: (v is not None, v if v is not None else 0)
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (*nulls(r["doc_id"]), leaf_of(r))):
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: b"" if s is None else b"x" + s.encode())
    trees = [tree([leaf_of(r) for r in groups[s]]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for g, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            seen = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                seen["text"] = r["text"].translate(str.maketrans(UPPER, LOWER))
            proof: list[str] = []
            end = climb(top, g, climb(trees[g], i, leaf_of(seen), proof), proof)
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], h(*proof), end, end == top[-1][0]))
    return out
