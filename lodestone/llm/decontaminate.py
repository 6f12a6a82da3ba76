"""Benchmark decontamination by winnowing.

Every text is read as words. Of each run of ``WINDOW`` consecutive k-gram hashes the least
is a fingerprint; a span of ``SPAN`` shared words holds such a run on either side, so it
shares a fingerprint. Fingerprints of documents and items are joined, and each hit is
extended over the words of all windows that can choose it; ``SPAN`` equal words in a row (or the whole item,
if that is shorter) are marked in the document. A longer span holds a fingerprint for each of its windows.

Items shorter than ``SPAN`` words take their whole word sequence as the only fingerprint, and
documents are fingerprinted once more for each such length that occurs.

Defined cases: null texts have no words; items without words or without item_id take no part;
items that repeat an item_id count once; a document without words is not contaminated; repeated
documents are judged each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, map_columns, table, words_of, written

SPAN, GRAM = 13, 8
WINDOW = SPAN - GRAM + 1
#: An index of more bytes is not sent to executors; fingerprints are then joined by a shuffle.
MAX_SENT_BYTES = 64 << 20
#: What a distinct word takes in an index beside its bytes: a dictionary's entry, a byte string and a number.
_WORD_BYTES = 160
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

HITS = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
])


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word numbers; the greatest value where one is 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for i in range(size):
            part = ids[i : i + n]
            out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            bad |= part == 0
    out[out == _NONE] = 0
    out[bad] = _NONE
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window (the rightmost of equal ones), ascending."""
    if len(hashes) < window or window == 1:
        at = np.arange(len(hashes)) if window == 1 else np.empty(0, np.int64)
    else:
        turned = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
        at = np.unique(np.arange(len(turned)) + window - 1 - turned.argmin(1))
    return at[hashes[at] != _NONE]


class Index:
    """Fingerprints of items as sorted arrays, with the items themselves, one after the other, for extension.

    A window of ``SPAN`` words and its fingerprint lie in the fingerprint's surroundings: the words of all winnowing windows
    that can choose it. So a hit is extended by comparing the surroundings of both places. Surroundings that repeat, as in
    periodic texts, are looked at once: an item keeps one place of each, and a document asks for one place of each.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], hits: int = 1 << 16) -> None:
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.slice = hits
        ids = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint32) for _, words in items]
        self.words = np.concatenate([*ids, np.zeros(0, np.uint32)])
        self.ends = np.cumsum([0, *map(len, ids)])
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for i, some in enumerate(ids):
            size = 0 if len(some) >= SPAN else len(some)
            hashes = gram_hashes(some, size or GRAM)
            at = winnow(hashes, 1 if size else WINDOW)
            around = _around(some, at, size)
            one = _distinct(around)[0]
            # surroundings cut by an item's end say nothing more if the same stand whole elsewhere
            inner = (around[one] != 0).all(1)
            full = around[one[inner]]
            at = at[[i for i, whole in zip(one.tolist(), inner.tolist(), strict=True) if whole or not ((around[i] == full) | (around[i] == 0)).all(1).any()]]
            found.setdefault(size, []).append((hashes[at], np.full(len(at), i, np.int32), at.astype(np.int32)))
        #: By gram (0: winnowed): sorted fingerprints, and of each the item and the place there.
        self.postings: dict[int, tuple[np.ndarray, ...]] = {}
        for size, parts in found.items():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.postings[size] = tuple(c[order] for c in columns)

    def size(self) -> int:
        """About how many bytes the index takes."""
        arrays = [self.words, *(x for p in self.postings.values() for x in p)]
        return sum(a.nbytes for a in arrays) + sum(_WORD_BYTES + len(w) for w in self.number) + sum(_WORD_BYTES + len(n) for n in self.names)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of an item's window, and the items that occur."""
        number = self.number.get
        ids = np.fromiter((number(w, 0) for w in words), np.uint32, len(words))
        turns = np.zeros(len(ids) + 1, np.int64)
        found: set[int] = set()
        for size, (keys, items, places) in self.postings.items():
            hashes = gram_hashes(ids, size or GRAM)
            if not (hashes != _NONE).any():
                continue
            at = winnow(hashes, 1 if size else WINDOW)
            low, high = (np.searchsorted(keys, hashes[at], side) for side in ("left", "right"))
            at, low, high = (c[high > low] for c in (at, low, high))
            for a in range(0, len(at), self.slice):
                self._extend(ids, size, at[a : a + self.slice], low[a : a + self.slice], high[a : a + self.slice], items, places, turns, found)
        return np.cumsum(turns)[:-1] > 0, found

    def _extend(self, ids, size, at, low, high, items, places, turns, found) -> None:
        """Mark the windows around the places ``at`` that also stand around one of their postings."""
        around = _around(ids, at, size)
        one, which = _distinct(around)
        need = size or SPAN
        offsets = around.shape[1] - need + 1
        whole = np.zeros((len(one), offsets), bool)
        pairs = np.r_[0, np.cumsum(high[one] - low[one])]
        i = 0
        while i < len(one):  # about as many pairs at a time as places
            j = max(i + 1, int(np.searchsorted(pairs, pairs[i] + self.slice, "right")) - 1)
            own = np.repeat(np.arange(i, j), np.diff(pairs[i : j + 1]))
            posting = np.arange(pairs[i], pairs[j]) - pairs[own] + low[one][own]
            item = items[posting]
            other = _around(self.words, places[posting] + self.ends[item], size, self.ends[item], self.ends[item + 1])
            same = (around[one[own]] == other) & (other != 0)
            for o in range(offsets):
                met = same[:, o : o + need].all(1)
                whole[own[met], o] = True
                found.update(np.unique(item[met]).tolist())
            i = j
        for o in range(offsets):
            begin = at[whole[which, o]] - (0 if size else WINDOW - 1) + o
            np.add.at(turns, begin, 1)
            np.add.at(turns, begin + need, -1)


def _around(words: np.ndarray, at: np.ndarray, size: int, low: np.ndarray | int = 0, high: np.ndarray | int | None = None) -> np.ndarray:
    """The words around fingerprints at ``at``: the gram alone if it has ``size`` words, else those of all windows that can choose it; 0 beyond ``low`` and ``high``."""
    before = 0 if size else WINDOW - 1
    spots = np.asarray(at, np.int64)[:, None] + np.arange(-before, size or GRAM + WINDOW - 1)
    high = len(words) if high is None else np.asarray(high)[..., None]
    inside = (spots >= np.asarray(low)[..., None]) & (spots < high)
    return np.where(inside, words[np.clip(spots, 0, max(0, len(words) - 1))] if len(words) else 0, 0).astype(np.uint32)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different row, and for every row which of these it equals."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()
    return np.unique(flat, return_index=True, return_inverse=True)[1:]


def _judged(index: Index):
    def fn(texts: pa.Array) -> list[pa.Array]:
        n_words, n_hit, items = [], [], []
        for data in as_bytes(texts):
            words = words_of(data)
            hit, found = index.hits(words)
            n_words.append(len(words))
            n_hit.append(int(hit.sum()))
            items.append(sorted({index.names[i] for i in found}))
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]

    return fn


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    return benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("words")).where("item is not null and words is not null").distinct()


def contaminated_words(df: DataFrame, carry: list, text: str, benchmark: DataFrame, item_key: str, item_text: str, *, max_sent_bytes: int = MAX_SENT_BYTES) -> DataFrame:
    """The columns ``carry`` of each row of ``df`` (as c0, c1, ...) with n_words, n_hit and items.

    ``items`` are the ids, as sorted strings, of the items with a window that occurs. A
    benchmark whose index takes more than ``max_sent_bytes`` is joined by fingerprint instead of sent.
    """
    items = _items(benchmark, item_key, item_text)
    carry = [F.col(c) if isinstance(c, str) else c for c in carry]
    # larger texts are not collected to learn how large their index would be
    size = items.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    if size <= max_sent_bytes // 4:
        rows = [(r.item, words_of(r.words.encode())) for r in items.collect()]
        index = Index(sorted(r for r in rows if r[1]))
        if index.size() <= max_sent_bytes:
            sent = df.sparkSession.sparkContext.broadcast(index)
            return map_columns(df, carry, [F.col(text)], lambda: _judged(sent.value), HITS)
    return _joined(df, carry, text, items)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) | 1 for w in words), np.uint64, len(words))


def _fingerprints(df: DataFrame, carry: list, text: str, sizes: tuple[int, ...] | None) -> DataFrame:
    """Rows (c0.., gram, fp): of items (sizes None) their own, else those of every given length."""

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            out = []
            for data in as_bytes(texts):
                ids = _word_hashes(words_of(data))
                kinds = sizes if sizes is not None else ((0,) if len(ids) >= SPAN else (len(ids),) if len(ids) else ())
                found = set()
                for size in kinds:
                    hashes = gram_hashes(ids, size or GRAM)
                    found.update((size, int(h)) for h in hashes[winnow(hashes, 1 if size else WINDOW)].view(np.int64))
                out.append([{"gram": g, "fp": h} for g, h in found])
            return [pa.array(out, pa.list_(pa.struct([("gram", pa.int32()), ("fp", pa.int64())])))]

        return fn

    pair = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("fp", T.LongType())])
    out = map_columns(df, carry, [F.col(text)], make, T.StructType([T.StructField("fps", T.ArrayType(pair))]))
    return out.select(*[f"c{i}" for i in range(len(carry))], F.inline("fps"))


def _covered(spans) -> Column:
    """How many places sorted spans (a, b), both inclusive, cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    step = lambda held, x: F.struct((held["n"] + F.greatest(x["b"] - F.greatest(x["a"] - 1, held["end"]), F.lit(0))).alias("n"), F.greatest(held["end"], x["b"]).alias("end"))
    return F.aggregate(spans, start, step, lambda held: held["n"])


def _joined(df: DataFrame, carry: list, text: str, items: DataFrame) -> DataFrame:
    """As contaminated_words, for benchmarks of any size: fingerprints meet in a join."""
    items = written(items.select("item", "words"), "items")
    item_fp = _fingerprints(items, [F.col("item")], "words", None).select(F.col("c0").alias("item"), "gram", "fp")
    sizes = tuple(sorted(r.gram for r in item_fp.select("gram").distinct().collect()))  # at most SPAN values
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = df.select(digest.alias("digest"), F.col(text).alias("text")).where("text is not null")
    doc_fp = _fingerprints(texts, [F.col("digest")], "text", sizes).select(F.col("c0").alias("digest"), "gram", "fp").distinct()
    pairs = written(doc_fp.join(item_fp.distinct(), ["gram", "fp"]).select("digest", "item").distinct(), "pairs")
    once = texts.join(pairs.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    both = pairs.join(items, "item").join(once, "digest")

    def make():
        def fn(texts_: pa.Array, words: pa.Array) -> list[pa.Array]:
            out = []
            for data, item in zip(as_bytes(texts_), as_bytes(words), strict=True):
                index = Index([("", words_of(item))])
                hit = np.zeros(len(data) + 2, np.int8)
                found = index.hits(words_of(data))[0]
                hit[1 : len(found) + 1] = found
                turns = np.flatnonzero(np.diff(hit))
                out.append([{"a": a, "b": b - 1} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)])
            return [pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]

        return fn

    span = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    hits = map_columns(both, [F.col("digest"), F.col("item")], [F.col("text"), F.col("words")], make, T.StructType([T.StructField("spans", span)]))
    hits = written(hits.where(F.size("spans") > 0), "hits")
    marked = hits.groupBy("c0").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).select("c0", _covered(F.col("spans")).alias("n_hit"))
    named = hits.groupBy("c0").agg(F.array_sort(F.collect_set("c1")).alias("items"))
    by_text = marked.join(named, "c0").withColumnRenamed("c0", "digest")

    def count():
        return lambda texts_: [pa.array([len(words_of(x)) for x in as_bytes(texts_)], pa.int64())]

    counted = map_columns(df, [*carry, digest], [F.col(text)], count, T.StructType([HITS["n_words"]]))
    n = len(carry)
    return counted.withColumnRenamed(f"c{n}", "digest").join(by_text, "digest", "left").select(
        *[f"c{i}" for i in range(n)], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(table(spark, sf_dir, "documents"), ["doc_id"], "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS g
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), p AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]]) -> list[tuple]:
    """n_words, n_hit, n_items, items_sha256, contaminated of each text; for tests."""
    windows = []
    for name, text in items:
        words = words_of((text or "").encode())
        size = min(SPAN, len(words))
        if words and name is not None:
            windows += [(str(name), words[i : i + size]) for i in range(len(words) - size + 1)]
    out = []
    for text in texts:
        words = words_of((text or "").encode())
        hit, found = set(), set()
        for name, window in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(name)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out
