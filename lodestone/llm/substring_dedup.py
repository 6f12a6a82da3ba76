"""Substring dedup: words of passages that stand earlier in the corpus, found by FM-indexes of shards.

A window is ``WINDOW`` consecutive words of a document. Windows of equal words have the same least hash
of a GRAM-word run, so that hash deals them to shards: a segment is a stretch of a document's windows with
the same least hash, and all equal windows meet in one shard. Only segments whose hash occurs twice can hold
a repeated window; a bitmap of fixed size, made from exact counts, keeps most others from being sent.

A shard orders its segments by document and place, keeps the first of each equal text (all windows of the others stand earlier) and indexes those: a
suffix order over 2 * WINDOW words at most, its Burrows-Wheeler transform as a wavelet matrix of packed bits, and the first place of each group of
suffixes that begin with the same window. These segments then stream through the index by backward
search, many at a time, which gives every position's matching statistic (how far the words from there on are
in the index); a position that matches a whole window whose first place is another one is reported. The words of segments are
compared as they are; hashes only deal and filter. Stretches of reported windows go back to their documents.

Hot hashes (a passage that many documents share) are known from the counts: their windows are dealt one by one by a hash of
all their words, and a task sends a window again only if it stands earlier than the one it sent; the others are
reported at once (their 128-bit digests are equal).

Order and ties: documents are ordered by id, null ids last, then by the digest of their text; of rows with equal id
and text one counts as the first and every window of the others is removed.
Defined cases: null texts have no words; texts of fewer than WINDOW words keep all; a document without words is an empty
text; texts of any length are read whole; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, dropped, map_columns, modest_batches, table, written

WINDOW, GRAM = 20, 6
#: Windows of a segment at most; longer stretches are several segments.
MOST_WINDOWS = 64
#: Stretches with repeated hashes dealt to a shard on average.
SHARD = 40_000
#: Hashes of more stretches are hot; of more than MOST_HOT such hashes only those above a higher bound.
HOT, MOST_HOT = 4096, 1 << 20
#: Bits of the bitmap of repeated hashes.
FILTER_BITS = 27
#: Words whose hashes, and windows whose first places, a task remembers.
KNOWN_WORDS, KNOWN_WINDOWS = 1 << 18, 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def gram_hashes(words: list[bytes], hashes: _Hashes, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of ``gram`` words."""
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(0, len(words) - gram + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            out = (out ^ ids[i : i + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    n, span = len(values) - size + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[size - span : size - span + n])


def stretches(words: list[bytes], hashes: _Hashes, window: int = WINDOW, gram: int = GRAM, most: int = MOST_WINDOWS) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one least hash, at most ``most`` each: first window, windows, the hash,
    and how often the hash stands there (windows can repeat within a stretch if it does twice)."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    grams, size = gram_hashes(words, hashes, gram), window - gram + 1
    keys = sliding_least(grams, size)
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[begins, len(keys)])
    if sizes.max() > most:
        parts = -(-sizes // most)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins, left = np.repeat(begins, parts) + nth * most, np.repeat(sizes, parts) - nth * most
        sizes = np.minimum(left, most)
    keys, times = keys[begins], np.ones(len(begins), np.int64)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    for i in np.flatnonzero(np.isin(keys, twice)).tolist() if len(twice) else ():
        times[i] = np.count_nonzero(grams[begins[i] : begins[i] + sizes[i] + size - 1] == keys[i])
    return begins, sizes, keys, times


# --- the index -------------------------------------------------------------------------------------------------------
class WaveletMatrix:
    """Ranks over a sequence of numbers: one row of packed bits per binary digit, most significant first."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.digits = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for d in range(self.digits - 1, -1, -1):
            ones = ((values >> d) & 1).astype(bool)
            packed = np.zeros((len(ones) >> 6) + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.bits.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.uint32))
            self.zeros.append(int(len(ones) - ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])
        every = np.arange(symbols)
        self.begins = self._moved(every, np.zeros(symbols, np.int64))

    def _moved(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for row in range(self.digits):
            block = at >> 6
            below = self.bits[row][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[row][block].astype(np.int64) + np.bitwise_count(below)
            at = np.where((symbols >> (self.digits - 1 - row)) & 1, self.zeros[row] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._moved(symbols, at) - self.begins[symbols]


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class FmIndex:
    """Backward search over texts of numbers from 1, which a 0 ends, for matches of up to ``depth`` numbers."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int = WINDOW) -> None:
        self.depth, n = depth, len(text)
        #: ranks[i]: the order of suffixes by their first 2 ** i numbers
        ranks = [_dense(text)]
        while 1 << (len(ranks) - 1) <= depth:
            half = 1 << (len(ranks) - 1)
            after = np.zeros(n, np.int64)
            after[: max(0, n - half)] = ranks[-1][half:] + 1
            ranks.append(_dense(ranks[-1] * (n + 1) + after))
        order = np.argsort(ranks[-1], kind="stable")
        #: How many numbers each suffix shares with the one before it in order, up to all that were ordered.
        shared = np.zeros(n, np.int64)
        a, b = order[:-1], order[1:]
        for i in range(len(ranks) - 1, -1, -1):
            x, y = a + shared[1:], b + shared[1:]
            inside = np.maximum(x, y) < n
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            shared[1:] += (inside & (ranks[i][x] == ranks[i][y])) * (1 << i)
        self.shared = np.minimum(shared, depth).astype(np.uint8)
        self.wavelet = WaveletMatrix(text[order - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))].astype(np.int64)
        self.n, self.symbols = n, symbols
        self._borders: dict[int, np.ndarray] = {}
        #: Of each group of suffixes with the same first ``depth`` numbers the first place in the text.
        self.first = np.minimum.reduceat(order, self.borders(depth)) if n else order

    def borders(self, depth: int) -> np.ndarray:
        """Where, in suffix order, the first ``depth`` numbers change."""
        if depth not in self._borders:
            self._borders[depth] = np.flatnonzero(self.shared < depth)
        return self._borders[depth]

    def around(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share their first ``depth`` numbers with the one at ``at``."""
        borders = self.borders(depth)
        group = np.searchsorted(borders, at, "right") - 1
        return borders[group], np.r_[borders, self.n][group + 1]

    def matches(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the streams text[begins:ends]: per place the length matched, at most ``depth``,
        and where that is ``depth`` the first place of those numbers in the index, else -1. Numbers that the index lacks are -1."""
        length, first = np.zeros(len(text), np.int64), np.full(len(text), -1, np.int64)
        longest = np.argsort(begins - ends, kind="stable")
        begins, at = begins[longest], ends[longest] - 1
        low, high, size = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        while True:
            live = int(np.count_nonzero(at >= begins))  # the longest streams come first
            if not live:
                return length, first
            at, begins, low, high, size = at[:live], begins[:live], low[:live], high[:live], size[:live]
            symbol = text[at]
            todo = np.arange(live)
            while len(todo):
                c, known = symbol[todo], symbol[todo] >= 0
                c = np.where(known, c, 0)
                rank = self.wavelet.rank(np.r_[c, c], np.r_[low[todo], high[todo]])
                lo, hi = self.before[c] + rank[: len(todo)], self.before[c] + rank[len(todo) :]
                met = known & (lo < hi)
                done = todo[met]
                low[done], high[done] = lo[met], hi[met]
                size[done] += 1
                todo = todo[~met]
                lost = todo[size[todo] == 0]
                low[lost], high[lost] = 0, self.n
                todo = todo[size[todo] > 0]
                size[todo] -= 1  # drop the last number, look for the rest
                for d in np.unique(size[todo]).tolist():
                    some = todo[size[todo] == d]
                    low[some], high[some] = self.around(low[some], d) if d else (0, self.n)
            over = size > self.depth
            size[over] = self.depth
            low[over], high[over] = self.around(low[over], self.depth)
            length[at] = size
            whole = size == self.depth
            first[at[whole]] = self.first[np.searchsorted(self.borders(self.depth), low[whole])]
            at = at - 1


def repeated(segments: list[bytes], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Of each of different segments, in the order of the corpus, the stretches (start, windows) that stand earlier."""
    number: dict[bytes, int] = {}
    parts, begins, at = [], [], 0
    for segment in segments:
        ids = [number.setdefault(w, len(number) + 1) for w in segment.split(b" ")]
        parts += [*ids, 0]
        begins.append(at)
        at += len(ids) + 1
    text, starts = np.array(parts, np.int64), np.array(begins, np.int64)
    ends = np.r_[starts[1:], at] - 1
    index = FmIndex(text, len(number) + 1, window)
    first = index.matches(text, starts, ends)[1]
    hit = np.zeros(len(text) + 1, np.int8)
    hit[:-1] = (first >= 0) & (first < np.arange(len(text)))
    turns = np.diff(hit, prepend=0)  # a segment ends without a whole window, so no stretch crosses into the next
    lows, highs = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    owner = np.searchsorted(starts, lows, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for o, a, b in zip(owner.tolist(), (lows - starts[owner]).tolist(), (highs - lows).tolist(), strict=True):
        out[o].append((a, b))
    return out


# --- the corpus ------------------------------------------------------------------------------------------------------
_COUNT = T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())])
_FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType())])
_LISTS = {"hash": pa.int64(), "a": pa.int64(), "b": pa.int64(), "id": pa.int64(), "start": pa.int32(), "windows": pa.int32(), "times": pa.int32()}
_BLOCK = T.StructType([
    T.StructField("shard", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.LongType() if t == pa.int64() else T.IntegerType())) for c, t in _LISTS.items()],
    T.StructField("texts", T.BinaryType()),
])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes of a batch's stretches, each with how many there are."""
    hashes = _Hashes()
    for batch in batches:
        found = [stretches(data.split(), hashes)[2:] for data in as_bytes(batch.column(0))]
        if found:
            keys, which = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            n = np.bincount(which, np.concatenate([f[1] for f in found]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=_COUNT.names)


def _bits(repeats: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS bits, that of the last bits of each repeated hash set; its size does not depend on their number."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    # Spark numbers buckets of 32,768 bits from the value 1 on
    parts = repeats.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, bits in zip(*(c.to_pylist() for c in parts.toArrow().columns), strict=True):
        out[(bucket - 1) * 4096 :][:4096] = np.frombuffer(bits, np.uint8)
    return out


def _hot(repeats: DataFrame, most: int, least: int) -> np.ndarray:
    """Hashes of more than ``least`` stretches, or of so many more that no more than ``most`` are left."""
    while repeats.where(F.col("n") > least).limit(most + 1).count() > most:
        least *= 2
    rows = repeats.where(F.col("n") > least).select("hash").toArrow()
    return np.sort(rows.column("hash").to_numpy().view(np.uint64))


def _segments(shards: int, bits: np.ndarray, hot: np.ndarray, window: int):
    """Blocks of segments for each shard, and stretches of hot windows that are known to stand earlier."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = _Hashes(), zstandard.ZstdCompressor(1)
        met: dict[bytes, tuple] = {}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("shard", *_LISTS)}
            texts: list[bytes] = []

            def put(shard, *values, segment=None):
                for column, value in zip(out.values(), (shard, *values), strict=True):
                    column.append(value)
                texts.append(segment)

            ids, rows_a, rows_b = (batch.column(i).to_pylist() for i in range(3))
            for id_, a, b, data in zip(ids, rows_a, rows_b, as_bytes(batch.column(3)), strict=True):
                words = data.split()
                starts, sizes, keys, times = stretches(words, hashes, window)
                at = keys & np.uint64((1 << FILTER_BITS) - 1)
                keep = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                if not len(keep):
                    continue
                near = np.minimum(np.searchsorted(hot, keys[keep]), max(0, len(hot) - 1))
                is_hot = hot[near] == keys[keep] if len(hot) else np.zeros(len(keep), bool)
                where = (id_ is None, id_ or 0, a, b)
                for i, warm in zip(keep.tolist(), is_hot.tolist(), strict=True):
                    start, n, key = int(starts[i]), int(sizes[i]), int(keys[i])
                    if not warm:
                        put(key % shards, key, a, b, id_, start, n, int(times[i]), segment=b" ".join(words[start : start + n + window - 1]))
                        continue
                    gone = None
                    for s in range(start, start + n):
                        one = b" ".join(words[s : s + window])
                        digest = hashlib.blake2b(one, digest_size=16).digest()
                        held = met.get(digest)
                        if held is not None and held < (*where, s):
                            gone = s if gone is None else gone
                            continue
                        if gone is not None:
                            put((a + gone) % shards, 0, a, b, id_, gone, s - gone, 0)
                            gone = None
                        if held == (*where, s):
                            continue  # the same row once more
                        if held is None and len(met) >= KNOWN_WINDOWS:
                            met.clear()
                        met[digest] = (*where, s)
                        own = int.from_bytes(digest[:8], "little")
                        put(own % shards, own, a, b, id_, s, 1, 1, segment=one)
                    if gone is not None:
                        put((a + gone) % shards, 0, a, b, id_, gone, start + n - gone, 0)
            if texts:
                yield _blocks(out, texts, packer)

    return fn


def _blocks(out: dict[str, list], texts: list[bytes | None], packer) -> pa.RecordBatch:
    """One row per shard, the values of its segments in lists and their texts packed together."""
    shard = np.array(out["shard"], np.int32)
    order = np.argsort(shard, kind="stable")
    begins = np.flatnonzero(np.diff(shard[order], prepend=-1))
    offsets = pa.array(np.r_[begins, len(order)].astype(np.int32))
    columns = [pa.array(shard[order][begins])]
    for name, kind in _LISTS.items():
        values = pa.array(np.array(out[name], np.uint64).view(np.int64)) if name == "hash" else pa.array(out[name], kind)
        columns.append(pa.ListArray.from_arrays(offsets, values.take(pa.array(order))))
    lines = [b"" if texts[i] is None else texts[i] for i in order.tolist()]
    packed = [packer.compress(b"\n".join(lines[a:b])) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(lines)], strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=_BLOCK.names)


def _reported(window: int):
    """Stretches of a shard's segments that stand earlier."""

    def fn(key: tuple, rows: pa.Table) -> pa.Table:
        value = {c: rows.column(c).combine_chunks().flatten() for c in _LISTS}
        unpack = zstandard.ZstdDecompressor()
        texts = [line for x in rows.column("texts").to_pylist() for line in unpack.decompress(x).split(b"\n")]
        a, b, start, windows = (value[c].to_numpy() for c in ("a", "b", "start", "windows"))
        no_id, id_ = value["id"].is_null().to_numpy(zero_copy_only=False), value["id"].fill_null(0).to_numpy()
        found = [(i, 0, int(windows[i])) for i, t in enumerate(texts) if not t]  # reported where they were cut
        keys, which = np.unique(value["hash"].to_numpy(), return_inverse=True)
        times = np.bincount(which, value["times"].to_numpy(), len(keys))
        order = np.lexsort((start, b, a, id_, no_id))
        first: dict[bytes, int] = {}
        for i in order[times[which[order]] > 1].tolist():
            if texts[i]:
                f = first.setdefault(texts[i], i)
                if f != i and (a[f], b[f], start[f]) != (a[i], b[i], start[i]):  # equal: the same row once more
                    found.append((i, 0, int(windows[i])))
        if first:
            for i, parts in zip(first.values(), repeated(list(first), window), strict=True):
                found += [(i, s, n) for s, n in parts]
        i = np.array([f[0] for f in found], np.int64)
        at = start[i] + np.array([f[1] for f in found], np.int32)
        return pa.Table.from_arrays([pa.array(a[i]), pa.array(b[i]), pa.array(at.astype(np.int32)), pa.array([f[2] for f in found], pa.int32())], names=_FOUND.names)

    return fn


def _row(key: Column, text: Column) -> list[Column]:
    """128 bits that tell (key, text) from every other."""
    digest = F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(c) for i, c in enumerate("ab")]


def repeats(df: DataFrame, key: str, text: str, *, shard: int = SHARD, hot: int = HOT, most_hot: int = MOST_HOT) -> DataFrame:
    """Rows (a, b, start, windows): stretches of windows of a row that stand earlier, the row by its 128 bits."""
    spark = df.sparkSession
    modest_batches(spark)
    counts = df.select(F.col(text)).mapInArrow(_counted, _COUNT)
    again = written(counts.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"), "repeats")
    shards = max(1, -(-(again.agg(F.sum("n")).first()[0] or 0) // shard))
    sent = spark.sparkContext.broadcast((_bits(again), _hot(again, most_hot, hot)))
    dropped(again)
    cut = df.select(F.col(key).cast("long").alias("id"), *_row(F.col(key), F.col(text)), F.col(text).alias("text"))

    def segments(batches):
        yield from _segments(shards, *sent.value, WINDOW)(batches)

    return cut.mapInArrow(segments, _BLOCK).groupBy("shard").applyInArrow(_reported(WINDOW), _FOUND)


_KEPT = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("kept", T.StringType(), False)])


def _kept():
    def fn(texts: pa.Array, spans: pa.Array) -> list[pa.Array]:
        n_words, n_removed, kept = [], [], []
        for data, gone in zip(as_bytes(texts), spans.to_pylist(), strict=True):
            words = data.split()
            turn = np.zeros(len(words) + 1, np.int64)
            for span in gone or ():
                turn[span["start"]] += 1
                turn[span["start"] + span["windows"] + WINDOW - 1] -= 1
            stays = np.cumsum(turn)[:-1] == 0
            n_words.append(len(words))
            n_removed.append(int(len(words) - stays.sum()))
            kept.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s] if gone else words))
        return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

    return fn


def deduplicated(df: DataFrame, key: str, text: str, **options: int) -> DataFrame:
    """Rows (key, n_words, n_removed, kept): every row's words that no earlier passage covers, joined by blanks."""
    found = repeats(df, key, text, **options).groupBy("a", "b").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    # rows of equal key and text are one row with a number, made before the shuffle
    rows = df.select(*_row(F.col(key), F.col(text)), F.col(key).alias("key"), F.col(text).alias("text")).groupBy("a", "b")
    rows = rows.agg(F.first("key").alias("key"), F.first("text").alias("text"), F.count("*").alias("times"))
    both = rows.join(found, ["a", "b"], "left")
    kept = map_columns(both, [F.col("key"), F.col("times")], [F.col("text"), F.col("spans")], _kept, _KEPT)
    each = kept.select("c0", "n_words", "n_removed", "kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c1"))).alias("nth"))
    whole = (F.col("nth") > 1) & (F.col("n_words") >= WINDOW)
    return each.select(
        F.col("c0").alias("key"), "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT r, i, list_aggregate(list_slice(w, i, i + 19), 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), k AS (
  SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY r, i) AS nth FROM x
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM k WHERE nth > 1
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), stays AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN stays USING (r)
"""


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """doc_id, n_words, n_removed and kept of each row; for tests."""
    met: set[tuple] = set()
    out = []
    def place(row):
        digest = hashlib.sha256(f"{'-' if row[0] is None else row[0]}:{row[1] or ''}".encode()).digest()
        return row[0] is None, row[0] or 0, *np.frombuffer(digest[:16], ">i8").tolist()

    for id_, text in sorted(rows, key=place):
        words = (text or "").encode().split()
        gone: set[int] = set()
        for i in range(len(words) - window + 1):
            one = tuple(words[i : i + window])
            if one in met:
                gone.update(range(i, i + window))
            met.add(one)
        out.append((id_, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out
