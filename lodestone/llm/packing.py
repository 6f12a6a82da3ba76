"""Packing of tokenised documents into fixed sequences by first-fit decreasing.

Documents are tokenised where they lie. Full sequences are cut off each; what remains is
dealt to random groups of about ``GROUP`` documents, and each group fits its remainders,
largest first, into the first sequence with room. A tournament tree over the sequences'
free room finds that sequence in logarithmic time. Only lengths and checksums are shuffled.

Defined cases: a null text is empty, so its document is the end id alone; null and repeated
doc_ids keep one set of pieces per row; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import map_columns, table

LENGTH, END, GROUP = 1024, 0, 2048
#: Sequence numbers are a group's number times this, plus a number within the group.
SPREAD = 1 << 32

PIECE = T.StructType([
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False),
    T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("sequence_id", T.LongType(), False),
    T.StructField("offset", T.LongType(), False),
])


class TokenIds:
    """Ids of texts by a tokenizer file; plain texts take a faster library with the same vocabulary.

    The second library reads the same merges as ranks and splits words alike. It is used for
    texts of characters below U+0250 only, where both hold the same letter and digit classes, and without
    ``<|``, the beginning of special tokens.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.fast = _fast(ranks, pattern) if ranks else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text and (text.isascii() or max(text) < "ɐ"):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def _fast(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


@cache
def _token_ids(tokenizer: str, ranks: str | None, pattern: str | None) -> TokenIds:
    return TokenIds(tokenizer, ranks, pattern)


class Bins:
    """Bins of equal room, found first-fit by a tournament tree of their free room."""

    def __init__(self, count: int, room: int) -> None:
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.room = room
        self.tree = [room] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size`` and the offset there."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        offset = self.room - tree[at]
        tree[at] -= size
        number = at - self.leaves
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return number, offset


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, the largest put first, equal ones in the order given."""
    bins, places = Bins(len(sizes), room), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        places[i] = bins.put(sizes[i])
    return places


def packed(df: DataFrame, carry: Column, text: str, *, tokenizer: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: ``carry`` as c0, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-df.count() // group))

    def make():
        ids_of = _token_ids(tokenizer, ranks, pattern).ids
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId() if TaskContext.get() else 0

        def fn(texts: pa.Array) -> list[pa.Array]:
            total, checks, dealt = [], [], []
            for text_ in texts.to_pylist():
                ids = np.append(ids_of(text_ or ""), np.uint32(end)).astype("<u4")
                sums = [zlib.crc32(ids[i : i + length].tobytes()) for i in range(0, len(ids), length)]
                total.append(len(ids))
                checks.append(sums)
                # equal documents of a task are told apart by a running number, so that they spread over
                # groups, and a repeated task deals them out as before
                content = xxhash.xxh64_intdigest(np.array(sums, np.uint32).tobytes(), seed=len(ids))
                times = seen[content] = seen.get(content, -1) + 1
                dealt.append(xxhash.xxh64_intdigest(b"%d %d %d" % (content, times, part)) % groups)
            return [pa.array(total, pa.int64()), pa.array(checks, pa.list_(pa.int64())), pa.array(dealt, pa.int64())]

        return fn

    schema = T.StructType([T.StructField("doc_tokens", T.LongType(), False), T.StructField("checks", T.ArrayType(T.LongType(), False), False), T.StructField("grp", T.LongType(), False)])
    cut = map_columns(df, [carry], [F.col(text)], make, schema)
    out = T.StructType([cut.schema["c0"], *PIECE.fields])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        spread = key[0].as_py() * SPREAD
        rows = rows.sort_by([("doc_tokens", "descending"), ("c0", "ascending")])
        docs, totals, sums = rows.column("c0"), rows.column("doc_tokens").to_pylist(), rows.column("checks").to_pylist()
        rest = [t % length for t in totals]
        places = iter(first_fit_decreasing([r for r in rest if r], length))
        full = len(totals)  # numbers above those of the bins
        take, columns = [], []
        for i, (tokens, checks) in enumerate(zip(totals, sums, strict=True)):
            for k, check in enumerate(checks):
                size = min(length, tokens - k * length)
                if size == length:
                    number, offset, full = full, 0, full + 1
                else:
                    number, offset = next(places)
                take.append(i)
                columns.append((k * length, size, check, tokens, spread + number, offset))
        made = [pa.array([r[i] for r in columns], pa.int64()) for i in range(6)]
        return pa.Table.from_arrays([docs.take(pa.array(take, pa.int64())), *made], names=out.names)

    return cut.groupBy("grp").applyInArrow(pack, out)


def public_files() -> dict[str, str]:
    """The tokenizer that the queries use, as parameters of ``packed``."""
    import public_tokenizers as P

    return {"tokenizer": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), F.col("doc_id"), "text", **public_files()).withColumnRenamed("c0", "doc_id")
