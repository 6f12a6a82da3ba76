"""Fill-in-middle transformation over lines, by overlapping-chunk decomposition.

A text is cut into chunks of bytes. A unit (a line with its end) begins where the byte before is
a line feed, so a chunk sees all its beginnings if it overlaps its left neighbour by one byte; sentinels
need two bytes of the right neighbour. All chunks of a batch are counted together: beginnings, code
points, sentinels. Prefix sums of the counts give a text's number of units and tell for both cut ranks
which chunk owns them, and only those two chunks are read again to find the cuts.

Texts are read in slabs of ``SLAB`` bytes at most, so what is held beside a text does not grow with it.

Defined cases: a null text is empty, and an empty text is plain with no units; a null id is hashed as
an empty string; a text that already holds a sentinel stays plain; repeated rows are transformed each, alike;
an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, map_columns, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and of the chunks that are counted at a time.
CHUNK, SLAB = 4096, 1 << 20
#: Percent of texts that are transformed, and of those that put the suffix first.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7

PARTS = T.StructType([
    T.StructField("n", T.LongType(), False),
    T.StructField("form", T.StringType(), False),
    T.StructField("prefix_chars", T.LongType(), True),
    T.StructField("middle_chars", T.LongType(), True),
    T.StructField("output", T.StringType(), False),
])


class Chunks:
    """The chunks of texts that lie one after the other in ``data``, with their counts."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, chunk: int = CHUNK, slab: int = SLAB) -> None:
        self.data, self.chunk, self.ends = data, chunk, ends
        self.starts = np.r_[0, ends[:-1]].astype(np.int64)
        per_text = -(-(ends - self.starts) // chunk)
        #: The first chunk of each text, and after the last text the number of chunks.
        self.first = np.r_[0, np.cumsum(per_text)].astype(np.int64)
        owner = np.repeat(np.arange(len(ends)), per_text)
        self.low = self.starts[owner] + (np.arange(len(owner)) - self.first[owner]) * chunk
        self.high = np.minimum(self.low + chunk, ends[owner])
        units, chars, marks = (np.zeros(len(owner), np.int64) for _ in range(3))
        at = 0
        while at < len(owner):
            to = max(at + 1, int(np.searchsorted(self.high, self.low[at] + slab, "right")))
            cuts = self.low[at:to] - self.low[at]
            units[at:to] = np.add.reduceat(self._beginnings(self.low[at], self.high[to - 1]), cuts, dtype=np.int64)
            chars[at:to] = np.add.reduceat(self._leads(self.low[at], self.high[to - 1]), cuts, dtype=np.int64)
            marks[at:to] = np.add.reduceat(self._sentinels(self.low[at], self.high[to - 1]), cuts, dtype=np.int64)
            at = to
        self.units, self.chars, self.marks = (np.r_[0, np.cumsum(x)] for x in (units, chars, marks))

    def _beginnings(self, low: int, high: int) -> np.ndarray:
        """Which bytes begin a unit: the first of a text, and those after a line feed."""
        out = np.empty(high - low, bool)
        out[1:] = self.data[low : high - 1] == 10
        out[0] = low > 0 and self.data[low - 1] == 10
        inside = self.starts[np.searchsorted(self.starts, low) : np.searchsorted(self.starts, high)]
        out[inside - low] = True
        return out

    def _leads(self, low: int, high: int) -> np.ndarray:
        """Which bytes begin a code point."""
        return (self.data[low:high] & 0xC0) != 0x80

    def _sentinels(self, low: int, high: int) -> np.ndarray:
        """Which bytes begin a sentinel that ends in the same text."""
        seen = np.zeros(high - low + 2, np.uint8)
        part = self.data[low : high + 2]
        seen[: len(part)] = part
        out = (seen[:-2] == ord("<")) & (seen[2:] == ord(">")) & np.isin(seen[1:-1], np.frombuffer(b"PSM", np.uint8))
        for back in (1, 2):  # a text's last two bytes begin none
            last = self.ends - back
            last = last[(last >= low) & (last < high)]
            out[last - low] = False
        return out

    def total(self, counts: np.ndarray) -> np.ndarray:
        """A count of every text."""
        return counts[self.first[1:]] - counts[self.first[:-1]]

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """Bytes and code points of ``text`` before its unit ``rank``; its length where there is none."""
        base = self.first[text]
        wanted = self.units[base] + rank
        if wanted >= self.units[self.first[text + 1]]:
            return int(self.ends[text] - self.starts[text]), int(self.chars[self.first[text + 1]] - self.chars[base])
        own = int(np.searchsorted(self.units, wanted, "right")) - 1
        low, high = int(self.low[own]), int(self.high[own])
        at = low + int(np.flatnonzero(self._beginnings(low, high))[wanted - self.units[own]])
        chars = self.chars[own] - self.chars[base] + np.count_nonzero(self._leads(low, at)) if at > low else self.chars[own] - self.chars[base]
        return at - int(self.starts[text]), int(chars)


def _transformed(rate: int, suffix_first: int, chunk: int, slab: int):
    def fn(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> list[pa.Array]:
        rows = as_bytes(texts)
        chunks = Chunks(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([len(r) for r in rows], dtype=np.int64), chunk, slab)
        n, marked = chunks.total(chunks.units), chunks.total(chunks.marks)
        first, second = (h.to_numpy(zero_copy_only=False) % (n + 1) for h in (h1, h2))
        forms, before, between, out = [], [], [], []
        for i, (text, a, b, draw, order) in enumerate(zip(rows, np.minimum(first, second).tolist(), np.maximum(first, second).tolist(), h3.to_pylist(), h4.to_pylist(), strict=True)):
            if not text or marked[i] or draw % 100 >= rate:
                forms.append("plain")
                before.append(None)
                between.append(None)
                out.append(text)
                continue
            (start, chars), (end, more) = chunks.cut(i, a), chunks.cut(i, b)
            spm = order % 100 < suffix_first
            forms.append("spm" if spm else "psm")
            before.append(chars)
            between.append(more - chars)
            prefix, suffix = (PREFIX.encode(), text[:start]), (SUFFIX.encode(), text[end:])
            out.append(b"".join((*(suffix + prefix if spm else prefix + suffix), MIDDLE.encode(), text[start:end])))
        return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]

    return fn


def fill_middle(df: DataFrame, carry: list[Column], key: Column, text: str, *, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """``carry`` as c0, c1, ... with n, form, prefix_chars, middle_chars and the transformed text as output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return map_columns(df, carry, [F.col(text), *draws], lambda: _transformed(rate, suffix_first, chunk, slab), PARTS)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    # each sentinel stands once in an output, as texts that hold one stay plain
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    rest = F.split_part(output, F.lit(MIDDLE), F.lit(1))
    left = lambda mark: F.split_part(rest, F.lit(mark), F.lit(1))
    right = lambda mark: F.split_part(rest, F.lit(mark), F.lit(2))
    psm = F.concat(F.substring(left(SUFFIX), len(PREFIX) + 1, 2**31 - 1), middle, right(SUFFIX))
    spm = F.concat(right(PREFIX), middle, F.substring(left(PREFIX), len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"), [F.col("doc_id")], F.col("doc_id"), "text")
    return made.select(
        F.col("c0").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
  FROM h
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def brute_force(key: object, text: str | None, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple:
    """n, form, prefix_chars, middle_chars and output of a text; for tests."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}"
    return len(units), "psm", len(p), len(m), f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"
