"""Line deduplication by an exact set-similarity join.

A line is the set of its words, which are its tokens. It is removed if some earlier line, by (key, line number, text), has a Jaccard similarity of ``THRESHOLD`` or more with it, whether or not
that line is removed itself.

Tokens are words, ordered by rarity: first by their count, from a table of ``COUNTERS`` hashed counters
summed over all lines and sent to executors (its size is fixed), then by hash. Similar lines share a token of their
prefixes, so prefix tokens are the join key. Their entries travel as packed columns, one block per task and cell of the
token space. Within a cell length, positional and bitmap filters leave few pairs, and the words of both lines decide.
Equal sets are one entry per task, and one per token after the shuffle; sets are equal if the sums of two independent 64-bit
hashes over their words are, 128 bits together.

Of each token a line gets the ``FEW`` likeliest earlier lines. If it had more, and the words then clear it of all that it got, it is searched
again among all lines that share a token and gets all of them that may be similar, so no pair is lost. In large groups the earliest lines lead: lines near to a leader
are settled with it and the rest goes on among themselves, so a large group of similar lines takes linear work. Words so frequent
that more than ``HOT`` lines may share one are dealt to a grid of cells, each with two parts of their lines.

Defined cases: lines are parted by a line feed; lines without words stay; null texts stay null; null keys
come after all others; lines of equal key and number are ordered by a hash of their texts, and those of
equal rows are one line, which stays in all or goes from all; an empty table gives no rows; extra columns pass through.
Keys are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_TABLE, as_bytes, modest_batches, table, words_of, written

THRESHOLD = 0.8
COUNTERS, SLICE = 1 << 20, 1 << 12
#: Pairs that a line is given at once for each token; lines with a token in one cell from which on its cell becomes a grid, and the most parts of a grid's side.
FEW, HOT, MOST_PARTS = 4, 1 << 16, 512
#: Bytes of text worked on at a time, entries that a task gathers before it sends them, entries in a cell and in a task.
PIECE, GATHER, CELL, TASK = 1 << 16, 100_000, 150_000, 2_000_000
#: Lines to search again of so many bytes at most are sent to all tasks; more meet the others in a shuffle.
SENT_BYTES = 4 << 20
#: Null keys are ordered after all others.
LAST = (1 << 63) - 1

#: What a byte adds to the hash of its word; 0 parts words.
_VALUES = np.array([0 if b == 32 else b + 1 for b in WORD_TABLE], np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Bases of a word's two hashes; lines are equal if the sums of both over their words are.
_BASES = _BASE, 0xC2B2AE3D27D4EB4F
#: A token is a rarity level (6 bits) and a hash; with a line's number in a piece it fits 64 bits.
_TOKEN_BITS, _HASH_BITS = 44, 38
_FIELDS = {"token": "<u8", "key": "<i8", "twin": "<i8", "line": "<u4", "n": "<u4", "pos": "<u4", "sig": "<u8", "sig2": "<u8", "b1": "<u8", "b2": "<u8"}
_ROW = pa.schema([("kind", pa.int32()), ("cell", pa.int64()), ("block", pa.binary())])
_FOUND = "kind int, key long, twin long, line int, key2 long, twin2 long, line2 int"
GONE, PAIR, CUT_PAIR = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of a hash base and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.held = [(np.ones(1, np.uint64),) * 2 for _ in _BASES]

    def of(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[which][0]) < n:
            size = max(n, PIECE + (PIECE >> 3))
            made = []
            for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            self.held[which] = tuple(made)
        return tuple(x[:n] for x in self.held[which])


class Piece:
    """Words of some whole lines: hash and line of each; key, twin and number of each line."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, keys: np.ndarray, twins: np.ndarray, lines: np.ndarray, powers: _Powers) -> None:
        n = len(raw)
        text = _VALUES[raw]
        feeds = np.flatnonzero(raw == 10)
        word = np.zeros(n + 2, bool)
        word[1:-1] = text != 0
        edges = word[1:] != word[:-1]
        cuts = np.unique(starts[(starts > 0) & (starts < n)])
        cuts = cuts[word[cuts] & word[cuts + 1]]  # a text that ends in a word, where the next begins with one
        at, end = np.flatnonzero(edges).reshape(-1, 2).T
        if len(cuts):
            at, end = (np.sort(np.r_[x, cuts]) for x in (at, end))
        self.at, self.end, self.powers = at, end, powers
        self.words = self.hashed(0, text)
        # a line begins at a text's start or after a line feed
        begins = np.sort(np.r_[starts, feeds + 1])
        first = np.searchsorted(at, begins)
        count = np.diff(np.r_[first, len(at)])
        begins, count = begins[count > 0], count[count > 0]
        self.of = np.repeat(np.arange(len(count)), count)
        doc = np.searchsorted(starts, begins, "right") - 1
        passed = np.searchsorted(feeds, begins) - np.searchsorted(feeds, starts)[doc]
        self.key, self.twin, self.line = keys[doc], twins[doc], passed + lines[doc]
        self.raw, self.begins, self.stops = raw, begins, (starts, feeds)

    def hashed(self, which: int, text: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word by one of the bases."""
        text = _VALUES[self.raw] if text is None else text
        up, down = self.powers.of(which, len(text))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(np.multiply(text, up, out=text), out=sums[1:])
        return _mixed((sums[self.end] - sums[self.at]) * down[self.at])

    def text(self, i: int) -> bytes:
        """The bytes of a line with words, given by its number among those."""
        begin, (starts, feeds) = int(self.begins[i]), self.stops
        after = [int(x[k]) for x, k in ((feeds, np.searchsorted(feeds, begin)), (starts, np.searchsorted(starts, begin, "right"))) if k < len(x)]
        return self.raw[begin : min([len(self.raw), *after])].tobytes()

    def tokens(self, levels: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted tokens of each line's distinct words, the line of each, and both hashes of its word.

        Different words of a line may have equal tokens; each of them counts.
        """
        h = self.words
        value = (levels[(h & np.uint64(COUNTERS - 1)).view(np.int64)].astype(np.uint64) << np.uint64(_HASH_BITS)) | (h >> np.uint64(64 - _HASH_BITS))
        both = (self.of.astype(np.uint64) << np.uint64(_TOKEN_BITS)) | value
        second = self.hashed(1)
        order = np.argsort(both)
        if ((both[order][1:] == both[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
            order = np.lexsort((second, h, both))
        both, h, second = both[order], h[order], second[order]
        new = np.r_[True, (both[1:] != both[:-1]) | (h[1:] != h[:-1]) | (second[1:] != second[:-1])] if len(both) else np.zeros(0, bool)
        both = both[new]
        return both & np.uint64((1 << _TOKEN_BITS) - 1), (both >> np.uint64(_TOKEN_BITS)).view(np.int64), h[new], second[new]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and ends in the bytes of all."""
    column = texts.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)


def _pieces(batch: pa.RecordBatch, powers: _Powers) -> Iterator[Piece]:
    """A batch of (key, twin, text, first line number) in pieces of about ``PIECE`` bytes; a longer text is cut at line feeds."""
    offsets, raw = _bytes_of(batch.column(2))
    keys, twins, firsts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 3))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= 2 * PIECE or j > i + 1:
            if high > low:
                yield Piece(raw[low:high], offsets[i:j] - low, keys[i:j], twins[i:j], firsts[i:j], powers)
        else:
            line = int(firsts[i])
            while low < high:
                end = high
                if high - low > PIECE:
                    feeds = np.flatnonzero(raw[low : low + PIECE] == 10)
                    if len(feeds):
                        end = low + int(feeds[-1]) + 1
                    else:
                        step = low + PIECE
                        while step < high and not (found := np.flatnonzero(raw[step : step + PIECE] == 10)).size:
                            step += PIECE
                        end = min(high, step + int(found[0]) + 1) if step < high else high
                yield Piece(raw[low:end], np.zeros(1, np.int64), keys[i : i + 1], twins[i : i + 1], np.full(1, line), powers)
                line += int((raw[low:end] == 10).sum())
                low = end
        i = j


def _summed(parts: DataFrame, size: int, *, bits: bool = False) -> np.ndarray:
    """Rows (part, block) of ``size`` numbers each, added by part (or their bits united); its size is fixed by the parts."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for block in batch.column("block"):
                block_ = np.frombuffer(block.as_py(), "<u4")
                total = total | block_ if bits else total + block_
        clipped = np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([clipped], pa.binary())], names=["part", "salt", "block"])

    schema = "part int, salt int, block binary"
    half = parts.select("part", (F.crc32("block") % 16).cast("int").alias("salt"), "block").groupBy("part", "salt").applyInArrow(add, schema)
    whole = half.select("part", F.lit(0).alias("salt"), "block").groupBy("part", "salt").applyInArrow(add, schema)
    rows = whole.collect()
    out = np.zeros((max((r.part for r in rows), default=-1) + 1, size), np.uint32)
    for row in rows:
        out[row.part] = np.frombuffer(row.block, "<u4")
    return out


def word_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The rarity level of each of the word counters over all lines, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts, held, n = _Powers(), np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for piece in _pieces(batch, powers):
                held.append((piece.words & np.uint64(COUNTERS - 1)).view(np.int64))
                n += len(held[-1])
                if n >= COUNTERS:
                    counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, n = [], 0
        counts += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=COUNTERS)
        kept = [(i, c.astype("<u4").tobytes()) for i, c in enumerate(counts.reshape(-1, SLICE)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int32()), pa.array([c for _, c in kept], pa.binary())], names=["part", "block"])

    got = _summed(docs.mapInArrow(run, "part int, block binary"), SLICE)
    counts = np.zeros((COUNTERS // SLICE, SLICE), np.uint32)
    counts[: len(got)] = got
    return np.floor(np.log2(counts.ravel() + 1.0)).astype(np.uint8), int(counts.sum(dtype=np.int64))


def _needed(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Common tokens that sets of n and m tokens need for the threshold."""
    return np.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def entries(piece: Piece, levels: np.ndarray, threshold: float, *, only: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Prefix entries of a piece's lines, the (key, twin, line) of lines that equal an earlier one of the piece, and each entry's line.

    With ``only`` there are entries of the tokens in that table alone.
    """
    token, of, h1, h2 = piece.tokens(levels)
    if not len(token):
        return {name: np.zeros(0, kind) for name, kind in _FIELDS.items()}, np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    n = np.diff(np.r_[start, len(of)])
    mixed = _mixed(token + np.uint64(1))
    sig, sig2 = (np.add.reduceat(_mixed(h), start) for h in (h1, h2))
    order = np.lexsort((piece.twin, piece.line, piece.key, sig2, sig))
    head = np.r_[True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (sig, sig2, n)])]
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    later = np.logical_or.reduce([c[order] != c[lead] for c in (piece.key, piece.line, piece.twin)])
    gone = order[later]
    leads = np.zeros(len(n), bool)
    leads[order[head]] = True
    pos = np.arange(len(of)) - np.repeat(start, n)
    prefix = np.where(leads, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
    keep = pos < np.repeat(prefix, n)
    if only is not None:
        keep &= _marked(only, token)
    # each token flips one bit of its line: the bits in which two lines differ are no more than the tokens in which they do
    bit = mixed & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    b1 = np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), start)
    b2 = np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), one), start)
    line = of[keep]
    values = {"token": token[keep], "key": piece.key[line], "twin": piece.twin[line], "line": piece.line[line], "n": n[line], "pos": pos[keep], "sig": sig[line], "sig2": sig2[line], "b1": b1[line], "b2": b2[line]}
    columns = {name: values[name].astype(kind) for name, kind in _FIELDS.items()}
    return columns, np.column_stack([piece.key[gone], piece.twin[gone], piece.line[gone]]), line


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    raw = b"".join(columns[name].astype(kind).tobytes() for name, kind in _FIELDS.items())
    return zstandard.ZstdCompressor(level=1).compress(len(columns["token"]).to_bytes(8, "little") + raw)


def _unpacked(blocks: list[bytes]) -> dict[str, np.ndarray]:
    parts = []
    for block in blocks:
        raw, at, part = zstandard.ZstdDecompressor().decompress(block), 8, {}
        n = int.from_bytes(raw[:8], "little")
        for name, kind in _FIELDS.items():
            part[name] = np.frombuffer(raw, kind, n, at)
            at += n * np.dtype(kind).itemsize
        parts.append(part)
    return {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind) for name, kind in _FIELDS.items()}


def _dealt(columns: dict[str, np.ndarray], cells: int, hot: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of entries by cell. Tokens that may be hot go to every cell of a grid that holds their line's part."""
    # the level bounds how many lines share a word: it occurs less than 2^(level + 1) times
    most = np.float64(2.0) ** ((columns["token"] >> np.uint64(_HASH_BITS)).astype(float) + 1)
    parts = np.clip(np.ceil(most / (2 * hot)), 1, MOST_PARTS).astype(np.int64)
    cell = (_mixed(columns["token"]) % np.uint64(cells)).astype(np.int64)
    plain = np.flatnonzero(parts == 1)
    rows, at = [plain], [cell[plain]]
    for i in np.flatnonzero(parts > 1).tolist():
        own, count = int(columns["sig"][i] % np.uint64(parts[i])), int(parts[i])
        for other in range(count):
            low, high = min(own, other), max(own, other)
            rows.append(np.array([i]))
            at.append(np.array([cells + (int(cell[i]) * 1_000_003 + low * 8191 + high) % (cells * count)]))
    row, at_ = np.concatenate(rows), np.concatenate(at)
    order = np.lexsort((columns["key"][row], at_))
    row, at_ = row[order], at_[order]
    for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(at_)) + 1):
        if len(some):
            yield int(at_[some[0]]), _packed({name: c[row[some]] for name, c in columns.items()})


def _blocks(docs: DataFrame, levels, cells: int, threshold: float, hot: int, *, probe: bool = False, only=None) -> DataFrame:
    """Rows (kind, cell, block): entries (kind 0, or 1 for probes) and lines gone already (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, gathered, held = _Powers(), [], 0

        def rows(blocks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.int64()), pa.array([b[2] for b in blocks], pa.binary())], schema=_ROW)

        def sent() -> pa.RecordBatch:
            columns = {name: np.concatenate([g[name] for g in gathered]) for name in gathered[0]}
            gathered.clear()
            return rows([(int(probe), cell, block) for cell, block in _dealt(columns, cells, hot)])

        for batch in batches:
            for piece in _pieces(batch, powers):
                found, gone, _ = entries(piece, levels.value, threshold, only=only and only.value)
                if len(gone) and not only:  # else they are known
                    yield rows([(2, -1 - int(piece.key[0] % 997), gone.astype("<i8").tobytes())])
                if len(found["token"]):
                    gathered.append(found)
                    held += len(found["token"])
                if held >= GATHER:
                    yield sent()
                    held = 0
        if gathered:
            yield sent()

    return docs.mapInArrow(run, "kind int, cell long, block binary")


def _order_of(x: dict[str, np.ndarray]) -> np.ndarray:
    """A number for each entry by which lines are ordered: by key, line number and twin."""
    key, twin, line = (x[c] for c in _PLACE)
    if len(key) and not twin.any():
        low, span = int(key.min()), int(line.max()) + 1
        if (int(key.max()) - low + 1) * span < 1 << 62:
            return (key - low) * span + line
    order = np.lexsort((twin, line, key))
    new = np.zeros(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (key, twin, line)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _distance(s: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs pass the positional, length and bitmap filters, and in how many bits they differ."""
    n, m = s["n"][i], s["n"][j]
    need = _needed(n, m, threshold)
    on = np.flatnonzero(np.minimum(n - s["pos"][i], m - s["pos"][j]) >= need)
    spare = (n + m - 2 * need)[on]
    i, j = i[on], j[on]
    bits = np.bitwise_count(s["b1"][i] ^ s["b1"][j]).astype(np.int64) + np.bitwise_count(s["b2"][i] ^ s["b2"][j])
    near = bits <= spare
    return on[near], bits[near]


def _nearest(later: np.ndarray, earlier: np.ndarray, bits: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each later entry the ``few`` of least difference; of each pair, whether the entry had more."""
    order = np.lexsort((earlier, bits, later))
    later, earlier = later[order], earlier[order]
    start = np.flatnonzero(np.r_[True, later[1:] != later[:-1]]) if len(later) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(later)])
    keep = np.arange(len(later)) - np.repeat(start, size) < few
    return later[keep], earlier[keep], np.repeat(size > few, size)[keep]


def _ranges(start: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, start[i] + 0 ... size[i] - 1), about ``most`` at a time."""
    done = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + most, "right")))
        some = size[i:j]
        of = np.repeat(np.arange(i, j), some)
        yield of, np.arange(len(of)) - np.repeat(np.cumsum(some) - some, some) + start[of]
        i = j


def _scanned(s: dict[str, np.ndarray], threshold: float, few: int, parted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of entries that may be similar, and whether the later one may have others; entries are ordered by group and length."""
    group, n, pos, place = (s[c] for c in ("group", "n", "pos", "place"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def met(i: np.ndarray, j: np.ndarray, parts: list) -> None:
        on, bits = _distance(s, i, j, threshold)
        i, j = i[on], j[on]
        swap = place[i] < place[j]
        other = place[i] != place[j]
        parts.append(tuple(c[other] for c in (np.where(swap, j, i), np.where(swap, i, j), bits)))

    span = int(n.max()) + 2 if len(n) else 1
    at = group * span + n
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    # the greatest length of lines that the entry's position still allows
    most = s["most"] = np.minimum(np.floor((n - pos + 1e-9) * ((1 + threshold) / threshold)).astype(np.int64) - n, span - 1)
    large = np.repeat(sizes > parted, sizes)
    plain = np.flatnonzero(~large & (most >= n))
    high = np.searchsorted(at, group[plain] * span + most[plain], "right")
    held: list = []
    for i, j in _ranges(plain + 1, high - plain - 1, _PAIRS):
        met(plain[i], j, held)
    if held:
        out.append(_nearest(*map(np.concatenate, zip(*held, strict=True)), few))
    for a, size in zip(starts[sizes > parted].tolist(), sizes[sizes > parted].tolist(), strict=True):
        out += _led(s, np.arange(a, a + size), threshold, few, met)
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _led(s: dict[str, np.ndarray], rows: np.ndarray, threshold: float, few: int, met) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a large group: its earliest open lines meet all others; lines that they may be similar to are settled with these pairs.

    As long as that settles a tenth of the open lines it goes on; the rest then meet all earlier lines of near length.
    """
    n, place, b1, b2, most = (s[c][rows] for c in ("n", "place", "b1", "b2", "most"))
    open_ = np.ones(len(rows), bool)

    def search(some: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.searchsorted(n, np.ceil(threshold * n[some] - 1e-9), "left")
        high = np.maximum(low, np.searchsorted(n, np.minimum(np.floor((n[some] + 1e-9) / threshold), most[some]), "right"))
        longest = n[high - 1]
        spare = n[some] + longest - 2 * _needed(n[some], longest, threshold) + 1  # that of no pair of these lengths is greater
        held, near, size = [(np.zeros(0, np.int64),) * 3], [], 0

        def flush() -> None:
            i, j = (np.concatenate(c) for c in zip(*near, strict=True))
            met(rows[i], rows[j], held)
            near.clear()

        for i, a, b, differ in zip(some.tolist(), low.tolist(), high.tolist(), spare.tolist(), strict=True):
            j = a + np.flatnonzero(np.bitwise_count(b1[a:b] ^ b1[i]) + np.bitwise_count(b2[a:b] ^ b2[i]) <= differ)
            j = j[wanted(i, j)]
            near.append((np.full(len(j), i), j))
            size += len(j)
            if size >= _PAIRS:
                flush()
                size = 0
        if near:
            flush()
        return tuple(map(np.concatenate, zip(*held, strict=True)))

    while open_.sum() > _LEADERS:
        left = np.flatnonzero(open_)
        lead = left[np.argpartition(place[left], _LEADERS)[:_LEADERS]]
        leads = np.zeros(len(rows), bool)
        leads[lead] = True
        # a leader meets all earlier lines and all other open ones, which are later
        later, earlier, bits = search(lead, lambda a, b: (place[b] < place[a]) | (open_[b] & ~leads[b]))
        own = leads[later - rows[0]]
        yield _nearest(later[own], earlier[own], bits[own], few)
        open_[lead] = False
        near = ~own & open_[later - rows[0]]
        found = _nearest(later[near], earlier[near], bits[near], few)
        yield found[0], found[1], np.ones(len(found[0]), bool)
        open_[found[0] - rows[0]] = False
        if len(np.unique(found[0])) < len(left) // 10:
            break
    yield _nearest(*search(np.flatnonzero(open_), lambda a, b: place[b] < place[a]), few)


#: Pairs held at a time, lines of a large group that lead at a time.
_PAIRS, _LEADERS = 1 << 20, 16


def joined(x: dict[str, np.ndarray], threshold: float, few: int, parted: int = 2_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell's entries: rows gone as equal sets; later and earlier rows of pairs; whether the later may have other pairs."""
    order = np.argsort(x["token"])
    token = x["token"][order]
    alone = np.r_[True, token[1:] != token[:-1]] & np.r_[token[1:] != token[:-1], True]
    order = order[~alone[: len(order)]]  # many tokens occur in one line and are done
    if not len(order):
        return order, order, order, np.zeros(0, bool)
    token = x["token"][order]
    group = np.cumsum(np.r_[True, token[1:] != token[:-1]])
    # of equal sets the earliest goes on; that two sets part a run of equal ones costs time alone
    room = np.uint64(64 - int(group[-1]).bit_length())
    by_set = np.argsort((group.astype(np.uint64) << room) | (x["sig"][order] >> (np.uint64(64) - room)))
    order, group = order[by_set], group[by_set]
    s = {c: x[c][order] for c in ("sig", "sig2", "n")}
    place = _order_of(x)[order]
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | np.logical_or.reduce([c[1:] != c[:-1] for c in s.values()])])
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
    first = np.minimum.reduceat(place, start)[run] == place
    gone = order[~first & (x["pos"][order] == 0)]
    lead = np.flatnonzero(first)
    lead = lead[np.r_[True, run[lead][1:] != run[lead][:-1]]]
    order, group, place = order[lead], group[lead], place[lead]
    size = np.bincount(group)[group]
    order, group, place = order[size > 1], group[size > 1], place[size > 1]
    n = x["n"][order].astype(np.int64)
    by_length = np.argsort(group * (int(n.max(initial=0)) + 1) + n)
    order = order[by_length]
    s = {"group": group[by_length], "place": place[by_length], "n": n[by_length], "pos": x["pos"][order].astype(np.int64), "b1": x["b1"][order], "b2": x["b2"][order]}
    later, earlier, more = _scanned(s, threshold, few, parted)
    return gone, order[later], order[earlier], more


def _probed(x: dict[str, np.ndarray], probe: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of probes and of all earlier entries of their tokens that may be similar."""
    place = _order_of(x)
    plain, asked = np.flatnonzero(~probe), np.flatnonzero(probe)
    plain = plain[np.lexsort((place[plain], x["token"][plain]))]
    tokens, places = x["token"][plain], place[plain]
    low, high = (np.searchsorted(tokens, x["token"][asked], side) for side in ("left", "right"))
    size = np.array([np.searchsorted(places[a:b], place[i], "left") for i, a, b in zip(asked.tolist(), low.tolist(), high.tolist(), strict=True)], np.int64)
    s = {c: x[c].astype(np.int64) if c in ("n", "pos") else x[c] for c in ("n", "pos", "b1", "b2")}
    found = [(np.zeros(0, np.int64),) * 2]
    for of, at in _ranges(low, size, _PAIRS):
        i, j = asked[of], plain[at]
        near = np.minimum(s["n"][i], s["n"][j]) >= threshold * np.maximum(s["n"][i], s["n"][j]) - 1e-9
        i, j = i[near], j[near]
        on, _ = _distance(s, i, j, threshold)
        found.append((i[on], j[on]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _matched(blocks: DataFrame, threshold: float, few: int, *, probing: bool = False) -> DataFrame:
    """Rows of ``_FOUND``: lines gone and pairs to verify. When ``probing``, entries meet probes only."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, raws = [], []
        for batch in batches:
            kinds += batch.column("kind").to_pylist()
            raws += batch.column("block").to_pylist()
        names = ["kind", "key", "twin", "line", "key2", "twin2", "line2"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.int64(), pa.int64(), pa.int32()]

        def out(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            columns = [kind, *a.T, *b.T]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)).cast(t) for c, t in zip(columns, types, strict=True)], names=names)

        local = [np.frombuffer(r, "<i8").reshape(-1, 3) for k, r in zip(kinds, raws, strict=True) if k == 2]
        for part in local:
            yield out(np.full(len(part), GONE), part, np.zeros_like(part))
        blocks_ = [(k, r) for k, r in zip(kinds, raws, strict=True) if k < 2]
        if not blocks_:
            return
        place = lambda x, i: np.column_stack([x["key"][i], x["twin"][i], x["line"][i].astype(np.int64)])
        plain, probes = ([r for k, r in blocks_ if k == want] for want in (0, 1))
        if probes:
            parts = [_unpacked(plain), _unpacked(probes)]
            x = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
            probe = np.arange(len(x["key"])) >= len(parts[0]["key"])
            a, b = _probed(x, probe, threshold)
            yield out(np.full(len(a), PAIR), place(x, a), place(x, b))
            return
        if probing:
            return
        del kinds, raws, blocks_
        x = _unpacked(plain)
        del plain
        gone, a, b, more = joined(x, threshold, few)
        yield out(np.full(len(gone), GONE), place(x, gone), np.zeros((len(gone), 3), np.int64))
        yield out(np.where(more, CUT_PAIR, PAIR), place(x, a), place(x, b))

    return blocks.groupBy("cell").applyInArrow(run, _FOUND)


def similar(a: bytes, b: bytes, threshold: float) -> bool:
    x, y = set(words_of(a)), set(words_of(b))
    return len(x & y) >= math.ceil((len(x) + len(y)) * threshold / (1 + threshold) - 1e-9)


_PLACE = ["key", "twin", "line"]


def _place_hash(key: np.ndarray, twin: np.ndarray, line: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(key.view(np.uint64) * np.uint64(_BASE) + twin.view(np.uint64)) + line.astype(np.uint64))


#: Bits in a table of marks that is sent to executors: sixteen for each mark, within these bounds.
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 26


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the table of marks may hold the hashes; it holds all that were put in."""
    slot = hashes & np.uint64(32 * len(marks) - 1)
    return (marks[(slot >> np.uint64(5)).view(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def _marks(rows: DataFrame, count: int, hashes) -> np.ndarray:
    """The table of marks of what ``hashes`` gives for batches of the rows."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            for some in hashes(batch):
                held[(some & np.uint64(bits - 1)).view(np.int64)] = True
        words = np.packbits(held, bitorder="little").view("<u4").reshape(-1, SLICE)
        kept = [(i, w.tobytes()) for i, w in enumerate(words) if w.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int32()), pa.array([w for _, w in kept], pa.binary())], names=["part", "block"])

    got = _summed(rows.mapInArrow(run, "part int, block binary"), SLICE, bits=True)
    out = np.zeros((bits // 32 // SLICE, SLICE), np.uint32)
    out[: len(got)] = got
    return out.ravel()


def _asked_places(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
    for i in (0, 3):
        yield _place_hash(*columns[i : i + 3])


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (key, twin, line, text) of at least the lines that pairs name.

    A table of marks of bounded size lets documents be read where they lie, without a shuffle of their texts.
    """
    marks = _marks(pairs.select(*_PLACE, "key2", "twin2", "line2"), 2 * pairs.count(), _asked_places)
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, twins = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            offsets, raw = _bytes_of(batch.column(2))
            low, n = int(offsets[0]), len(offsets) - 1
            feeds = np.flatnonzero(raw[low : int(offsets[-1])] == 10) + low
            of = np.searchsorted(offsets, feeds, "right") - 1
            # the first line of each text, then those after a line feed
            doc = np.r_[np.arange(n), of]
            number = np.r_[np.zeros(n, np.int64), np.arange(len(feeds)) - np.searchsorted(feeds, offsets[of]) + 1]
            begin = np.r_[offsets[:-1], feeds + 1]
            take = np.flatnonzero(_marked(sent.value, _place_hash(keys[doc], twins[doc], number)))
            doc, number, begin = doc[take], number[take], begin[take]
            after = np.searchsorted(feeds, begin)
            end = np.minimum(offsets[doc + 1], np.r_[feeds, offsets[-1]][after])
            texts = [raw[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), pa.array(twins[doc]), pa.array(number, pa.int32()), pa.array(texts, pa.binary())], names=[*_PLACE, "text"])

    return written(docs.select("key", "twin", "text").mapInArrow(run, "key long, twin long, line int, text binary").dropDuplicates(_PLACE), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The distinct later lines of the pairs whose words confirm the similarity."""
    two = texts.select(*[F.col(c).alias(f"{c}2") for c in [*_PLACE, "text"]])
    both = pairs.join(texts, _PLACE).join(two, ["key2", "twin2", "line2"]).select(*_PLACE, "text", "text2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(a, b, threshold) for a, b in zip(as_bytes(batch.column(3)), as_bytes(batch.column(4)), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=_PLACE).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "key long, twin long, line int").distinct()


def _identity(df: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """A row's place in the order, and what tells rows of equal place apart: their text, or 0 if there are none."""
    order = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    repeated = not df.groupBy(order.alias("key")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return order, F.coalesce(F.xxhash64(F.col(text)), F.lit(0)) if repeated else F.lit(0).cast("long")


def removed_lines(df: DataFrame, order: Column, twin: Column, text: str, *, threshold: float = THRESHOLD, few: int = FEW, hot: int = HOT, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Rows (key, twin, removed): the sorted numbers, from 0, of the lines to remove, where there are any."""
    spark = df.sparkSession
    modest_batches(spark)
    docs = df.where(F.col(text).isNotNull()).select(order.alias("key"), twin.alias("twin"), F.col(text).alias("text"), F.lit(0).alias("first"))
    levels, words = word_counts(docs)
    sent = spark.sparkContext.broadcast(levels)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # about one word in four begins a prefix token; tasks follow the input where the session's number is too small for it
    cells, tasks = (max(least, math.ceil(words / 4 / size)) for size in (CELL, TASK))
    found = written(_matched(_blocks(docs, sent, cells, threshold, hot).repartition(tasks, "cell"), threshold, few), "found")
    pairs = found.where(f"kind != {GONE}")
    texts = _texts(docs, pairs)
    alike = written(_verified(pairs.drop("kind").distinct(), texts, threshold), "similar")
    gone = found.where(f"kind = {GONE}").select(*_PLACE).union(alike)
    missed = found.where(f"kind = {CUT_PAIR}").select(*_PLACE).distinct().join(alike, _PLACE, "left_anti")
    missed = written(missed.join(texts, _PLACE).select("key", "twin", F.col("text").cast("string").alias("text"), F.col("line").alias("first")), "missed")
    facts = missed.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    many = facts.n
    if many and facts.bytes <= sent_bytes:  # their words cleared them of all lines that they were given: all lines meet them where they lie
        gone = gone.union(written(_met_again(docs, missed, sent, threshold), "again"))
    elif many:  # or search all lines again that share a token
        only = spark.sparkContext.broadcast(_prefix_marks(missed, sent, many, threshold))
        blocks = [_blocks(x, sent, cells, threshold, hot, probe=probe, only=only) for x, probe in ((missed, True), (docs, False))]
        again = written(_matched(blocks[0].union(blocks[1]).repartition(tasks, "cell"), threshold, few, probing=True).drop("kind").distinct(), "again")
        gone = gone.union(_verified(again, _texts(docs, again), threshold))
    return gone.groupBy("key", "twin").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _met_again(docs: DataFrame, missed: DataFrame, levels, threshold: float) -> DataFrame:
    """Places of those of the few ``missed`` lines that some earlier line is similar to; they are sent to all tasks."""
    batches = missed.toArrow().combine_chunks().to_batches()
    pieces = [p for batch in batches for p in _pieces(batch, _Powers())]
    probes, texts = {name: [] for name in _FIELDS} | {"text": []}, []
    for piece in pieces:
        found, _, line = entries(piece, levels.value, threshold)
        for name in _FIELDS:
            probes[name].append(found[name])
        probes["text"].append(len(texts) + line)
        texts += [piece.text(i) for i in range(len(piece.key))]
    asked = {name: np.concatenate(columns) for name, columns in probes.items()}
    order = np.argsort(asked["token"], kind="stable")
    asked = {name: c[order] for name, c in asked.items()}
    marks = np.zeros(_LEAST_BITS, bool)
    marks[(asked["token"] & np.uint64(_LEAST_BITS - 1)).view(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast((asked, texts, np.packbits(marks, bitorder="little").view(np.uint32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, texts, marks = sent.value
        powers, done = _Powers(), set()
        n = len(asked["token"])
        for batch in batches:
            for piece in _pieces(batch, powers):
                x, _, line = entries(piece, levels.value, threshold, only=marks)
                both = {c: np.concatenate([asked[c], x[c]]) for c in _FIELDS}
                place = _order_of(both)
                s = {c: both[c].astype(np.int64) if c in ("n", "pos") else both[c] for c in ("n", "pos", "b1", "b2")}
                low, high = (np.searchsorted(asked["token"], x["token"], side) for side in ("left", "right"))
                for of, i in _ranges(low, high - low, _PAIRS):
                    j = of + n
                    on = (place[j] < place[i]) & (np.minimum(s["n"][i], s["n"][j]) >= threshold * np.maximum(s["n"][i], s["n"][j]) - 1e-9)
                    of, i, j = of[on], i[on], j[on]
                    near, _ = _distance(s, i, j, threshold)
                    for a, b in np.unique(np.column_stack([i[near], line[of[near]]]), axis=0).tolist():
                        at = tuple(int(asked[c][a]) for c in _PLACE)
                        if at not in done and similar(texts[asked["text"][a]], piece.text(b), threshold):
                            done.add(at)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=_PLACE)

    return docs.mapInArrow(run, "key long, twin long, line int").distinct()


def _prefix_marks(lines: DataFrame, levels, count: int, threshold: float) -> np.ndarray:
    """The table of marks of the lines' prefix tokens."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for piece in _pieces(batch, _Powers()):
            yield entries(piece, levels.value, threshold)[0]["token"]

    return _marks(lines, 16 * count, hashes)


def deduplicated(df: DataFrame, key: str, text: str, *, threshold: float = THRESHOLD, few: int = FEW, hot: int = HOT, sent_bytes: int = SENT_BYTES, changed: str | None = None) -> DataFrame:
    """The rows and columns of ``df`` with removed lines cut out of ``text``.

    With ``changed`` a column of that name tells whether a row has lost a line.
    """
    order, twin = _identity(df, key, text)
    gone = written(removed_lines(df, order, twin, text, threshold=threshold, few=few, hot=hot, sent_bytes=sent_bytes), "removed")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), order.alias("key"), twin.alias("twin"))
    cut = F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    joined_ = rows.join(gone, ["key", "twin"], "left")
    told = [F.col("removed").isNotNull().alias(changed)] if changed else []
    return joined_.select(*[(F.when(F.col("removed").isNull(), F.col("row")[c]).otherwise(cut) if c == text else F.col("row")[c]).alias(c) for c in df.columns], *told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    order, twin = _identity(documents, "doc_id", "text")
    gone = removed_lines(documents, order, twin, "text")
    counted = documents.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), order.alias("key"), twin.alias("twin"))
    return counted.join(gone, ["key", "twin"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines")
    )


SQL = r"""
WITH l AS (
  SELECT r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, unnest(range(len(ls))) AS i, unnest(ls) AS t
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), s AS (
  SELECT r, k, i, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws FROM l
), x AS (
  SELECT r, k, i, len(ws) AS n, unnest(ws) AS w FROM s WHERE len(ws) > 0
), o AS (
  SELECT x.*, row_number() OVER (PARTITION BY r, i ORDER BY c, w) AS pos FROM x JOIN (SELECT w, count(*) AS c FROM x GROUP BY w) USING (w)
), p AS (
  SELECT * FROM o WHERE pos <= n - (4 * n + 4) // 5 + 1
), c AS (
  SELECT DISTINCT a.r, a.i, b.r AS r2, b.i AS i2
  FROM p AS a JOIN p AS b ON a.w = b.w AND (b.k < a.k OR (b.k = a.k AND b.i < a.i)) AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), g AS (
  SELECT DISTINCT c.r, c.i FROM c JOIN s AS a ON a.r = c.r AND a.i = c.i JOIN s AS b ON b.r = c.r2 AND b.i = c.i2
  WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (len(a.ws) + len(b.ws))
)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY g.i), '') AS removed_lines
FROM l LEFT JOIN g ON g.r = l.r AND g.i = l.i GROUP BY l.r
"""


def brute_force(rows: list[tuple[int | None, str | None]], threshold: float = THRESHOLD) -> list[list[int]]:
    """The removed line numbers of each row, by comparing all lines; for tests."""
    twin = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    place = lambda k, t, i: (LAST if k is None else k, i, twin(t))
    lines = [(place(k, t, i), x.encode()) for k, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    sets = [(p, line, set(words_of(line))) for p, line in lines]
    gone = {p for p, a, s in sets if s and any(q < p and r and s & r and similar(a, b, threshold) for q, b, r in sets)}
    return [[] if t is None else [i for i, _ in enumerate(t.split("\n")) if place(k, t, i) in gone] for k, t in rows]
