"""Hybrid scores of batches of chunks, and the mergeable lists of rows that selection can take.

A batch of chunks meets all questions of a tile at once: vectors in one matrix product, shared tokens in one count over
number-coded words. Of a question's pairs only those stay that some pass of the selection can still take, in lists that
merge: the lists of a union are the lists of what the parts kept. So a task sends a number of rows that
depends on the settings alone, however many sources the chunks have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators import grid
from lodestone.settings import Settings
from lodestone.sources.shared import checkpoint

DEFAULTS = Settings()
#: Matches of words and questions that are counted at a time.
_MATCHES = 1 << 20
#: Bytes of questions whose lists a task holds; of more, tiles of so many meet tiles of chunks.
HELD_BYTES = 4 << 20
#: Tasks whose rows of a question are merged together before it is selected from, and buckets of questions for each shuffle partition.
MERGED, BUCKETS = 64, 16


# --- scores of a batch -----------------------------------------------------------------------------------------------
class TokenSets:
    """Sets of words, asked how many of their words a chunk's vocabulary holds."""

    def __init__(self, sets: Sequence[Sequence[str]]) -> None:
        own = [sorted(set(s or ())) for s in sets]
        words = sorted({w for s in own for w in s})
        number = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        self.sizes = np.array([len(s) for s in own], np.int64)
        pairs = np.array([(number[w], i) for i, s in enumerate(own) for w in s], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.sets, self.begins = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))

    def shares(self, vocabularies: pa.ListArray) -> np.ndarray:
        """The share of each set's words in each vocabulary, whose words are distinct: sets x chunks, 0 for empty sets."""
        n, out = len(vocabularies), np.zeros((len(self.sizes), len(vocabularies)))
        if not len(self.words) or not n:
            return out
        lengths = pc.fill_null(pc.list_value_length(vocabularies), 0).to_numpy(zero_copy_only=False)
        found = pc.index_in(vocabularies.flatten(), value_set=self.words)
        chunk = np.repeat(np.arange(n), lengths)[pc.is_valid(found).to_numpy(zero_copy_only=False)]
        word = found.drop_null().to_numpy()
        times = self.begins[word + 1] - self.begins[word]
        done = np.r_[0, np.cumsum(times)]
        i = 0
        while i < len(word):
            j = max(i + 1, int(np.searchsorted(done, done[i] + _MATCHES, "right")) - 1)
            own = np.repeat(np.arange(i, j), times[i:j])
            at = self.sets[self.begins[word[own]] + np.arange(len(own)) - (done[own] - done[i])]
            out += np.bincount(at * n + chunk[own], minlength=out.size).reshape(out.shape)
            i = j
        return out / np.maximum(self.sizes, 1)[:, None]


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers of one width as rows; others, and nulls, as zeros."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width))
    ends = np.cumsum(lengths)
    for i in np.flatnonzero(lengths == width).tolist():
        out[i] = flat[ends[i] - width : ends[i]]
    return out


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks() if column.num_chunks else pa.array([], column.type)


def _bits(lists: pa.ListArray, names: Sequence[str]) -> np.ndarray:
    """Sets of names as bits."""
    out = np.zeros(len(lists), np.int64)
    if len(lists) and names:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        found = pc.index_in(lists.flatten(), value_set=pa.array(names, pa.string()))
        known = pc.is_valid(found).to_numpy(zero_copy_only=False)
        np.bitwise_or.at(out, np.repeat(np.arange(len(lists)), lengths)[known], np.int64(1) << found.drop_null().to_numpy().astype(np.int64))
    return out


class Scorer:
    """Scores of all pairs of a tile's questions and a batch of chunks.

    ``questions`` has query_id, vectors, tokens, qmodes, most (its greatest overlap with any chunk), clauses and extras as
    ``answer.prepared`` makes them; chunks chunk_id, source, embedding, vocab and cmodes.
    """

    def __init__(self, questions: pa.Table, modes: Sequence[str], settings: Settings = DEFAULTS, strict: str = "acan") -> None:
        rows = questions.to_pylist()
        self.settings, self.modes, self.strict = settings, list(modes), strict
        self.ids = [r["query_id"] for r in rows]
        self.asked_modes = [sorted(r["qmodes"] or ()) for r in rows]
        self.qbits = _bits(pa.array(self.asked_modes, pa.list_(pa.string())), self.modes)
        self.most = np.array([r.get("most") or 0.0 for r in rows])
        vectors, sets = [], []
        #: Of each question where its variants begin and end, and of each clause and extra: (vector, own words, words beside).
        self.variants, self.clauses, self.extras = [], [], []
        for r in rows:
            self.variants.append(len(vectors))
            vectors += r["vectors"]
        self.questions = len(rows)
        sets += [r["tokens"] for r in rows]
        for r in rows:
            for name, held in (("clauses", self.clauses), ("extras", self.extras)):
                parts = []
                for x in r.get(name) or ():
                    parts.append((len(vectors), len(sets), len(sets) + 1))
                    vectors.append(x["embedding"])
                    sets += [x["tokens"], x.get("beside") or ()]
                held.append(parts)
        self.n_variants = self.variants[-1] + len(rows[-1]["vectors"]) if rows else 0
        self.width = len(vectors[0]) if vectors else 0
        self.vectors = np.array(vectors, float).reshape(-1, max(1, self.width))
        self.sets = TokenSets(sets)

    def scores(self, chunks: pa.Table) -> dict[str, np.ndarray]:
        """dense, overlap, lexical, adjustment, score, late and matched, questions x chunks; clauses and expansions as lists of rows."""
        settings, n = self.settings, self.questions
        near = (self.vectors @ matrix(_column(chunks, "embedding"), self.width).T + 1) / 2
        dense = np.maximum.reduceat(near[: self.n_variants], self.variants, axis=0)
        shares = self.sets.shares(_column(chunks, "vocab"))
        overlap = shares[:n]
        lexical = np.where(self.most[:, None] > 0, overlap / np.where(self.most > 0, self.most, 1)[:, None], overlap)
        cbits = _bits(_column(chunks, "cmodes"), self.modes)
        matched = (self.qbits[:, None] & cbits) != 0
        strict = np.int64(1 << self.modes.index(self.strict)) if self.strict in self.modes else np.int64(0)
        unwelcome = np.where((cbits & strict) != 0, -settings.acan_mismatch_penalty, np.where(cbits != 0, -settings.mode_mismatch_penalty, 0.0))
        broad = np.where(np.bitwise_count(self.qbits) >= 2, 0.4, 1.0)[:, None]
        unwelcome = np.where((cbits & strict) != 0, unwelcome, unwelcome * broad)
        adjustment = np.where(self.qbits[:, None] == 0, 0.0, np.where(matched, settings.mode_match_bonus, unwelcome))
        weight = min(1.0, max(0.0, settings.retrieval_alpha))
        score, late = weight * dense + (1 - weight) * lexical, np.zeros(dense.shape, bool)
        if settings.enable_mode_routing:
            score = np.clip(score + adjustment, 0.0, 1.0)
            late = ((cbits & strict) != 0) & ((self.qbits & strict) == 0)[:, None]
        clauses, expansions = [], []
        for q in range(n):
            clauses.append([np.where(shares[w] >= settings.clause_min_overlap, 0.75 * shares[w] + 0.25 * near[v] + 0.1 * shares[b], np.nan) for v, w, b in self.clauses[q]])
            expansions.append([np.where(shares[w] >= settings.expansion_min_overlap, 0.55 * shares[w] + 0.35 * near[v] + np.where(matched[q], 0.08, 0.0), np.nan) for v, w, _ in self.extras[q]])
        return {"dense": dense, "overlap": overlap, "lexical": lexical, "adjustment": adjustment, "score": score, "late": late, "matched": matched, "modes": self.qbits[:, None] & cbits, "clauses": clauses, "expansions": expansions}


# --- lists that merge --------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Lists:
    """Which rows of a question selection can take, even if the scores of its ``pool`` best rows still change.

    The pool; of the rest, of late and of other rows: the ``pool + 2k`` best, and of those that are among the ``cap`` best of their source the 3k
    best (at most k rows are taken before, and at most k more stand in sources that are full); of each mode and coverage value (null
    where its pass refuses the row; of matching rows apart) the first ``pool + 2k + 1``.
    """

    k: int
    cap: int
    pool: int
    modes: int = 0

    def kept(self, rows: dict[str, np.ndarray], values: Sequence[np.ndarray] = (), *, ordered: bool = False) -> np.ndarray:
        """The rows (key, source, score, late, matched, modes as bits) to keep, ascending; ``ordered`` says that keys ascend."""
        score = rows["score"]
        place = np.arange(len(score))
        if not ordered:
            place[np.argsort(rows["key"], kind="stable")] = np.arange(len(score))
        order = np.lexsort((place, -score))
        keep = np.zeros(len(score), bool)
        keep[order[: self.pool]] = True
        rest = order[self.pool :]
        for late in (False, True):
            some = rest[rows["late"][rest] == late]
            keep[some[: self.pool + 2 * self.k]] = True
            keep[some[_nth(rows["source"][some]) < self.cap][: 3 * self.k]] = True
        each = self.pool + 2 * self.k + 1
        for bit in range(self.modes):
            keep[order[(rows["modes"][order] >> bit) & 1 > 0][:each]] = True
        for value in values:
            by_value = np.lexsort((place, -np.where(np.isnan(value), -np.inf, value)))
            by_value = by_value[~np.isnan(value[by_value])]
            keep[by_value[:each]] = True
            keep[by_value[rows["matched"][by_value]][:each]] = True
        return np.flatnonzero(keep)

    def least(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """Scores under which other rows and late rows come into no list that goes by the score alone."""
        out = np.full(2, -np.inf)
        order = np.argsort(-rows["score"], kind="stable")[self.pool :]
        for late in (0, 1):
            some = order[rows["late"][order] == bool(late)]
            capped = some[_nth(rows["source"][some]) < self.cap]
            if len(some) >= self.pool + 2 * self.k and len(capped) >= 3 * self.k:
                out[late] = min(rows["score"][some[self.pool + 2 * self.k - 1]], rows["score"][capped[3 * self.k - 1]])
        return out


def _nth(groups: np.ndarray) -> np.ndarray:
    """Of each value how often it stands before."""
    codes = pd.factorize(groups, use_na_sentinel=False)[0]
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    out = np.empty(len(codes), np.int64)
    out[order] = np.arange(len(codes)) - np.repeat(begins, np.diff(np.r_[begins, len(codes)]))
    return out


#: Shares of the score in a coverage pass's value.
SHARES = {"clauses": 0.05, "expansions": 0.1}
_HELD = ("key", "source", "dense", "overlap", "score", "late", "matched", "modes")


@dataclass
class Candidates:
    """Keeps of all batches the rows of each question that its lists hold."""

    scorer: Scorer
    lists: Lists
    key: pa.DataType
    source: pa.DataType
    digits: int | None = None
    held: list[dict] = field(default_factory=list)

    @property
    def at_once(self) -> int:
        return grid.at_once(max(len(self.scorer.vectors), len(self.scorer.sets.sizes)))

    def add(self, chunks: pa.Table) -> None:
        if not self.scorer.questions:
            return
        chunks = chunks.sort_by("chunk_id")
        found = self.scorer.scores(chunks)
        if self.digits is not None:
            found["score"] = np.round(found["score"], self.digits)
        keys, sources = (np.array(_column(chunks, c).to_pylist(), object) for c in ("chunk_id", "source"))
        codes = pd.factorize(sources, use_na_sentinel=False)[0]
        for q in range(self.scorer.questions):
            values = np.array([*found["clauses"][q], *found["expansions"][q]]).reshape(-1, len(keys))
            wanted = np.ones(len(keys), bool)
            if len(self.held) > q:
                wanted = found["score"][q] >= self.held[q]["least"][found["late"][q].astype(int)]
                if len(values):
                    wanted |= ~np.isnan(values).all(0)
                if self.lists.modes:
                    wanted |= found["modes"][q] != 0
            at = np.flatnonzero(wanted)
            own = {"source": codes[at], **{c: found[c][q][at] for c in ("score", "late", "matched", "modes")}}
            at = at[self.lists.kept(own, self._totals(q, values[:, at], own["score"]), ordered=True)]
            self._merge(q, {"key": keys[at], "source": sources[at], **{c: found[c][q][at] for c in _HELD[2:]}, "values": values[:, at]})

    def _totals(self, q: int, values: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
        """What the coverage passes go by: their parts and their shares of the score."""
        n_clauses = len(self.scorer.clauses[q])
        return [v + SHARES["clauses" if i < n_clauses else "expansions"] * score for i, v in enumerate(values)]

    def _merge(self, q: int, rows: dict[str, np.ndarray]) -> None:
        if len(self.held) > q:
            old = self.held[q]
            if not len(rows["key"]):
                return
            rows = {c: np.concatenate([old[c], rows[c]], axis=-1) for c in rows}
            keep = self.lists.kept(rows, self._totals(q, rows["values"], rows["score"]))
            rows = {c: v[..., keep] for c, v in rows.items()}
        rows["least"] = self.lists.least(rows)
        if len(self.held) > q:
            self.held[q] = rows
        else:
            self.held.append(rows)

    def rows(self) -> pa.Table:
        s, counts = self.scorer, [len(h["key"]) for h in self.held]
        of = np.repeat(np.arange(len(counts)), counts)
        flat = {c: np.concatenate([h[c] for h in self.held]) if counts else np.zeros(0, object) for c in _HELD}
        names = [[s.modes[b] for b in range(len(s.modes)) if m >> b & 1] for m in flat["modes"].tolist()]
        parts = {"clauses": [], "expansions": []}
        for q, h in enumerate(self.held):
            n = len(s.clauses[q])
            for name, some in (("clauses", h["values"][:n]), ("expansions", h["values"][n:])):
                parts[name] += [[None if np.isnan(x) else x for x in row] for row in some.T.tolist()] if len(some) else [[]] * len(h["key"])
        numbers = lambda c: pa.array(flat[c].astype(float))
        strings = pa.list_(pa.string())
        columns = {
            "query_id": pa.array([s.ids[i] for i in of.tolist()]), "chunk_id": pa.array(flat["key"].tolist(), self.key), "source": pa.array(flat["source"].tolist(), self.source),
            "dense": numbers("dense"), "overlap": numbers("overlap"), "score": numbers("score"), "late": pa.array(flat["late"].astype(bool)), "matched": pa.array(flat["matched"].astype(bool)),
            "modes": pa.array(names, strings), "query_modes": pa.array([s.asked_modes[i] for i in of.tolist()], strings),
            "clauses": pa.array(parts["clauses"], pa.list_(pa.float64())), "expansions": pa.array(parts["expansions"], pa.list_(pa.float64())),
        }
        return pa.table(columns)


_ROW = "source {source}, dense double, overlap double, score double, late boolean, matched boolean, modes array<string>, query_modes array<string>, clauses array<double>, expansions array<double>"


def _kinds(chunks: DataFrame, questions: DataFrame) -> dict[str, str]:
    kind = {f.name: f.dataType.simpleString() for f in (*chunks.schema.fields, *questions.schema.fields)}
    return {"chunk_id": kind["chunk_id"], "source": kind["source"], "query_id": kind["query_id"]}


def asked(questions: DataFrame) -> DataFrame:
    """The columns of questions that scoring needs; what is missing is empty. They are read twice, to be summed and to be sent, so they are kept first."""
    none = {"most": "double", "qmodes": "array<string>", "tokens": "array<string>", "clauses": "array<struct<tokens:array<string>,embedding:array<float>,beside:array<string>>>", "extras": "array<struct<tokens:array<string>,embedding:array<float>,beside:array<string>>>"}
    have = set(questions.columns)
    return questions.select("query_id", "vectors", *[c if c in have else F.lit(None).cast(kind).alias(c) for c, kind in none.items()]).where(F.size("vectors") > 0)


def greatest_overlaps(chunks: DataFrame, questions: DataFrame, *, limit: int = grid.MAX_BROADCAST_BYTES) -> DataFrame:
    """(query_id, most): the greatest share of a question's tokens in any chunk's vocabulary; a task sends one row a question."""

    class Most:
        def __init__(self, table: pa.Table) -> None:
            self.ids = _column(table, "query_id")
            self.sets = TokenSets(_column(table, "tokens").to_pylist())
            self.most = np.zeros(len(self.ids))
            self.at_once = grid.at_once(len(self.ids))

        def add(self, table: pa.Table) -> None:
            self.most = np.maximum(self.most, self.sets.shares(_column(table, "vocab")).max(1, initial=0.0))

        def rows(self) -> pa.Table:
            return pa.table({"query_id": self.ids, "most": pa.array(self.most)})

    kind = questions.schema["query_id"].dataType.simpleString()
    found = grid.reduced(chunks.select("chunk_id", "vocab"), questions.select("query_id", "tokens"), Most, f"query_id {kind}, most double", limit=limit)
    return found.groupBy("query_id").agg(F.max("most").alias("most"))


def pairs(chunks: DataFrame, questions: DataFrame, modes: Sequence[str], settings: Settings = DEFAULTS, *, limit: int = grid.MAX_BROADCAST_BYTES) -> DataFrame:
    """(query_id, chunk_id, dense, lexical, adjustment, score) of all pairs, which are the result."""

    class Every:
        streams = True

        def __init__(self, table: pa.Table) -> None:
            self.scorer, self.parts = Scorer(table, modes, settings), []
            self.at_once = grid.at_once(max(len(self.scorer.vectors), len(self.scorer.sets.sizes)))

        def add(self, table: pa.Table) -> None:
            n = self.scorer.questions
            if not n:
                return
            found, keys = self.scorer.scores(table), _column(table, "chunk_id")
            made = {"query_id": pa.array(self.scorer.ids).take(pa.array(np.repeat(np.arange(n), len(keys)))), "chunk_id": pa.concat_arrays([keys] * n) if n else keys[:0]}
            self.parts.append(pa.table({**made, **{c: pa.array(found[c].ravel()) for c in ("dense", "lexical", "adjustment", "score")}}))

        def rows(self) -> pa.Table:
            out, self.parts = self.parts, []
            return pa.concat_tables(out) if out else pa.schema([]).empty_table()

    kind = _kinds(chunks, questions)
    schema = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, dense double, lexical double, adjustment double, score double"
    return grid.reduced(chunks.select("chunk_id", "embedding", "vocab", "cmodes"), checkpoint(asked(questions)), Every, schema, limit=limit, tile=grid.PAIR_TILE_BYTES)


def candidates(chunks: DataFrame, questions: DataFrame, lists: Lists, modes: Sequence[str] = (), settings: Settings = DEFAULTS, *, digits: int | None = None, limit: int = HELD_BYTES, tile: int = HELD_BYTES) -> DataFrame:
    """The rows of each question that ``lists`` keep: (query_id, chunk_id, source, dense, overlap, score, late, matched, modes, query_modes, clauses, expansions).

    ``chunks`` has chunk_id, source, embedding, vocab and cmodes. Each task scores its chunks once and sends what the lists hold; those of many tasks are
    merged together.
    """
    kind = _kinds(chunks, questions)
    types = {f.name: to_arrow_type(f.dataType) for f in chunks.schema.fields}
    schema = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, " + _ROW.format(**kind)
    wanted = chunks.select("chunk_id", "source", "embedding", "vocab", "cmodes")
    found = grid.reduced(wanted, checkpoint(asked(questions)), lambda table: Candidates(Scorer(table, modes, settings), lists, types["chunk_id"], types["source"], digits), schema, limit=limit, tile=tile)
    return merged(found, lists, modes)


def merged(found: DataFrame, lists: Lists, modes: Sequence[str] = ()) -> DataFrame:
    """Of each question's rows from ``MERGED`` tasks together those that ``lists`` keep; a bucket of questions is merged by one task."""
    names, columns = list(modes), found.columns

    def merge(table: pa.Table) -> pa.Table:
        query = pd.factorize(np.array(table.column("query_id").to_pylist(), object))[0]
        rows = {"source": np.array(table.column("source").to_pylist(), object), "key": np.array(table.column("chunk_id").to_pylist(), object)}
        rows |= {"score": table.column("score").to_numpy(), "modes": _bits(_column(table, "modes"), names)}
        rows |= {c: table.column(c).to_numpy().astype(bool) for c in ("late", "matched")}
        parts = {c: np.array([*table.column(c).to_pylist(), None], object)[:-1] for c in SHARES}
        order, keep = np.argsort(query, kind="stable"), []
        for at in np.split(order, np.flatnonzero(np.diff(query[order])) + 1):
            some, values = {c: v[at] for c, v in rows.items()}, []
            for name, share in SHARES.items():
                own = parts[name][at]
                values += [np.array([x[i] if x[i] is not None else np.nan for x in own], float) + share * some["score"] for i in range(len(own[0]))]
            keep.append(at[lists.kept(some, values)])
        return table.select(columns).take(pa.array(np.concatenate(keep)))

    buckets = BUCKETS * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.withColumns({"_part": F.floor(F.spark_partition_id() / MERGED), "_bucket": F.pmod(F.xxhash64("query_id"), F.lit(buckets))})
    return dealt.groupBy("_bucket", "_part").applyInArrow(merge, found.schema)
