"""Toxicity scores by a convolutional text classifier trained in numpy.

Words and their first letters are hashed to rows of an embedding table, and a word is the sum of
its rows, so that unseen forms of a known stem are recognised; filters of several widths slide over the
embedded words, each keeps its greatest response anywhere in the text, and a logistic layer joins
them. Training starts from embeddings whose first component is a word's shrunken association
with the label. A threshold is set per language, the language being guessed from the text's own
function words, and shifted to 0.5, so a score of 0.5 or more predicts the label.

Four fifths of the labelled rows, by hash of their ids, may teach, but at most ``max_rows`` rows and ``max_bytes`` bytes of whole texts
do. Every row's logit is computed and written. The logits of all other labelled rows set the thresholds: they are counted in
a histogram of fixed size, and a language's threshold is drawn to the common one the more the fewer toxic rows it has. Labels, language, source and ids are never
inputs of a score.

Defined cases: null and empty texts are scored as texts without words; null labels and null ids teach nothing;
an id with several labels counts as toxic if one of them is; of several texts under an id that with the least hash teaches; without rows to teach, or with one class
only, every score is the smoothed share of toxic rows; without toxic rows that set thresholds, those that teach set them; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, dropped, map_columns, table, words_of, written

BUCKETS, WIDTH, FILTERS, SPANS = 1 << 18, 8, 8, (1, 2, 3)
#: Bytes of the beginnings of a word that are hashed beside it, and buckets per word.
BEGINNINGS = (4, 5, 6)
KEYS = 1 + len(BEGINNINGS)
#: At most this many labelled rows, and bytes of text, teach the classifier.
MAX_ROWS, MAX_BYTES = 4_000, 32 << 20
#: Of so many parts of the labelled rows one sets thresholds and never teaches.
PARTS = 5
#: Logits are counted in steps of 1 / STEPS between -BOUND and BOUND.
STEPS, BOUND = 50, 40
#: Toxic rows of a language for which its own threshold counts as much as the common one.
COMMON = 20
#: Words scored at a time, whatever the length of a text.
SLICE = 50_000

# Frequent function words of each language, for guessing a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for it with as on be at by this had not are but from or have an they which",
    "fr": "le la les des et en du que dans est une pour qui sur pas au avec par ce il sont plus ne se mais ou",
    "de": "der die und den das von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat",
    "es": "el los las que del se por con una para como su al lo pero sus muy sin sobre este ya entre cuando todo esta ser",
}
LANGUAGES = ("", *FUNCTION_WORDS)
_LANGUAGE = {w.encode(): i for i, words in enumerate(FUNCTION_WORDS.values(), 1) for w in words.split()}


def hashed(words: list[bytes], known: dict[bytes, bytes], buckets: int) -> np.ndarray:
    """Buckets of each word and of its beginnings, from 1, one row per word; ``known`` remembers some.

    A beginning counts with whether nothing, one byte or more follows, so that a stem's forms differ from the stem alone.
    """
    if len(known) > 150_000:
        known.clear()
    out = []
    for word in words:
        row = known.get(word)
        if row is None:
            row = np.array([zlib.crc32(word) % buckets + 1, *(zlib.crc32(word[:n], 4 * n + min(max(len(word) - n, -1), 2)) % buckets + 1 for n in BEGINNINGS)], "<i4").tobytes()
            if len(word) <= 64:
                known[word] = row
        out.append(row)
    return np.frombuffer(b"".join(out), "<i4").reshape(-1, KEYS)


def language_of(words: list[bytes]) -> int:
    """Number in LANGUAGES of the language most of whose function words occur; 0 if none does."""
    counts = [0] * len(LANGUAGES)
    get = _LANGUAGE.get
    for word in words:
        counts[get(word, 0)] += 1
    counts[0] = 0
    return int(np.argmax(counts)) if any(counts) else 0


@dataclass
class Model:
    """Embeddings (row 0 is padding), filters by width, output layer, thresholds by language."""

    table: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES), np.float32))
    constant: float | None = None

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """The greatest response of each filter at any place, at least 0."""
        best = np.zeros(sum(f.shape[2] for f in self.filters), np.float32)
        pad = max(len(f) for f in self.filters) - 1
        for low in range(0, max(1, len(ids)), SLICE):
            part = np.concatenate([_blank(pad), ids[max(0, low - pad) : low + SLICE], _blank(pad)])
            rows = self.table[part].sum(1)
            np.maximum(best, np.concatenate([_convolved(rows, f, b).max(0) for f, b in zip(self.filters, self.biases, strict=True)]), out=best)
        return best

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Logits of many texts, short ones together with padding between them."""
        out = np.empty(len(docs), np.float32)
        pad = max(len(f) for f in self.filters) - 1
        batch: list[int] = []
        size = 0

        def flush() -> None:
            pieces, starts, at = [_blank(pad)], [], 0
            for i in batch:
                starts.append(at)
                pieces += [docs[i], _blank(pad)]
                at += len(docs[i]) + pad
            rows = self.table[np.concatenate(pieces)].sum(1)
            pooled = []
            for f, b in zip(self.filters, self.biases, strict=True):
                values = _convolved(rows, f, b)
                pooled.append(np.maximum.reduceat(values[: at], starts, axis=0))
            out[batch] = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.bias

        for i, ids in enumerate(docs):
            if len(ids) > SLICE:
                out[i] = self.responses(ids) @ self.out + self.bias
                continue
            if batch and size + len(ids) > SLICE:
                flush()
                batch, size = [], 0
            batch.append(i)
            size += len(ids) + pad
        if batch:
            flush()
        return out

    def scores(self, docs: list[np.ndarray], languages: list[int]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        return 1 / (1 + np.exp(self.thresholds[languages] - self.logits(docs).astype(float)))


def _blank(n: int) -> np.ndarray:
    return np.zeros((n, KEYS), np.int32)


def _convolved(rows: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Responses at each place where the filter's words all lie within ``rows``."""
    n = len(rows) - len(filters) + 1
    total = rows[:n] @ filters[0]
    for k in range(1, len(filters)):
        total += rows[k : k + n] @ filters[k]
    return total + bias


def trained(docs: list[np.ndarray], labels: np.ndarray, languages: np.ndarray, *, buckets: int = BUCKETS, epochs: int = 8, rate: float = 0.05, seed: int = 7) -> Model:
    """A model from hashed texts and 0/1 labels. The result depends on the arguments alone."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros((1, 1), np.float32), constant=float((labels.sum() + 0.5) / (len(labels) + 2)) if len(labels) else 0.25)
    rng = np.random.default_rng(seed)
    held, toxic = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for ids, label in zip(docs, labels, strict=True):
        once = np.unique(ids)
        held[once] += 1
        toxic[once] += label
    share = labels.mean()
    expected = held * share
    # observed less expected in standard deviations, shrunk: words seen once or twice stay near 0
    link = (toxic - expected) / np.sqrt(expected * (1 - share) + 1)
    model = Model(np.zeros((buckets + 1, WIDTH), np.float32))
    model.table[:, 0] = np.clip(link / 4, -1, 3)
    model.table[1:, 1:] = rng.normal(0, 0.02, (buckets, WIDTH - 1))
    model.table[0] = 0
    model.table[held == 0] = 0
    for span in SPANS:
        weights = rng.normal(0, 0.1, (span, WIDTH, FILTERS)).astype(np.float32)
        weights[:, 0, :] += 1.0 / span
        model.filters.append(weights)
        model.biases.append(np.full(FILTERS, -0.3, np.float32))
    model.out = np.full(FILTERS * len(SPANS), 2.0 / (FILTERS * len(SPANS)), np.float32)
    model.bias = -1.0
    _descend(model, docs, labels, epochs, rate, rng)
    set_thresholds(model, histogram(model.logits(docs), labels, np.asarray(languages)))
    return model


def _descend(model: Model, docs: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, rng) -> None:
    """Adagrad on the logistic loss, 32 texts at a time; a maximum passes its gradient to its own place only."""
    params = [*model.filters, *model.biases, model.out]
    sums = [np.full(p.shape, 1e-3, np.float32) for p in params]
    seen = np.full(model.table.shape, 1e-2, np.float32)
    bias_sum = 1e-3
    pad = max(SPANS) - 1
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for low in range(0, len(order), 32):
            some = order[low : low + 32]
            ids = np.concatenate([_blank(pad), *(x for i in some for x in (docs[i], _blank(pad)))])
            starts = np.cumsum([0, *(len(docs[i]) + pad for i in some[:-1])])
            rows = model.table[ids].sum(1)
            places, best = zip(*(_greatest(_convolved(rows, f, b), starts) for f, b in zip(model.filters, model.biases, strict=True)), strict=True)
            pooled = np.maximum(np.concatenate(best, 1), 0)
            error = (1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30))) - labels[some]).astype(np.float32) / len(some)
            back = error[:, None] * model.out * (pooled > 0)
            grads, moved, moves = [], [], []
            for k, span in enumerate(SPANS):
                g, grad = back[:, k * FILTERS : (k + 1) * FILTERS], np.empty_like(model.filters[k])
                for j in range(span):
                    at = places[k] + j
                    grad[j] = np.einsum("dfw,df->wf", rows[at], g)
                    moved.append(ids[at].ravel())
                    moves.append(np.repeat((model.filters[k][j].T * g[:, :, None]).reshape(-1, WIDTH), KEYS, 0))
                grads.append(grad)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(SPANS))] + [error @ pooled]
            for p, s, g in zip(params, sums, grads, strict=True):
                s += g * g
                p -= rate * g / np.sqrt(s)
            bias_sum += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / bias_sum**0.5
            at = np.concatenate(moved)
            by_row = np.argsort(at, kind="stable")
            once, first = np.unique(at[by_row], return_index=True)
            total = np.add.reduceat(np.concatenate(moves)[by_row], first, axis=0)
            total[once == 0] = 0
            seen[once] += total * total
            model.table[once] -= rate * 0.2 * total / np.sqrt(seen[once])
        rate *= 0.8


def _greatest(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of each column's greatest value in each run of rows that begins at ``starts``."""
    top = np.maximum.reduceat(values, starts, axis=0)
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(values)]))
    row, column = np.nonzero(values == top[run])
    place = np.zeros(top.shape, np.int64)
    place[run[row][::-1], column[::-1]] = row[::-1]  # of equal values the first
    return place, top


SHAPE = len(LANGUAGES), 2, 2 * BOUND * STEPS


def histogram(logits: np.ndarray, labels: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """Counts by language, label and step of the logit."""
    step = np.clip(np.floor((logits.astype(float) + BOUND) * STEPS), 0, SHAPE[2] - 1).astype(np.int64)
    return np.bincount(np.ravel_multi_index((languages, labels.astype(np.int64), step), SHAPE), minlength=int(np.prod(SHAPE))).reshape(SHAPE)


def set_thresholds(model: Model, counts: np.ndarray) -> None:
    """Thresholds of the best F1 over counted logits, by language and drawn to the common one; nothing without toxic rows."""
    if not counts[:, 1].any():
        return
    whole = _threshold(counts.sum(0))
    for i, own in enumerate(counts):
        toxic = int(own[1].sum())
        model.thresholds[i] = (toxic * _threshold(own) + COMMON * whole) / (toxic + COMMON) if i and toxic else whole


def _threshold(counts: np.ndarray) -> float:
    """The logit with the best F1 of ``logit >= threshold`` over counts by label and step, in the middle of its gap."""
    at = np.flatnonzero(counts.sum(0))[::-1]
    hits, all_ = np.cumsum(counts[1, at]), np.cumsum(counts[:, at].sum(0))
    best = int(np.argmax(2 * hits / (all_ + counts[1].sum())))
    low = at[best + 1] + 1 if best + 1 < len(at) else at[best] - STEPS
    return float((at[best] + low) / 2 / STEPS - BOUND)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Fit:
    """A taught model and the labelled rows (k, y) that set its thresholds."""

    model: Model
    judges: DataFrame


def fitted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Fit:
    """A model taught by a bounded sample of the labelled rows outside the held-out fold, and the others of them."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out("k"))
    known = known.groupBy("k").agg((F.max("y") > 0).cast("int").alias("y"))
    place = F.xxhash64("k")
    teachers = known.where(F.pmod(place, F.lit(PARTS)) != 0).orderBy(place, "k").limit(max_rows)
    texts = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("k is not null")
    hashes = F.xxhash64("t").alias("h")
    sizes = texts.join(F.broadcast(teachers), "k").groupBy("k", "y").agg(F.min(F.struct(hashes, F.octet_length("t").alias("n"))).alias("s"))
    left, chosen = max_bytes, []
    for r in sizes.orderBy(place, "k").collect():  # at most max_rows rows
        if r.s.n <= left:
            left -= r.s.n
            chosen.append((r.k, r.y, r.s.h))

    def make():
        memory: dict[bytes, bytes] = {}

        def fn(batch: pa.Array) -> list[pa.Array]:
            words = [words_of(x) for x in as_bytes(batch)]
            return [pa.array([hashed(w, memory, BUCKETS).tobytes() for w in words], pa.binary()), pa.array([language_of(w) for w in words], pa.int32())]

        return fn

    schema = T.StructType([T.StructField("ids", T.BinaryType(), False), T.StructField("language", T.IntegerType(), False)])
    few = documents.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("k", texts.schema["k"].dataType), T.StructField("y", T.IntegerType()), T.StructField("h", T.LongType())]))
    rows = texts.withColumn("h", hashes).join(F.broadcast(few), ["k", "h"])
    got = map_columns(rows, [F.col("k"), F.col("y")], [F.col("t")], make, schema).dropDuplicates(["c0"]).toPandas().sort_values("c0")
    docs = [np.frombuffer(x, "<i4").reshape(-1, KEYS) for x in got["ids"]]
    model = trained(docs, got["c1"].to_numpy(), got["language"].to_numpy())
    return Fit(model, known.join(F.broadcast(few.select("k")), "k", "left_anti"))


LOGIT = T.StructType([T.StructField("logit", T.DoubleType(), False), T.StructField("language", T.IntegerType(), False)])


def scored(df: DataFrame, carry: list[Column], key: str, text: str, fit: Fit, *, twice: bool = False) -> DataFrame:
    """The columns ``carry`` (as c0, c1, ...) with the score of each row's whole text.

    What is carried is written beside the logits. With ``twice`` it is not, as whole rows would be a copy of the table: logits for the thresholds
    are then written alone, and texts are read and scored once more.
    """
    n = 0 if twice else len(carry)
    names = [f"c{i}" for i in range(len(carry))]
    if fit.model.constant is not None:
        return df.select(*[c.alias(name) for c, name in zip(carry, names, strict=True)], F.lit(fit.model.constant).alias("score"))
    sent = df.sparkSession.sparkContext.broadcast(fit.model)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        memory: dict[bytes, bytes] = {}

        def fn(texts: pa.Array) -> list[pa.Array]:
            words = [words_of(x) for x in as_bytes(texts)]
            logits = sent.value.logits([hashed(w, memory, BUCKETS) for w in words])
            return [pa.array(logits, pa.float64()), pa.array([language_of(w) for w in words], pa.int32())]

        return fn

    out = written(map_columns(df, [*carry[:n], F.col(key)], [F.col(text)], make, LOGIT), "logits")
    judged = out.select(F.col(f"c{n}").alias("k"), "logit", "language").join(fit.judges, "k")
    step = F.greatest(F.lit(0), F.least(F.lit(SHAPE[2] - 1), F.floor((F.col("logit") + BOUND) * STEPS)))
    counts = np.zeros(SHAPE, np.int64)
    for r in judged.groupBy("language", "y", step.cast("int").alias("step")).count().collect():  # at most as many rows as the histogram has counts
        counts[r.language, r.y, r.step] = r["count"]
    set_thresholds(fit.model, counts)
    if twice:
        dropped(out)
        out = map_columns(df, carry, [F.col(text)], make, LOGIT)
    threshold = F.element_at(F.array(*[F.lit(float(x)) for x in fit.model.thresholds]), F.col("language") + 1)
    return out.select(*names, (1 / (1 + F.exp(threshold - F.col("logit")))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fit = fitted(documents, table(spark, sf_dir, "labels"))
    out = scored(documents, [F.col("doc_id")], "doc_id", "text", fit).withColumnRenamed("c0", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
