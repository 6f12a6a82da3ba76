"""Evaluation metrics of retrieval and answers, their summaries, intervals and subgroups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import abstained, citations, clean_list, dot, sentences, squeeze
from lodestone.operators.hybrid import matrix
from lodestone.operators.scoring import small

# Resamples, seed and shifts of the bootstrap's generator.
RESAMPLES, SEED, SHIFTS = 1000, 1337, (13, 17, 5)

#: Claims, and sentences, of a case that meet in a cell.
CLAIM_TILE = 4096


def retrieval_metrics(retrieved: DataFrame, gold: DataFrame, *, by: str = "case_id", digits: int = 6) -> DataFrame:
    """Recall, precision, top-1, MRR, nDCG and distinct share per case.

    ``retrieved`` has by, rank and prefix; ``gold`` has by and prefix, repeats counted in recall. A case
    without gold has null metrics; with gold but nothing retrieved, recall is 0 and the others are null.
    """
    wanted = gold.groupBy(by).agg(F.count("*").alias("n_gold"), F.count_distinct("prefix").alias("n_distinct"))
    marks = gold.groupBy(by, "prefix").agg(F.count("*").alias("times"))
    rows = retrieved.select(by, "rank", "prefix").join(marks, [by, "prefix"], "left")
    # a prefix counts once, where it first occurs
    firsts = rows.groupBy(by, "prefix").agg(F.min("rank").alias("first"), F.max("times").alias("times"), F.count("*").alias("held"))
    gain = F.when(F.col("times").isNotNull(), 1 / F.log2(F.col("first") + 1)).otherwise(0.0)
    hit = F.col("times").isNotNull()
    found = firsts.groupBy(by).agg(
        F.sum("held").alias("k"), F.count("*").alias("n_prefixes"), F.coalesce(F.sum("times"), F.lit(0)).alias("n_recalled"), F.count_if(hit).alias("n_hit"),
        F.min(F.when(hit, F.col("first"))).alias("first_hit"), F.sum(gain).alias("dcg"),
    )
    all_ = wanted.join(found, by, "full")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_distinct", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known, both = F.col("n_gold").isNotNull(), F.col("n_gold").isNotNull() & F.col("k").isNotNull()
    r = lambda ok, c: F.when(ok, F.round(c, digits))
    return all_.select(
        by,
        r(known, F.coalesce("n_recalled", F.lit(0)) / F.col("n_gold")).alias("gold_doc_recall_at_k"),
        r(both, F.col("n_hit") / F.col("k")).alias("gold_doc_precision_at_k"),
        F.when(both, F.when(F.col("first_hit") == 1, 1.0).otherwise(0.0)).alias("gold_doc_top1_hit"),
        r(both, F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).alias("gold_doc_mrr"),
        r(both, F.col("dcg") / ideal).alias("gold_doc_ndcg"),
        r(F.col("k").isNotNull(), F.col("n_prefixes") / F.col("k")).alias("unique_prefix_fraction"),
    )


def labelled_rate(retrieved: DataFrame, labelled: DataFrame, name: str, *, by: str = "case_id", digits: int = 6) -> DataFrame:
    """The share of retrieved rows whose prefix is labelled; null for cases without labels."""
    marks = labelled.select(by, "prefix").distinct().withColumn("_l", F.lit(1.0))
    rows = retrieved.select(by, "prefix").join(marks, [by, "prefix"], "left")
    rate = rows.groupBy(by).agg(F.round(F.avg(F.coalesce("_l", F.lit(0.0))), digits).alias("rate"))
    return retrieved.select(by).distinct().join(labelled.select(by).distinct().withColumn("_k", F.lit(1)), by, "left").join(rate, by, "left").select(by, F.when(F.col("_k").isNotNull(), F.col("rate")).alias(name))


def evidence_coverage(claims: DataFrame, retrieved: DataFrame, *, by: str = "case_id", digits: int = 6) -> DataFrame:
    """(case, claims, covered, coverage): claims with a retrieved chunk or document prefix among their evidence.

    ``claims`` has by, claim, prefixes and chunk_ids; ``retrieved`` has by, prefix and chunk_id.
    """
    seen = retrieved.groupBy(by).agg(F.collect_set("prefix").alias("p"), F.collect_set("chunk_id").alias("c"))
    hit = F.arrays_overlap(clean_list("prefixes"), "p") | F.arrays_overlap(clean_list("chunk_ids"), "c")
    met = claims.join(seen, by, "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return met.groupBy(by).agg(F.count("*").alias("claim_count"), F.count_if("hit").alias("covered_count"), F.round(F.avg(F.col("hit").cast("double")), digits).alias("claim_evidence_coverage"))


def claim_similarity(claims: DataFrame, sentence_vectors: DataFrame, *, by: str = "case_id", apart: str | None = None, tile: int = CLAIM_TILE) -> DataFrame:
    """(case, claim_id, similarity): the greatest cosine with a sentence of the case; 0 without sentences.

    Claims meet only sentences of their own case, in a grid of tiles of about ``tile`` rows a side, each cell one matrix product that
    keeps a claim's best; so a case may have any number of both. With ``apart`` a sentence whose column of that name is the claim's id does not count.
    """
    mine, said = claims.select(by, "claim_id", "embedding"), sentence_vectors.select(by, F.col(apart).alias("sentence_id") if apart else F.lit(None).alias("sentence_id"), F.col("embedding").alias("vector"))
    count = lambda df, name: df.groupBy(by).agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    counts = small(count(mine, "_across").join(count(said, "_down"), by, "left"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))).cast("int")
    asked = mine.join(counts, by).select(by, "claim_id", "embedding", part("claim_id", F.col("_across")).alias("_t"), every(F.col("_down")).alias("_c"))
    met = said.join(counts, by).select(by, "sentence_id", "vector", part("vector", F.col("_down")).alias("_c"), every(F.col("_across")).alias("_t"))
    kind = asked.schema

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        best = pa.nulls(left.num_rows, pa.float64())
        if left.num_rows and right.num_rows:
            own, other = left.column("embedding").combine_chunks(), right.column("vector").combine_chunks()
            wide = max(len(x) for x in (own[0], other[0]))
            near = matrix(own, wide) @ matrix(other, wide).T
            if apart:
                ids = np.array(right.column("sentence_id").to_pylist(), object)
                near[np.array(left.column("claim_id").to_pylist(), object)[:, None] == ids[None, :]] = -np.inf
            top = near.max(1)
            best = pa.array(top, mask=np.isneginf(top))
        return left.select([by, "claim_id"]).append_column("best", best)

    keys = [by, "_t", "_c"]
    schema = f"`{by}` {kind[by].dataType.simpleString()}, claim_id {kind['claim_id'].dataType.simpleString()}, best double"
    found = asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(cell, schema)
    return found.groupBy(by, "claim_id").agg(F.coalesce(F.max("best"), F.lit(0.0)).alias("similarity"))


def claim_metrics(similarities: DataFrame, threshold: float, *, by: str = "case_id", digits: int = 6) -> DataFrame:
    """(case, n_claims, n_over, rate, similarity_mean) of claims at or over a threshold."""
    over = (F.col("similarity") >= threshold).cast("double")
    return similarities.groupBy(by).agg(F.count("*").alias("n_claims"), F.sum(over).cast("long").alias("n_over"), F.round(F.avg(over), digits).alias("rate"), F.round(F.avg("similarity"), digits).alias("similarity_mean"))


def matched_citations(cited: DataFrame, retrieved: DataFrame, *, by: str = "case_id") -> DataFrame:
    """(case, sentence_id, chunk_id): each citation's chunk, by id or else the first retrieved id that ends with it."""
    rows = cited.join(retrieved.select(by, "rank", "chunk_id"), by).where(F.col("chunk_id").endswith(F.col("citation")))
    best = F.min_by("chunk_id", F.struct((F.col("chunk_id") != F.col("citation")).alias("inexact"), "rank"))
    return rows.groupBy(by, "sentence_id", "citation").agg(best.alias("chunk_id")).select(by, "sentence_id", "chunk_id")


def citation_support(pairs: DataFrame, sentence_vectors: DataFrame, window_vectors: DataFrame, threshold: float, *, by: str = "case_id", digits: int = 6) -> DataFrame:
    """(case, scored, supported, rate, similarity_mean): a pair's support is its best window's cosine; 0 without windows."""
    met = pairs.join(sentence_vectors.select(by, "sentence_id", F.col("embedding").alias("_s")), [by, "sentence_id"])
    met = met.join(window_vectors.select("chunk_id", F.col("embedding").alias("_w")), "chunk_id", "left")
    best = met.groupBy(by, "sentence_id", "chunk_id").agg(F.max(dot("_s", "_w")).alias("best"))
    over = F.count_if(F.col("best") >= threshold)
    return best.groupBy(by).agg(F.count("best").alias("scored"), over.alias("supported"), F.coalesce(F.round(over / F.nullif(F.count("best"), F.lit(0)), digits), F.lit(0.0)).alias("rate"), F.coalesce(F.round(F.avg("best"), digits), F.lit(0.0)).alias("similarity_mean"))


def answer_stats(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Add sentence, word and citation counts, the share of citing sentences and whether the answer abstains."""
    rows = answers.withColumn("_s", sentences(text))
    cites = F.transform("_s", lambda s: F.size(citations(s)))
    words = F.aggregate(F.transform("_s", lambda s: F.size(F.split(squeeze(s), " "))), F.lit(0), lambda a, n: a + n)
    n = F.size("_s")
    out = rows.withColumns({
        "answer_sentence_count": n.cast("long"), "answer_word_count": words.cast("long"), "citation_count": F.aggregate(cites, F.lit(0), lambda a, c: a + c).cast("long"),
        "citation_sentence_rate": F.when(n > 0, F.round(F.size(F.filter(cites, lambda c: c > 0)) / n, 6)), "abstained": abstained(text),
    })
    return out.drop("_s")


def means(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """The mean of each metric, nulls aside, booleans as 0 and 1."""
    return rows.groupBy(*by).agg(*[F.round(F.avg(F.col(m).cast("double")), digits).alias(m) for m in metrics])


def subgroup_means(rows: DataFrame, metrics: Sequence[str], sets: Sequence[Sequence[str]], digits: int = 6) -> DataFrame:
    """Means over several groupings in one pass: (grouping, subgroup, n, metrics). Missing keys read ``unknown``."""
    columns = sorted({c for s in sets for c in s})
    ready = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns], *metrics)
    grouped = ready.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    out = grouped.agg(F.grouping_id(*[F.col(c) for c in columns]).alias("_g"), F.count("*").alias("n"), *[F.round(F.avg(F.col(m).cast("double")), digits).alias(m) for m in metrics])
    names = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): list(s) for s in sets}
    label, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, s in names.items():
        label = F.when(F.col("_g") == number, F.lit("+".join(s) or "all")).otherwise(label)
        value = F.when(F.col("_g") == number, F.concat_ws("|", *[F.col(c) for c in s]) if s else F.lit("all")).otherwise(value)
    return out.select(label.alias("grouping"), value.alias("subgroup"), "n", *metrics)


def timings(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """p50, p95 and mean with three digits; 0 for groups without values."""
    q = lambda p: F.round(F.coalesce(F.percentile(value, p), F.lit(0.0)), 3)
    return rows.groupBy(*by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 3).alias("mean"))


@cache
def _jumps() -> np.ndarray:
    """What 2^j steps of the generator make of each single bit; steps are linear over bits."""
    out = np.empty((63, 32), np.uint32)
    out[0] = _step(np.uint32(1) << np.arange(32, dtype=np.uint32))
    for j in range(1, 63):
        out[j] = _moved(out[j - 1], out[j - 1])
    return out


def _step(x: np.ndarray) -> np.ndarray:
    """The next number of the 32-bit xorshift generator for each state."""
    left, right, again = (np.uint32(s) for s in SHIFTS)
    x = x ^ (x << left)
    x = x ^ (x >> right)
    return x ^ (x << again)


def _moved(x: np.ndarray, jump: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(32):
        out ^= (x >> np.uint32(b) & np.uint32(1)) * jump[b]
    return out


def states(numbers: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The generator's states after the given numbers of draws."""
    out = np.full(numbers.shape, seed, np.uint32)
    for j in range(int(numbers.max(initial=0)).bit_length()):
        out = np.where(numbers >> j & 1, _moved(out, _jumps()[j]), out)
    return out


def _spaced(numbers: np.ndarray, step: int, lanes: int) -> np.ndarray:
    """The generator's states after the given numbers of draws, a row each, and in its further lanes those each ``step`` draws later."""
    out = np.empty((len(numbers), lanes), np.uint32)
    out[:, 0] = states(numbers)
    jump = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for j in range(step.bit_length()):
        if step >> j & 1:
            jump = _moved(jump, _jumps()[j])
    have = 1
    while have < lanes:
        more = min(have, lanes - have)
        out[:, have : have + more] = _moved(out[:, :more], jump)
        jump, have = _moved(jump, jump), have + more
    return out


def sample_sums(x: np.ndarray, low: int, n: int, samples: np.ndarray) -> np.ndarray:
    """Each sample's sum over its draws, of ``n`` values, that fall on ``x``, the values from number ``low`` on."""
    lanes = max(1, min(n, LANES // len(samples)))
    length = -(-n // lanes)
    ahead = np.arange(lanes, dtype=np.int64) * length
    state = _spaced(samples.astype(np.int64) * n, length, lanes)
    out = np.zeros(len(samples))
    padded = np.append(x, 0.0)
    for t in range(length):
        state = _step(state)
        at = (state % np.uint32(n)).astype(np.int64) - low if n < 1 << 32 else state.astype(np.int64) - low
        at[(at < 0) | (at >= len(x)) | (ahead + t >= n)] = len(x)
        out += padded[at].sum(axis=1)
    return out


#: Values in a block, draws in a task for each block, states that are moved at once, and draws that meet a block at a time.
BOOTSTRAP_BLOCK, BOOTSTRAP_DRAWS, LANES, MET_DRAWS = 1 << 20, 200_000_000, 1 << 16, 50_000_000
#: Draws made at a time when a group has several blocks.
STRETCH = 1 << 22
#: Values, and draws, of a group that is resampled as one row of a batch; such rows are taken so many at a time.
BOOTSTRAP_WHOLE, WHOLE_DRAWS, WHOLE_ROWS = 1024, 1 << 20, 1000


def _numbers(first: int, count: int) -> np.ndarray:
    """The generator's ``count`` numbers from draw ``first`` on."""
    lanes = max(1, min(count, LANES))
    length = -(-count // lanes)
    state = _spaced(np.array([first], np.int64), length, lanes)[0]
    out = np.empty((length, lanes), np.uint32)
    for t in range(length):
        out[t] = state = _step(state)
    return out.T.ravel()[:count]


def drawn(n: int, first: int, count: int) -> np.ndarray:
    """The values, by number below ``n``, that ``count`` draws from number ``first`` on fall on; each is made once."""
    numbers = _numbers(first, count)
    return (numbers % np.uint32(n) if n < 1 << 32 else numbers).astype(np.int64)


def _whole(lists: pa.ListArray, numbers: np.ndarray, resamples: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list of values its length and both ends of the interval; lists of one length share their draws, the first of ``numbers``."""
    lengths, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    begins, out = np.cumsum(lengths) - lengths, np.empty((len(lists), 2))
    places = [p * (resamples - 1) for p in (0.025, 0.975)]
    near = [(int(np.floor(p)), int(np.ceil(p))) for p in places]
    for n in np.unique(lengths).tolist():
        at = (numbers[: resamples * n] % np.uint32(n)).astype(np.intp).reshape(resamples, n)
        for i in np.flatnonzero(lengths == n).tolist():
            means_ = np.partition(flat[begins[i] : begins[i] + n][at].sum(axis=1) / n, sorted({j for pair in near for j in pair}))
            for e, (low, high) in enumerate(near):
                a, b = means_[low], means_[high]
                out[i, e] = a if low == high or a == b else (high - places[e]) * a + (places[e] - low) * b
            if n == 1:
                out[i] = flat[begins[i]]
    return lengths, out


def _numbered(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, x, i, n): each value's number by ``order`` within its group and the group's size, without a task that holds a group."""
    from lodestone.sources.shared import checkpoint

    by = [*[F.col(k) for k in keys], F.col("o").asc_nulls_last(), F.col("x")]
    chosen = rows.where(F.col(value).isNotNull()).select(*[F.col(k) for k in keys], F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    parted = chosen.repartitionByRange(*by).sortWithinPartitions(*by)
    held = checkpoint(parted.select(*keys, "x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = held.groupBy(*keys, "part").agg(F.min("at").alias("start"), F.count("*").alias("c"))
    earlier = F.sum("c").over(W.partitionBy(*keys).orderBy("part")) - F.col("c")
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), (earlier - F.col("start")).alias("shift"), F.sum("c").over(W.partitionBy(*keys)).alias("n"))
    same = F.col("part") == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return held.join(counts, same).select(*keys, "x", (F.col("at") + F.col("shift")).alias("i"), "n")


def bootstrap(rows: DataFrame, value: str, order: str, by: Sequence[str], *, resamples: int = RESAMPLES, digits: int = 6, block: int = BOOTSTRAP_BLOCK, draws: int = BOOTSTRAP_DRAWS, whole: int = BOOTSTRAP_WHOLE) -> DataFrame:
    """(by, low, high, n): the 95 % interval of the mean over resamples drawn by one generator in case order.

    Groups may have any size. One of at most ``whole`` values is a row that one task resamples; its draws are the first of the generator, whatever
    the group, so a task makes them once and reduces them once for each size that it meets. Values of larger groups are numbered and cut into blocks.
    A task takes some samples of a group of one block, starts the generator where they begin and adds up. Draws of still larger groups are made once,
    parted by the block that they fall on, and meet it some samples at a time, so n values take as many draws as n values of one block do. Values of
    equal order are numbered by value.
    """
    from lodestone.sources.shared import checkpoint

    keys, most = list(by), min(whole, block, max(1, WHOLE_DRAWS // resamples))
    chosen = rows.where(F.col(value).isNotNull()).select(*[F.col(k) for k in keys], F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    # each has more than ``most`` values, so these are few
    large = checkpoint(chosen.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*[F.col(k).alias(f"_{k}") for k in keys]))
    if large.isEmpty():
        ends = _ends_of_whole(chosen, keys, resamples)
    else:
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
        ends = _ends_of_whole(chosen.join(large, same, "left_anti"), keys, resamples)
        ends = ends.unionByName(_ends_of_blocks(chosen.join(large, same, "left_semi"), "x", "o", keys, resamples, block, draws))
    end = lambda c: F.when(F.col("n") == 1, F.col(c)).otherwise(F.round(c, digits)).alias(c)
    return ends.select(*keys, end("low"), end("high"), "n")


def _ends_of_whole(chosen: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """(keys, n, low, high) of groups that are small enough to be rows."""
    names = {f.name: f.dataType for f in chosen.schema.fields}
    lists = chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("o").isNull().alias("none"), "o", "x"))).alias("v")).select(*keys, F.col("v.x").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.empty(0, np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, WHOLE_ROWS):
                part = batch.slice(i, WHOLE_ROWS)
                values = part.column("v")
                longest = pc.max(pc.list_value_length(values)).as_py()
                if len(numbers) < resamples * longest:
                    numbers = _numbers(0, resamples * longest)
                n, ends = _whole(values, numbers, resamples)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(n.astype(np.int64)), *[pa.array(e) for e in ends.T]], names=[*keys, "n", "low", "high"])

    kinds = "".join(f"`{k}` {names[k].simpleString()}, " for k in keys)
    return lists.mapInArrow(run, f"{kinds}n long, low double, high double")


def _ends_of_blocks(rows: DataFrame, value: str, order: str, keys: list[str], resamples: int, block: int, draws: int) -> DataFrame:
    """(keys, n, low, high) of groups whose values are numbered and cut into blocks."""
    names = {f.name: f.dataType for f in rows.schema.fields}
    kinds = "".join(f"`{k}` {names[k].simpleString()}, " for k in keys)
    numbered = _numbered(rows, keys, value, order).withColumn("block", F.expr(f"i div {block}"))

    def packed(table: pa.Table) -> pa.Table:
        x = table.sort_by("i").column("x").to_numpy()
        return table.slice(0, 1).select([*keys, "n", "block"]).append_column("raw", pa.array([x.tobytes()], pa.binary()))

    packs = numbered.groupBy(*keys, "n", "block").applyInArrow(packed, f"{kinds}n long, block long, raw binary")
    some = F.greatest(F.lit(1), F.least(F.lit(resamples), F.expr(f"{draws} div n"))).cast("long")
    tasks = packs.where(F.col("n") <= block).withColumn("some", some).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), F.col("some"))))

    def summed(table: pa.Table) -> pa.Table:
        n, number, some_, first, raw = (table.column(c)[0].as_py() for c in ("n", "block", "some", "from", "raw"))
        samples = np.arange(first, min(resamples, first + some_))
        sums = sample_sums(np.frombuffer(raw, float), number * block, n, samples)
        held = [table.column(k).take(pa.array([0] * len(samples))) for k in keys]
        return pa.Table.from_arrays([*held, pa.array([n] * len(samples)), pa.array(samples), pa.array(sums)], names=[*keys, "n", "sample", "total"])

    # few bytes make many draws, so these tasks are dealt out by number and not joined by size
    at_once, together = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "block", "from"]
    sums = tasks.repartition(at_once, *together).groupBy(*together).applyInArrow(summed, f"{kinds}n long, sample long, total double")
    sums = sums.unionByName(_large_sums(numbered, packs.where(F.col("n") > block), keys, kinds, resamples, block))
    means_ = sums.groupBy(*keys, "n", "sample").agg((F.sum("total") / F.col("n")).alias("m"))
    ends = means_.groupBy(*keys, "n").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return ends.select(*keys, "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _large_sums(numbered: DataFrame, packs: DataFrame, keys: list[str], kinds: str, resamples: int, block: int) -> DataFrame:
    """(keys, n, sample, total) of groups of several blocks."""
    at_once = max(1, MET_DRAWS // block)
    groups = numbered.where(F.col("n") > block).select(*keys, "n").distinct()
    long_ = lambda i: F.lit(i).cast("long")
    parts = groups.withColumn("sample", F.explode(F.sequence(long_(0), long_(resamples - 1))))
    parts = parts.withColumn("first", F.explode(F.sequence(long_(0), F.col("n") - 1, long_(STRETCH))))
    spread = parts.repartition(*[F.col(k) for k in keys], "sample", "first")
    names = [*keys, "n", "block", "range", "sample", "raw"]

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, sample, first = (row.column(c)[0].as_py() for c in ("n", "sample", "first"))
                at = drawn(n, sample * n + first, min(STRETCH, n - first))
                of = at // block
                order = np.argsort(of, kind="stable")
                of, at = of[order], (at[order] - of[order] * block).astype("<u4")
                begins = np.flatnonzero(np.diff(of, prepend=-1))
                raws = [at[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(at)], strict=True)]
                held = [row.column(k).take(pa.array([0] * len(raws))) for k in keys]
                same = lambda v: pa.array([v] * len(raws), pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*held, same(n), pa.array(of[begins]), same(sample // at_once), same(sample), pa.array(raws, pa.binary())], names=names)

    fallen = spread.mapInArrow(parted, f"{kinds}n long, block long, range long, sample long, raw binary")
    ranges = packs.withColumn("range", F.explode(F.sequence(long_(0), long_((resamples - 1) // at_once))))
    together = [*keys, "n", "block", "range"]

    def met(some: pa.Table, held: pa.Table) -> pa.Table:
        x = np.frombuffer(held.column("raw")[0].as_py(), float)
        totals: dict[int, float] = {}
        for sample, raw in zip(some.column("sample").to_pylist(), some.column("raw"), strict=True):
            totals[sample] = totals.get(sample, 0.0) + float(x[np.frombuffer(raw.as_buffer(), "<u4")].sum())
        first = held.slice(0, 1)
        same = [first.column(k).take(pa.array([0] * len(totals))) for k in [*keys, "n"]]
        return pa.Table.from_arrays([*same, pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.float64())], names=[*keys, "n", "sample", "total"])

    return fallen.groupBy(*together).cogroup(ranges.groupBy(*together)).applyInArrow(met, f"{kinds}n long, sample long, total double")


def judged(raw: Column, required: Column, forbidden: Column, has_reference: Column) -> Column:
    """A judge's JSON answer as clamped scores; null if it is no object."""
    from lodestone.functions.text import json_object

    check = lambda word: f"array<struct<claim:string,{word}:int,reason:string>>"
    whole = ("decision_correctness", "groundedness", "completeness", "mandatory_optional_precision", "uncertainty_handling", "reference_alignment")
    schema = "struct<" + ",".join(f"{k}:double" for k in (*whole, "required_claim_recall", "forbidden_claim_violation")) + f",required_claim_checks:{check('covered')},forbidden_claim_checks:{check('violated')},notes:string>"
    p = json_object(raw, schema)
    clamp = lambda k: F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(p[k], F.lit(0.0)).cast("int")))
    covered = F.when(F.size(required) > 0, p["required_claim_checks"])
    covered = F.slice(covered, F.lit(1), F.size(required))
    violated = F.when(F.size(forbidden) > 0, p["forbidden_claim_checks"])
    violated = F.slice(violated, F.lit(1), F.size(forbidden))
    recall = F.when(F.coalesce(F.size(covered), F.lit(0)) > 0, F.size(F.filter(covered, lambda c: c["covered"] != 0)) / F.size(covered)).otherwise(F.coalesce(p["required_claim_recall"], F.lit(0.0)))
    against = F.when(F.coalesce(F.size(violated), F.lit(0)) > 0, F.exists(violated, lambda c: c["violated"] != 0)).otherwise(F.coalesce(p["forbidden_claim_violation"], F.lit(0.0)) != 0)
    fields = [clamp(k).alias(k) for k in whole[:-1]]
    fields += [F.when(has_reference, clamp("reference_alignment")).alias("reference_alignment"), F.least(F.greatest(recall, F.lit(0.0)), F.lit(1.0)).alias("required_claim_recall"), against.cast("int").alias("forbidden_claim_violation")]
    return F.when(p.isNotNull(), F.struct(*fields, F.trim(F.coalesce(p["notes"], F.lit(""))).alias("notes")))
