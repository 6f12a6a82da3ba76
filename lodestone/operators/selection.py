"""Diversified selection of scored chunks: coverage passes, a cap per source, deferred chunks.

The fill passes have a closed form: a chunk's tier follows from running counts per source, and
the result is the order by (tier, rank). ``selected`` runs all passes of a query over the rows that any of them can
take, which the lists of ``hybrid`` leave; these are few, whatever the number of chunks and sources.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tiers(ranked: DataFrame, *, cap: int, by: str = "query_id", source: str = "source", deferred: Column | None = None, chosen: Column | None = None) -> DataFrame:
    """Add ``tier`` to rows with ``rank``: -1 already chosen, 0 within the cap, 1 deferred within it, 2 and 3 beyond.

    ``deferred`` marks chunks that fill up after the others, ``chosen`` those that a coverage pass has
    taken; these count against their source's cap.
    """
    late = F.lit(False) if deferred is None else F.coalesce(deferred, F.lit(False))
    taken = F.lit(False) if chosen is None else F.coalesce(chosen, F.lit(False))
    rows = ranked.withColumns({"_late": late, "_taken": taken})
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    group = W.partitionBy(by, source)
    running = group.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    early, held = ~F.col("_late") & ~F.col("_taken"), F.col("_late") & ~F.col("_taken")
    before = one(F.col("_taken")).over(group)
    used = F.greatest(before, F.least(F.lit(cap), before + one(early).over(group)))
    tier = (
        F.when(F.col("_taken"), -1)
        .when(~F.col("_late"), F.when(before + one(early).over(running) <= cap, 0).otherwise(2))
        .otherwise(F.when(used + one(held).over(running) <= cap, 1).otherwise(3))
    )
    return rows.withColumn("tier", tier).drop("_late", "_taken")


def filled(ranked: DataFrame, k: int, *, cap: int, by: str = "query_id", source: str = "source", deferred: Column | None = None, chosen: Column | None = None, chosen_order: str = "rank") -> DataFrame:
    """The first ``k`` rows by (tier, rank), chosen rows first in their own order, as ``position``."""
    rows = tiers(ranked, cap=cap, by=by, source=source, deferred=deferred, chosen=chosen)
    order = W.partitionBy(by).orderBy("tier", F.when(F.col("tier") < 0, F.col(chosen_order)).otherwise(F.col("rank")))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def mode_coverage(scores: DataFrame, *, modes: Sequence[str], each: int, cap: int, by: str = "query_id", source: str = "source", key: str = "chunk_id", score: str = "score", held: str = "modes") -> DataFrame:
    """Rows taken so that every mode has ``each`` chunks, modes in sorted order, within the cap.

    A chunk of several modes is taken once, for the first of them that comes to it. A source's cap counts what earlier modes have taken.
    Of a mode's chunks at most ``cap + each * modes`` of a source can matter, and only those are shuffled.
    """
    taken: list[DataFrame] = []
    few = cap + max(1, each) * len(modes)
    for i, name in enumerate(sorted(modes)):
        group = W.partitionBy(by, source).orderBy(F.desc(score), key)
        rows = scores.where(F.array_contains(held, name)).withColumn("_n", F.row_number().over(group)).where(F.col("_n") <= few).drop("_n")
        if taken:
            before = reduce(DataFrame.unionByName, taken)
            counts = before.groupBy(by, source).agg(F.count("*").alias("_used"))
            rows = rows.join(before.select(by, key), [by, key], "left_anti").join(counts, [by, source], "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
        else:
            rows = rows.withColumn("_used", F.lit(0).cast("long"))
        rows = rows.withColumn("_own", F.row_number().over(group)).where(F.col("_used") + F.col("_own") <= cap)
        best = rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))).where(F.col("_n") <= max(1, each))
        taken.append(best.select(by, key, source, score, F.lit(name).alias("taken_for"), (F.lit(i * 1_000_000) + F.col("_n")).alias("taken_order")))
    return reduce(DataFrame.unionByName, taken)


def selected(rows: DataFrame, k: int, *, cap: int, pool: int, modes: bool = False, each_mode: int = 1, each_clause: int = 1, each_expansion: int = 1, by: str = "query_id") -> DataFrame:
    """(by, position, chunk_id, score, taken_for): ``k`` rows of each query in the order of selection.

    ``rows`` are candidates with chunk_id, source, score, late, modes (of the query that the chunk has), query_modes, matched, and clauses and
    expansions, arrays with the part of a pass's score that does not depend on ``score``, null where the pass refuses the chunk.
    Passes, each over what is left: with ``modes``, for each mode ``each_mode`` rows of the pool within the cap, then one of any rank for modes that still lack some;
    for each clause the best by its part and 0.05 of the score, rows that match a mode first; for each expansion the best by its part and 0.1 of the
    score; then by score: rows within the cap, late rows within it, other rows, other late rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        source, score, late = frame["source"].tolist(), frame["score"].to_numpy(float), frame["late"].to_numpy(bool)
        everything = np.arange(len(frame))
        taken: list[int] = []
        named: list[str] = []
        used: dict = {}

        def take(order, most: int, name: str, capped: bool) -> int:
            """Take up to ``most`` rows of ``order``; how many there were."""
            n = 0
            for i in map(int, order):
                if n == most or len(taken) == k:
                    break
                if i in taken or (capped and used.get(source[i], 0) >= cap):
                    continue
                taken.append(i)
                named.append(name)
                used[source[i]] = used.get(source[i], 0) + 1
                n += 1
            return n

        wanted = sorted(frame["query_modes"].iloc[0]) if modes else []
        of = {mode: np.flatnonzero([mode in held for held in frame["modes"]]) for mode in wanted}
        got = {mode: take(of[mode][of[mode] < pool], each_mode, "mode", True) for mode in wanted}
        for mode in wanted:
            if got[mode] < each_mode:
                take(of[mode], 1, "mode", False)
        match = frame["matched"].to_numpy(bool)

        def by_part(column: str, share: float) -> list[np.ndarray]:
            """The rows that each pass of a kind takes, best first."""
            parts = np.array(frame[column].tolist(), float).reshape(len(frame), -1).T
            values = [p + share * score for p in parts]
            return [order[v[order] > 0] for v in values for order in [np.argsort(np.where(np.isnan(v), np.inf, -v), kind="stable")]]

        for order in by_part("clauses", 0.05):
            left = each_clause - take(order[match[order]], each_clause, "clause", False)
            take(order, left, "clause", False)
        for order in by_part("expansions", 0.1):
            take(order, each_expansion, "expansion", False)
        for capped in (True, False):
            take(everything[~late], k, "fill", capped)
            take(everything[late], k, "late", capped)
        out = frame.iloc[taken][[by, "chunk_id", "score"]]
        return out.assign(position=np.arange(1, len(taken) + 1, dtype=np.int32), taken_for=named)[[by, "position", "chunk_id", "score", "taken_for"]]

    return rows.groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, position int, chunk_id {kinds['chunk_id']}, score double, taken_for string")
