import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import dot, overlap_share
from lodestone.operators import chunking, collect, conflicts, dashboard, feedback, hybrid, metrics, models, packing, runs, scoring, selection
from lodestone.settings import Settings


# --- selection and packing against direct folds --------------------------------------------------------------------
def greedy(rows, k, cap, late):
    """Pick rows of (rank, source) in passes, each over what is left."""
    chosen, used = [], {}

    def take(test, capped):
        for rank, source in rows:
            if len(chosen) < k and (rank, source) not in chosen and test(source) and (not capped or used.get(source, 0) < cap):
                chosen.append((rank, source))
                used[source] = used.get(source, 0) + 1

    take(lambda s: s != late, True)
    take(lambda s: s == late, True)
    take(lambda s: s != late, False)
    take(lambda s: s == late, False)
    return [r for r, _ in chosen]


def test_fill_passes_equal_the_greedy_fold(spark):
    rng = random.Random(3)
    cases = {q: [(i, rng.randrange(4)) for i in range(1, rng.randrange(2, 14))] for q in range(60)}
    df = spark.createDataFrame([(q, r, s) for q, rows in cases.items() for r, s in rows], "query_id int, rank int, source int")
    for k, cap in ((5, 2), (8, 1)):
        got = selection.filled(df, k, cap=cap, deferred=F.col("source") == 0).orderBy("query_id", "position").collect()
        found = {q: [r.rank for r in got if r.query_id == q] for q in cases}
        assert found == {q: greedy(rows, k, cap, 0) for q, rows in cases.items()}


def pack_fold(texts, budget, settings):
    out, left = [], budget
    for i, text in enumerate(texts):
        if i >= settings.max_packed_docs:
            break
        size = lambda t: 0 if not t else max(1, len(t) // 4)
        fit = text if size(text) <= settings.max_doc_tokens else text[: settings.max_doc_tokens * 4].strip()
        if size(fit) <= left:
            out.append(fit)
            left -= size(fit)
            continue
        if left >= 80:
            out.append(fit[: left * 4].strip())
        break
    return out


def test_packing_equals_the_fold(spark):
    rng = random.Random(4)
    settings = Settings(max_doc_tokens=120, max_packed_docs=4)
    cases = {q: ["x" * rng.choice([0, 3, 100, 300, 400, 900]) for _ in range(rng.randrange(1, 8))] for q in range(50)}
    df = spark.createDataFrame([(q, i + 1, t) for q, texts in cases.items() for i, t in enumerate(texts)], "query_id int, rank int, text string")
    rows = packing.packed(df, F.lit(300), settings=settings).orderBy("query_id", "rank").collect()
    assert {q: [r.packed_text for r in rows if r.query_id == q] for q in cases} == {q: pack_fold(t, 300, settings) for q, t in cases.items()}


def test_a_chunk_of_two_modes_is_taken_once(spark):
    rows = [(1, "a", "s1", 0.9, ["m1", "m2"]), (1, "b", "s1", 0.8, ["m2"]), (1, "c", "s1", 0.7, ["m2"]), (1, "d", "s2", 0.6, ["m2"])]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, source string, score double, modes array<string>")
    got = selection.mode_coverage(df, modes=["m1", "m2"], each=2, cap=2).orderBy("taken_order").collect()
    assert [(r.chunk_id, r.taken_for) for r in got] == [("a", "m1"), ("b", "m2"), ("d", "m2")]


def all_passes(rows, k, cap, pool, wanted, each):
    """The passes as plain loops; a row is (score, id, source, late, modes, matched, clause parts, expansion parts)."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1]))
    out, used = [], {}

    def add(r, capped):
        if r in out or len(out) == k or (capped and used.get(r[2], 0) >= cap):
            return False
        out.append(r)
        used[r[2]] = used.get(r[2], 0) + 1
        return True

    count = {}
    for mode in wanted:
        for r in rows[:pool]:
            if mode in r[4] and count.get(mode, 0) < each and add(r, True):
                count[mode] = count.get(mode, 0) + 1
    for mode in wanted:
        if count.get(mode, 0) < each:
            next((True for r in rows if mode in r[4] and add(r, False)), None)
    for column, share in ((6, 0.05), (7, 0.1)):
        for i in range(2):
            for _ in range(each):
                able = [r for r in rows if r not in out and r[column][i] is not None and r[column][i] + share * r[0] > 0]
                if column == 6 and any(r[5] for r in able):
                    able = [r for r in able if r[5]]
                if able:
                    add(max(able, key=lambda r: (r[column][i] + share * r[0], -rows.index(r))), False)
    for capped in (True, False):
        for late in (False, True):
            for r in rows:
                if r[3] == late:
                    add(r, capped)
    return [r[1] for r in out]


def test_all_passes_equal_plain_loops_over_all_rows(spark):
    rng = random.Random(8)
    cases, rows = {}, []
    for q in range(40):
        wanted = sorted(rng.sample(["m1", "m2", "m3"], rng.randrange(4)))
        found = []
        for i in range(rng.randrange(1, 90)):
            modes = sorted(m for m in wanted if rng.random() < 0.15)
            part = lambda: [round(rng.random(), 3) if rng.random() < 0.2 else None for _ in range(2)]
            found.append((rng.randrange(100) / 100, i, rng.randrange(5), rng.random() < 0.2, modes, bool(modes), part(), part()))
        cases[q] = (found, wanted)
        rows += [(q, r[1], r[2], r[0], r[3], r[4], wanted, *r[5:]) for r in found]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, source int, score double, late boolean, modes array<string>, query_modes array<string>, matched boolean, clauses array<double>, expansions array<double>")
    for k, cap, pool, each in ((6, 1, 6, 1), (9, 2, 12, 2)):
        few = hybrid.merged(df, hybrid.Lists(k, cap, pool, 3), ["m1", "m2", "m3"])
        got = selection.selected(few, k, cap=cap, pool=pool, modes=True, each_mode=each, each_clause=each, each_expansion=each).orderBy("query_id", "position").collect()
        for q, (found, wanted) in cases.items():
            assert [r.chunk_id for r in got if r.query_id == q] == all_passes(found, k, cap, pool, wanted, each), q
        plain = selection.selected(hybrid.merged(df, hybrid.Lists(k, cap, 0)), k, cap=cap, pool=0).where("taken_for not in ('fill', 'late')")
        assert {r.taken_for for r in plain.collect()} <= {"clause", "expansion"}


def test_packing_limits_before_it_sorts(spark):
    packed = packing.packed(spark.createDataFrame([(1, 1, "t")], "query_id int, rank int, text string"), F.lit(99))
    assert "WindowGroupLimit" in packed._jdf.queryExecution().executedPlan().toString()


# --- hybrid candidates -----------------------------------------------------------------------------------------------
def hybrid_tables(spark, n, sources, seed=4):
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    words = [f"t{i}" for i in range(30)]
    some = lambda k: draw.sample(words, draw.randrange(k))
    chunks = [(i, f"s{draw.randrange(sources)}", rng.normal(size=3).round(1).tolist(), some(9), draw.choice([[], [], ["acan"], ["rfp"], ["acan", "rfp"]])) for i in range(n)]
    part = lambda: {"tokens": some(4), "embedding": rng.normal(size=3).round(1).tolist(), "beside": some(3)}
    questions = [(q, [rng.normal(size=3).round(1).tolist() for _ in range(1 + q % 3)], some(8), [[], ["rfp"], ["acan", "rfp"]][q % 3], 0.5 if q % 2 else None, [part() for _ in range(q % 3)], [part() for _ in range(q % 2)]) for q in range(7)]
    kind = "array<struct<tokens:array<string>,embedding:array<float>,beside:array<string>>>"
    return (
        spark.createDataFrame(chunks, "chunk_id int, source string, embedding array<float>, vocab array<string>, cmodes array<string>").repartition(4),
        spark.createDataFrame(questions, f"query_id int, vectors array<array<float>>, tokens array<string>, qmodes array<string>, most double, clauses {kind}, extras {kind}"),
    )


def plain_scores(chunks, questions, settings):
    """All pairs by the columns of ``scoring``."""
    pairs = chunks.join(questions)
    near = lambda v: (dot(v, "embedding") + 1) / 2
    overlap = overlap_share(F.col("tokens"), F.col("vocab"))
    lexical = F.when(F.coalesce(F.col("most"), F.lit(0.0)) > 0, overlap / F.col("most")).otherwise(overlap)
    dense = F.array_max(F.transform("vectors", near))
    score = scoring.clipped(scoring.hybrid(dense, lexical, settings.retrieval_alpha) + scoring.mode_adjustment(F.col("qmodes"), F.col("cmodes"), settings))
    match = F.arrays_overlap("qmodes", "cmodes")
    own = lambda x: overlap_share(x["tokens"], F.col("vocab"))
    clause = lambda x: F.when(own(x) >= settings.clause_min_overlap, 0.75 * own(x) + 0.25 * near(x["embedding"]) + 0.1 * overlap_share(x["beside"], F.col("vocab")))
    extra = lambda x: F.when(own(x) >= settings.expansion_min_overlap, 0.55 * own(x) + 0.35 * near(x["embedding"]) + F.when(match, 0.08).otherwise(0.0))
    return pairs.select("query_id", "chunk_id", "source", dense.alias("dense"), overlap.alias("overlap"), score.alias("score"), (F.array_contains("cmodes", "acan") & ~F.array_contains("qmodes", "acan")).alias("late"), match.alias("matched"),
                        F.array_sort(F.array_intersect("cmodes", "qmodes")).alias("modes"), F.col("qmodes").alias("query_modes"), F.transform("clauses", clause).alias("clauses"), F.transform("extras", extra).alias("expansions"))


def shown_rows(df):
    near = lambda v: round(v, 9) if isinstance(v, float) else [near(x) for x in v] if isinstance(v, list) else v
    return sorted((tuple(near(v) for v in r) for r in df.collect()), key=repr)


def test_batches_score_as_columns_do(spark):
    chunks, questions = hybrid_tables(spark, 150, 12)
    settings = Settings(retrieval_alpha=0.6)
    every = hybrid.Lists(200, 200, 200)
    want = shown_rows(plain_scores(chunks, questions, settings))
    for limit, tile in ((1 << 20, 1 << 20), (0, 1 << 20), (0, 1500)):
        got = hybrid.candidates(chunks, questions, every, ["acan", "rfp"], settings, limit=limit, tile=tile)
        assert shown_rows(got) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    flat = hybrid.pairs(chunks, questions, ["acan", "rfp"], settings)
    assert [r[2:3] + r[5:] for r in shown_rows(flat)] == [(r[3], r[5]) for r in want]
    most = {r.query_id: r.most for r in hybrid.greatest_overlaps(chunks, questions).collect()}
    assert most == pytest.approx({q: max(r[4] for r in want if r[0] == q) for q in range(7)})
    assert hybrid.candidates(chunks.limit(0), questions, every, ["acan"]).count() == hybrid.candidates(chunks, questions.limit(0), every, ["acan"]).count() == 0


def test_shared_words_of_all_pairs(spark):
    chunks, questions = hybrid_tables(spark, 90, 5)
    want = sorted((r.query_id, r.chunk_id, round(r.o, 9)) for r in chunks.join(questions).select("query_id", "chunk_id", overlap_share(F.col("tokens"), F.col("vocab")).alias("o")).where("o > 0").collect())
    for limit, tile in ((1 << 20, 1 << 20), (0, 1 << 20), (0, 700)):
        got = scoring.lexical_scores(chunks, questions, limit=limit, tile=tile)
        assert sorted((r.query_id, r.chunk_id, round(r.overlap, 9)) for r in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert scoring.lexical_scores(chunks.limit(0), questions).count() == scoring.lexical_scores(chunks, questions.limit(0)).count() == 0


@pytest.mark.parametrize("sources", [3, 40, 5000])
def test_candidates_are_enough_for_every_selection(spark, sources, monkeypatch):
    chunks, questions = hybrid_tables(spark, 2_000, sources, seed=sources)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)  # many batches a task
    settings = Settings(retrieval_alpha=0.6)
    rows = plain_scores(chunks, questions, settings).cache()
    for k, cap, pool in ((4, 1, 0), (5, 2, 9)):
        few = hybrid.candidates(chunks, questions, hybrid.Lists(k, cap, pool, 2), ["acan", "rfp"], settings)
        pick = lambda df: [tuple(r)[:3] for r in selection.selected(df, k, cap=cap, pool=pool, modes=True).orderBy("query_id", "position").collect()]  # noqa: E731, B023
        assert pick(few) == pick(rows)
        # the pool's scores change: the lists still hold what can move up
        changed = lambda df: scoring.ranked(df, "score", "chunk_id").withColumn("score", F.when(F.col("rank") <= pool, F.col("score") * ((F.col("chunk_id") * 37) % 11) / 10).otherwise(F.col("score")))  # noqa: E731, B023
        assert pick(changed(few)) == pick(changed(rows))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_sends_few_rows_whatever_the_sources(spark):
    chunks = spark.range(20_000, numPartitions=2).select(F.col("id").alias("chunk_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"), F.array(F.lit("a")).alias("vocab"), F.array().cast("array<string>").alias("cmodes"))
    questions = spark.createDataFrame([(1, [[1.0, 0.0]])], "query_id int, vectors array<array<float>>")
    for k, cap, pool in ((10, 2, 60), (3, 1, 0)):
        lists = hybrid.Lists(k, cap, pool)
        rows = hybrid.grid.reduced(chunks, hybrid.asked(questions), lambda t: hybrid.Candidates(hybrid.Scorer(t, []), lists, hybrid.pa.int64(), hybrid.pa.string()), "query_id int, chunk_id long, " + hybrid._ROW.format(source="string"))  # noqa: B023
        assert rows.count() <= 2 * (pool + 2 * (pool + 2 * k) + 6 * k)


def test_many_queries_take_few_chunks_at_a_time():
    table = hybrid.pa.table({"x": list(range(10))})
    few, any_ = type("Few", (), {"at_once": 4})(), object()
    assert [p.column("x").to_pylist() for p in hybrid.grid._parts(table, few)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert [p.num_rows for p in hybrid.grid._parts(table, any_)] == [10] and list(hybrid.grid._parts(table.slice(0, 0), few)) == []
    assert hybrid.grid.at_once(10**6) == 16 and hybrid.grid.at_once(4) == hybrid.grid.CELLS // 4


def test_lists_of_a_union_are_the_lists_of_the_lists():
    draw = np.random.default_rng(1)
    lists = hybrid.Lists(2, 1, 3, 2)
    for _ in range(60):
        n = int(draw.integers(1, 80))
        rows = {"key": draw.permutation(n).astype(object), "source": draw.integers(0, 6, n), "score": draw.integers(0, 9, n) / 8, "late": draw.random(n) < 0.3, "matched": draw.random(n) < 0.5, "modes": draw.integers(0, 4, n)}
        value = np.where(draw.random(n) < 0.3, draw.random(n), np.nan)
        whole = set(lists.kept(rows, [value]).tolist())
        part = draw.integers(0, 3, n)
        few = np.concatenate([at[lists.kept({c: v[at] for c, v in rows.items()}, [value[at]])] for at in (np.flatnonzero(part == i) for i in range(3)) if len(at)])
        assert set(few[lists.kept({c: v[few] for c, v in rows.items()}, [value[few]])].tolist()) == whole


# --- scoring -------------------------------------------------------------------------------------------------------
def test_mode_adjustment(spark):
    rows = [([], ["acan"]), (["rfp"], ["rfp", "acan"]), (["rfp"], ["acan"]), (["rfp"], ["rfsa"]), (["rfp", "rfso"], ["rfsa"]), (["rfp"], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q array<string>, c array<string>")
    got = [r[0] for r in df.orderBy("i").select(scoring.mode_adjustment(F.col("q"), F.col("c"))).collect()]
    assert got == pytest.approx([0, 0.08, -0.18, -0.06, -0.024, 0])


def test_modes_are_substrings(spark):
    df = spark.createDataFrame([("the vacancy of a Standing-Offer",), ("none",)], "x string")
    assert [r[0] for r in df.select(scoring.modes_of(F.col("x"))).collect()] == [["acan", "rfso"], []]


def test_subqueries_split_only_at_question_words(spark):
    df = spark.createDataFrame([("What is the first long clause here and how must the second one be done?",), ("short and what",)], "x string")
    assert [r[0] for r in df.select(scoring.subqueries(F.col("x"))).collect()] == [["what is the first long clause here", "how must the second one be done"], []]


def test_rerank_blend_leaves_others_alone(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 1.0), (1, "b", 0.5, 3.0), (1, "c", 0.7, None)], "query_id int, chunk_id string, score double, rerank double")
    got = {r.chunk_id: r.score for r in scoring.rerank_blend(df).collect()}
    assert got == pytest.approx({"a": 0.2, "b": 0.8, "c": 0.7})


def test_dense_topk_equals_the_join(spark):
    rng = np.random.default_rng(2)
    chunks = spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(80)] + [(200, None)], "chunk_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(q, [rng.normal(size=4).round(1).tolist() for _ in range(1 + q % 2)]) for q in range(5)], "query_id int, vectors array<array<float>>")
    best = lambda limit: sorted(tuple(r) for r in scoring.ranked(scoring.dense_topk(chunks, queries, 6, limit=limit), "score", "chunk_id", limit=6).collect())
    assert best(1 << 20) == best(0) and len(best(0)) == 30
    assert scoring.dense_topk(chunks, queries.limit(0), 6).count() == 0


# --- chunking ------------------------------------------------------------------------------------------------------
def test_chunk_rules():
    blocks = list(chunking.blocks_of("Title\n\n```\na\n\nb\n```\n| a | b |\n| c | d |\n- x\n\n  y\n10. z\n1. no list\nplain".split("\n")))
    assert blocks == ["Title", "```\na\n\nb\n```", "| a | b |\n| c | d |", "- x\n\n  y\n10. z", "1. no list\nplain"]
    assert chunking.heading_of("Step 3: do\nx") == "Step 3: do"
    assert chunking.heading_of("a lower line") is None
    assert chunking.heading_of("1.2 Scope of it all.") == "1.2 Scope of it all."
    assert list(chunking.pieces_of("aa\nbb\ncc", 5)) == ["aa\nbb", "cc"]
    assert list(chunking.pieces_of("x" * 9, 5)) == ["x" * 9]


def test_chunks_overlap_by_whole_blocks():
    text = "Alpha\n\n" + "\n\n".join(c * 40 for c in "abcd")
    got = chunking.chunks_of(text, 100, 30)
    assert [t for t, _ in got] == ["Alpha"] * len(got)
    assert got[0][1].split("\n\n") == ["Alpha", "a" * 40, "b" * 40]
    assert got[1][1].split("\n\n") == ["b" * 40, "c" * 40]
    assert chunking.chunks_of("  \r\n ", 100, 30) == []


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, "doc", "One.\n\nTwo"), (2, "none", None)], "id int, stem string, body string")
    rows = chunking.chunked(df, carry=("id",)).collect()
    assert [(r.id, r.chunk_id, r.text) for r in rows] == [(1, "doc__0", "One.\n\nTwo")]


def test_retrieval_text(spark):
    df = spark.createDataFrame([("T", "", "S", "", 3, "body"), ("", "", "", "", 0, "body")], "source_title string, title string, section_title string, doc_type string, authority_rank int, text string")
    got = [r[0] for r in df.select(chunking.retrieval_text(True)).collect()]
    assert got == ["TITLE: T\nSECTION: S\nAUTHORITY_RANK: 3\n\nbody", "body"]


# --- conflicts -----------------------------------------------------------------------------------------------------
def test_conflict_labels(spark):
    rows = [("you must file", "you must not file", 0.5, 0.5), ("when asked", "fine", 0.5, 0.5), ("it is mandatory", "you should", 0.1, 0.5), ("plain", "words", 0.5, 0.0), ("plain", "words", 0.1, 0.1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, s double, o double")
    got = [r[0] for r in df.orderBy("i").select(conflicts.label(F.col("a"), F.col("b"), F.col("s"), F.col("o"))).collect()]
    assert got == ["direct_contradiction", "conditional_applicability", "amplification", "partial_overlap", "no_conflict"]


def test_conflict_section(spark):
    found = spark.createDataFrame([(1, 1, "x", "y", 0.5, "amplification"), (1, 2, "x", "z", 0.4, "no_conflict")], "query_id int, n int, a_chunk_id string, b_chunk_id string, confidence double, label string")
    got = {r.query_id: r.section for r in conflicts.prompt_section(found, spark.createDataFrame([(1,), (2,)], "query_id int")).collect()}
    assert got[1].startswith("Conflict detected:\n* [x] against [y] -> amplification @0.5\n") and "[z]" not in got[1]
    assert got[2].startswith("Conflict detected:\n* ") and "[" not in got[2]


# --- feedback ------------------------------------------------------------------------------------------------------
VOTES = "line_no long, conversation_id string, target string, feedback_type string, thumb string, cited_chunk_ids array<string>, timestamp long"


def votes(spark, *rows):
    return spark.createDataFrame([(i, "c", t, "citation", thumb, chunks, i) for i, (t, thumb, chunks) in enumerate(rows)], VOTES)


def fold(rows):
    """Weights after votes in order, all chunks of a conversation together."""
    weights, kept = {}, {}
    for target, thumb, chunks in rows:
        own = kept.setdefault(target, {})
        weights.update(own)
        if thumb != "none":
            for c in chunks:
                own.setdefault(c, weights.get(c, 1.0))
                weights[c] = min(2.0, max(0.2, weights.get(c, 1.0) * {"up": 1.05, "side": 0.95, "down": 0.8}[thumb]))
    return weights


def test_votes_do_not_commute(spark):
    one = {r.chunk_id: r.weight for r in feedback.vote_weights(votes(spark, ("A", "up", ["x"]), ("B", "down", ["x"]), ("A", "none", ["x"]))).collect()}
    two = {r.chunk_id: r.weight for r in feedback.vote_weights(votes(spark, ("A", "up", ["x"]), ("A", "none", ["x"]), ("B", "down", ["x"]))).collect()}
    assert one == {"x": 1.0} and two == {"x": 0.8}


def test_votes_equal_the_fold(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ABC"), rng.choice(["up", "side", "down", "none"]), rng.sample(["x", "y", "z"], rng.randrange(1, 3))) for _ in range(120)]
    got = {r.chunk_id: r.weight for r in feedback.vote_weights(votes(spark, *rows)).collect()}
    assert got == pytest.approx(fold(rows))


def test_normalised_events(spark):
    raw = spark.createDataFrame([(0, " 12 ", "", " t ", "odd", "UP", " hi ", None, None, [" a ", ""], None), (1, "x", "c", "t", "answer", "none", None, "q", "r", None, " b ")],
                                "line_no long, timestamp string, conversation_id string, turn_id string, feedback_type string, thumb string, comment string, question string, answer string, cited_chunk_ids array<string>, target_chunk_id string")
    a, b = feedback.normalised(raw).orderBy("line_no").collect()
    assert (a.timestamp, a.conversation_id, a.turn_id, a.feedback_type, a.thumb, a.comment, a.cited_chunk_ids, a.target_chunk_id) == (12, "default", "t", "citation", "up", "hi", ["a"], "a")
    assert (b.timestamp, b.feedback_type, b.cited_chunk_ids, b.target_chunk_id) == (None, "answer", [], "b")
    assert feedback.rejected(raw).count() == 1


def test_summary_shows_both_kinds(spark):
    now = spark.createDataFrame([("citation", "down", 100), ("citation", "none", 200), ("citation", "side", 100)], "feedback_type string, thumb string, timestamp long")
    rows = {r.feedback_type: r for r in feedback.summary(now, F.lit(150)).collect()}
    assert (rows["citation"].total, rows["citation"].attention_rate, rows["citation"].last_updated) == (2, 1.0, 200)
    assert (rows["answer"].total, rows["answer"].up_rate, rows["answer"].last_updated) == (0, 0.0, None)


def test_stream_weights_equal_the_batch(spark, tmp_path):
    from lodestone.streaming import feedback as stream

    rng = random.Random(2)
    rows = [{"line_no": i, "conversation_id": rng.choice("cd"), "target": rng.choice("ABC"), "feedback_type": rng.choice(["citation"] * 5 + ["answer"]), "thumb": rng.choice(["up", "down", "none"]), "cited_chunk_ids": rng.sample("xyz", rng.randrange(1, 3)), "timestamp": i} for i in range(40)]
    log = tmp_path / "log"
    log.mkdir()
    for part in range(4):
        (log / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part * 10 : part * 10 + 10]))
        os.utime(log / f"{part}.json", (1_700_000_000 + 60 * part,) * 2)  # a stream takes files by age
    for name, sink in (("weights", stream.stream_weights), ("latest", stream.stream_latest)):
        q = sink(stream.read_log(spark, str(log), files_per_trigger=1), str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    batch = feedback.vote_weights(spark.createDataFrame(rows, stream.EVENT))
    key = lambda r: (r.conversation_id, r.chunk_id)
    expected = {key(r): pytest.approx(r.weight) for r in batch.collect()}
    assert len(expected) == 6 and {key(r): r.weight for r in stream.weights(spark, str(tmp_path / "weights")).collect()} == expected
    last = {(r["conversation_id"], r["target"]): r["line_no"] for r in rows}
    assert {(r.conversation_id, r.target): r.line_no for r in stream.latest_events(spark, str(tmp_path / "latest")).collect()} == last


def test_keyed_state_equals_the_batch_after_a_restart(spark, tmp_path):
    from lodestone.streaming import feedback as stream
    from lodestone.streaming import state

    rng = random.Random(6)
    rows = [{"line_no": i, "conversation_id": rng.choice("cd"), "target": rng.choice("ABCD"), "feedback_type": rng.choice(["citation"] * 6 + ["answer"]), "thumb": rng.choice(["up", "down", "side", "none"]), "cited_chunk_ids": rng.sample("wxyz", rng.randrange(1, 3)), "timestamp": i} for i in range(60)]
    rows[45:] = [{**r, "conversation_id": "e", "target": "A"} for r in rows[45:]]
    log, out = tmp_path / "log", str(tmp_path / "weights")
    log.mkdir()
    reports = []
    for parts in (range(2), range(2, 4)):  # the query is started again, from its checkpoint
        for part in parts:
            (log / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part * 15 : part * 15 + 15]))
            os.utime(log / f"{part}.json", (1_700_000_000 + 60 * part,) * 2)
        found = state.stateful_weights(stream.read_log(spark, str(log), files_per_trigger=1))
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        reports += [p for p in q.recentProgress if p["numInputRows"]]
    key = lambda r: (r.conversation_id, r.chunk_id)
    expected = {key(r): pytest.approx(r.weight) for r in feedback.vote_weights(spark.createDataFrame(rows, stream.EVENT)).collect()}
    assert {key(r): r.weight for r in state.latest_weights(spark, out).collect()} == expected and len(expected) > 9
    # the last batch votes in one conversation only, and writes state of its keys alone
    fold = next(o for o in reports[-1]["stateOperators"] if o["numRowsTotal"] == max(x["numRowsTotal"] for x in reports[-1]["stateOperators"]))
    assert len(reports) == 4 and fold["numRowsUpdated"] < fold["numRowsTotal"] / 2


def test_standing_counts_equal_the_summary_at_every_batch(spark, tmp_path):
    from lodestone.streaming import feedback as stream
    from lodestone.streaming import state

    rng = random.Random(9)
    day = 86_400
    rows = [{"line_no": i, "conversation_id": rng.choice("cd"), "target": rng.choice("ABCDE"), "feedback_type": rng.choice(["citation", "answer"]), "thumb": rng.choice(["up", "down", "side", "none"]), "cited_chunk_ids": [], "timestamp": i * day // 6 + rng.randrange(day)} for i in range(60)]
    late = rows.pop(20)  # comes with the last batch, older by its line than what stands then
    log, out = tmp_path / "log", str(tmp_path / "changes")
    log.mkdir()
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    seen = []
    for part in range(4):
        batch = rows[part * 15 : part * 15 + 15] + [late] * (part == 3)
        seen += batch
        (log / f"{part}.json").write_text("\n".join(json.dumps(r) for r in batch))
        q = state.standing_changes(stream.read_log(spark, str(log))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        now = F.lit(max(r["timestamp"] for r in seen))
        current = feedback.latest(spark.createDataFrame(seen, stream.EVENT), "feedback_type", "conversation_id", "target")
        assert shown(state.activity(spark, out, now)) == shown(feedback.summary(current, now))


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    from lodestone.streaming.tables import Buckets

    kept = Buckets(spark, str(tmp_path / "t"), "k string, n long", ("k",), buckets=3)
    one = spark.createDataFrame([(str(i), 0) for i in range(12)], "k string, n long")
    kept.write(one, 0)
    for version in (1, 2, 2, 3):
        new = spark.createDataFrame([("5", version)], "k string, n long")
        only = kept.touched(new)
        kept.write(kept.read(version, only).where("k != '5'").unionByName(new), version)
    assert {r.k: r.n for r in kept.read().collect()} == {**{str(i): 0 for i in range(12)}, "5": 3}
    assert {r.k: r.n for r in kept.read(3).collect()}["5"] == 2 and sorted(map(len, kept.versions().values())) == [1, 1, 2]


# --- run artifacts ---------------------------------------------------------------------------------------------------
def test_nested_numbers_of_payloads(spark):
    texts = ['{"a":{"b":1,"c":true,"d":"7","e":null,"f":[1],"g":{"h":2.5}}}', '{"a":{"b":false}}', '{"a":3}', "[1]", "{broken", None, '{"a":{"b":{"c":9}}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.try_parse_json("t").alias("p"))
    paths = [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "f"), ("a", "g", "h"), ("a",), ("a", "b", "c")]
    got = {r.path: (r.n, r.mean) for r in runs.collected(rows, "p", paths).collect()}
    assert got == {"a.b": (2, 0.5), "a.c": (1, 1.0), "a.d": (0, None), "a.e": (0, None), "a.f": (0, None), "a.g.h": (1, 2.5), "a": (1, 3.0), "a.b.c": (1, 9.0)}
    found = sorted((r.i, r.path, r.value) for r in runs.leaves(rows, "i", "p").collect())
    assert found == [(0, "a.b", 1.0), (0, "a.c", 1.0), (0, "a.g.h", 2.5), (1, "a.b", 0.0), (2, "a", 3.0), (6, "a.b.c", 9.0)]


def test_run_summaries(spark, tmp_path):
    from lodestone.sources import readers

    cases = [{"chat_error": "x", "answer": " "}, {"chat_error": "", "judge": {"error": "y"}, "answer": "yes"}, {"judge": None, "answer": None}, {"answer": 4}, "odd", {"chat_error": None, "judge": "z", "answer": "no"}]
    (tmp_path / "one.json").write_text(json.dumps({"config": {"top_k": 3}, "overall_metrics": {"retrieval_gold_doc_mrr_mean": 0.5}, "cases": cases}))
    (tmp_path / "two.json").write_text(json.dumps({"cases": {"no": "list"}, "subgroup_metrics": {"by_mode": {"rfp": {"count": 2}}}}))
    (tmp_path / "three.json").write_text("{broken")
    got = {r.run_id: r for r in runs.summaries(readers.run_payloads(spark, str(tmp_path)), "run_id", "payload").collect()}
    assert tuple(got["one"].error_breakdown) == (6, 1, 1, 3) and got["one"].key_metrics.retrieval.mrr == 0.5 and got["one"].config.toPython() == {"top_k": 3}
    assert tuple(got["two"].error_breakdown) == (0, 0, 0, 0) == tuple(got["three"].error_breakdown)
    assert got["two"].subgroup_metrics.toPython()["by_mode"]["rfp"]["count"] == 2 and got["three"].overall_metrics is None and got["two"].key_metrics.retrieval.mrr is None


# --- metrics -------------------------------------------------------------------------------------------------------
def test_worked_retrieval_examples(spark):
    retrieved = spark.createDataFrame([(1, 1, "z"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a"), (2, 2, "a"), (2, 3, "a"), (2, 4, "b"), (4, 1, "q")], "case_id int, rank int, prefix string")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "case_id int, prefix string")
    rows = {r.case_id: r for r in metrics.retrieval_metrics(retrieved, gold).collect()}
    assert (rows[1].gold_doc_precision_at_k, rows[1].gold_doc_top1_hit, rows[1].gold_doc_mrr) == (0.666667, 0.0, 0.5)
    assert (rows[2].gold_doc_precision_at_k, rows[2].gold_doc_recall_at_k) == (0.5, 1.0) and rows[2].gold_doc_ndcg <= 1
    assert (rows[3].gold_doc_recall_at_k, rows[3].gold_doc_mrr, rows[3].gold_doc_ndcg) == (0.0, None, None)
    assert (rows[4].gold_doc_recall_at_k, rows[4].unique_prefix_fraction) == (None, 1.0)


def test_evidence_by_prefix_or_chunk(spark):
    claims = spark.createDataFrame([(1, "x", ["a"], None), (1, "y", None, ["c__1"]), (1, "z", ["no"], ["no__1"])], "case_id int, claim string, prefixes array<string>, chunk_ids array<string>")
    seen = spark.createDataFrame([(1, "a", "a__0"), (1, "c", "c__1")], "case_id int, prefix string, chunk_id string")
    r = metrics.evidence_coverage(claims, seen).first()
    assert (r.claim_count, r.covered_count, r.claim_evidence_coverage) == (3, 2, 0.666667)


def test_timings(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40)], "v double")
    assert metrics.timings(df, "v").first().asDict() == {"p50": 25.0, "p95": 38.5, "mean": 25.0}
    assert metrics.timings(df.where("v < 0"), "v").first().asDict() == {"p50": 0.0, "p95": 0.0, "mean": 0.0}


def test_bootstrap_of_one_value(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("b", 1, 1.0), ("b", 2, 0.0)], "g string, i int, v double")
    rows = {r.g: r for r in metrics.bootstrap(df, "v", "i", ["g"]).collect()}
    assert (rows["a"].low, rows["a"].high, rows["a"].n) == (0.5, 0.5, 1)
    assert (rows["b"].low, rows["b"].high) == (0.0, 1.0)


def plain_interval(values, samples):
    seed, means = 1337, []
    for _ in range(samples):
        total = 0.0
        for _ in values:
            seed ^= seed << 13 & 0xFFFFFFFF
            seed ^= seed >> 17
            seed ^= seed << 5 & 0xFFFFFFFF
            total += values[seed % len(values)]
        means.append(total / len(values))
    return [round(float(np.quantile(means, q)), 6) for q in (0.025, 0.975)]


def test_bootstrap_in_blocks_equals_a_plain_loop(spark):
    groups = {"a": [(i * 37 % 101) / 7 for i in range(57)], "b": [1.5, 2.0], None: [float(i % 9) for i in range(23)]}
    rows = [(g, i, v) for g, values in groups.items() for i, v in enumerate(values)][::-1]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(3)
    for block, draws in ((1 << 20, 10**8), (10, 500)):
        got = {r.g: r for r in metrics.bootstrap(df, "v", "i", ["g"], resamples=40, block=block, draws=draws).collect()}
        assert {g: [got[g].low, got[g].high] for g in got} == {g: pytest.approx(plain_interval(v, 40), abs=2e-6) for g, v in groups.items()}
        assert {g: r.n for g, r in got.items()} == {"a": 57, "b": 2, None: 23}


def test_batches_of_chunks_and_their_matrices_are_modest(spark):
    import tracemalloc

    import pyarrow as pa

    from lodestone.operators import grid, hybrid
    from lodestone.settings import Settings

    class Widest:
        at_once = 1 << 30

        def __init__(self, table):
            self.most, self.n = 0, 0

        def add(self, table):
            self.most, self.n = max(self.most, table.nbytes), self.n + table.num_rows

        def rows(self):
            return pa.table({"n": [self.n], "most": [self.most]})

    chunks = spark.range(0, 3_000, 1, 1).selectExpr("id AS chunk_id", "array_repeat('a word', 1000) AS vocab")
    seen = grid.reduced(chunks, spark.range(1).selectExpr("id AS query_id"), Widest, "n long, most long").collect()
    assert sum(r.n for r in seen) == 3_000 and 0 < max(r.most for r in seen) <= 10 << 20
    # what a worker works out for all questions at once does not depend on how many chunks a batch has
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(2_000)]
    part = lambda: {"tokens": rng.choice(words, 8).tolist(), "embedding": rng.normal(size=16).tolist(), "beside": []}
    asked = [{"query_id": q, "vectors": [rng.normal(size=16).tolist()], "tokens": [], "qmodes": [], "most": 0.0, "clauses": [part(), part()], "extras": []} for q in range(200)]
    scorer = hybrid.Scorer(pa.Table.from_pylist(asked), (), Settings(enable_mode_routing=False))
    held = hybrid.Candidates(scorer, hybrid.Lists(11, 3, 0), pa.int64(), pa.int64())
    n = min(4_096, held.at_once)
    vocab = [rng.choice(words, 100, replace=False).tolist() for _ in range(n)]
    table = pa.table({"chunk_id": np.arange(n), "source": np.arange(n) % 50, "embedding": rng.normal(size=(n, 16)).tolist(), "vocab": vocab, "cmodes": pa.array([[]] * n, pa.list_(pa.string()))})
    tracemalloc.start()
    held.add(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_groups_of_one_size_share_their_draws(spark, monkeypatch):
    sizes = [3] * 40 + [1, 2, 50, 64, 65, 300]
    groups = {g: [((g + 3) * i * 37 % 101) / 7 for i in range(n)] for g, n in enumerate(sizes)}
    groups[None] = [1.0, 9.0, 2.5, 4.0]
    df = spark.createDataFrame([(g, i if i else None, v) for g, values in groups.items() for i, v in enumerate([*values[1:], values[0]], 1) for i in [i % len(values)]], "g int, i int, v double").repartition(3)
    ordered = {g: [*v[1:], v[0]] for g, v in groups.items()}  # a row without order comes last
    for whole in (1024, 64):
        got = {r.g: r for r in metrics.bootstrap(df, "v", "i", ["g"], resamples=40, whole=whole).collect()}
        assert {g: r.n for g, r in got.items()} == {g: len(v) for g, v in groups.items()}
        assert {g: [r.low, r.high] for g, r in got.items()} == {g: pytest.approx(plain_interval(v, 40), abs=2e-6) for g, v in ordered.items()}
    # no generator is started for a group: a task takes the draws of 40 groups from its first numbers
    import pyarrow as pa

    numbers, calls = metrics._numbers(0, 3 * 1000), []
    monkeypatch.setattr(metrics, "_moved", lambda *x: calls.append(x))
    lists = pa.array([groups[g] for g in range(40)], pa.list_(pa.float64()))
    lengths, ends = metrics._whole(lists, numbers, 1000)
    assert lengths.tolist() == [3] * 40 and ends.shape == (40, 2) and not calls
    # and neither groups nor resamples are shuffled as rows of their own
    text = metrics.bootstrap(df.where("g < 40"), "v", "i", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in text


def test_draws_of_large_groups_are_made_once(spark, monkeypatch):
    n = 5_000
    state, want = np.full(1, metrics.SEED, np.uint32), []
    for _ in range(3 * n):
        state = metrics._step(state)
        want.append(int(state[0] % n))
    assert metrics.drawn(n, 0, n).tolist() == want[:n] and metrics.drawn(n, 2 * n + 17, 900).tolist() == want[2 * n + 17 : 2 * n + 917]
    df = spark.createDataFrame([("a", i, float(i * 7919 % 101)) for i in range(n)], "g string, i int, v double")
    plans = {b: metrics.bootstrap(df, "v", "i", ["g"], resamples=6, block=b) for b in (n, 64)}
    assert plans[n].collect() == plans[64].collect()
    # of 79 blocks each takes part in one meeting for all samples, and no task makes a draw for each block
    numbered = metrics._numbered(df, ["g"], "v", "i").withColumn("block", F.expr("i div 64"))
    packs = numbered.groupBy("g", "n", "block").agg(F.lit(b"").alias("raw"))
    left = metrics._large_sums(numbered, packs, ["g"], "g string, ", 6, 64)
    text = left._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1


def test_claims_meet_sentences_in_tiles(spark):
    rng = np.random.default_rng(5)
    vector = lambda: rng.normal(size=5).tolist()
    claims = [(c, i, vector()) for c, n in (("a", 30), ("b", 1), ("none", 3), (None, 2)) for i in range(n)]
    said = [(c, i, vector()) for c, n in (("a", 45), ("b", 2), ("other", 4)) for i in range(n)]
    kinds = "case_id string, {} int, embedding array<double>"
    c, s = spark.createDataFrame(claims, kinds.format("claim_id")), spark.createDataFrame(said, kinds.format("sentence_id"))
    for apart in (None, "sentence_id"):
        want = {(k, i): max((float(np.dot(v, w)) for k2, j, w in said if k == k2 and not (apart and i == j)), default=0.0) for k, i, v in claims if k is not None}
        for tile in (4096, 7):
            got = {(r.case_id, r.claim_id): r.similarity for r in metrics.claim_similarity(c, s, apart=apart, tile=tile).collect()}
            assert got == pytest.approx(want)


def test_bootstrap_of_a_large_group(spark):
    df = spark.range(30_000).selectExpr("'g' AS g", "id AS i", "CAST(id % 100 AS DOUBLE) AS v")
    r = metrics.bootstrap(df, "v", "i", ["g"], resamples=20, block=7_000).first()
    values = [float(i % 100) for i in range(30_000)]
    assert (r.n, [r.low, r.high]) == (30_000, pytest.approx(plain_interval(values, 20), abs=2e-6))


def test_citations_match_by_id_or_ending(spark):
    cited = spark.createDataFrame([(1, 0, "b__1"), (1, 1, "x__9"), (1, 2, "zz")], "case_id int, sentence_id int, citation string")
    seen = spark.createDataFrame([(1, 1, "ab__1"), (1, 2, "b__1"), (1, 3, "y/x__9"), (1, 4, "z/x__9")], "case_id int, rank int, chunk_id string")
    assert sorted((r.sentence_id, r.chunk_id) for r in metrics.matched_citations(cited, seen).collect()) == [(0, "b__1"), (1, "y/x__9")]


# --- dashboard, models, collection -----------------------------------------------------------------------------------
def test_comparison_tones(spark):
    a = spark.createDataFrame([("retrieval_noise_rate_mean", 0.2), ("x", 1.0), ("gone", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("retrieval_noise_rate_mean", 0.1), ("x", 1.0)], "metric string, value double")
    assert {r.metric: r.tone for r in dashboard.compared(a, b).collect()} == {"retrieval_noise_rate_mean": "good", "x": "neutral", "gone": "neutral"}


def test_offline_client(spark):
    client = models.OfflineClient()
    assert np.allclose(np.linalg.norm(client.embed(["alpha beta", "gamma"]), axis=1), 1)
    assert client.rerank("alpha beta", ["beta beta", "none"]) == [0.5, 0.0]
    df = spark.createDataFrame([("q", [("d__1", "First. Second")], [])], "message string, documents array<struct<chunk_id:string,text:string>>, history array<struct<role:string,text:string>>")
    assert models.answered(df).first().answer.startswith("First. [d__1]")


def test_failing_model_is_a_row(spark):
    class Failing:  # local, so that it is sent to the workers whole
        def chat(self, message, documents, history, max_tokens):
            raise RuntimeError("down")

    df = spark.createDataFrame([("q",)], "message string").withColumns({"documents": F.array().cast("array<struct<chunk_id:string,text:string>>"), "history": F.array().cast("array<struct<role:string,text:string>>")})
    row = models.answered(df, Failing).first()
    assert row.answer is None and row.answer_error == "RuntimeError: down"


PAGE = """<html><head><title>T</title><meta name="dcterms.modified" content="2024-02-03"></head><body><nav><li>menu</li></nav><main>
<h1>Head &amp; more</h1><p>Some <b>bold text.</p><ul><li><p>Inner item</p></li><li>Search</li></ul><p>Some bold text.</p></main></body></html>"""


def test_pages_become_documents(spark):
    df = spark.createDataFrame([(1, "https://example.org/a", PAGE), (2, "https://example.org/b", None)], "page_id int, url string, html string")
    one, two = collect.extracted(df).orderBy("page_id").collect()
    assert (one.title, one.date_modified) == ("Head & more", "2024-02-03")
    assert one.text.split("\n")[0] == "Head & more" and "menu" not in one.text and "Inner item" in one.text and "Search" not in one.text.split("\n")
    assert (two.title, two.text) == ("Untitled", "")


def test_directive_document():
    xml = '<doc title="D"><chapter title="One" anchor="1"><clause anchor="1.1">Do <b>it</b></clause><clause anchor="1.1">Do <b>it</b></clause></chapter><note>Date modified: 2023-01-02</note></doc>'
    assert collect.directive_document(xml) == ("D", "1 One\n1.1 Do it", "2023-01-02")


def test_line_dedupe_drops_containers(spark):
    long = "x" * 45
    df = spark.createDataFrame([(["a", "a", long, long + " and at least twenty more"],)], "l array<string>")
    assert df.select(collect.deduplicated_lines("l")).first()[0] == ["a", long]


def test_changes_and_manifest(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "canonical_url string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x")], "canonical_url string, content_hash string")
    assert {r.canonical_url: r.status for r in collect.changed(now, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    rows = spark.createDataFrame([("b", 1, "old", 1), ("b", 1, "new", 2), ("a", 2, "x", 3)], "canonical_url string, authority_rank int, title string, seq int")
    assert [(r.canonical_url, r.title) for r in collect.manifest(rows, "seq").collect()] == [("b", "new"), ("a", "x")]


def test_a_long_chain_of_pages_is_reached_to_its_end(spark):
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(53)] + [("p53", "p0")], "source string, target string").coalesce(1)
    rows = collect.reachable(spark.createDataFrame([("p0",)], "url string"), edges).collect()
    assert {r.url: r.level for r in rows} == {f"p{i}": i for i in range(54)}


def test_votes_against_are_numbered_alike_with_and_without_a_limit(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["citation", "answer"]), rng.choice(["side", "down", "up"]), rng.randrange(9) or None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "feedback_type string, thumb string, timestamp long, first_line int")
    all_ = {(r.feedback_type, r.first_line): r.position for r in feedback.negatives(df).collect()}
    for kind in ("citation", "answer"):
        order = sorted((r for r in rows if r[0] == kind and r[1] != "up"), key=lambda r: (-(r[2] or 0), r[3]))
        assert [all_[kind, r[3]] for r in order] == list(range(1, len(order) + 1))
    assert {(r.feedback_type, r.first_line): r.position for r in feedback.negatives(df, most=7).collect()} == {k: v for k, v in all_.items() if v <= 7}


def test_every_setting_is_used():
    from dataclasses import fields
    from pathlib import Path

    import lodestone

    code = "\n".join(p.read_text() for p in Path(lodestone.__file__).parent.rglob("*.py") if p.name != "settings.py" and "llm" not in p.parts)
    assert [f.name for f in fields(Settings) if f"settings.{f.name}" not in code and f"DEFAULTS.{f.name}" not in code] == []
