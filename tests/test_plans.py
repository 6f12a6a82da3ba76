import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.operators import chunking, collect
from lodestone.plans import answer, crawl, evaluate
from lodestone.settings import Settings
from lodestone.sources import fetch, readers

DOCS = [("a", "Rfp guide", "An rfp is a request for proposal.\n\nSuppliers must send the offer before closing."),
        ("b", "Acan guide", "An acan names a single known business.\n\nFiles must hold the reason."),
        ("c", "Travel", "Travel is booked by the office. Tickets are kept.")]


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.createDataFrame([(s, s, t, f"{s}.txt", f"https://x/{s}", "guide", 3, b) for s, t, b in DOCS], "stem string, title string, source_title string, source_path string, source_url string, doc_type string, authority_rank int, body string")
    cut = chunking.chunked(docs, carry=("title", "source_title", "source_path", "source_url", "doc_type", "authority_rank"), settings=Settings(chunk_chars=60, chunk_overlap=0))
    return answer.indexed(cut).cache()


QUESTIONS = "query_id int, conversation_id string, question string, language string, expansions array<string>"


def test_answers(spark, chunks):
    q = spark.createDataFrame([(1, "c1", "When must suppliers send the rfp offer?", "en", ["closing of offers"]), (2, "c2", "Who books travel tickets?", "fr", [])], QUESTIONS)
    settings = Settings(top_k=3)
    found = answer.retrieved(chunks, answer.prepared(q), settings=settings).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in found if r.query_id == 1][0].startswith("a__") and [r.chunk_id for r in found if r.query_id == 2][0] == "c__0"
    assert all("b__" not in r.chunk_id for r in found[:2])
    weights = spark.createDataFrame([("c1", found[0].chunk_id, 0.2)], "conversation_id string, chunk_id string, weight double")
    complaints = spark.createDataFrame([("c1", "down", "wrong")], "conversation_id string, thumb string, comment string")
    history = spark.createDataFrame([("c1", 1, "USER", "hi")], "conversation_id string, turn int, role string, text string")
    rows = {r.query_id: r for r in answer.answered(chunks, q, history=history, weights=weights, complaints=complaints, settings=settings).collect()}
    assert "[" in rows[2].answer and rows[2].citations[0].link == "https://x/c" and rows[1].n_docs == 3


def test_coverage_switch(spark, chunks):
    q = spark.createDataFrame([(1, "c1", "acan or rfp rules", "en", [])], QUESTIONS)
    found = answer.retrieved(chunks, answer.prepared(q), settings=Settings(top_k=2, enable_mode_coverage=True))
    assert {r.chunk_id[0] for r in found.collect()} == {"a", "b"}


def test_clause_and_expansion_switches(spark, chunks):
    q = spark.createDataFrame([(1, "c1", "How must suppliers send the offer and who books the travel tickets?", "en", [])], QUESTIONS)
    plain = Settings(top_k=2, enable_rerank=False)
    for more in ({"enable_clause_coverage": True, "min_chunks_per_clause": 1}, {"enable_query_expansion": True, "expansion_min_overlap": 0.01}):
        settings = Settings(top_k=2, enable_rerank=False, **more)
        ready = answer.prepared(q, settings=settings).first()
        assert ready.clauses or ready.extras
        found = answer.retrieved(chunks, answer.prepared(q, settings=settings), settings=settings).collect()
        assert len(found) == 2
        if "enable_clause_coverage" in more:
            assert {r.chunk_id[0] for r in found} == {"a", "c"}
    assert not answer.prepared(q, settings=plain).first().clauses


class Talking:
    """Answers the plan's own requests with JSON."""

    def __init__(self):
        from lodestone.operators.models import OfflineClient

        self.offline = OfflineClient()
        self.embed, self.rerank = self.offline.embed, self.offline.rerank

    def chat(self, message, documents, history, max_tokens):
        if "search queries" in message:
            return 'Here: {"queries": ["travel tickets", "office"]}'
        if message.startswith("Sort the message"):
            return '{"route": "thanks"}' if "Message:\nthanks" in message else "?"
        if "labels" in message.lower() and "PAIR_1" in message:
            return '{"PAIR_1": "amplification"}'
        return self.offline.chat(message, documents, history, max_tokens)


def test_model_calls(spark, chunks):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    q = spark.createDataFrame([(1, "c1", "thanks", "en", ["x"]), (2, "c2", "Who must keep the tickets?", "en", None)], QUESTIONS)
    assert [r.expansions for r in answer.expanded(q, client=Talking).orderBy("query_id").collect()] == [["x", "travel tickets", "office"], ["travel tickets", "office"]]
    assert answer.expanded(q, settings=Settings(enable_rewrite=False)) is q
    assert [r.expansions for r in answer.expanded(q).orderBy("query_id").collect()] == [["x"], []]
    rows = answer.routed(answer.classified(q, client=Talking)).orderBy("query_id").collect()
    assert [r.route for r in rows] == ["thanks", "policy_question"] and rows[0].reply
    found = spark.createDataFrame([(1, "PAIR_1", 1, "a", "b", "x", "y", "no_conflict")], "query_id int, pair_key string, n int, a_chunk_id string, b_chunk_id string, a_excerpt string, b_excerpt string, label string")
    from lodestone.operators import conflicts

    assert conflicts.classified(found, Talking).first().label == "amplification" and conflicts.classified(found).first().label == "no_conflict"
    settings = Settings(top_k=2, enable_conflict_classifier=True, max_output_tokens=5)
    assert all(len(r.answer) <= 20 for r in answer.answered(chunks, q, settings=settings).collect())


def test_vectors_come_from_the_cache(spark, chunks):
    from lodestone.operators.chunking import retrieval_text
    from lodestone.sources.writers import cache_key

    raw = chunks.drop("embedding", "vocab", "cmodes")
    keyed = raw.select(cache_key("offline-hash", False, F.col("chunk_id"), retrieval_text(False)).alias("key"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    assert {tuple(r.embedding) for r in answer.indexed(raw, cache=keyed).collect()} == {(1.0,)}
    other = answer.indexed(raw, cache=keyed, settings=Settings(embed_model="another")).first()
    assert len(other.embedding) > 1


def test_routes(spark):
    q = spark.createDataFrame([(1, "en", '{"route":"greeting"}'), (2, "fr", "?")], "query_id int, language string, classified string")
    rows = {r.query_id: r for r in answer.routed(q).collect()}
    assert rows[1].reply.startswith("Hello") and rows[2].route == "policy_question" and rows[2].reply is None


def test_evaluation(spark, chunks, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id":"1","question":"When must suppliers send the rfp offer?","split":"dev","mode":"rfp","gold_relevant_doc_prefixes":["a"],"noise_doc_prefixes":["c"],"required_claims":["Suppliers must send the offer before closing."],"reference_answer":"before closing","expect_abstain":false,"claim_evidence":[{"claim":"x","evidence_doc_prefixes":["a"]}]}\n{"id":"2","question":"unknown"}\n')
    cases = readers.claims_of(readers.cases(spark, str(path)))
    q = cases.select(F.col("id").alias("query_id"), F.lit("c").alias("conversation_id"), "question", F.lit("en").alias("language"), F.array().cast("array<string>").alias("expansions"))
    found = answer.retrieved(chunks, answer.prepared(q), settings=Settings(top_k=3)).withColumnRenamed("query_id", "case_id").cache()
    said = spark.createDataFrame([("1", "Suppliers must send the offer before closing [a__1].")], "case_id string, answer string")
    rows = {r.case_id: r for r in evaluate.case_metrics(cases, found, said, chunks).collect()}
    one = rows["1"]
    assert (one.gold_doc_recall_at_k, one.required_claim_recall, one.citation_support_rate, one.abstention_correct, one.claim_evidence_coverage) == (1.0, 1.0, 1.0, True, 1.0)
    assert one.noise_rate is not None and rows["2"].noise_rate is None and rows["2"].required_claim_recall is None
    table = evaluate.case_metrics(cases, found, said, chunks).cache()
    overall = {r.metric: r.value for r in evaluate.summary(table).collect()}
    assert overall["retrieval_gold_doc_recall_at_k_mean"] == 1.0 and overall["judge_reference_alignment_mean"] is None and len(overall) == 22
    assert {r.metric for r in evaluate.intervals(table).collect()} >= {"retrieval_gold_doc_mrr_mean"}
    assert any(r.subgroup == "unknown" for r in evaluate.subgroups(table).collect())


class Judging(Talking):
    """Grades answers with JSON, but for those on travel."""

    def chat(self, message, documents, history, max_tokens):
        if message.startswith("Grade an answer"):
            if "QUESTION\nWho books" in message:
                return "no verdict"
            assert "EXCERPTS\n[a__" in message and 'REQUIRED\n["Offers close."]' in message
            return '```json\n{"decision_correctness": 5, "groundedness": 1, "reference_alignment": 2, "required_claim_checks": [{"claim": "x", "covered": 1}], "forbidden_claim_violation": 1, "notes": " ok "}\n```'
        return super().chat(message, documents, history, max_tokens)


class Grading(Talking):
    def chat(self, message, documents, history, max_tokens):
        return '{"decision_correctness": 1}' if message.startswith("Grade an answer") else super().chat(message, documents, history, max_tokens)


def test_judge(spark, chunks):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cases = spark.createDataFrame([("1", "When must suppliers send the offer?", ["Offers close."], [], None, " "), ("2", "Who books travel?", None, None, True, "the office"), ("3", "unanswered", [], [], None, None)],
                                  "id string, question string, required array<string>, forbidden array<string>, expect_abstain boolean, reference_answer string")
    found = spark.createDataFrame([("1", r + 1, f"a__{r}") for r in range(2)] + [("2", 9, "c__0")], "case_id string, rank int, chunk_id string")
    said = spark.createDataFrame([("1", "Before closing."), ("2", "The office."), ("3", " ")], "case_id string, answer string")
    rows = {r.case_id: r for r in evaluate.judged(cases, found, said, chunks, Judging).collect()}
    assert set(rows) == {"1", "2"} and rows["2"].judge is None and rows["2"].judge_error == "no JSON object"
    one = rows["1"].judge
    assert (one.decision_correctness, one.groundedness, one.completeness, one.reference_alignment, one.required_claim_recall, one.forbidden_claim_violation, one.notes) == (2, 1, 0, None, 1.0, 1, "ok") and rows["1"].judge_error is None
    base = cases.select(F.col("id").alias("case_id"), F.lit("dev").alias("split"), F.lit("rfp").alias("mode"), F.lit("q").alias("question_type"))
    means = {r.metric: r.value for r in evaluate.summary(evaluate.with_judge(base, evaluate.judged(cases, found, said, chunks, Judging))).collect()}
    assert means["judge_decision_correctness_mean"] == 2.0 and means["judge_reference_alignment_mean"] is None and means["judge_required_claim_recall_mean"] == 1.0


def test_crawl(spark):
    base = "https://canadabuys.canada.ca/en/buyer-s-portal/buyer-s-guide"
    body = lambda *links: "<main><h1>T</h1><p>" + "word " * 130 + "</p>" + "".join(f'<a href="{x}">l</a>' for x in links) + "</main>"
    pages = spark.createDataFrame([(base, body("/en/buyer-s-portal/buyer-s-guide/a/", "#x", "https://example.org/")), (f"{base}/a", body(f"{base}/b-0")), (f"{base}/b", "<main><p>short</p></main>"), (f"{base}/lost", body())], "url string, html string")
    got = collect.crawled(pages, spark.createDataFrame([(base,)], "url string"), Settings()).collect()
    assert sorted(r.canonical_url for r in got) == [base, f"{base}/a"]
    assert all(r.doc_type == "buyers_guide" and r.word_count == 131 for r in got)


def site(pages, log):
    """A fetcher over {url: (status, final url, content type, body)} that notes every request."""

    def make():
        def get(url, timeout):
            with open(log, "a") as f:
                f.write(url + "\n")
            if url not in pages:
                return fetch.Response(404, url, "", "")
            status, final, kind, body = pages[url]
            if isinstance(status, str):
                raise OSError(status)
            return fetch.Response(status, final or url, kind, body)

        return get

    return make


def queue_crawl(pages, seeds, scope, follow, most, least_words):
    """The crawl as a plain queue; the pages here are read by their words alone."""
    queue, seen, done, docs, errors, skipped = list(dict.fromkeys(seeds)), set(), set(), [], [], []
    while queue and len(seen) < most:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        status, final, kind, body = pages.get(url, (404, None, "", ""))
        final = final or url
        if status != 200:
            errors.append(url)
            continue
        if not scope(final) or final in done:
            continue
        if "html" in kind and follow(final):
            queue += [x for x in re.findall('href="([^"]*)"', body) if scope(x)]
        if "<broken" in body:
            errors.append(url)
            continue
        words = re.sub("<[^>]*>", " ", body).split()
        (skipped if len(words) < least_words else docs).append(final)
        done.add(final)
    return docs, errors, skipped, seen


def test_crawl_equals_a_queue(spark, tmp_path):
    base = f"https://{V.PORTAL_HOST}{V.GUIDE_PATH}"
    draw = random.Random(2)
    names = [f"{base}/p{i}" for i in range(60)]
    outside = "https://example.org/x"
    pages = {}
    for i, url in enumerate(names):
        links = [names[draw.randrange(60)] for _ in range(draw.randrange(4))] + [outside, f"{base}/p{(i + 1) % 60}", f"{base}/lost{i % 3}"] * (i % 2)
        body = f"<main><p>{'word ' * draw.choice([20, 30])}</p>" + "".join(f'<a href="{x}"></a>' for x in links) + "</main>"
        pages[url] = (200, draw.choice([None, None, None, names[draw.randrange(60)], outside]), "text/html", body)
    directive = f"https://{V.DIRECTIVE_HOST}{V.DIRECTIVE_PATH}?id={V.DIRECTIVE_ID}&section=xml"
    pages[directive] = (200, None, "application/xml", '<doc title="D"><chapter title="One" anchor="1"><clause anchor="1.1">' + "word " * 40 + "</clause></chapter></doc>")
    pages[names[7]] = (200, None, "application/xml", "<broken " + "word " * 40)
    pages[names[9]] = ("down", None, "", "")
    inside = lambda u: u.startswith(base) or u == directive
    seeds = spark.createDataFrame([(directive,), (names[0],), (outside,), (names[5],)], "url string").coalesce(1)
    for most, few in ((1000, crawl.FEW), (25, 5), (1000, 3)):
        log = tmp_path / f"log{most}-{few}"
        get = crawl.fetching(site(pages, str(log)), retries=1, pause=0)
        made = crawl.crawl(spark, seeds, get, Settings(max_pages=most, min_guide_words=25), few=few)
        docs, errors, skipped, seen = queue_crawl(pages, [directive, names[0], names[5]], inside, lambda u: u != directive, most, 25)
        found = made.documents().collect()
        assert sorted(r.canonical_url for r in found) == sorted(docs)
        assert sorted(r.url for r in made.errors().collect()) == sorted(errors)
        assert sorted(r.url for r in made.skipped().collect()) == sorted(skipped)
        asked = log.read_text().split()
        assert sorted(asked) == sorted(seen) and made.visited == len(seen)
        assert next(r for r in found if r.canonical_url == directive).text.startswith("1 One")
    counts = made.counts()
    assert counts["document_count"] == len(docs) and counts["visited_count"] == len(seen) and counts["raw_url_count"] > counts["canonical_url_count"] >= len(seen)


def test_crawl_of_a_long_chain(spark, tmp_path):
    base = f"https://{V.PORTAL_HOST}{V.GUIDE_PATH}"
    pages = {f"{base}/c{i}": (200, None, "text/html", f'<p>{"word " * 3}{i}</p><a href="{base}/c{i + 1}"></a><a href="{base}/c{i // 2}"></a>') for i in range(14)}
    log = tmp_path / "log"
    made = crawl.crawl(spark, spark.createDataFrame([(f"{base}/c0",)], "url string"), crawl.fetching(site(pages, str(log)), retries=1, pause=0), Settings(min_guide_words=1), few=8)
    assert made.documents().count() == 14 and made.levels == 15 and made.visited == 15  # the last link leads nowhere
    assert len(log.read_text().split()) == 15


def test_crawl_of_stored_pages_and_nothing(spark):
    base = f"https://{V.PORTAL_HOST}{V.GUIDE_PATH}"
    pages = spark.createDataFrame([(f"{base}/a/", f'<p>{"w " * 9}</p><a href="../b/">x</a>'), (f"{base}/b", "<p>w w w</p>"), (f"{base}/lost", "<p>w</p>")], "url string, html string")
    made = crawl.crawl(spark, spark.createDataFrame([(f"{base}/a",)], "url string"), crawl.stored(pages), Settings(min_guide_words=1))
    assert sorted(r.canonical_url for r in made.documents().collect()) == [f"{base}/a", f"{base}/b"] and made.errors().count() == 0
    none = crawl.crawl(spark, spark.createDataFrame([("https://example.org",)], "url string"), crawl.stored(pages))
    assert none.documents().count() == 0 and none.visited == 0


# --- command line and votes ------------------------------------------------------------------------------------------
@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    for stem, title, body in DOCS:
        (tmp_path / "docs" / f"{stem}.txt").write_text(f"TITLE: {title}\nSOURCE_URL: https://x/{stem}\nDOC_TYPE: guide\n---\n{body}")
    return tmp_path


def test_answer_command(spark, folder):
    from lodestone import cli

    said = cli.main(["answer", "Who books travel tickets?", "--documents", str(folder / "docs")], spark=spark)
    assert "Sources:" in said and "https://x/c" in said
    (folder / "none").mkdir()
    with pytest.raises(SystemExit):
        cli.main(["answer", "?", "--documents", str(folder / "none")], spark=spark)


def test_evaluate_and_compare_commands(spark, folder):
    import json
    import sys

    from pyspark import cloudpickle

    from lodestone import cli

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    cases = [{"id": str(i), "question": f"Who books travel {i}?", "split": "dev" if i else "test", "gold_relevant_doc_prefixes": ["c"], "required_claims": ["Travel is booked by the office."]} for i in range(3)]
    (folder / "cases.jsonl").write_text("# cases\n" + "\n".join(map(json.dumps, cases)))
    common = ["evaluate", "--documents", str(folder / "docs"), "--cases", str(folder / "cases.jsonl"), "--top-k", "2", "--output"]
    (folder / "runs").mkdir()
    for name, more in (("one", ["--split", "dev", "--with-chat"]), ("two", ["--limit", "1"])):
        said = cli.main([*common, str(folder / name), *more], spark=spark)
        assert said.startswith("2 cases" if name == "one" else "1 cases")
        text = spark.read.text(str(folder / name)).first().value
        held = json.loads(text)
        assert held["overall_metrics"]["retrieval_gold_doc_recall_at_k_mean"] == 1.0 and {"by_split", "by_mode_x_question_type"} <= set(held["subgroup_metrics"])
        (folder / "runs" / f"{name}.json").write_text(text)
    with pytest.raises(SystemExit):
        cli.main([*common, str(folder / "three"), "--with-judge"], spark=spark)
    cli.main([*common, str(folder / "three"), "--limit", "1", "--with-chat", "--with-judge"], spark=spark, client=Grading)
    held = json.loads(spark.read.text(str(folder / "three")).first().value)
    assert held["config"]["with_judge"] and held["overall_metrics"]["judge_decision_correctness_mean"] == 1.0 and "judge" in held["timing_summary_ms"]
    said = cli.main(["compare", str(folder / "runs"), "one", "two"], spark=spark)
    assert "retrieval_gold_doc_recall_at_k_mean: 1.0 -> 1.0 (0.0, neutral)" in said


def test_collect_command(spark, tmp_path):
    from lodestone import cli

    base = "https://canadabuys.canada.ca/en/buyer-s-portal/buyer-s-guide"
    body = "<main><h1>T</h1><p>" + "word " * 130 + "</p></main>"
    pages = str(tmp_path / "pages")
    spark.createDataFrame([(base, body)], "url string, html string").write.parquet(pages)
    args = ["collect", "--pages", pages, "--output", str(tmp_path / "out"), "--seeds", base]
    assert cli.main(args, spark=spark) == "1 new" and cli.main(args, spark=spark) == "1 unchanged"


def test_votes_are_taken_in_or_refused(spark, chunks):
    from lodestone.plans import feedback

    columns = "line_no long, timestamp string, conversation_id string, turn_id string, feedback_type string, thumb string, comment string, question string, answer string, cited_chunk_ids array<string>, target_chunk_id string"
    first = chunks.select("chunk_id").orderBy("chunk_id").first()[0]
    raw = [(1, "10", "c", "t", None, "DOWN", "", "", "", [first], None), (2, "20", "c", "u", "answer", "side", "no", "", "", [], None), (3, "30", "c", "t", "citation", "better", "", "", "", [], None), (4, "40", "c", "t", "praise", "up", "", "", "", [], None)]
    good, bad = feedback.submitted(spark.createDataFrame(raw, columns))
    assert [(r.line_no, r.status, r.error.split()[0]) for r in bad.orderBy("line_no").collect()] == [(3, 400, "thumb"), (4, 400, "feedback_type")]
    summary, against = feedback.board(good, chunks, F.lit(50))
    assert {(r.feedback_type, r.total) for r in summary.collect()} == {("citation", 1), ("answer", 1)}
    assert {(r.target_chunk_id, r.source_title) for r in against.collect()} == {(first, "Rfp guide"), ("", None)}
