import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dashboard
from lodestone.sources import readers, writers


def test_documents_with_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.TXT").write_text("TITLE: One: two\ntitle: Last\nauthority_rank: x\n---\nBody\n---\nmore")
    (tmp_path / "b.md").write_text("plain body")
    (tmp_path / "c.pdf").write_text("no")
    rows = {r.stem: r for r in readers.with_header(readers.raw_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].source_title, rows["a"].authority_rank, rows["a"].body) == ("Last", 0, "Body\n---\nmore")
    assert (rows["b"].source_title, rows["b"].body) == ("b", "plain body")


def test_cases(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('# note\n{"id": "1", "question": "q", "mode": "rfp", "required_phrase_groups": [["a", "b"], ["c"]], "forbidden_phrases": ["z"]}\n\n')
    found = readers.claims_of(readers.cases(spark, str(path))).first()
    assert (found.id, found.required, found.forbidden) == ("1", ["a", "c"], ["z"])
    path.write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="bad line"):
        readers.cases(spark, str(path)).collect()


def test_modes_skip_broken_lines(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"mode": "b"}\nnot-json\n{"mode": "a"}\n{"mode": "b"}\n')
    assert [r.mode for r in readers.case_modes(spark, str(path)).collect()] == ["a", "b"]


def test_feedback_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"thumb": "up", "timestamp": 5}\nnot-json\n\n{"thumb": "down", "cited_chunk_ids": ["a"]}\n')
    assert [(r.thumb, r.timestamp) for r in readers.feedback(spark, str(path)).orderBy("line_no").collect()] == [("up", "5"), ("down", None)]


def test_runs_keep_broken_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"config": {"with_chat": True, "case_count": 2}, "overall_metrics": {"answer_abstention_accuracy": None, "retrieval_gold_doc_mrr_mean": 0.5}, "cases": [{"answer": "x"}]}))
    (tmp_path / "bad.json").write_text("{")
    rows = {r.run_id: r for r in dashboard.run_listing(readers.runs(spark, str(tmp_path))).collect()}
    assert [m.metric for m in rows["one"].headline] == ["retrieval_gold_doc_mrr_mean", "answer_abstention_accuracy"] and rows["one"].case_count == 2
    assert (rows["bad"].case_count, rows["bad"].headline, rows["bad"].with_chat) == (0, [], False)
    assert readers.run(spark, str(tmp_path), "one").count() == 1
    with pytest.raises(LookupError):
        readers.run(spark, str(tmp_path), "none")


def test_missing_manifest_and_cache_are_empty(spark, tmp_path):
    assert readers.previous_manifest(spark, str(tmp_path / "none.json")).count() == 0
    assert writers.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_cache_round_trip(spark, tmp_path):
    from lodestone.operators.models import embedded_with_cache

    chunks = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha")], "chunk_id int, text string").withColumn("key", writers.cache_key("m", False, F.lit("k"), F.col("text")))
    path = str(tmp_path / "cache")
    both, fresh = embedded_with_cache(chunks, "text", writers.read_cache(spark, path))
    assert (both.count(), fresh.count()) == (3, 2)
    writers.append_cache(fresh, path)
    assert writers.cache_missing(chunks, writers.read_cache(spark, path)).count() == 0


def test_documents_are_written_when_changed(spark, tmp_path):
    rows = spark.createDataFrame([("new", "T", "u", "c", "other", 9, None, "body"), ("unchanged", "T", "u", "d", "other", 9, "2024-01-01", "body")],
                                 "status string, title string, url string, canonical_url string, doc_type string, authority_rank int, date_modified string, text string")
    writers.write_documents(rows, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.payload for r in got] == ["TITLE: T\nSOURCE_URL: u\nCANONICAL_URL: c\nDOC_TYPE: other\nAUTHORITY_RANK: 9\n---\nbody\n"]


def test_conversations(spark):
    one = spark.createDataFrame([(1, 7, 5.0), (2, 7, 5.0), (3, 8, 9.0)], "id int, user_id int, created_at double")
    assert [r.id for r in readers.conversations_of(one, F.lit(7)).collect()] == [2, 1]
    left, messages = writers.without_conversation(one, spark.createDataFrame([(1, 1), (2, 3)], "id int, conversation_id int"), 3)
    assert (left.count(), messages.count()) == (2, 1)
    title = spark.createDataFrame([("x" * 60,), ("y",)], "t string").select(writers.conversation_title(F.col("t"))).collect()
    assert [r[0] for r in title] == ["x" * 50 + "...", "y"]


def test_settings_from_environment():
    from lodestone.settings import Settings

    s = Settings.from_env({"TOP_K": "5", "ENABLE_RERANK": "off", "RERANK_ALPHA": "0.5", "MAX_PAGES": " "})
    assert (s.top_k, s.enable_rerank, s.rerank_alpha, s.max_pages) == (5, False, 0.5, 300)


def test_fetching_retries_and_keeps_failures(spark):
    from lodestone.sources import fetch

    def fetcher():
        tries = {}

        def get(url, timeout):
            tries[url] = tries.get(url, 0) + 1
            if url == "gone":
                return fetch.Response(404, url, "", "")
            if url == "down" or (url == "slow" and tries[url] < 3):
                raise OSError("no answer") if url == "down" else TimeoutError("late")
            return fetch.Response(200, url + "/", "text/html", f"tries {tries[url]}")

        return get

    urls = spark.createDataFrame([("ok",), ("ok",), ("gone",), ("slow",), ("down",), (None,)], "url string")
    rows = {r.url: r for r in fetch.fetched(urls, fetcher, sleep=lambda s: None).collect()}
    assert (rows["ok"].html, rows["ok"].final_url, rows["slow"].html) == ("tries 1", "ok/", "tries 3")
    assert (rows["gone"].error, rows["down"].error) == ("status 404", "OSError: no answer")
    assert fetch.seeds(spark).count() == 3 and fetch.seeds(spark, forms=True, directive_html=True).count() == 5


def test_functions_in_sql(spark):
    from lodestone.functions.sql import register

    register(spark)
    assert [tuple(r) for r in spark.sql("select * from chunk_text('d', 'One', 100, 0)").collect()] == [("d__0", "One", "One")]
    assert [r.line for r in spark.sql("select * from page_lines('<h1>A</h1><p>b')").collect()] == ["A", "b"]
    assert len(spark.sql("select embed_text('alpha') as v").first().v) == 64


def test_conversation_log(spark, tmp_path):
    from lodestone.sources import conversations as store

    turns = spark.createDataFrame([("u1", None, "x" * 60, "fr", 1.0), ("u1", "c9", "more", None, 2.0), (None, None, "nobody", "en", 3.0), ("u2", None, "short", "en", 4.0), ("u2", None, "short", "en", 4.0)],
                                  "user_id string, conversation_id string, text string, language string, created_at double")
    path = str(tmp_path / "log")
    store.append(store.asked(turns), path)
    log = store.log(spark, path)
    standing = {r.user_id: r for r in store.conversations(log).collect()}
    assert set(standing) == {"u1", "u2"} and standing["u1"].title == "x" * 50 + "..." and standing["u2"].title == "short"  # a turn written twice counts once
    one = standing["u1"].id
    reply = spark.createDataFrame([(one, "bot", "reply", "fr", [("t", "l", "c")], 5.0), ("c9", "bot", "to nobody", None, None, 6.0)], "conversation_id string, role string, text string, language string, citations array<struct<title:string,link:string,chunk_id:string>>, created_at double")
    store.append(store.messages_logged(reply), path)
    said = store.messages(store.log(spark, path)).orderBy("conversation_id", "place").where(F.col("conversation_id") == one).collect()
    assert [(r.role, r.text, r.language, r.place) for r in said] == [("user", "x" * 60, "fr", 1), ("bot", "reply", "fr", 2)] and said[1].citations[0].link == "l"
    assert store.messages(store.log(spark, path)).where("conversation_id = 'c9'").count() == 0  # never started
    gone = spark.createDataFrame([(one, 7.0)], "conversation_id string, created_at double")
    spoken = spark.createDataFrame([("u1", "de", 1.0), ("u1", "fr", 2.0), ("u2", None, 1.0)], "user_id string, language string, created_at double")
    # two writers at once: each only adds rows
    store.append(store.deleted(gone), path)
    store.append(store.languages_logged(spoken).unionByName(store.messages_logged(reply.withColumn("text", F.lit("late")))), path)
    log = store.log(spark, path)
    assert {r.user_id for r in store.conversations(log).collect()} == {"u2"} and {r.text for r in store.messages(log).collect()} == {"short"}
    assert {r.user_id: r.language for r in store.languages(log).collect()} == {"u1": "fr", "u2": "en"}
