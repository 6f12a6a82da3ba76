import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import urls
from lodestone.functions import values as V

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet="aB9 .!?\n\t-é[]_,", max_size=60), min_size=1, max_size=30)


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@SLOW
@given(TEXTS)
def test_tokens_and_normal_form(spark, texts):
    assert column(spark, texts, T.tokens("x")) == [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    assert column(spark, texts, T.normalized("x")) == [" ".join(re.findall("[a-z0-9]+", t.lower())) for t in texts]


@SLOW
@given(TEXTS)
def test_sentences(spark, texts):
    expected = [[s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", t) if len(s.strip()) >= 10] for t in texts]
    assert column(spark, texts, T.sentences("x")) == expected


@SLOW
@given(TEXTS)
def test_windows(spark, texts):
    def plain(t):
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", t) if len(s.strip()) >= 10]
        if not parts:
            return [" ".join(t.split())[:1200]] if t.split() else []
        out, seen = [], set()
        for i, s in enumerate(parts):
            for w in [s] + ([f"{s} {parts[i + 1]}"] if i + 1 < len(parts) else []):
                if (key := " ".join(w.lower().split())) not in seen:
                    seen.add(key)
                    out.append(w)
        return out[:24]

    assert column(spark, texts, T.sentence_windows("x")) == [plain(t) for t in texts]


def test_citations(spark):
    said = ["see [a__1, chunk_id: b__2] and [a__1] [none]", "", "[ Chunk_ID:  c__3 ]"]
    assert column(spark, said, T.citations("x")) == [["a__1", "b__2"], [], ["c__3"]]


def test_doc_prefix_and_abstention(spark):
    assert column(spark, ["a__b__3", "plain", "__x"], T.doc_prefix("x")) == ["a__b", "plain", ""]
    assert column(spark, ["We CANNOT determine it", "yes"], T.abstained("x")) == [True, False]


def test_json_objects(spark):
    raw = ['{"a": 1}', '```json\n{"a": 2}\n```', 'well {"a": 3} so', "no", "[1]"]
    assert column(spark, raw, T.json_object("x", "struct<a:int>")["a"]) == [1, 2, 3, None, None]


def test_numbers(spark):
    assert column(spark, [" 12.9 ", "x", "", "7"], T.epoch_seconds("x")) == [12, None, None, 7]
    assert column(spark, ["", "abc", "abcdefgh"], T.token_count("x")) == [0, 1, 2]
    assert column(spark, ["  abcdefghij ", "ab "], T.truncated("x", 2)) == ["abcdef", "ab"]


def test_distinct_ignoring_case(spark):
    df = spark.createDataFrame([([" A", "a ", "", "b", "B", "c"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(T.distinct_ignoring_case("x")).collect()] == [["A", "b", "c"], []]


def test_urls(spark):
    given_ = [
        f"https://{V.PORTAL_HOST.upper()}/en//buyer-s-portal/buyer-s-guide/a-0/?q=1#x",
        "https://www.tbs-sct.gc.ca/pol/doc-eng.aspx?section=xml&id=32692&z=1", "//example.org", "http://example.org/a/?b=1",
    ]
    assert column(spark, given_, urls.canonical("x")) == [
        f"https://{V.PORTAL_HOST}/en/buyer-s-portal/buyer-s-guide/a", f"https://{V.DIRECTIVE_HOST}/pol/doc-eng.aspx?id=32692&section=xml",
        "https://example.org/", "http://example.org/a",
    ]
    canonical = column(spark, given_, urls.canonical("x"))
    assert column(spark, canonical, urls.in_scope("x")) == [True, True, False, False]
    assert column(spark, canonical, urls.follow_links("x")) == [True, False, False, False]
    assert [r.authority_rank for r in column(spark, canonical, urls.source_class("x"))] == [3, 1, 9, 9]
    forms = [f"https://{V.PORTAL_HOST}{V.FORMS_PATH}/x"]
    assert column(spark, forms, urls.in_scope("x")) == [False]
    assert column(spark, forms, urls.in_scope("x", forms=True)) == [True]


def test_rewrites_leave_out_the_question_in_any_case(spark):
    from lodestone.operators.models import rewritten

    raw = ['{"queries": ["DIE STRASSE?", "die stra\u00dfe?", "die Strasse", "x"]}']
    assert column(spark, raw, rewritten(F.col("x"), F.lit("  Die Stra\u00dfe? "))) == [["die Strasse", "x"]]


def test_rewrites(spark):
    from lodestone.operators.models import intent, rewritten, verdict

    raw = ['{"queries": ["A b", "a", "", "A b", "c", "d", "e"]}', "broken"]
    assert column(spark, raw, rewritten(F.col("x"), F.lit("a"))) == [["A b", "c", "d"], []]
    assert [r.route for r in column(spark, ['{"route":"greeting"}', '{"label":"thanks"}', '{"route":"x"}', "no"], intent(F.col("x")))] == ["greeting", "thanks", "policy_question", "policy_question"]
    found = column(spark, ['{"unsupported_claims":["a"," "]}', "none"], verdict(F.col("x")))
    assert [(v.revise, v.unsupported) for v in found] == [(True, ["a"]), (False, [])]
