import os

import numpy as np
import pytest

from lodestone.llm import decontaminate, licenses, line_dedup, secrets, simhash
from lodestone.llm.common import shared_dir
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def rows(spark, name, key="doc_id"):
    return sorted(QUERIES[name](spark, SF).collect(), key=lambda r: r[key])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])


def test_token_counts(spark, docs):
    import public_tokenizers

    from lodestone.llm import token_counts

    pieces = set(token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    longest, known = max(map(len, pieces)), {}

    def greedy(word):
        n = i = 0
        while i < len(word):
            i = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pieces), 0)
            if not i:
                return 1
            n += 1
        return n

    for r, d in zip(rows(spark, "op1_token_counts"), docs, strict=True):
        words = d.text.encode().split()
        counts = [known[w] if w in known else known.setdefault(w, greedy(b" " + w)) for w in words]
        assert (r.n_words, r.n_tokens, r.max_word_tokens) == (len(words), sum(counts), max(counts, default=0))


def test_simhash(spark, docs):
    got = rows(spark, "op3_simhash")
    prints = [simhash.fingerprint(d.text.encode()) for d in docs]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == simhash.brute_force([d.doc_id for d in docs], prints)


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [tuple(r)[1:] for r in rows(spark, "op4_decontaminate")]
    assert got == decontaminate.brute_force([d.text for d in docs], items)


def test_packing_has_little_padding(spark):
    got = QUERIES["op5_packing"](spark, SF).collect()
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024 and sum(used.values()) / (1024 * len(used)) > 0.99


def test_licenses(spark, docs):
    got = [(*tuple(r)[1:5], r.base_labels, r.labels, r.score) for r in rows(spark, "op6_license_scan")]
    expected = [licenses.brute_force(d.text) for d in docs]
    assert got == [(*e[:4], ",".join(e[4]), ",".join(e[5]), e[6]) for e in expected]
    assert any(r[1] for r in got)


def test_line_dedup(spark, docs):
    got = rows(spark, "op7_line_dedup")
    assert [r.removed_lines for r in got] == [",".join(map(str, x)) for x in line_dedup.brute_force([(d.doc_id, d.text) for d in docs])]


def test_secrets(spark, docs):
    got = [(r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows(spark, "op8_secret_scan")]
    assert got == [secrets.brute_force(d.text) for d in docs]


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.5), ("sf0.1", 0.85)])
def test_toxicity(spark, sf, least):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in QUERIES["op10_toxicity"](spark, f"/root/testdata/{sf}").collect() if r.held_out and labels.get(r.doc_id) is not None]
    hits = sum(p and y for p, y in got)
    assert hits >= least * sum(y for _, y in got) and hits >= least * sum(p for p, _ in got)
    assert np.mean([p == y for p, y in got]) > 0.93


def test_pipeline(spark):
    import corpus_pipeline as p

    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = p.table(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    lines = [r.text for r in docs.collect()]
    assert len(set(lines)) == len(lines)
    before = set(os.listdir(shared_dir(spark)))
    pieces = p.run(spark, SF)
    made = {f.split("-")[1] for f in set(os.listdir(shared_dir(spark))) - before if f.startswith("stage-")}
    assert made == {"packing"}  # the tables of the other stages are deleted
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_documents(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, None, "en", "s", None), (None, "a b c d e f", "en", "s", 11), (2, "", None, None, 0), (1, None, "en", "s", None), (3, "a b c d e f\nnew words here", "en", "s", 26)]
    spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, changed int").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == {1, 3}
