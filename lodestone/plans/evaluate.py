"""Evaluating cases: retrieval and answer metrics per case, then summaries, intervals and subgroups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import values as V
from lodestone.operators import metrics, models
from lodestone.operators.models import Factory, OfflineClient
from lodestone.settings import Settings
from lodestone.sources.shared import checkpoint

DEFAULTS = Settings()
INTERVALS = tuple(m for m in V.SUMMARY_METRICS if m.endswith("_mean") and "count" not in m and "unique" not in m and m not in ("judge_required_claim_recall_mean", "judge_forbidden_claim_violation_mean"))


def case_metrics(cases: DataFrame, retrieved: DataFrame, answers: DataFrame, chunks: DataFrame, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per case with all metrics.

    ``cases`` as read with their claims (id, required, forbidden, ...); ``retrieved`` has case_id, rank, chunk_id; ``answers``
    case_id and answer. Answer metrics are null without an answer.
    """
    c = cases.withColumnRenamed("id", "case_id")
    rows = retrieved.withColumn("prefix", T.doc_prefix(F.col("chunk_id")))
    listed = lambda *names: F.coalesce(*[F.when(F.size(T.clean_list(n)) > 0, T.clean_list(n)) for n in names], F.array().cast("array<string>"))
    each = lambda values, name: c.select("case_id", F.explode(values).alias(name))
    gold = each(listed("gold_relevant_doc_prefixes", "expected_doc_prefixes"), "prefix")
    out = c.select("case_id", "split", "mode", "question_type").join(metrics.retrieval_metrics(rows, gold), "case_id", "left")
    for column, name in (("noise_doc_prefixes", "noise_rate"), ("contradiction_doc_prefixes", "contradiction_rate")):
        out = out.join(metrics.labelled_rate(rows, each(T.clean_list(column), "prefix"), name), "case_id", "left")
    evidence = c.select("case_id", F.inline("claim_evidence")).select("case_id", "claim", F.col("evidence_doc_prefixes").alias("prefixes"), F.col("evidence_chunk_ids").alias("chunk_ids"))
    out = out.join(metrics.evidence_coverage(evidence, rows).select("case_id", "claim_evidence_coverage"), "case_id", "left")
    said = answers.where("answer is not null")
    stats = metrics.answer_stats(said)
    spoken = models.embedded(said.select("case_id", F.posexplode(T.sentences("answer")).alias("sentence_id", "sentence")), "sentence", client)
    for column, name, field, threshold in (("required", "required_claim_recall", "rate", settings.required_claim_threshold), ("forbidden", "forbidden_claim_violation_rate", "rate", settings.forbidden_claim_threshold)):
        claims = c.join(said.select("case_id"), "case_id").select("case_id", F.posexplode(column).alias("claim_id", "claim"))
        found = metrics.claim_metrics(metrics.claim_similarity(models.embedded(claims, "claim", client), spoken), threshold)
        out = out.join(found.select("case_id", F.col(field).alias(name)), "case_id", "left")
    cited = spoken.select("case_id", "sentence_id", F.explode(T.citations("sentence")).alias("citation"))
    pairs = metrics.matched_citations(cited, rows)
    windows = models.embedded(chunks.join(pairs.select("chunk_id").distinct(), "chunk_id").select("chunk_id", F.explode(T.sentence_windows("text", settings.max_citation_windows)).alias("window")), "window", client)
    support = metrics.citation_support(pairs, spoken, windows, settings.citation_support_threshold)
    out = out.join(support.select("case_id", F.col("rate").alias("citation_support_rate")), "case_id", "left")
    both = said.join(c.select("case_id", "reference_answer", "expect_abstain"), "case_id")
    vectors = models.embedded(models.embedded(both, "answer", client, name="_a"), "reference_answer", client, name="_b")
    reference = vectors.select("case_id", F.when(F.col("reference_answer").isNotNull(), F.round(T.dot("_a", "_b"), 6)).alias("reference_answer_similarity"), (T.abstained("answer") == F.col("expect_abstain")).alias("abstention_correct"))
    return out.join(reference, "case_id", "left").join(stats.select("case_id", "answer_sentence_count", "answer_word_count", "citation_count", "citation_sentence_rate"), "case_id", "left")


#: What a judge is asked for, from 0 to 2 each.
JUDGED = ("decision_correctness", "groundedness", "completeness", "mandatory_optional_precision", "uncertainty_handling", "reference_alignment")
#: Retrieved chunks that a judge sees, and characters of each.
SNIPPETS, SNIPPET_CHARS = 6, 600


def judge_message(question, required, forbidden, abstain, reference, answer, snippets):
    """What a judge is asked about an answer, as a Column of Columns."""
    task = (
        "Grade an answer about purchasing rules by the question, the claims and the excerpts below, and by nothing else. Reply with one JSON object. "
        f"Keys {', '.join(JUDGED)}: 2 good, 1 in part, 0 wrong or without support. required_claim_recall: share of the required claims that the answer makes. "
        "forbidden_claim_violation: 1 if it makes a forbidden one, else 0. required_claim_checks and forbidden_claim_checks: a list with claim, covered (or violated) as 0 or 1, and reason for each claim. notes: one sentence."
    )
    part = lambda title, value: F.concat(F.lit(f"\n\n{title}\n"), value)
    return F.concat(
        F.lit(task), part("QUESTION", question), part("REQUIRED", F.to_json(required)), part("FORBIDDEN", F.to_json(forbidden)), part("SHOULD DECLINE", F.coalesce(abstain.cast("string"), F.lit("not said"))),
        part("REFERENCE", F.coalesce(reference, F.lit("none"))), part("ANSWER", answer), part("EXCERPTS", F.coalesce(snippets, F.lit("none"))),
    )


def judged(cases: DataFrame, retrieved: DataFrame, answers: DataFrame, chunks: DataFrame, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """(case_id, judge, judge_error): a judge's clamped scores of every case with an answer; what is no JSON object is an error.

    A judge sees the first SNIPPETS chunks of a case. Without a reference answer nothing can align with it.
    """
    near = retrieved.where(F.col("rank") <= SNIPPETS).join(chunks.select("chunk_id", "text"), "chunk_id")
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.substring(T.strip(F.regexp_replace("text", "\n", " ")), 1, SNIPPET_CHARS))
    shown = near.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_s")).select("case_id", F.array_join(F.transform("_s", lambda x: x["line"]), "\n").alias("_shown"))
    said = answers.where(T.strip(F.coalesce("answer", F.lit(""))) != "")
    rows = said.select("case_id", "answer").join(cases.withColumnRenamed("id", "case_id").select("case_id", "question", "required", "forbidden", "expect_abstain", "reference_answer"), "case_id").join(shown, "case_id", "left")
    reference = F.nullif(T.strip(F.coalesce("reference_answer", F.lit(""))), F.lit(""))
    none = F.array().cast("array<string>")
    claims = {c: F.coalesce(c, none) for c in ("required", "forbidden")}
    rows = rows.withColumns({**claims, "_reference": reference})
    ask = judge_message(F.col("question"), F.col("required"), F.col("forbidden"), F.col("expect_abstain"), F.col("_reference"), F.col("answer"), F.col("_shown"))
    empty = {"_documents": F.array().cast("array<struct<chunk_id:string,text:string>>"), "_history": F.array().cast("array<struct<role:string,text:string>>")}
    told = checkpoint(models.answered(rows.withColumns({"_ask": ask, **empty}), client, name="_raw", message="_ask", documents="_documents", history="_history", max_tokens=settings.max_output_tokens))  # asked once
    scores = metrics.judged(F.col("_raw"), F.col("required"), F.col("forbidden"), F.col("_reference").isNotNull())
    return told.withColumn("judge", scores).select("case_id", "judge", F.when(F.col("_raw_error").isNotNull(), F.col("_raw_error")).when(F.col("judge").isNull(), "no JSON object").alias("judge_error"))


def with_judge(rows: DataFrame, judged_: DataFrame) -> DataFrame:
    """Case metrics with the judge's scores beside them."""
    names = ("decision_correctness", "reference_alignment", "required_claim_recall", "forbidden_claim_violation")
    return rows.join(judged_.select("case_id", *[F.col(f"judge.{n}").cast("double").alias(f"judge_{n}") for n in names], "judge_error"), "case_id", "left")


def named(rows: DataFrame) -> DataFrame:
    """Case metrics under their report names; metrics that the rows lack are null."""
    have = set(rows.columns)
    return rows.select("case_id", "split", "mode", "question_type", *[(F.col(c).cast("double") if c in have else F.lit(None).cast("double")).alias(m) for m, c in V.SUMMARY_METRICS.items()])


def summary(rows: DataFrame) -> DataFrame:
    """(metric, value) over all cases."""
    means = metrics.means(named(rows), list(V.SUMMARY_METRICS))
    return means.unpivot([], list(V.SUMMARY_METRICS), "metric", "value")


def intervals(rows: DataFrame) -> DataFrame:
    """(metric, low, high, n) of the metrics that have intervals."""
    long = named(rows).unpivot(["case_id"], list(INTERVALS), "metric", "value")
    return metrics.bootstrap(long, "value", "case_id", ["metric"])


def subgroups(rows: DataFrame) -> DataFrame:
    return metrics.subgroup_means(named(rows), list(V.SUMMARY_METRICS), [["split"], ["mode"], ["question_type"], ["mode", "question_type"]])


def report(rows: DataFrame) -> dict:
    """The aggregate parts of a run's artifact: overall metrics, intervals and subgroups; as large as the metrics are many."""
    overall = {r.metric: r.value for r in summary(rows).collect()}
    ci95 = {r.metric: {"low": r.low, "high": r.high, "n": r.n} for r in intervals(rows).collect()}
    groups: dict[str, dict] = {}
    for r in subgroups(rows).collect():
        held = r.asDict()
        groups.setdefault("by_" + held.pop("grouping").replace("+", "_x_"), {})[held.pop("subgroup")] = {"count": held.pop("n"), "metrics": held}
    return {"overall_metrics": overall, "overall_metric_ci95": ci95, "subgroup_metrics": groups}
