"""Command line: ``python -m lodestone.cli answer | evaluate | collect | compare``."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, collect, dashboard
from lodestone.operators.models import Factory, OfflineClient
from lodestone.plans import answer, crawl, evaluate
from lodestone.settings import Settings
from lodestone.sources import fetch, readers, writers
from lodestone.sources.shared import checkpoint


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description="Answers from documents, and their evaluation.")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("answer", help="answer a question from a folder of documents")
    one.add_argument("question")
    one.add_argument("--language", default="en")
    run = commands.add_parser("evaluate", help="run evaluation cases and write their report")
    run.add_argument("--cases", required=True)
    run.add_argument("--split", default="all", help="splits, comma-separated")
    run.add_argument("--limit", type=int, default=0)
    run.add_argument("--top-k", type=int)
    run.add_argument("--with-chat", action="store_true")
    run.add_argument("--with-judge", action="store_true", help="let a model grade the answers; takes --with-chat")
    run.add_argument("--output", required=True)
    for name in ("required-claim", "forbidden-claim", "citation-support"):
        run.add_argument(f"--{name}-threshold", type=float)
    for command in (one, run):
        command.add_argument("--documents", help="the folder of documents; RAW_DIR or data by default")
    site = commands.add_parser("collect", help="crawl pages into documents and a manifest")
    site.add_argument("--pages", help="a Parquet table of url and html; pages are fetched without it")
    site.add_argument("--max-pages", type=int)
    site.add_argument("--forms", action="store_true", help="forms and templates too")
    site.add_argument("--directive-html", action="store_true", help="the directive's HTML page too")
    site.add_argument("--output", required=True)
    site.add_argument("--seeds", nargs="*", default=[])
    both = commands.add_parser("compare", help="compare two runs of a folder")
    both.add_argument("runs")
    both.add_argument("base")
    both.add_argument("trial")
    return top


def chunks_of(spark: SparkSession, folder: str | None, client: Factory, settings: Settings) -> DataFrame:
    """The folder's documents as indexed chunks; an error if there are none."""
    docs = readers.with_header(readers.raw_files(spark, folder, settings)).where(F.trim("body") != "")
    cut = chunking.chunked(docs.withColumn("title", F.col("source_title")), carry=("title", "source_title", "source_path", "source_url", "doc_type", "authority_rank"), settings=settings)
    if cut.isEmpty():
        raise SystemExit(f"no documents below {folder or settings.raw_dir}")
    return checkpoint(answer.indexed(cut, client, settings))


def _answer(spark: SparkSession, args: argparse.Namespace, client: Factory, settings: Settings) -> str:
    questions = spark.createDataFrame([("1", "cli", args.question, args.language, [])], "query_id string, conversation_id string, question string, language string, expansions array<string>")
    row = answer.answered(chunks_of(spark, args.documents, client, settings), questions, client=client, settings=settings).first()
    links = [f"[{c.citation}] {c.title} - {c.link}" for c in row.citations or ()]
    return "\n".join([row.answer or f"The model failed: {row.answer_error}", "", "Sources:", *(links or ["none"])])


def _evaluate(spark: SparkSession, args: argparse.Namespace, client: Factory, settings: Settings) -> str:
    if args.with_judge and not args.with_chat:
        raise SystemExit("--with-judge takes --with-chat")
    given = {"top_k": args.top_k, "required_claim_threshold": args.required_claim_threshold, "forbidden_claim_threshold": args.forbidden_claim_threshold, "citation_support_threshold": args.citation_support_threshold}
    settings = replace(settings, **{k: v for k, v in given.items() if v is not None})
    splits = [s.strip() for s in args.split.split(",") if s.strip()]
    cases = checkpoint(readers.claims_of(readers.filtered_cases(readers.cases(spark, args.cases), None if not splits or "all" in splits else splits, args.limit or None)))
    if cases.isEmpty():
        raise SystemExit("no cases")
    chunks = chunks_of(spark, args.documents, client, settings)
    questions = cases.select(F.col("id").alias("query_id"), F.lit("case").alias("conversation_id"), "question", F.lit("en").alias("language"), F.array().cast("array<string>").alias("expansions"))
    questions = checkpoint(answer.expanded(questions, None, client, settings))
    n = cases.count()
    began = time.perf_counter()
    found = checkpoint(answer.retrieved(chunks, checkpoint(answer.prepared(questions, client, settings)), client, settings).withColumnRenamed("query_id", "case_id"))
    seconds = {"retrieval": time.perf_counter() - began}
    said = spark.createDataFrame([], "case_id string, answer string")
    if args.with_chat:
        began = time.perf_counter()
        said = checkpoint(answer.answered(chunks, questions, client=client, settings=replace(settings, enable_rewrite=False)).select(F.col("query_id").alias("case_id"), "answer"))
        seconds["chat"] = time.perf_counter() - began
    rows = evaluate.case_metrics(cases, found, said, chunks, client, settings)
    if args.with_judge:
        began = time.perf_counter()
        graded = evaluate.judged(cases, found, said, chunks, client, settings)
        seconds["judge"] = time.perf_counter() - began
        rows = evaluate.with_judge(rows, graded)
    rows = checkpoint(rows)
    report = evaluate.report(rows) | {
        "config": {"cases_file": args.cases, "split_filter": splits or ["all"], "top_k": settings.top_k, "with_chat": args.with_chat, "with_judge": args.with_judge, "case_count": n},
        # cases run as one batch, so a case's time is its share
        "timing_summary_ms": {k: dict.fromkeys(("p50", "p95", "mean"), round(1000 * s / n, 3)) for k, s in seconds.items()},
    }
    rows.write.mode("overwrite").json(f"{args.output}.cases")
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(args.output)
    shown = {k: v for k, v in report["overall_metrics"].items() if v is not None}
    return "\n".join([f"{n} cases", *(f"{k} = {v}" for k, v in sorted(shown.items()))])


def _collect(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> str:
    seeds = spark.createDataFrame([(u,) for u in args.seeds], "url string").coalesce(1) if args.seeds else fetch.seeds(spark, forms=args.forms, directive_html=args.directive_html)
    if args.max_pages is not None:
        settings = replace(settings, max_pages=args.max_pages)
    get = crawl.stored(checkpoint(spark.read.parquet(args.pages))) if args.pages else crawl.fetching()
    made = crawl.crawl(spark, seeds, get, settings, forms=args.forms, directive_html=args.directive_html)
    docs = made.documents()
    before = readers.previous_manifest(spark, f"{args.output}/manifest")
    rows = checkpoint(collect.changed(docs, before))  # the manifest that it was read from is overwritten below
    writers.write_documents(rows, f"{args.output}/documents")
    told = rows.groupBy("status").count().orderBy("status").collect()
    failed, short = made.errors(), made.skipped()
    failed.write.mode("overwrite").json(f"{args.output}/errors")
    short.write.mode("overwrite").json(f"{args.output}/skipped")
    listed = rows.select("canonical_url", "authority_rank", "title", F.col("url").alias("source_url"), "doc_type", "date_modified", "content_hash", F.col("word_count").cast("string").alias("word_count"))
    writers.write_manifest(listed, f"{args.output}/manifest")
    return ", ".join(f"{r['count']} {r.status}" for r in told) or "nothing collected"


def _compare(spark: SparkSession, args: argparse.Namespace) -> str:
    one = lambda run: readers.run(spark, args.runs, run).select(F.explode("overall_metrics").alias("metric", "value"))
    rows = dashboard.compared(one(args.base), one(args.trial)).orderBy("metric").collect()  # a few dozen metrics
    return "\n".join(f"{r.metric}: {r.base} -> {r.trial} ({r.delta}, {r.tone})" for r in rows)


def main(argv: Sequence[str] | None = None, *, client: Factory = OfflineClient, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    settings = Settings.from_env()
    text = {"answer": lambda: _answer(spark, args, client, settings), "evaluate": lambda: _evaluate(spark, args, client, settings), "collect": lambda: _collect(spark, args, settings), "compare": lambda: _compare(spark, args)}[args.command]()
    print(text)
    return text


if __name__ == "__main__":
    main()
