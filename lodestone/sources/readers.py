"""Readers of documents, evaluation cases, runs, feedback logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.settings import Settings

DEFAULTS = Settings()
CLAIM = "struct<claim:string,evidence_doc_prefixes:array<string>,evidence_chunk_ids:array<string>>"
CASE = (
    "struct<id:string,question:string,split:string,mode:string,question_type:string,source_family_needed:array<string>,"
    "expected_doc_prefixes:array<string>,gold_relevant_doc_prefixes:array<string>,gold_relevant_chunk_ids:array<string>,"
    f"claim_evidence:array<{CLAIM}>,required_claims:array<string>,forbidden_claims:array<string>,"
    "required_phrase_groups:array<array<string>>,forbidden_phrases:array<string>,reference_answer:string,expect_abstain:boolean,"
    "noise_doc_prefixes:array<string>,contradiction_doc_prefixes:array<string>>"
)
FEEDBACK = (
    "struct<timestamp:string,conversation_id:string,turn_id:string,feedback_type:string,thumb:string,comment:string,"
    "question:string,answer:string,cited_chunk_ids:array<string>,target_chunk_id:string>"
)
CONFIG = "struct<cases_file:string,split_filter:array<string>,top_k:int,with_chat:boolean,with_judge:boolean,judge_model:string,case_count:int>"
TIMING = "struct<p50:double,p95:double,mean:double>"
RUN = (
    f"struct<config:{CONFIG},timing_summary_ms:struct<retrieval:{TIMING},chat:{TIMING},judge:{TIMING},total:{TIMING}>,overall_metrics:map<string,double>,"
    "overall_metric_ci95:map<string,struct<low:double,high:double,n:int>>,"
    "subgroup_metrics:map<string,map<string,struct<count:int,metrics:map<string,double>>>>,"
    "cases:array<struct<chat_error:string,answer:string,judge:struct<error:string>,query_expansions:array<string>>>>"
)
MANIFEST = "documents array<struct<doc_id:string,title:string,source_url:string,canonical_url:string,doc_type:string,authority_rank:int,date_modified:string,fetched_at:string,content_hash:string,word_count:int,text_path:string>>"


def raw_files(spark: SparkSession, folder: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(source_path, text) of all ``.txt`` and ``.md`` files below a folder, the settings' own if none is named; bad bytes dropped."""
    folder = folder or settings.raw_dir
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = files.where(F.lower("path").rlike(r"\.(txt|md)$"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "�", "")
    return kept.select(F.col("path").alias("source_path"), text.alias("text"))


def with_header(files: DataFrame) -> DataFrame:
    """Documents (source_path, stem, source_title, source_url, doc_type, authority_rank, body) from (source_path, text).

    A header of ``KEY: value`` lines ends at the first line ``---``; the last of equal keys counts. Text without
    such a line is all body. A rank that is no number is 0.
    """
    cut = F.locate("\n---\n", F.col("text"))
    head = F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise("")
    body = F.when(cut > 0, F.substring("text", cut + 5, F.length("text"))).otherwise(F.col("text"))
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.upper(strip(F.split(x, ":", 2)[0])).alias("k"), strip(F.split(x, ":", 2)[1]).alias("v")))
    value = lambda k: F.coalesce(F.try_element_at(F.filter("_p", lambda p: p["k"] == k), F.lit(-1))["v"], F.lit(""))
    rows = files.select("source_path", pairs.alias("_p"), body.alias("body"))
    stem = F.regexp_replace(F.regexp_extract("source_path", "([^/]*)$", 1), r"\.[^.]*$", "")
    title = F.when(value("TITLE") != "", value("TITLE")).otherwise(stem)
    url = F.when(value("CANONICAL_URL") != "", value("CANONICAL_URL")).otherwise(value("SOURCE_URL"))
    return rows.select("source_path", stem.alias("stem"), title.alias("source_title"), url.alias("source_url"), value("DOC_TYPE").alias("doc_type"), F.coalesce(value("AUTHORITY_RANK").try_cast("int"), F.lit(0)).alias("authority_rank"), "body")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a log in file order; numbers rise but need not be dense."""
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("line_no"), "value").where(strip("value") != "")


def _fields(lines: DataFrame, schema: str, check: Column | None = None) -> DataFrame:
    found = lines.withColumn("r", F.from_json("value", schema))
    if check is not None:
        found = found.withColumn("r", F.when(check, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "value"))))
    return found.select("line_no", "value", "r.*")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSONL file with ``#`` comments. A line without id or question is an error."""
    lines = _numbered(spark, path).where(~strip("value").startswith("#"))
    return _fields(lines, CASE, F.col("r.id").isNotNull() & F.col("r.question").isNotNull()).drop("value")


def case_modes(spark: SparkSession, *paths: str) -> DataFrame:
    """The sorted distinct modes of case files; lines that are no objects are passed over."""
    lines = spark.read.text(list(paths)).where(~strip("value").startswith("#"))
    mode = strip(F.get_json_object("value", "$.mode"))
    return lines.select(mode.alias("mode")).where("mode is not null and mode != ''").distinct().orderBy("mode")


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Raw feedback events with line numbers; blank and broken lines are passed over."""
    found = _fields(_numbered(spark, path), FEEDBACK)
    whole = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.coalesce(F.get_json_object("value", "$").isNotNull(), F.lit(False))
    return found.where(whole).drop("value")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation runs, one JSON object per file; a broken file has null fields."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    read = files.select("path", F.col("modificationTime").alias("modified"), F.from_json(F.decode("content", "UTF-8"), RUN).alias("r"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return read.select(F.regexp_replace(name, r"\.json$", "").alias("run_id"), name.alias("filename"), "modified", "r.*")


def run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """One run; an error if there is none."""
    found = runs(spark, folder).where(F.col("run_id") == run_id)
    if found.isEmpty():
        raise LookupError(run_id)
    return found


def run_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, modified, payload): runs with their whole content as VARIANT; that of a broken file is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select(F.regexp_replace(name, r"\.json$", "").alias("run_id"), F.col("modificationTime").alias("modified"), F.try_parse_json(F.decode("content", "UTF-8")).alias("payload"))


def latest_run(listed: DataFrame) -> DataFrame:
    """The run changed last; the smaller id of equals."""
    return listed.orderBy(F.desc("modified"), "run_id").limit(1)


def previous_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a manifest; none if it is missing or broken."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.inline("documents"))
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST).select(F.inline("documents"))


def claims_of(case_rows: DataFrame) -> DataFrame:
    """Add required and forbidden: a case's claims, or those of the older fields where there are none."""
    from lodestone.functions.text import clean_list

    first = F.transform(F.filter(F.coalesce("required_phrase_groups", F.array().cast("array<array<string>>")), lambda g: F.size(g) > 0), lambda g: g[0])
    pick = lambda new, old: F.when(F.size(clean_list(new)) > 0, clean_list(new)).otherwise(clean_list(old))
    return case_rows.withColumns({"required": pick(F.col("required_claims"), first), "forbidden": pick(F.col("forbidden_claims"), F.col("forbidden_phrases"))})


def filtered_cases(case_rows: DataFrame, splits: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Cases of some splits, then the first in file order."""
    kept = case_rows.where(F.col("split").isin(*splits)) if splits else case_rows
    return kept.orderBy("line_no").limit(limit) if limit else kept


def conversations_of(conversations: DataFrame, user: Column) -> DataFrame:
    """A user's conversations, newest first, later ids first among equals."""
    return conversations.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("id"))


def messages_of(messages: DataFrame, conversation: Column) -> DataFrame:
    """A conversation's messages, oldest first, with parsed citations."""
    cited = F.from_json("citations", "array<struct<title:string,link:string,chunk_id:string>>")
    return messages.where(F.col("conversation_id") == conversation).withColumn("citations", cited).orderBy("created_at", "id")


def numbered(events: DataFrame, *order: str) -> DataFrame:
    """Add a dense line_no in the given order; for logs of bounded size, since one task numbers them."""
    return events.withColumn("line_no", F.row_number().over(W.orderBy(*order)))
