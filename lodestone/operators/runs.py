"""Run artifacts as VARIANT: nested values by path, every numeric leaf as a row, a run's detail and summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import values as V

#: What a summary keeps of a run as it stands.
PARTS = ("config", "timing_summary_ms", "overall_metrics", "overall_metric_ci95", "subgroup_metrics")


def path_of(keys: Sequence[str]) -> str:
    """The path expression of nested keys, which must not hold apostrophes."""
    return "$" + "".join(f"['{k}']" for k in keys)


def kind_of(value: Column) -> Column:
    """The type of a VARIANT, null where there is none."""
    return F.schema_of_variant(value)


def number(value: Column) -> Column:
    """A VARIANT's number; booleans are 0 and 1, texts, objects, lists and nulls are none."""
    kind = kind_of(value)
    plain = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(plain, F.try_variant_get(value, "$", "double"))


def at(payload: Column, *keys: str) -> Column:
    """The value at a path; null where a key is missing or what holds it is no object."""
    return F.try_variant_get(payload, path_of(keys), "variant")


def collected(rows: DataFrame, payload: str, paths: Sequence[Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """(by, path, n, mean) of the numbers at each path; rows without one do not count."""
    found = F.array(*[F.struct(F.lit(".".join(p)).alias("path"), number(at(F.col(payload), *p)).alias("value")) for p in paths])
    flat = rows.select(*by, F.inline(found))
    return flat.groupBy(*by, "path").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def leaves(rows: DataFrame, key: str, payload: str, depth: int = 8) -> DataFrame:
    """(key, path, value): every number of a payload's nested objects, with its keys joined by dots.

    Objects are opened level by level, ``depth`` levels at most; lists are not opened.
    """
    spark = rows.sparkSession
    level, out = rows.select(F.col(key), F.lit("").alias("path"), F.col(payload).alias("value")), []
    for i in range(depth):
        inner = level.where(kind_of(F.col("value")).startswith("OBJECT")).alias(f"l{i}")
        made = inner.lateralJoin(spark.tvf.variant_explode(F.col(f"l{i}.value").outer()).alias("e"))
        level = made.select(F.col(f"l{i}.{key}"), F.concat_ws(".", F.nullif(F.col(f"l{i}.path"), F.lit("")), F.col("e.key")).alias("path"), F.col("e.value").alias("value"))
        out.append(level.select(key, "path", number(F.col("value")).alias("value")).where("value is not null"))
    return reduce(DataFrame.unionByName, out)


def _said(value: Column) -> Column:
    """Whether a JSON value says something: no null, false, zero, empty text, list or object."""
    kind = kind_of(value)
    text = F.to_json(value)
    return F.coalesce(value.isNotNull() & (kind != "VOID") & ~text.isin('""', "false", "0", "0.0", "[]", "{}"), F.lit(False))


def errors(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, total_cases, chat_error_count, judge_error_count, empty_answer_count) of a payload's cases; zeros where it has no list of them."""
    spark = rows.sparkSession
    listed = rows.select(key, at(F.col(payload), "cases").alias("cases"))
    full = listed.where(kind_of(F.col("cases")).startswith("ARRAY")).alias("l")
    case = full.lateralJoin(spark.tvf.variant_explode(F.col("l.cases").outer()).alias("e")).select(F.col(f"l.{key}"), F.col("e.value").alias("c"))
    whole = kind_of(F.col("c")).startswith("OBJECT")
    answer = at(F.col("c"), "answer")
    empty = F.coalesce((kind_of(answer) != "STRING") | (F.trim(F.regexp_replace(F.try_variant_get(answer, "$", "string"), r"(?U)\s", " ")) == ""), F.lit(True))
    counted = case.groupBy(key).agg(
        F.count("*").alias("total_cases"), F.count_if(whole & _said(at(F.col("c"), "chat_error"))).alias("chat_error_count"),
        F.count_if(whole & _said(at(F.col("c"), "judge", "error"))).alias("judge_error_count"), F.count_if(whole & empty).alias("empty_answer_count"),
    )
    names = ("total_cases", "chat_error_count", "judge_error_count", "empty_answer_count")
    return rows.select(key).join(counted, key, "left").select(key, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


def summaries(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, the parts of PARTS as VARIANT, error_breakdown, key_metrics) of runs, whose keys are distinct."""
    metric = lambda name: F.try_variant_get(at(F.col(payload), "overall_metrics", name), "$", "double")
    groups = F.struct(*[F.struct(*[metric(m).alias(n) for n, m in names.items()]).alias(g) for g, names in V.KEY_METRICS.items()])
    told = errors(rows, key, payload)
    counts = told.select(key, F.struct(*told.columns[1:]).alias("error_breakdown"))
    parts = rows.select(key, *[at(F.col(payload), p).alias(p) for p in PARTS], groups.alias("key_metrics"))
    return parts.join(counts, key)
