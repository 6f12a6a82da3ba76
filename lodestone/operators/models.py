"""Models behind one client: embedding, reranking, chat. The offline client is deterministic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import values as V

DIMENSIONS = 64


class ModelClient(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...

    def rerank(self, query: str, documents: Sequence[str]) -> Sequence[float]: ...

    def chat(self, message: str, documents: Sequence[tuple[str, str]], history: Sequence[tuple[str, str]], max_tokens: int) -> str: ...


class OfflineClient:
    """Signed feature hashing, token overlap and an extract of the first document."""

    def _tokens(self, text: str) -> list[str]:
        return [t for t in re.findall(r"[a-z0-9]+", text.lower()) if len(t) > 2 and t not in V.STOPWORDS]

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in self._tokens(text):
                h = zlib.crc32(token.encode())
                row[h % DIMENSIONS] += 1 if h & 0x80000000 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)

    def rerank(self, query: str, documents: Sequence[str]) -> list[float]:
        asked = set(self._tokens(query))
        return [len(asked.intersection(self._tokens(d))) / max(1, len(asked)) for d in documents]

    def chat(self, message: str, documents: Sequence[tuple[str, str]], history: Sequence[tuple[str, str]], max_tokens: int) -> str:
        if not documents:
            return "Insufficient evidence in the documents."[: 4 * max_tokens]
        said = "\n".join(f"{text.split('. ')[0].strip().rstrip('.')}. [{chunk}]" for chunk, text in documents[:3]) + "\n\nConflict detected: no."
        return said[: 4 * max_tokens]


#: Makes the client within each task, so that nothing but its recipe is sent.
Factory = Callable[[], ModelClient]


def _mapped(df: DataFrame, columns: Sequence[str], name: str, kind: str, arrow: pa.DataType, call) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = call()
        for batch in batches:
            values = fn(*[batch.column(c).to_pylist() for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` {kind}")


def embedded(df: DataFrame, text: str, client: Factory = OfflineClient, *, name: str = "embedding", batch: int = 64) -> DataFrame:
    """Add unit vectors of ``text``, asked for in batches."""

    def call():
        model = client()

        def fn(texts: list[str | None]) -> list[list[float]]:
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                out += model.embed([t or "" for t in texts[i : i + batch]]).astype(np.float32).tolist()
            return out

        return fn

    return _mapped(df, [text], name, "array<float>", pa.list_(pa.float32()), call)


def embedded_with_cache(chunks: DataFrame, text: str, cache: DataFrame, client: Factory = OfflineClient) -> tuple[DataFrame, DataFrame]:
    """``chunks`` (with key) with their vectors, and the vectors that the cache lacked."""
    from lodestone.sources.writers import cache_missing

    fresh = embedded(cache_missing(chunks, cache).select("key", text), text, client).select("key", "embedding")
    return chunks.join(cache.select("key", "embedding").unionByName(fresh), "key"), fresh


def reranked(candidates: DataFrame, question: str, text: str, client: Factory = OfflineClient, *, by: str | None = None) -> DataFrame:
    """Add ``rerank`` to (question, text) rows, asked for once per question, or per value of ``by``.

    All rows of a question are scored by one call, so candidates must be few per question.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        asked = table.column(question)[0].as_py() or ""
        scores = client().rerank(asked, [t or "" for t in table.column(text).to_pylist()])
        return table.append_column("rerank", pa.array([float(s) for s in scores], pa.float64()))

    return candidates.groupBy(by or question).applyInArrow(run, f"{kinds}, rerank double")


def asked(rows: DataFrame, message: Column, client: Factory = OfflineClient, *, name: str, max_tokens: int) -> DataFrame:
    """Add the model's reply to a message without documents; a failing call gives an empty one."""
    none = {"_message": message, "_documents": F.array().cast("array<struct<chunk_id:string,text:string>>"), "_history": F.array().cast("array<struct<role:string,text:string>>")}
    out = answered(rows.withColumns(none), client, name=name, message="_message", documents="_documents", history="_history", max_tokens=max_tokens)
    return out.withColumn(name, F.coalesce(name, F.lit(""))).drop(*none, f"{name}_error")


def answered(prompts: DataFrame, client: Factory = OfflineClient, *, name: str = "answer", message: str = "message", documents: str = "documents", history: str = "history", max_tokens: int = 400) -> DataFrame:
    """Add a reply to each row's ``message`` with ``documents`` (array of chunk_id, text) and ``history`` (array of role, text).

    A failing call gives null and its error in ``<name>_error``; the other rows go on.
    """
    kind = pa.struct([("text", pa.string()), ("error", pa.string())])

    def call():
        model = client()

        def one(message_: str, documents_, history_) -> dict:
            try:
                docs = [(d["chunk_id"], d["text"]) for d in documents_ or ()]
                return {"text": model.chat(message_ or "", docs, [(h["role"], h["text"]) for h in history_ or ()], max_tokens), "error": None}
            except Exception as error:  # any failure of a remote model is a row's outcome, not the job's
                return {"text": None, "error": f"{type(error).__name__}: {error}"}

        return lambda *columns: [one(*row) for row in zip(*columns, strict=True)]

    out = _mapped(prompts, [message, documents, history], "_reply", "struct<text:string,error:string>", kind, call)
    return out.withColumns({name: F.col("_reply.text"), f"{name}_error": F.col("_reply.error")}).drop("_reply")


def intent(raw: Column) -> Column:
    """(route, clarifying_question) of a classifier's JSON; a policy question unless it names a known route."""
    from lodestone.functions.text import strip

    parsed = F.from_json(raw, "struct<route:string,label:string,clarifying_question:string>")
    route = strip(F.coalesce(F.nullif(parsed["route"], F.lit("")), parsed["label"], F.lit("")))
    known = F.coalesce(route.isin(*V.ROUTES), F.lit(False))
    return F.struct(F.when(known, route).otherwise("policy_question").alias("route"), F.when(known, strip(F.coalesce(parsed["clarifying_question"], F.lit("")))).otherwise("").alias("clarifying_question"))


def replies(spark) -> DataFrame:
    """The canned replies (route, locale, reply)."""
    return spark.createDataFrame([(r, k, t) for r, texts in V.REPLIES.items() for k, t in texts.items()], "route string, locale string, reply string")


def canned(routed: DataFrame) -> DataFrame:
    """Add ``reply`` to (route, language, clarifying_question) rows; unknown routes ask for clarification."""
    table = F.broadcast(replies(routed.sparkSession))  # a dozen rows
    rows = routed.withColumns({"locale": F.when(F.lower(F.trim(F.coalesce("language", F.lit("")))) == "fr", "fr").otherwise("en"), "_route": F.when(F.col("route").isin(*V.REPLIES), F.col("route")).otherwise("needs_clarification")})
    met = rows.join(table.withColumnRenamed("route", "_route"), ["_route", "locale"])
    asks = (F.col("route") == "needs_clarification") & (F.coalesce("clarifying_question", F.lit("")) != "")
    return met.withColumn("reply", F.when(asks, F.concat_ws("\n\n", "reply", "clarifying_question")).otherwise(F.col("reply"))).drop("_route", "locale")


def rewritten(raw: Column, question: Column, most: int = 3) -> Column:
    """The queries of a rewriter's JSON without blanks, repeats and the question itself, in whatever case and with or without blanks around it.

    Both cases are compared, as neither alone gives back all letters (a sharp s in upper case is two letters, which no lower case joins).
    """
    from lodestone.functions.text import clean_list, json_object, strip

    found, own = F.array_distinct(clean_list(json_object(raw, "struct<queries:array<string>>")["queries"])), strip(question)
    other = lambda q: (F.lower(q) != F.lower(own)) & (F.upper(q) != F.upper(own))
    return F.slice(F.filter(found, other), 1, max(1, most))


def verdict(raw: Column) -> Column:
    """(revise, unsupported, missing) of a verifier's JSON."""
    from lodestone.functions.text import clean_list, json_object

    p = json_object(raw, "struct<revision_needed:boolean,unsupported_claims:array<string>,missing_citations:array<string>,notes:array<string>>")
    unsupported, missing = clean_list(p["unsupported_claims"]), clean_list(p["missing_citations"])
    revise = F.coalesce(p["revision_needed"], F.lit(False)) | (F.size(unsupported) > 0) | (F.size(missing) > 0)
    return F.struct(revise.alias("revise"), unsupported.alias("unsupported"), missing.alias("missing"), clean_list(p["notes"]).alias("notes"))
