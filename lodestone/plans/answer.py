"""Answering questions: routing, retrieval, selection, packing, conflicts, prompting, critique, citations.

Questions are rows, so one question is a one-row DataFrame and a batch shares every scan of the chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.functions.text import content_tokens, token_count
from lodestone.operators import conflicts, feedback, hybrid, models, packing, scoring, selection
from lodestone.operators.models import Factory, OfflineClient
from lodestone.settings import Settings
from lodestone.sources.shared import checkpoint
from lodestone.sources.writers import cache_key

DEFAULTS = Settings()
INSTRUCTIONS = (
    "Answer from the given documents alone. Put the CHUNK_ID that supports a claim in square brackets behind it. "
    "Where the documents do not say, state that evidence is missing. End with a few words under the heading 'Conflict detected'."
)
FRENCH = "\n\nThe reader speaks French: respond entirely in French, and translate what you quote."


def indexed(chunks: DataFrame, client: Factory = OfflineClient, settings: Settings = DEFAULTS, *, cache: DataFrame | None = None) -> DataFrame:
    """Chunks with embedding, vocab, modes and source: what retrieval needs, made once and kept as a table.

    Vectors that ``cache`` (key, embedding) holds under the settings' model are taken from there.
    """
    from lodestone.operators.chunking import retrieval_text

    ready = chunks.withColumn("_r", retrieval_text(settings.embed_metadata))
    if cache is None:
        ready = models.embedded(ready, "_r", client, batch=settings.embed_batch)
    else:
        keyed = ready.withColumn("key", cache_key(settings.embed_model, settings.embed_metadata, F.col("chunk_id"), F.col("_r")))
        ready = models.embedded_with_cache(keyed, "_r", cache, client)[0].drop("key")
    named = F.concat_ws("\n", "title", "source_path", F.substring("text", 1, 240))
    return ready.withColumns({"vocab": scoring.vocabulary(F.col("title"), F.col("source_path"), F.col("_r")), "cmodes": scoring.modes_of(named)}).drop("_r")


def prepared(questions: DataFrame, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """Questions (query_id, question, expansions) with variants' vectors, tokens and modes, and the queries of the coverage passes.

    ``clauses`` are parts of a question with a question of their own, ``extras`` queries made from its terms; each has its tokens, its
    vector and, for clauses, the first tokens of the question beside them. Both are empty unless the settings ask for them.
    """
    asked = questions.select("query_id", "question", "expansions", F.array().cast("array<string>").alias("_none"))
    variants = F.transform(scoring.merged_queries(F.col("question"), F.col("expansions")), lambda q: F.struct(F.lit("v").alias("role"), q.alias("text")))
    modes = scoring.modes_of(F.col("question"))
    clauses = scoring.subqueries(F.col("question"), settings.max_subqueries)
    parts = [variants]
    if settings.enable_clause_coverage:
        parts.append(F.transform(clauses, lambda q: F.struct(F.lit("c").alias("role"), q.alias("text"))))
    if settings.enable_query_expansion:
        known = clauses if settings.enable_clause_coverage else F.col("_none")
        parts.append(F.transform(scoring.expansion_queries(F.col("question"), known, modes, settings.max_expansion_queries), lambda q: F.struct(F.lit("x").alias("role"), q.alias("text"))))
    texts = asked.select("query_id", F.posexplode(F.concat(*parts)).alias("i", "q")).select("query_id", "i", "q.role", "q.text")
    rows = models.embedded(texts, "text", client, batch=settings.embed_batch).withColumn("tokens", content_tokens("text"))
    row = F.struct("i", "role", "embedding", "tokens")
    all_ = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_q"))  # a few rows a question
    of = lambda role: F.filter("_q", lambda x: x["role"] == role)
    long = lambda role: F.filter(of(role), lambda x: F.size(x["tokens"]) >= 3)
    merged = F.array_join(scoring.merged_queries(F.col("question"), F.col("expansions")), " ")
    ready = questions.join(all_, "query_id").withColumns({"tokens": content_tokens(merged), "qmodes": modes})
    beside = lambda x: F.slice(F.filter("tokens", lambda t: ~F.array_contains(x["tokens"], t)), 1, 8)
    return ready.withColumns({
        "vectors": F.transform(of("v"), lambda x: x["embedding"]),
        "clauses": F.transform(long("c"), lambda x: F.struct(x["tokens"].alias("tokens"), x["embedding"].alias("embedding"), beside(x).alias("beside"))),
        "extras": F.transform(long("x"), lambda x: F.struct(x["tokens"].alias("tokens"), x["embedding"].alias("embedding"))),
    }).drop("_q")


def _recent(history: DataFrame | None, questions: DataFrame, most: int = 6) -> DataFrame:
    """``questions`` with ``_said``, the last messages of their conversations as lines."""
    if history is None:
        return questions.withColumn("_said", F.lit("(none)"))
    lines = packing.history_text(packing.history_tail(history, most, by="conversation_id"), by="conversation_id")
    return questions.join(lines.withColumnRenamed("history", "_said"), "conversation_id", "left").withColumn("_said", F.coalesce("_said", F.lit("(none)")))


def expanded(questions: DataFrame, history: DataFrame | None = None, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """Questions whose ``expansions`` also hold the search queries that the model makes of them and of what was said before."""
    most = settings.rewrite_max_queries
    if not settings.enable_rewrite or most <= 0:
        return questions
    task = f'Write up to {most} short search queries, in words that the documents would use, for the question below. Answer with JSON alone: {{"queries": ["..."]}}.'
    message = F.concat(F.lit(task + "\n\nSaid before:\n"), "_said", F.lit("\n\nQuestion:\n"), "question")
    rows = models.asked(_recent(history, questions), message, client, name="_raw", max_tokens=settings.max_output_tokens)
    found = F.coalesce(models.rewritten(F.col("_raw"), F.col("question"), most), F.array().cast("array<string>"))
    return rows.withColumn("expansions", F.concat(F.coalesce("expansions", F.array().cast("array<string>")), found)).select(*questions.columns)


def classified(questions: DataFrame, history: DataFrame | None = None, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """Questions with ``classified``, the model's JSON on where they belong; what it does not answer well counts as a policy question."""
    task = (
        f"Sort the message for an assistant on purchasing rules. Answer with JSON alone, keys route (one of {', '.join(V.ROUTES)}) and clarifying_question. "
        "A question that names a rule or a case is a policy_question. One on the subject that lacks what a search needs is needs_clarification, with the one question to ask back; else clarifying_question is empty."
    )
    message = F.concat(F.lit(task + "\n\nSaid before:\n"), "_said", F.lit("\n\nMessage:\n"), "question")
    return models.asked(_recent(history, questions), message, client, name="classified", max_tokens=settings.max_output_tokens).drop("_said")


def candidates(chunks: DataFrame, questions: DataFrame, settings: Settings = DEFAULTS, *, limit: int = hybrid.HELD_BYTES) -> DataFrame:
    """The rows of prepared questions and indexed chunks that selection can take: dense, overlap and score, with what the passes need.

    A question's greatest overlap, which scales the others, takes a pass over the vocabularies alone.
    """
    k, cap, pool = settings.top_k, max(1, settings.max_chunks_per_source), max(settings.top_k, settings.retrieval_candidate_pool)
    modes = sorted(V.MODE_PHRASES)
    covered = settings.enable_mode_routing and settings.enable_mode_coverage
    most = hybrid.greatest_overlaps(chunks, questions)
    ready = questions.drop("most").join(most, "query_id", "left")
    named = chunks.withColumn("source", F.col("source_path"))
    return hybrid.candidates(named, ready, hybrid.Lists(k, cap, pool, len(modes) if covered else 0), modes, settings, limit=limit)


def retrieved(chunks: DataFrame, questions: DataFrame, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, rank, chunk_id, score) after rerank, coverage and capped fill; ``rank`` is the order of selection.

    ``questions`` are prepared with the same settings.
    """
    k, cap, pool = settings.top_k, max(1, settings.max_chunks_per_source), max(settings.top_k, settings.retrieval_candidate_pool)
    covered = settings.enable_mode_routing and settings.enable_mode_coverage
    rows = candidates(chunks, questions, settings)
    if settings.enable_rerank:
        rows = checkpoint(rows)  # read twice
        first = scoring.ranked(rows, "score", "chunk_id", limit=pool)
        asked = first.select("query_id", "chunk_id").join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id").join(questions.select("query_id", "question"), "query_id")
        marks = models.reranked(asked, "question", "_t", client, by="query_id").select("query_id", "chunk_id", "rerank")
        rows = scoring.rerank_blend(rows.join(marks, ["query_id", "chunk_id"], "left"), alpha=settings.rerank_alpha)
    kept = selection.selected(rows, k, cap=cap, pool=pool, modes=covered, each_mode=max(1, settings.min_chunks_per_mode), each_clause=max(1, settings.min_chunks_per_clause), each_expansion=max(1, settings.min_chunks_per_expansion))
    return kept.select("query_id", F.col("position").alias("rank"), "chunk_id", "score")


def answered(chunks: DataFrame, questions: DataFrame, *, history: DataFrame | None = None, weights: DataFrame | None = None, complaints: DataFrame | None = None, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, answer, citations, stats) for questions (query_id, conversation_id, question, language, expansions).

    ``history`` has conversation_id, turn, role, text; ``weights`` conversation_id, chunk_id, weight; ``complaints``
    conversation_id, thumb, comment. Questions for which no document fits get a fixed reply.
    """
    # kept in the shared folder: what follows reads them several times, and models are asked once
    ready = checkpoint(prepared(expanded(questions, history, client, settings), client, settings))
    found = checkpoint(retrieved(chunks, ready, client, settings).join(questions.select("query_id", "conversation_id"), "query_id"))
    if weights is not None:
        # a conversation without weights keeps its selection order
        voted = weights.select("conversation_id").distinct().withColumn("_v", F.lit(True))
        order = W.partitionBy("query_id").orderBy(F.when(F.col("_v"), -F.col("_s")), "rank")
        met = found.join(weights, ["conversation_id", "chunk_id"], "left").join(voted, "conversation_id", "left").withColumn("_s", F.col("score") * F.coalesce("weight", F.lit(1.0)))
        found = met.withColumn("_rank", F.row_number().over(order)).select("query_id", "conversation_id", F.col("_rank").alias("rank"), "chunk_id", F.col("_s").alias("score"))
    texts = found.join(chunks.select("chunk_id", "text", "title", "source_title", "source_url", "source_path", "embedding"), "chunk_id")
    fixed = questions.select("query_id", token_count("question").alias("_fixed"))
    packed = checkpoint(packing.packed(texts.join(fixed, "query_id"), packing.budget(F.col("_fixed"), settings), settings=settings))
    docs = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("packed_text").alias("text")))).alias("documents"))
    opposed = conflicts.pairs(texts, settings=settings)
    if settings.enable_conflict_classifier:
        opposed = conflicts.classified(opposed, client, max_tokens=settings.max_output_tokens)
    section = conflicts.prompt_section(opposed, questions) if settings.enable_conflicts else questions.select("query_id", F.lit("Conflict detected:\n- not evaluated.").alias("section"))
    prompts = questions.join(section, "query_id").join(docs, "query_id", "left")
    note = F.lit("")
    if complaints is not None:
        prompts = prompts.join(complaints.select("conversation_id", "thumb", "comment"), "conversation_id", "left")
        note = F.coalesce(feedback.prompt_note(F.col("thumb"), F.col("comment")), F.lit(""))
    tail = F.when(F.col("language") == "fr", FRENCH).otherwise("")
    prompts = prompts.withColumn("message", F.concat(F.concat_ws("\n\n", "question", F.lit(INSTRUCTIONS), "section"), tail, note))
    if history is not None:
        kept = packing.history_tail(history, 2 * settings.max_history_turns, by="conversation_id")
        said = kept.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
        prompts = prompts.join(said, "conversation_id", "left")
    else:
        prompts = prompts.withColumn("history", F.array().cast("array<struct<turn:int,role:string,text:string>>"))
    replies = checkpoint(models.answered(prompts.select("query_id", "question", "message", "documents", "history"), client, max_tokens=settings.max_output_tokens))
    if settings.enable_critique:
        replies = revised(replies, client, settings)
    cited = packing.top_citations(packed, most=settings.top_citations)
    links = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation", F.coalesce("source_title", "title").alias("title"), F.col("source_url").alias("link"), F.col("chunk_id").cast("string").alias("chunk_id")))).alias("citations"))
    answer = F.when(F.col("documents").isNull(), "No context docs fit. Try a shorter question.").otherwise(F.col("answer"))
    return replies.join(links, "query_id", "left").join(packing.packing_stats(packed), "query_id", "left").select("query_id", answer.alias("answer"), "answer_error", "citations", "n_docs", "n_tokens", "truncated_docs")


def revised(replies: DataFrame, client: Factory = OfflineClient, settings: Settings = DEFAULTS) -> DataFrame:
    """Check each draft with the model and revise it where the check says so; a failed revision keeps the draft."""
    ask = F.concat(F.lit("Return strict JSON with revision_needed, unsupported_claims, missing_citations and notes.\n\nQUESTION:\n"), "question", F.lit("\n\nDRAFT_ANSWER:\n"), F.coalesce("answer", F.lit("")))
    checked = models.answered(replies.withColumn("_ask", ask), client, name="_check", message="_ask", max_tokens=settings.max_output_tokens).withColumn("_v", models.verdict(F.col("_check")))
    again = F.concat("message", F.lit("\n\nRevise the draft with the documents alone.\n\nDRAFT_ANSWER:\n"), F.coalesce("answer", F.lit("")), F.lit("\n\nFINDINGS:\n"), F.to_json("_v"))
    needs = models.answered(checked.where("_v.revise").withColumn("_ask", again), client, name="_new", message="_ask", max_tokens=settings.max_output_tokens)
    done = needs.withColumn("answer", F.coalesce(F.nullif("_new", F.lit("")), "answer"))
    names = replies.columns
    return done.select(*names).unionByName(checked.where("not _v.revise").select(*names))


def routed(questions: DataFrame, raw: str = "classified") -> DataFrame:
    """Questions with their route; those that need no retrieval get a canned ``reply``."""
    rows = questions.withColumn("_d", models.intent(F.col(raw))).select(*questions.columns, "_d.*")
    canned = models.canned(rows.where("route != 'policy_question'"))
    return rows.where("route = 'policy_question'").withColumn("reply", F.lit(None).cast("string")).unionByName(canned)
