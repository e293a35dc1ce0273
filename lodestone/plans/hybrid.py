"""Hybrid retrieval of a table of questions over a table of chunks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions.messages import split_questions
from lodestone.functions.text import search_tokens
from lodestone.operators import retrieval as R
from lodestone.operators.dedup import near_duplicates, signatures
from lodestone.operators.dense import dense_topk, ranked_with, search, tiles
from lodestone.operators.lexical import asked_tokens, bm25, lexical_rerank, query_terms, tokenize
from lodestone.operators.scoring import Scorer, rerank, rerank_or_fallback
from lodestone.session import cut_lineage, merged

KEY = R.KEY
CARD_OWNERS = 20


def hybrid_candidates(queries: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """First stage: dense and lexical ranks, fusion, matched terms, and the hits of any channel.

    Candidates are the best by similarity, the best by words, the chunks of a named entity and the best cards; only
    they are ranked among all chunks. One dense search finds the best chunks and the best cards.

    queries: query_id, text, embedding. chunks: chunk_id, text, section, family_names, owner_id, kind,
    conflict, embedding.
    """
    whole = F.concat_ws("\n", "text", "section", F.array_join("family_names", " "))
    terms = query_terms(queries)
    tokens = cut_lineage(asked_tokens(tokenize(chunks, "chunk_id", whole), terms))
    card = F.coalesce(F.col("kind") == "family_card", F.lit(False))
    held = tiles(chunks.select("chunk_id", "owner_id", "embedding", card.alias("card")))
    top, cards = (cut_lineage(x) for x in search(queries, held, max(R.DENSE_WINDOW, limit or 0), CARD_OWNERS))
    exact = cut_lineage(R.exact_entity_match(queries, chunks))
    found = top.select(*KEY).unionByName(exact.select(*KEY)).unionByName(cards.select(*KEY))
    words = cut_lineage(R.ranked_words(cut_lineage(bm25(terms, tokens)), found))
    wanted = words.filter(F.col("lexical_rank") <= R.LEXICAL_WINDOW).select(*KEY).unionByName(exact.select(*KEY)).unionByName(cards.select(*KEY))
    dense = ranked_with(queries, chunks, held, top, cut_lineage(wanted.distinct()))
    return R.matched_terms(R.candidates(R.rank_channels(dense, words), exact, cards, limit), queries, tokens)


def finish(
    reranked: DataFrame, chunks: DataFrame, limit: int | None = None, semantic: bool | None = None, semantic_floor: float = R.SEMANTIC_FLOOR,
) -> DataFrame:
    """Cutoff, reject reasons, duplicates and diversification of reranked candidates, each question by its own mode."""
    facts = chunks.select("chunk_id", "conflict", "owner_id", "family_names", "section")
    hits = cut_lineage(merged(reranked).join(facts, "chunk_id"))
    judged = cut_lineage(R.reject_reason(hits, R.gap_cutoff(hits, semantic, semantic_floor), semantic))
    eligible = judged.filter("reason IS NULL").withColumns({
        "_order": -F.col("rerank"), "_names": F.array_join("family_names", "|"), "_owner": F.coalesce("owner_id", F.lit(""))})
    words = chunks.join(eligible.select("chunk_id").distinct(), "chunk_id", "left_semi")
    words = words.select("chunk_id", search_tokens(F.col("text")).alias("_tokens"))
    signed = signatures(words, "chunk_id", "_tokens")
    same = near_duplicates(eligible, ["query_id", "_owner", "_names"], "chunk_id", ["_order"], signed)
    repeats = same.filter("duplicate").select(*KEY, F.lit(True).alias("_dup"))
    marked = judged.join(merged(repeats), KEY, "left").withColumns({
        "reason": F.when(F.col("_dup"), "duplicate").otherwise(F.col("reason")),
        "group_key": R.group_key(F.col("owner_id"), F.col("family_names"), F.col("section"))})
    return R.diversify(cut_lineage(marked.drop("_dup")), "rerank", limit or R.DEFAULT_LIMIT)


def second_stage(found: DataFrame, queries: DataFrame, chunks: DataFrame, models: Mapping[str, Scorer] | None = None) -> DataFrame:
    """Add rerank, mode, passage and reranker_error to candidates.

    A question with a model (column ``model``, a name in ``models``) is scored by it; where any of its scores fails, or
    its model is unknown, all of its hits take the lexical score and say why. Other questions take the lexical score.
    """
    modes = {"passage": F.lit(None).cast("string"), "reranker_error": F.lit(None).cast("string")}
    if not models or "model" not in queries.columns:
        return _lexical(found, queries, chunks).withColumns(modes)
    asked = queries.filter("model IS NOT NULL").select("query_id", "model", F.col("text").alias("question"))
    heading = F.concat_ws("\n", F.array_join("family_names", "; "), "section").alias("heading")
    texts = chunks.select("chunk_id", "text", heading)
    cands = cut_lineage(found.join(asked, "query_id"))
    unknown = cands.filter(~F.col("model").isin(*models)).withColumns({
        "rerank": F.lit(None).cast("double"), "passage": F.lit(None).cast("string"), "_error": F.lit("unknown_model"),
        "mode": F.concat(F.lit(R.SEMANTIC_MODE), "model")})
    scored = unknown
    for name, scorer in models.items():
        scored = scored.unionByName(rerank(cands.filter(F.col("model") == name), scorer, name, texts=texts))
    scored = cut_lineage(scored.drop("question", "model"))
    failed = scored.groupBy("query_id").agg(F.max(F.col("rerank").isNull() | F.col("_error").isNotNull()).alias("_failed"))
    lexical = cut_lineage(_lexical(found.join(failed.filter("NOT _failed"), "query_id", "left_anti"), queries, chunks))
    kept = rerank_or_fallback(scored, lexical).withColumnRenamed("reason", "reranker_error")
    plain = lexical.join(asked.select("query_id"), "query_id", "left_anti").withColumns(modes)
    return kept.unionByName(plain)


def _lexical(found: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    touched = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    terms = query_terms(queries)
    bodies = cut_lineage(asked_tokens(tokenize(touched, "chunk_id", F.col("text")), terms, placed=True))
    heads = tokenize(touched, "chunk_id", F.concat_ws(" ", F.array_join("family_names", " "), "section"))
    return lexical_rerank(found, terms, bodies, heads)


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, limit: int | None = None, models: Mapping[str, Scorer] | None = None,
    semantic_floor: float = R.SEMANTIC_FLOOR,
) -> DataFrame:
    """Ranked, judged and diversified hits with diagnostics; questions of both modes go together.

    queries may name a cross-encoder per question in ``model``; ``models`` has the scorers by name.
    """
    found = cut_lineage(hybrid_candidates(queries, chunks, limit))
    return finish(second_stage(found, queries, chunks, models), chunks, limit, None, semantic_floor)


def baseline_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Dense search only."""
    return dense_topk(queries, chunks, k)


def compare_strategies(queries: DataFrame, chunkings: dict[str, DataFrame], k: int) -> DataFrame:
    """The same query vectors against several chunkings: one row per query, columns per strategy."""
    out = None
    for name, chunks in chunkings.items():
        hits = baseline_search(queries, chunks, k).groupBy("query_id").agg(
            F.count(F.lit(1)).alias(f"{name}_hits"), F.max("similarity").alias(f"{name}_best"),
            F.min_by("chunk_id", "rank").alias(f"{name}_top"))
        out = hits if out is None else out.join(hits, "query_id", "full")
    return out


def multi_question(messages: DataFrame, text: str = "text") -> DataFrame:
    """(message_id, number, question, query_id): every listed question becomes a query of its own."""
    rows = split_questions(messages, "message_id", text)
    return rows.withColumn("query_id", F.concat_ws("#", F.col("message_id").cast("string"), F.col("number").cast("string")))


def question_contexts(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per message and listed question: question, n_scanned, n_candidates and its context, selected hits in order.

    questions: message_id, number, question, query_id. A question without any hit keeps its row, with an empty context.
    """
    hit = F.struct("position", "chunk_id", "similarity", "rerank", "mode")
    found = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.array_sort(F.collect_list(F.when(F.col("selected"), hit))).alias("context"))
    kind = dict(found.dtypes)["context"]
    rows = questions.select("message_id", "number", "question", "query_id").join(found, "query_id", "left").withColumns({
        "n_scanned": chunks.agg(F.count(F.lit(1)).alias("n")).scalar(), "n_candidates": F.coalesce("n_candidates", F.lit(0)).cast("bigint"),
        "context": F.coalesce("context", F.array().cast(kind))})
    return rows.select("message_id", "number", "question", "query_id", "n_scanned", "n_candidates", "context")


def message_sources(contexts: DataFrame) -> DataFrame:
    """All sources of a message: (message_id, place, number, position, chunk_id, repeated), questions in order.

    A chunk that an earlier question of the message already gave is kept and marked as repeated.
    """
    rows = contexts.select("message_id", "number", F.explode("context").alias("_h"))
    flat = rows.select("message_id", "number", "_h.position", "_h.chunk_id", "_h.similarity", "_h.rerank", "_h.mode")
    first = flat.groupBy("message_id", "chunk_id").agg(F.min("number").alias("_first"))
    # A message has as many sources as questions times the limit, so its window is small.
    order = Window.partitionBy("message_id").orderBy("number", "position")
    placed = flat.join(first, ["message_id", "chunk_id"]).withColumn("place", F.row_number().over(order))
    return placed.withColumn("repeated", F.col("number") > F.col("_first")).drop("_first")


def multi_question_search(
    messages: DataFrame, chunks: DataFrame, encode: Callable[[DataFrame], DataFrame], limit: int | None = None,
    models: Mapping[str, Scorer] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Retrieve for every listed question of every message on its own; contexts per question, and the hits.

    messages: message_id, text, and model where a cross-encoder is wanted. encode: (query_id, text) to (query_id, embedding).
    """
    questions = cut_lineage(multi_question(messages))
    rows = questions.withColumn("text", F.col("question"))
    if "model" in messages.columns:
        rows = rows.join(messages.select("message_id", "model"), "message_id")
    asked = cut_lineage(rows.join(encode(rows.select("query_id", "text")), "query_id"))
    hits = cut_lineage(hybrid_search(asked, chunks, limit, models))
    return question_contexts(questions, hits, chunks), hits


def retrieval_diagnostics(hits: DataFrame, chunks: DataFrame, excerpt: int = 400) -> DataFrame:
    """Flat report of hits: ranks, scores, mode, reason and an excerpt of the chunk."""
    texts = chunks.select("chunk_id", F.substring("text", 1, excerpt).alias("excerpt"))
    columns = ("dense_rank", "lexical_rank", "similarity", "lexical", "fusion", "rerank", "mode", "reranker_error", "matched_terms", "exact", "selected", "reason", "position")
    return hits.join(texts, "chunk_id").select(*KEY, *[c for c in columns if c in hits.columns], "excerpt")
