"""Entity match, channel ranks, fusion, cutoffs, reject reasons and diversification.

Hits are keyed (query_id, chunk_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.text import contains_name, retrieval_tokens
from lodestone.operators.entities import names_met
from lodestone.operators.scans import row_numbers, top_rows
from lodestone.session import cut_lineage, merged, sized

KEY = ["query_id", "chunk_id"]
DENSE_WINDOW, LEXICAL_WINDOW, DEFAULT_LIMIT = 60, 40, 8
WHOLE = 2048
FLOOR, GAP = 0.25, 0.15
SEMANTIC_FLOOR, SEMANTIC_GAP = -2.5, 2.0
SEMANTIC_MODE = "cross_encoder:"


def named_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name_key): names that occur whole in a question."""
    known = names.select("name").distinct().select("name", F.lower("name").alias("name_key"))
    return names_met(queries.select("query_id", "text"), ["query_id"], "text", known, joined_only=False).select("query_id", "name_key").distinct()


def exact_entity_match(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, exact, in_text): chunks of an entity that the question names.

    chunks: chunk_id, text, family_names. in_text tells whether the chunk text also names it.
    """
    owned = chunks.select("chunk_id", "text", F.explode("family_names").alias("name"))
    named = named_entities(queries, owned)
    spelled = owned.select("name").distinct().select(F.lower("name").alias("name_key"), "name").groupBy("name_key").agg(F.min("name").alias("_name"))
    hits = owned.withColumn("name_key", F.lower("name")).join(named, "name_key")
    exact = hits.select("query_id", "chunk_id").distinct()
    asked = named.join(spelled, "name_key").groupBy("query_id").agg(F.array_sort(F.collect_set("_name")).alias("_asked"))
    # Many questions ask for the same names, so a text is searched once for each set of names and not for each question.
    sets = exact.join(asked, "query_id")
    searched = sets.select("chunk_id", "_asked").distinct().join(chunks.select("chunk_id", "text"), "chunk_id")
    found = searched.select("chunk_id", "_asked", F.exists("_asked", lambda n: contains_name(F.col("text"), n)).alias("in_text"))
    return sets.join(merged(found), ["chunk_id", "_asked"]).select("query_id", "chunk_id", F.lit(True).alias("exact"), "in_text")


def lexical_ranks(lexical: DataFrame) -> DataFrame:
    """Add lexical_rank over the positive scores of each question."""
    return row_numbers(lexical.filter("lexical > 0"), ["query_id"], F.col("lexical"), "chunk_id", "lexical_rank")


BUCKETS = 16


def ranked_words(lexical: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scores with lexical_rank, among all positive scores of a question, of its best LEXICAL_WINDOW and of the wanted pairs at least.

    lexical: a written table. Scores of a question lie in BUCKETS to a unit. Only buckets that hold a best or a wanted pair
    are ordered, behind the counted rows of the higher ones; a question with more than WHOLE wanted pairs is ordered whole.
    """
    rows = lexical.filter("lexical > 0").withColumn("_b", F.floor(F.col("lexical") * BUCKETS))
    sizes = cut_lineage(rows.groupBy("query_id", "_b").agg(F.count(F.lit(1)).alias("_n")))
    asked = cut_lineage(wanted.select(*KEY).distinct())
    many = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > WHOLE).select("query_id")
    few = asked.join(many, "query_id", "left_anti")
    before = Window.partitionBy("query_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    top = sizes.withColumn("_above", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_above") < LEXICAL_WINDOW).select("query_id", "_b")
    met = rows.join(sized(few), KEY, "left_semi").select("query_id", "_b")
    open_ = cut_lineage(top.unionByName(met).unionByName(sizes.join(many, "query_id", "left_semi").select("query_id", "_b")).distinct())
    skipped = sizes.join(open_.withColumn("_open", F.lit(True)), ["query_id", "_b"], "left").withColumn("_s", F.when(F.col("_open"), 0).otherwise(F.col("_n")))
    above = Window.partitionBy("query_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = cut_lineage(skipped.withColumn("_skipped", F.sum("_s").over(above)).filter("_open").select("query_id", "_b", "_skipped"))
    placed = row_numbers(rows.join(sized(ahead), ["query_id", "_b"]), ["query_id"], F.col("lexical"), "chunk_id", "_place")
    return placed.select(*KEY, "lexical", (F.col("_place") + F.col("_skipped")).alias("lexical_rank"))


def rank_channels(dense: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with dense_rank, and lexical and lexical_rank where words are shared (0 = none)."""
    joined = dense.join(merged(words.select(*KEY, "lexical", "lexical_rank")), KEY, "left")
    return joined.withColumns({"lexical": F.coalesce("lexical", F.lit(0.0)), "lexical_rank": F.coalesce("lexical_rank", F.lit(0))})


def rrf(dense_rank: Column, lexical_rank: Column, k: int = 60, digits: int = 9) -> Column:
    """Reciprocal rank fusion; lexical rank 0 adds nothing."""
    lexical = F.when(lexical_rank > 0, 1.0 / (k + lexical_rank)).otherwise(0.0)
    return F.round(1.0 / (k + dense_rank) + lexical, digits)


def candidates(ranked: DataFrame, exact: DataFrame, cards: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits of any channel: dense window, lexical window, exact entity, card recall."""
    flags = ranked.join(merged(exact.select(*KEY, "exact", "in_text")), KEY, "left")
    flags = flags.join(merged(cards.select(*KEY).withColumn("card", F.lit(True))), KEY, "left")
    flags = flags.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("exact", "in_text", "card")})
    kept = (
        (F.col("dense_rank") <= max(DENSE_WINDOW, limit or 0)) | F.col("lexical_rank").between(1, LEXICAL_WINDOW)
        | F.col("exact") | F.col("card")
    )
    return flags.filter(kept).withColumn("fusion", rrf(F.col("dense_rank"), F.col("lexical_rank")))


def matched_terms(hits: DataFrame, queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add matched_terms: the question's distinct terms that the chunk holds, in the order of the question.

    tokens: chunk_id, tokens (of text, section and names).
    """
    asked = queries.select("query_id", F.array_distinct(retrieval_tokens(F.col("text"))).alias("_asked"))
    rows = merged(hits).join(tokens.select("chunk_id", F.col("tokens").alias("_held")), "chunk_id", "left").join(sized(asked), "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("matched_terms", F.coalesce(F.array_intersect("_asked", "_held"), none)).drop("_asked", "_held")


def question_modes(hits: DataFrame, semantic: bool | None = None) -> DataFrame:
    """(query_id, exact_query, semantic): whether the question names an entity of a hit, and whether a model scored its hits.

    The mode of a question is that of its hits, unless ``semantic`` says it for all.
    """
    scored = F.col("mode").startswith(SEMANTIC_MODE) if "mode" in hits.columns else F.lit(False)
    flag = F.coalesce(F.max(scored), F.lit(False)) if semantic is None else F.lit(semantic)
    return hits.groupBy("query_id").agg(F.max("exact").alias("exact_query"), flag.alias("semantic"))


def gap_cutoff(hits: DataFrame, semantic: bool | None = None, semantic_floor: float = SEMANTIC_FLOOR) -> DataFrame:
    """(query_id, cutoff): the floor, or the score before the first wide gap among the top 20, by the question's mode.

    Hits of conflicting sources do not count, nor hits outside a named entity, nor (unless a model
    scored them) hits with a lexical score. hits: similarity, rerank, lexical, exact, conflict, mode.
    """
    modes = question_modes(hits, semantic)
    flagged = hits.select("query_id", "chunk_id", "similarity", "rerank", "lexical", "exact", "conflict").join(modes, "query_id")
    pool = flagged.filter(~F.col("conflict") & (~F.col("exact_query") | F.col("exact")) & (F.col("semantic") | (F.col("lexical") == 0)))
    score = F.when(F.col("semantic"), F.coalesce("rerank", F.lit(0.0))).otherwise(F.col("similarity"))
    top = top_rows(pool.select("query_id", "exact_query", "semantic", score.alias("_s"), "chunk_id"), ["query_id"], [F.desc("_s"), "chunk_id"], 20, "_i")
    before = F.lag("_s").over(Window.partitionBy("query_id").orderBy("_i"))
    wide = F.when(F.col("semantic"), SEMANTIC_GAP).otherwise(GAP)
    opened = F.when((F.col("_i") > F.when(F.col("exact_query"), 1).otherwise(3)) & (F.col("_b") - F.col("_s") > wide), F.col("_b"))
    gaps = top.withColumn("_b", before).groupBy("query_id").agg(F.max(opened).alias("_g"))
    floor = F.when(F.col("semantic"), float(semantic_floor)).otherwise(FLOOR)
    return modes.join(gaps, "query_id", "left").select("query_id", F.greatest(floor, F.coalesce("_g", floor)).alias("cutoff"))


def reject_reason(hits: DataFrame, cutoffs: DataFrame, semantic: bool | None = None) -> DataFrame:
    """Add reason: source_conflict, different_owner, threshold or null; a lexical score defies the threshold of similarity."""
    rows = hits.drop("reason").join(cutoffs, "query_id").join(question_modes(hits, semantic), "query_id")
    weak = F.when(F.col("semantic"), F.col("rerank") < F.col("cutoff")).otherwise((F.col("similarity") < F.col("cutoff")) & (F.col("lexical") <= 0))
    reason = (
        F.when(F.col("conflict"), "source_conflict").when(F.col("exact_query") & ~F.col("exact"), "different_owner")
        .when(weak, "threshold")
    )
    return rows.withColumn("reason", reason).drop("cutoff", "exact_query", "semantic")


def group_key(owner: Column, names: Column, section: Column) -> Column:
    """Owner, else the only entity name, else the section."""
    single = F.when(F.size(names) == 1, F.get(names, F.lit(0)))
    return F.coalesce(owner, single, F.concat(F.lit("general:"), section))


def diversify(hits: DataFrame, score: str = "rerank", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Add position and selected: one hit per group in turn, in the order groups first appear.

    Two rounds, or eight where the question names an entity. hits: group_key, exact, reason (null = eligible).
    """
    eligible = hits.filter("reason IS NULL").join(question_modes(hits, False), "query_id")
    rank = F.struct((-F.col(score)).alias("_s"), F.col("chunk_id").alias("_c"))
    slim = eligible.select(*KEY, "group_key", "exact_query", rank.alias("_r"))
    firsts = slim.groupBy("query_id", "group_key").agg(F.min("_r").alias("_first"))
    deep = top_rows(slim, ["query_id", "group_key"], ["_r"], 8, "_depth")
    deep = deep.filter((F.col("_depth") <= 2) | F.col("exact_query")).join(firsts, ["query_id", "group_key"])
    chosen = top_rows(deep, ["query_id"], ["_depth", "_first"], limit, "position").select(*KEY, "position")
    out = hits.join(chosen, KEY, "left")
    return out.withColumns({
        "selected": F.col("position").isNotNull(),
        "reason": F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("position").isNotNull(), "selected").otherwise("family_limit"),
    })
