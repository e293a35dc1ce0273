"""Corpus statistics, BM25 and the lexical second stage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.functions.text import retrieval_tokens
from lodestone.session import merged, sized

K1_PLUS = 2.2
PASSAGE, STRIDE = 128, 96
ASKED_TERMS = 100_000


def tokenize(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, tokens, length): the token table that statistics and scoring share."""
    rows = df.select(key, retrieval_tokens(text).alias("tokens"))
    return rows.withColumn("length", F.size("tokens"))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term): distinct terms of every question."""
    return queries.select("query_id", F.explode(F.array_distinct(retrieval_tokens(F.col(text)))).alias("term"))


def asked_tokens(tokens: DataFrame, terms: DataFrame, placed: bool = False) -> DataFrame:
    """A token table with the asked terms only, as search and ranking need no others; lengths stay those of whole texts.

    With ``placed`` the other tokens become nulls, so that places stay. More than ASKED_TERMS terms do not travel to the
    tasks; the tokens are then left whole.
    """
    found = terms.select("term").distinct().limit(ASKED_TERMS + 1).toArrow()["term"]
    if len(found) > ASKED_TERMS:
        return tokens
    wanted = pa.array(found.drop_null().to_pylist(), pa.string())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("tokens")
            field, held = batch.schema.field(at), batch.column(at)
            values = held.flatten()
            known = pc.is_in(values, value_set=wanted.cast(values.type))
            sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(sizes)]
            if placed:
                values = pc.if_else(known, values, pa.scalar(None, values.type))
            else:
                values = values.filter(known)
                ends = np.r_[0, np.cumsum(known.to_numpy(zero_copy_only=False))][ends]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=held.is_null() if held.null_count else None)
            yield batch.set_column(at, field, lists.cast(field.type))

    return tokens.mapInArrow(kept, T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.name == "tokens" else f.dataType) for f in tokens.schema]))


def corpus_stats(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, df, n_chunks, mean_length); the mean length is at least one."""
    seen = tokens.select(key, F.explode(F.array_distinct("tokens")).alias("term"))
    df = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumns({"n_chunks": _count(tokens), "mean_length": _mean(tokens)})


def _count(tokens: DataFrame) -> Column:
    return tokens.agg(F.count(F.lit(1)).alias("n")).scalar()


def _mean(tokens: DataFrame) -> Column:
    total = tokens.agg((F.sum(F.col("length").cast("long")) / F.count(F.lit(1))).alias("m"))
    return F.greatest(F.lit(1.0), total.scalar())


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(weight: Column, tf: Column, length: Column, mean: Column) -> Column:
    return weight * tf * K1_PLUS / (tf + 1.2 * (0.25 + 0.75 * length / mean))


def term_positions(tokens: DataFrame, terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, length, term, positions) of the wanted terms only; tokens of one chunk stay in one row group."""
    wanted = terms.select("term").distinct()
    rows = tokens.select(key, "length", F.posexplode("tokens").alias("pos", "term")).join(sized(wanted), "term", "left_semi")
    return rows.groupBy(key, "length", "term").agg(F.collect_list("pos").alias("positions"))


def bm25(terms: DataFrame, tokens: DataFrame, key: str = "chunk_id", digits: int = 6) -> DataFrame:
    """(query_id, key, lexical) for every pair with a shared term.

    Only wanted terms are counted. Tokens are dealt by chunk once; the (query, term) side is broadcast when its
    counted rows allow, and terms and pairs are then counted where the chunk lies, without a shuffle of their own.
    Otherwise the join on term is split by adaptive skew handling.
    """
    wanted = terms.select("term").distinct()
    dealt = tokens.select(key, "length", "tokens").repartition(key)
    rows = dealt.select(key, "length", F.explode("tokens").alias("term")).join(sized(wanted), "term", "left_semi")
    tf = rows.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi")
    df = df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, "term").withColumns({"_w": idf(_count(tokens), F.col("df")), "_mean": _mean(tokens)})
    hits = tf.join(sized(weighted.drop("df")), "term")
    part = term_score(F.col("_w"), F.col("tf"), F.col("length"), F.col("_mean"))
    scores = hits.groupBy("query_id", key).agg(F.round(F.sum(part), digits).alias("lexical"))
    return scores


def lexical_rerank(
    cands: DataFrame, terms: DataFrame, bodies: DataFrame, headings: DataFrame, digits: int = 8
) -> DataFrame:
    """Second stage over candidates (query_id, chunk_id, similarity): add rerank.

    ``bodies`` and ``headings`` are token tables of chunk text and of names with section. Statistics come
    from each question's own candidates; a long chunk counts by its best passage too.
    """
    positions = term_positions(bodies.join(merged(cands.select("chunk_id").distinct()), "chunk_id", "left_semi"), terms)
    counts = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_terms"))
    rows = merged(cands).join(bodies.select("chunk_id", "length"), "chunk_id")
    pool = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_pool"), F.greatest(F.lit(1.0), F.avg("length")).alias("_avg"))
    # Pairs meet the positions where the chunk lies; a row for every pair and asked term would be many times as much.
    asked = sized(terms)
    hits = merged(cands.select("query_id", "chunk_id")).join(positions, "chunk_id").join(asked, ["query_id", "term"])
    df = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_df"))
    weights = df.join(pool, "query_id").select("query_id", "term", idf(F.col("_pool"), F.col("_df")).alias("_w"), "_avg")
    hits = hits.join(weights, ["query_id", "term"])
    full = hits.groupBy("query_id", "chunk_id").agg(
        F.sum(term_score(F.col("_w"), F.size("positions"), F.col("length"), F.col("_avg"))).alias("_full"),
        F.count(F.lit(1)).alias("_covered"))
    # A position lies in at most two passages of PASSAGE tokens that start every STRIDE tokens.
    places = hits.withColumn("_pos", F.explode("positions")).withColumn("_p", F.explode(F.sequence(
        F.greatest(F.lit(0), F.ceil((F.col("_pos") - (PASSAGE - 1)) / STRIDE).cast("int")), F.floor(F.col("_pos") / STRIDE).cast("int"))))
    tf = places.groupBy("query_id", "chunk_id", "_p", "term", "_w", "_avg", "length").agg(F.count(F.lit(1)).alias("_tf"))
    size = F.least(F.lit(PASSAGE), F.col("length") - F.col("_p") * STRIDE)
    mean = F.least(F.lit(float(PASSAGE)), F.col("_avg"))
    passage = tf.groupBy("query_id", "chunk_id", "_p").agg(F.sum(term_score(F.col("_w"), F.col("_tf"), size, mean)).alias("_s"))
    best = passage.groupBy("query_id", "chunk_id").agg(F.max("_s").alias("_best"))
    titled = merged(cands.select("query_id", "chunk_id")).join(
        headings.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term")), "chunk_id").join(asked, ["query_id", "term"])
    titled = titled.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("_titled"))
    out = cands
    for part in (full, best, titled):
        out = out.join(part, ["query_id", "chunk_id"], "left")
    out = out.join(counts, "query_id", "left")
    zero = F.lit(0.0)
    whole = F.coalesce("_full", zero)
    lexical = 0.4 * whole + 0.6 * F.greatest(whole, F.coalesce("_best", zero))
    covered, title = F.coalesce("_covered", F.lit(0)) / F.col("_terms"), F.coalesce("_titled", F.lit(0)) / F.col("_terms")
    score = 0.30 * F.col("similarity") + 0.45 * lexical / (1 + lexical) + 0.15 * covered + 0.10 * title
    out = out.withColumn("rerank", F.round(F.when(F.col("_terms").isNull(), F.col("similarity")).otherwise(score), digits))
    return out.drop("_full", "_best", "_covered", "_titled", "_terms").withColumn("mode", F.lit("lexical_fallback"))
