"""Queries over vectors and dense search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine, valid_vector
from lodestone.operators.dense import card_recall, dense_topk
from lodestone.registry import query
from lodestone.session import table

SIM = "round(greatest(-1, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) + 0"


def vectors(spark, d):
    return table(spark, d, "embeddings")


def sides(spark, d):
    rows = vectors(spark, d)
    return (rows.select(F.col("vec_id").alias("query_id"), "embedding"),
            rows.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("owner_id")))


@query("valid_vector", """SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
 AND vec_id % 7 <> 0 AS valid FROM embeddings""")
def valid_vector_query(spark, d):
    broken = F.when(F.col("vec_id") % 7 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return vectors(spark, d).select("vec_id", valid_vector(broken, 64).alias("valid"))


@query("cosine", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_query(spark, d):
    rows = vectors(spark, d)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


TOPK = f"""SELECT query_id, chunk_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {SIM} AS similarity FROM embeddings a, embeddings b)) WHERE rank <= 10"""


@query("dense_topk", TOPK)
def dense_topk_query(spark, d):
    return dense_topk(*sides(spark, d), 10)


@query("card_recall", f"""SELECT query_id, owner_id, chunk_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, owner_id ORDER BY similarity DESC, chunk_id) AS rn FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label AS owner_id, {SIM} AS similarity FROM embeddings a, embeddings b)) WHERE rn = 1) WHERE rank <= 20""")
def card_recall_query(spark, d):
    return card_recall(*sides(spark, d))
