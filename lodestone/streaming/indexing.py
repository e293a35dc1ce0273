"""Incremental index from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from lodestone.functions.text import stable_id
from lodestone.functions.vectors import hashing_vectors
from lodestone.operators.chunking import fixed_windows

VECTORS = "input_hash string, embedding array<float>, batch long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def index_batch(docs: DataFrame, batch: int, path: str, size: int = 600, overlap: int = 100) -> None:
    """Chunk one batch and encode inputs that no earlier batch has encoded.

    Every batch writes its own folder and overwrites it, so a replayed batch changes nothing. The ids of its documents
    are written too: a document that is sent again is known by its last batch, even where that has no chunks.
    """
    spark = docs.sparkSession
    chunks = fixed_windows(docs, ["doc_id"], "text", size, overlap)
    chunks = chunks.withColumns({
        "chunk_id": stable_id(F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("text")),
        "input_hash": F.sha2("text", 256)})
    docs.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch}")
    written = spark.read.parquet(f"{path}/chunks/batch={batch}")
    known = _stored(spark, f"{path}/vectors", VECTORS).filter(F.col("batch") != batch).select("input_hash").distinct()
    inputs = written.groupBy("input_hash").agg(F.any_value("text").alias("text")).join(known, "input_hash", "left_anti")
    hashing_vectors(inputs, "input_hash", F.col("text")).write.mode("overwrite").parquet(f"{path}/vectors/batch={batch}")


def index_stream(docs: DataFrame, path: str, **sizes: int):
    """Start the index stream over docs (doc_id, text); returns the query."""
    return (
        docs.writeStream.foreachBatch(lambda df, batch: index_batch(df, batch, path, **sizes))
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )


def stream_index(docs: DataFrame, path: str, **sizes: int) -> DataFrame:
    """Run the stream over all that is there and return the chunks of each document's last batch with their vectors."""
    index_stream(docs, path, **sizes).awaitTermination()
    spark = docs.sparkSession
    last = spark.read.parquet(f"{path}/docs").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    chunks = spark.read.parquet(f"{path}/chunks").join(last, ["doc_id", "batch"], "left_semi")
    vectors = _stored(spark, f"{path}/vectors", VECTORS).groupBy("input_hash").agg(F.any_value("embedding").alias("embedding"))
    return chunks.join(vectors, "input_hash", "left")
