"""Running a stateful stream to the end of what is there, into a table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.session import cut_lineage, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(stream: DataFrame, mode: str = "append", name: str = "stream", parts: Iterable = (None,)) -> DataFrame:
    """Process all available input; the output is a parquet table with exactly-once commits.

    ``parts`` lays more input down while it is walked: the stream runs to the end of what is there after each of them.
    """
    spark = stream.sparkSession
    use_rocksdb(spark)
    path = scratch_path(spark, name)
    for _ in parts:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def ordered_parts(df: DataFrame, order: str, path: str, parts: int = 3) -> Iterator[int]:
    """Write a table part by part, ascending by a numeric column, for a stream that reads each part before the next is written.

    A part is one job with as many files as it needs, and one micro-batch: rows of a part cannot be late to its own
    watermark. Rows of equal ``order`` stay in one part.
    """
    df = cut_lineage(df)
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)))
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = df if low is None else df.filter(F.col(order) > low)
        part = part if high is None else part.filter(F.col(order) <= high)
        part.write.mode("append").parquet(path)
        yield i


def file_stream(spark: SparkSession, path: str, glob: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over parquet files of one folder, with the schema of what lies there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def table_stream(spark: SparkSession, path: str, parts: int = 3) -> DataFrame:
    """A parquet table as a stream of about ``parts`` micro-batches, be it one file or a folder of files."""
    table = spark.read.parquet(path)
    files = max(1, -(-len(table.inputFiles()) // parts))
    # A path that is a file must be a pattern: else the source takes it for the folder of its partitions.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(pattern)
