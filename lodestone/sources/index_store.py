"""Index tables: published as one consistent build, and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions.text import strip
from lodestone.functions.vectors import valid_vector

STRATEGIES = ("fixed", "structural")
PAIR_COLUMNS = ("build_id", "source", "content_hash", "model", "dims")


def write_index(tables: dict[str, DataFrame], path: str, build_id: str) -> None:
    """Write every table under its build, then one manifest row that makes the build visible.

    Readers go through the manifest, so a build that was not finished is never read.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/build_id={build_id}")
    spark = next(iter(tables.values())).sparkSession
    row = spark.range(1).select(
        F.lit(build_id).alias("build_id"), F.array(*[F.lit(n) for n in sorted(tables)]).alias("tables"), F.current_timestamp().alias("created_at"))
    row.write.mode("append").parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the latest published build."""
    manifest = spark.read.parquet(f"{path}/manifest")
    build = manifest.orderBy(F.desc("created_at"), F.desc("build_id")).select("build_id").first()[0]
    return spark.read.parquet(f"{path}/{name}/build_id={build}")


def _blank(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit("")) == ""


def check_index(chunks: DataFrame, strategy: str, source: str | None, model: str, dims: int) -> DataFrame:
    """(chunk_id, problem) for every broken rule. chunks: chunk_id, strategy, source, text, section,
    embedding_input, embedding_model, embedding."""
    rules = {
        "blank_id": _blank("chunk_id"),
        "wrong_strategy": ~F.col("strategy").eqNullSafe(F.lit(strategy)),
        "wrong_model": ~F.col("embedding_model").eqNullSafe(F.lit(model)),
        "blank_text": _blank("text"),
        "blank_section": _blank("section"),
        "blank_input": _blank("embedding_input"),
        "bad_vector": ~valid_vector(F.col("embedding"), dims),
    }
    if source is not None:
        rules["wrong_source"] = ~F.col("source").eqNullSafe(F.lit(source))
    problems = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda p: p.isNotNull())
    rows = chunks.select("chunk_id", F.explode(problems).alias("problem"))
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.unionByName(twice.select("chunk_id", F.lit("duplicate_id").alias("problem")))


def check_pair(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, differs): manifest rows of two strategies that do not belong together."""
    both = first.alias("a").join(second.alias("b"), keys, "full")
    names = [c for c in PAIR_COLUMNS if c in first.columns and c not in keys]
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in names]))
    return both.select(*keys, F.array_join(differs, ",").alias("differs")).filter("differs <> ''")
