"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and Arrow transfer on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan of few splits over the cores, for work that is heavy per row; large scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in TEXT_TABLES else scan


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the driver tables, registered as temporary views."""
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Where it is unset, a local session (driver and tasks on one machine) gets a temporary folder; a cluster is refused.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-ckpt-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back.

    Iterative jobs and shared intermediates survive lost executors, later reads prune columns, and the
    planner sees real sizes.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A side of a join, hinted by its counted rows: few are broadcast, more are merged.

    The planner guesses sizes from files and counts neither exploded rows nor built texts, so it may broadcast the wrong side.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def merged(df: DataFrame) -> DataFrame:
    """A side of a join with a row per pair of a question and a chunk: never broadcast.

    Written pairs are a byte or two a row on disk, so the planner takes millions of them for a small table.
    """
    return df.hint("merge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediates."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
