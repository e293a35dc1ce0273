"""Queries that run streams over the driver tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.tasks import epoch_seconds
from lodestone.queries import dialogue as B
from lodestone.registry import ORACLE, query
from lodestone.session import scratch_path, table
from lodestone.streaming.common import drain, ordered_parts, table_stream
from lodestone.streaming.indexing import stream_index
from lodestone.streaming.stateful import chat_state_stream, latest_state, rate_limit_stream, task_stream


def _in_order(spark, df, order, build, name):
    """The output of a stream over a table in three parts, ascending by ``order``, so that keys carry state over micro-batches."""
    path = scratch_path(spark, "parts")
    df.limit(0).write.parquet(path)
    stream = build(spark.readStream.schema(df.schema).parquet(path))
    return drain(stream, name=name, parts=ordered_parts(df, order, path))


@query("rate_limit_stream", ORACLE["rate_limit"])
def rate_limit_query(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id")
    events = events.withColumn("_at", epoch_seconds(events, "ts"))
    out = _in_order(spark, events, "_at", lambda rows: rate_limit_stream(rows, "user_id", 1, B.WIDTH), "rate")
    return out.withColumnRenamed("key", "user_id").select("user_id", "event_id", "window_start", "allowed", "retry_after")


@query("task_stream", ORACLE["task_transitions"].replace("SELECT task_id, seq, state, confirmed,", "SELECT task_id, seq, state,"))
def task_stream_query(spark, d):
    orders = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "P", "PLANNING").when(F.col("o_orderstatus") == "F", "EXECUTION").otherwise(
        F.when(F.col("o_orderkey") % 3 == 0, "DONE").otherwise("VALIDATION"))
    saves = orders.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("seq"), state.alias("state"), (F.col("o_orderpriority") < "4").alias("confirmed"))
    return _in_order(spark, saves, "seq", task_stream, "tasks")


@query("chat_state_stream", ORACLE["chat_state"])
def chat_state_query(spark, d):
    out = latest_state(_in_order(spark, B.accepted_changes(spark, d), "turn", chat_state_stream, "chats"))
    return out.select("chat_id", "category", "value", "evidence", "turn")


@query("index_stream", "SELECT doc_id, \"window\", \"start\", \"end\", text, token_count, true AS encoded FROM (" + ORACLE["fixed_windows"] + ")")
def index_stream_query(spark, d):
    docs = table_stream(spark, f"{d}/documents.parquet").select("doc_id", "text")
    out = stream_index(docs, scratch_path(spark, "index"))
    return out.select("doc_id", "window", "start", "end", "text", "token_count", F.col("embedding").isNotNull().alias("encoded"))
