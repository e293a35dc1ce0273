"""History windows, branches, chat state and call metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.messages import MAX_FACT
from lodestone.functions.text import strip
from lodestone.operators.scans import row_numbers, top_rows

LIST_CATEGORIES = ("clarifications", "constraints", "terms", "selections", "decisions")
MAX_ITEMS = 32


def last_n(messages: DataFrame, keys: list[str], order: str, n: int = 10) -> DataFrame:
    return top_rows(messages, keys, [F.desc(order)], n, "_back").drop("_back")


def sticky_facts(facts: DataFrame, messages: DataFrame, keys: list[str], order: str, n: int = 10) -> DataFrame:
    """Current value of every fact of a key, then its last n messages: (keys, part, name, content).

    facts: keys, name, value, at (orders the changes).
    """
    current = facts.groupBy(*keys, "name").agg(F.max_by("value", "at").alias("content")).withColumn("part", F.lit("fact"))
    recent = last_n(messages, keys, order, n).select(*keys, F.lit("message").alias("part"), F.col(order).cast("string").alias("name"), F.col("content"))
    return current.select(*keys, "part", "name", "content").unionByName(recent)


def branch_history(messages: DataFrame, branches: DataFrame, key: str, order: str) -> DataFrame:
    """History seen by every branch: the trunk up to its checkpoint, then its own messages.

    messages: key, branch (null = trunk), order. branches: key, name, checkpoint (last trunk order, inclusive).
    """
    trunk = messages.filter("branch IS NULL").drop("branch")
    base = trunk.join(branches, key).filter(F.col(order) <= F.col("checkpoint")).withColumn("own", F.lit(False))
    own = messages.filter("branch IS NOT NULL").withColumnRenamed("branch", "name").join(branches.select(key, "name"), [key, "name"], "left_semi")
    return base.drop("checkpoint").unionByName(own.withColumn("own", F.lit(True)))


def _newest_within(rows: DataFrame, keys: list[str], order: str, size: Column, limit: int, keep_one: bool) -> DataFrame:
    """Newest rows while their total stays within the limit; rows per key are few (a bounded tail)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"_total": F.sum(size).over(newest), "_back": F.count(F.lit(1)).over(newest)})
    fits = F.col("_total") <= limit
    return out.filter(fits | (F.col("_back") == 1) if keep_one else fits).drop("_total", "_back")


def compact_context(messages: DataFrame, keys: list[str], order: str, content: str, n: int = 4, limit: int = 1200) -> DataFrame:
    """Of the last n messages, the newest ones up to the first that does not fit."""
    return _newest_within(last_n(messages, keys, order, n), keys, order, F.length(content), limit, False)


def trim_history(turns: DataFrame, keys: list[str], order: str, size: str, n: int = 12, limit: int = 22000) -> DataFrame:
    """Of the last n turns, drop the oldest until the rest fits; one always stays."""
    return _newest_within(last_n(turns, keys, order, n), keys, order, F.col(size), limit, True)


def state_violations(changes: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_id, turn, seq, problem) for changes that void their turn.

    changes: chat_id, turn, seq, category, action, value, evidence. messages: chat_id, turn, content.
    """
    rows = changes.join(messages.select("chat_id", "turn", "content"), ["chat_id", "turn"], "left")
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    goal, listed = F.col("category") == "goal", F.col("category").isin(*LIST_CATEGORIES)
    problem = (
        F.when(blank("value") | (F.length("value") > MAX_FACT), "bad_value")
        .when(~F.coalesce(F.col("action").isin("add", "remove", "set"), F.lit(False)), "bad_action")
        .when(blank("evidence") | (F.length("evidence") > MAX_FACT) | ~F.coalesce(F.contains("content", "evidence"), F.lit(False)), "bad_evidence")
        .when(~F.coalesce((goal & (F.col("action") == "set")) | (listed & (F.col("action") != "set")), F.lit(False)), "bad_category")
    )
    return rows.select("chat_id", "turn", "seq", problem.alias("problem")).filter("problem IS NOT NULL")


def valid_changes(changes: DataFrame, violations: DataFrame) -> DataFrame:
    return changes.join(violations.select("chat_id", "turn").distinct(), ["chat_id", "turn"], "left_anti")





def chat_state(changes: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(chat_id, category, value, evidence, turn) after all changes of valid turns.

    A value is present with its first 'add' after its last 'remove'; the goal keeps the first of the last
    run of equal values. These are aggregates. Only chats with more distinct values in a list than the
    limit can ever be refused a turn; they alone run in order, as a stream with bounded state.
    """
    rows = changes.withColumns({"_v": strip(F.col("value")), "_at": F.struct("turn", "seq")}).withColumn("_k", F.lower("_v"))
    added = rows.filter("action = 'add'").select("chat_id", "category", "_k").distinct()
    long = added.groupBy("chat_id", "category").count().filter(F.col("count") > max_items).select("chat_id").distinct()
    short = rows.join(long, "chat_id", "left_anti")
    key = ["chat_id", "category", "_k"]
    lists = short.filter(F.col("category") != "goal")
    removed = lists.filter("action = 'remove'").groupBy(*key).agg(F.max("_at").alias("_off"))
    alive = lists.filter("action = 'add'").join(removed, key, "left").filter(F.col("_off").isNull() | (F.col("_at") > F.col("_off")))
    first = F.min_by(F.struct(F.col("_v").alias("value"), "evidence", "turn"), "_at").alias("_f")
    listed = alive.groupBy(*key).agg(first).select("chat_id", "category", "_f.*")
    goals = short.filter("category = 'goal'")
    last = goals.groupBy("chat_id").agg(F.max_by("_k", "_at").alias("_last"))
    other = goals.join(last, "chat_id").filter("_k <> _last").groupBy("chat_id").agg(F.max("_at").alias("_off"))
    run = goals.join(last, "chat_id").filter("_k = _last").join(other, "chat_id", "left").filter(F.col("_off").isNull() | (F.col("_at") > F.col("_off")))
    goal = run.groupBy("chat_id", "category").agg(first).select("chat_id", "category", "_f.*")
    return listed.unionByName(goal).unionByName(_ordered_state(changes.join(long, "chat_id", "left_semi"), max_items))


def apply_turn(state: dict, changes: list[tuple], turn: int, max_items: int) -> dict | None:
    """State after one turn's (category, action, value, evidence) changes, or None if a list overflows."""
    new = {c: dict(v) for c, v in state.items()}
    for category, action, value, evidence in changes:
        value = value.strip()
        key, items = value.lower(), new.setdefault(category, {})
        if category == "goal":
            if key not in items:
                new[category] = {key: (value, evidence, turn)}
        elif action == "add":
            items.setdefault(key, (value, evidence, turn))
        else:
            items.pop(key, None)
        if category != "goal" and len(items) > max_items:
            return None
    return new


def _ordered_state(changes: DataFrame, max_items: int) -> DataFrame:
    types = dict(changes.dtypes)
    schema = f"chat_id {types['chat_id']}, category string, value string, evidence string, turn {types['turn']}"
    columns = ["category", "action", "value", "evidence"]
    placed = changes.repartition("chat_id").sortWithinPartitions("chat_id", "turn", "seq").select("chat_id", "turn", *columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, turn, pending, state = None, None, [], {}

        def close() -> None:
            nonlocal state, pending
            if pending:
                state = apply_turn(state, pending, turn, max_items) or state
            pending = []

        def rows() -> pd.DataFrame:
            flat = [(chat, c, *fact) for c, items in state.items() for fact in items.values()]
            return pd.DataFrame(flat, columns=["chat_id", "category", "value", "evidence", "turn"])

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if row.chat_id != chat or row.turn != turn:
                    close()
                    if row.chat_id != chat:
                        if state:
                            yield rows()
                        chat, state = row.chat_id, {}
                    turn = row.turn
                pending.append((row.category, row.action, row.value, row.evidence))
        close()
        if state:
            yield rows()

    return placed.mapInPandas(run, schema)


def turn_gaps(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Turns whose number is not their place (1, 2, …) within the key: add expected."""
    ranked = row_numbers(turns, keys, -F.col(order), order, "expected")
    return ranked.filter(F.col(order) != F.col("expected"))


def token_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("attempts"))


STAGE_LINE = {"request": r"request=(\d+)", "stage": r"stage=(\S+)", "elapsed_ms": r"elapsed_ms=(\d+)", "status": r"status=(\S+)"}


def stage_metrics(lines: DataFrame, line: str = "line") -> DataFrame:
    """Counts, failures and durations per stage of 'stage= elapsed_ms= status=' lines."""
    parsed = lines.select(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")).alias(n) for n, p in STAGE_LINE.items()])
    done = parsed.filter("stage IS NOT NULL AND elapsed_ms IS NOT NULL").withColumn("elapsed_ms", F.col("elapsed_ms").cast("long"))
    failed = F.col("status").isNotNull() & ~F.col("status").isin("ok", "200")
    return done.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.when(failed, 1).otherwise(0)).alias("failures"), F.sum("elapsed_ms").alias("total_ms"),
        F.max("elapsed_ms").alias("max_ms"), F.percentile("elapsed_ms", 0.95).alias("p95_ms"))
