"""Keyed state machines over streams: rate windows, task saves and chat state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from lodestone.operators.dialogue import MAX_ITEMS, apply_turn
from lodestone.operators.tasks import STATES, epoch_seconds, transition
from lodestone.session import sized


BUCKETS = 4096


class _RateWindows(StatefulProcessor):
    """Windows of a bucket of keys: a call, a frame, a timer and a state row serve many keys, since each costs milliseconds."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "json string")

    def _opened(self) -> dict:
        return {k: (began, used) for k, began, used in json.loads(self.open.get()[0])} if self.open.exists() else {}

    def _keep(self, opened: dict, timerValues) -> None:
        # A row that is not late is at least a window newer than a closed one, so it would open a new one anyway.
        now = timerValues.getCurrentWatermarkInMs()
        left = [(k, began, used) for k, (began, used) in opened.items() if (began + self.window) * 1000 > now]
        if left:
            self.open.update((json.dumps(left),))
            self.handle.registerTimer((min(began for _, began, _ in left) + self.window) * 1000)
        elif self.open.exists():
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened = self._opened()
        pdf = pd.concat(list(rows)).sort_values(["ts", "missing", "event_id"])
        out = []
        for name, second in zip(pdf["key"].tolist(), pdf["second"].tolist()):
            began, used = opened.get(name, (None, 0))
            if began is None or second - began >= self.window:
                began, used = int(second), 0
            allowed = used < self.limit
            opened[name] = began, used + allowed
            out.append((began, allowed, None if allowed else max(1, self.window - (int(second) - began))))
        self._keep(opened, timerValues)
        frame = pd.DataFrame(out, columns=["window_start", "allowed", "retry_after"], index=pdf.index).astype({"retry_after": "Int64"})
        for name in ("missing", "event_id", "key"):
            frame.insert(0, name, pdf[name])
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._opened(), timerValues)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


READ, DECIDED = "rate_rows_read", "rate_rows_decided"


def rate_limit_stream(events: DataFrame, key: str, limit: int = 6, window: int = 60, buckets: int = BUCKETS) -> DataFrame:
    """Rate windows over event time: events (key, ts, event_id) sorted within a micro-batch, later rows dropped.

    The watermark trails by one window; closed windows leave the state with the next rows or by timer. State is kept per
    bucket of keys, so ``buckets`` is fixed for the life of a checkpoint.
    The observed metrics READ and DECIDED count rows on both sides; their difference is the number of late rows.
    """
    types = {f.name: f.dataType for f in events.schema.fields}
    # Keys go by their text, and numbers without nulls: pandas would make floats of whole numbers beside a null.
    whole = isinstance(types["event_id"], T.IntegralType)
    rows = events.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("key"), "ts",
        (F.coalesce("event_id", F.lit(0).cast(types["event_id"])) if whole else F.col("event_id")).alias("event_id"),
        F.isnull("event_id").alias("missing"), epoch_seconds(events, "ts").alias("second"))
    rows = rows.withColumn("at", F.timestamp_seconds("second")).observe(READ, F.count(F.lit(1)).alias("n"))
    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("event_id", types["event_id"]), T.StructField("missing", T.BooleanType()),
        T.StructField("window_start", T.LongType()), T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.LongType())])
    decided = (
        rows.withWatermark("at", f"{window} seconds").groupBy("bucket")
        .transformWithStateInPandas(_RateWindows(limit, window), schema, "append", "EventTime")
    )
    decided = decided.select(
        F.col("key").cast(types[key]).alias("key"), F.when(~F.col("missing"), F.col("event_id")).alias("event_id"), "window_start", "allowed", "retry_after")
    return decided.observe(DECIDED, F.count(F.lit(1)).alias("n"))


def late_rows(events: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """The events that came too late to be decided: the side table of a rate limit stream. event_id is unique per key."""
    done = decided.select(F.col("key").alias("_key"), F.col("event_id").alias("_event"))
    return events.join(done, F.col(key).eqNullSafe(F.col("_key")) & F.col("event_id").eqNullSafe(F.col("_event")), "left_anti")


class LateCount(StreamingQueryListener):
    """Adds up the late rows of rate limit streams over all their micro-batches."""

    def __init__(self):
        self.read = self.decided = 0

    @property
    def late(self) -> int:
        return self.read - self.decided

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics
        self.read += seen[READ].n if READ in seen else 0
        self.decided += seen[DECIDED].n if DECIDED in seen else 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class _TaskSaves(StatefulProcessor):
    """Saves of a bucket of tasks: a call, a frame and a state row serve many tasks, since each of them costs milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        codes = dict(json.loads(self.state.get()[0])) if self.state.exists() else {}
        pdf = pd.concat(list(rows)).sort_values(["missing", "seq"])
        accepted = []
        for task, name, confirmed in zip(pdf["task"].tolist(), pdf["state"].tolist(), pdf["confirmed"].tolist()):
            codes[task], ok = transition(codes.get(task, 0), STATES.index(name) + 1, confirmed)
            accepted.append(ok)
        self.state.update((json.dumps(list(codes.items())),))
        yield pdf[["task", "seq", "missing", "state"]].assign(accepted=accepted)

    def close(self) -> None:
        pass


def task_stream(saves: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Accept or refuse task saves against stored state: task_id, seq, state, confirmed.

    State is kept per bucket of task ids, so ``buckets`` is fixed for the life of a checkpoint.
    """
    types = {f.name: f.dataType for f in saves.schema.fields}
    # Tasks go by their text, and numbers without nulls: pandas would make floats of whole numbers beside a null.
    whole = isinstance(types["seq"], T.IntegralType)
    rows = saves.select(
        F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("bucket"), F.col("task_id").cast("string").alias("task"),
        (F.coalesce("seq", F.lit(0).cast(types["seq"])) if whole else F.col("seq")).alias("seq"), F.isnull("seq").alias("missing"), "state", "confirmed")
    schema = T.StructType([
        T.StructField("task", T.StringType()), T.StructField("seq", types["seq"]), T.StructField("missing", T.BooleanType()),
        T.StructField("state", T.StringType()), T.StructField("accepted", T.BooleanType())])
    done = rows.groupBy("bucket").transformWithStateInPandas(_TaskSaves(), schema, "append", "None")
    return done.select(F.col("task").cast(types["task_id"]).alias("task_id"), F.when(~F.col("missing"), F.col("seq")).alias("seq"), "state", "accepted")


TURNS = 4096


class _ChatState(StatefulProcessor):
    def __init__(self, max_items: int):
        self.max_items = max_items

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = json.loads(self.state.get()[0]) if self.state.exists() else {}
        state = {c: {k: tuple(fact) for k, fact in items.items()} for c, items in stored.items()}
        pdf = pd.concat(list(rows)).dropna(subset="turn").sort_values(["turn", "seq"])
        lines = zip(pdf["turn"].tolist(), *[pdf[c].tolist() for c in ("category", "action", "value", "evidence")])
        shown, out = {}, []
        for turn, group in groupby(lines, key=lambda line: line[0]):
            new = apply_turn(state, [line[1:] for line in group], int(turn), self.max_items)
            state = state if new is None else new
            facts = [(c, *fact) for c, items in state.items() for fact in items.values()]
            # A fact lives for many turns and is put into JSON once.
            for fact in facts:
                if fact not in shown:
                    shown[fact] = json.dumps(fact, ensure_ascii=False)
            out.append((key[0], int(turn), new is not None, f"[{', '.join([shown[fact] for fact in facts])}]"))
            if len(out) == TURNS:
                yield self._frame(out)
                shown, out = {}, []
        self.state.update((json.dumps(state, ensure_ascii=False),))
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["chat_id", "turn", "accepted", "state"])

    def close(self) -> None:
        pass


def chat_state_stream(changes: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(chat_id, turn, accepted, state): the state after every turn, as a JSON array of facts.

    changes: chat_id, turn, seq, category, action, value, evidence of valid turns; a turn arrives whole.
    """
    types = {f.name: f.dataType for f in changes.schema.fields}
    schema = T.StructType([
        T.StructField("chat_id", types["chat_id"]), T.StructField("turn", T.LongType()), T.StructField("accepted", T.BooleanType()),
        T.StructField("state", T.StringType())])
    return changes.groupBy("chat_id").transformWithStateInPandas(_ChatState(max_items), schema, "append", "None")


def latest_state(states: DataFrame) -> DataFrame:
    """(chat_id, category, value, evidence, turn) of every chat's last turn."""
    # Only the states of last turns are read and grouped; there is one for every turn.
    ends = states.groupBy(F.col("chat_id").alias("_chat")).agg(F.max("turn").alias("_end"))
    own = F.col("chat_id").eqNullSafe(F.col("_chat")) & (F.col("turn") == F.col("_end"))
    last = states.join(sized(ends), own, "left_semi").groupBy("chat_id").agg(F.max_by("state", "turn").alias("state"))
    facts = F.explode(F.from_json("state", "array<array<string>>")).alias("f")
    return last.select("chat_id", facts).select(
        "chat_id", F.get("f", F.lit(0)).alias("category"), F.get("f", F.lit(1)).alias("value"), F.get("f", F.lit(2)).alias("evidence"),
        F.get("f", F.lit(3)).cast("long").alias("turn"))
