"""Task state transitions and rate windows: ordered folds with few states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.folds import Fold, counted, segmented_fold
from lodestone.operators.scans import top_rows

# States and allowed edges.
STATES = ("PLANNING", "EXECUTION", "VALIDATION", "DONE")
EDGES = (("PLANNING", "EXECUTION"), ("EXECUTION", "VALIDATION"), ("VALIDATION", "DONE"), ("VALIDATION", "EXECUTION"))
_CODES = {name: i + 1 for i, name in enumerate(STATES)}
_ALLOWED = np.zeros((len(STATES) + 1, len(STATES) + 1), dtype=bool)
for _a, _b in EDGES:
    _ALLOWED[_CODES[_a], _CODES[_b]] = True
for _c in _CODES.values():
    _ALLOWED[_c, _c] = _ALLOWED[0, _c] = True
_NEEDS_PLAN = (_CODES["PLANNING"], _CODES["EXECUTION"])


def transition(state: int, target: int, confirmed: bool) -> tuple[int, bool]:
    """Stored state after a save, and whether the save was accepted. State 0 is a task not yet stored."""
    ok = bool(_ALLOWED[state, target]) and ((state, target) != _NEEDS_PLAN or bool(confirmed))
    return (target if ok else state), ok


def _sweep(states, target, confirmed):
    ok = _ALLOWED[states, target]
    if not confirmed and target == _NEEDS_PLAN[1]:
        ok = ok & (states != _NEEDS_PLAN[0])
    return np.where(ok, target, states)


def task_transitions(log: DataFrame, key: str = "task_id", order: str = "seq") -> DataFrame:
    """Accept or refuse every save against the stored state: add accepted.

    log: key, order, state, confirmed (the user confirmed the stored, unchanged, non-empty plan).
    """
    codes = F.create_map(*[F.lit(x) for name, code in _CODES.items() for x in (name, code)])
    rows = log.withColumns({"_code": F.coalesce(F.try_element_at(codes, F.col("state")), F.lit(0)), "_ok": F.coalesce("confirmed", F.lit(False))})
    fold = Fold(transition, _sweep, **counted(len(STATES)))
    return segmented_fold(rows, [key], [order], ["_code", "_ok"], fold, "accepted", "boolean").drop("_code", "_ok")


DAY = 86_400
_NEVER = -(1 << 60)


def _windows(width: int) -> Fold:
    """State: when the open window began. A window opens at the first second it does not cover."""

    def step(began, second):
        began = second if second - began >= width else began
        return began, began

    def sweep(began, second):
        return np.where(second - began >= width, second, began)

    def opening(first):
        return np.concatenate([[_NEVER], first - np.arange(1, width)]).astype("int64")

    def index(states, first):
        age = first - np.asarray(states)
        return np.where((age >= 1) & (age < width), age, 0)

    return Fold(step, sweep, opening, index)


def epoch_seconds(df: DataFrame, ts: str) -> Column:
    """Whole seconds since 1970; a timestamp without zone is taken as it stands, whatever the session zone."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        since = F.expr(f"CAST(`{ts}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND)")
        return F.floor(since.cast("decimal(20,6)")).cast("long")
    return F.unix_timestamp(F.date_trunc("second", F.col(ts)))


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int = 6, window: int = 60) -> DataFrame:
    """Add window_start, allowed and retry_after by windows that open at a key's first event.

    Events are first reduced to the distinct seconds of each key; the fold runs over those. ``window`` is at
    most a day; ``order`` tells events of one time apart.
    """
    if not 1 < window <= DAY:
        raise ValueError("window must be from 2 seconds to a day")
    rows = events.withColumn("_sec", epoch_seconds(events, ts))
    seconds = rows.groupBy(key, "_sec").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    opened = segmented_fold(seconds, [key], ["_sec"], ["_sec"], _windows(window), "window_start", "bigint")
    placed = rows.join(opened, [key, "_sec"])
    # Of a burst only the first rows are ranked, before the shuffle; all others compare themselves with the last of these.
    mark = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))
    first = top_rows(placed.select(key, "window_start", mark.alias("_m")), [key, "window_start"], ["_m"], limit, "_n")
    last = first.groupBy(key, "window_start").agg(F.max("_m").alias("_last"))
    out = placed.join(last, [key, "window_start"]).withColumn("allowed", mark <= F.col("_last")).drop("_last")
    retry = F.greatest(F.lit(1), F.lit(window) - (F.col("_sec") - F.col("window_start")))
    return out.withColumn("retry_after", F.when(~F.col("allowed"), retry)).drop("_sec")
