"""Ordered folds with a small state, cut into segments so that no key lands in one task whole.

A fold whose state takes few values is a table from entry state to exit state for every segment. Rows are
range-partitioned by (key, order), so a key of any size is spread evenly. The tables of a key with several segments are
composed in two levels (blocks of segments, then segments of a block), and every segment is folded on its own from
its known entry state. Keys that lie in one segment need the last step only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators.scans import join_segments, ranged

BLOCK = 64


@dataclass(frozen=True)
class Fold:
    """A state machine over rows.

    ``step(state, *inputs) -> (state, output)`` runs row by row; ``sweep(states, *inputs)`` advances a whole array of
    states. ``opening(first)`` lists the states in which a segment can start whose first row has that order value
    (index 0 is the initial one), and ``index(states, first)`` gives the places of states in that list.
    """

    step: Callable
    sweep: Callable
    opening: Callable[[object], np.ndarray]
    index: Callable[[np.ndarray, object], np.ndarray]


def counted(top: int) -> dict[str, Callable]:
    """Opening and index of a fold whose states are the numbers 0 .. top."""
    return {"opening": lambda first: np.arange(top + 1), "index": lambda states, first: np.asarray(states)}


def segmented_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], fold: Fold, output: str, output_type: str,
) -> DataFrame:
    """Fold every key in order. The first column of ``order`` is what ``Fold.opening`` gets."""
    df = ranged(df, keys, order)
    portion = [*keys, "_seg"]
    parts = df.groupBy(*portion).agg(F.min(F.struct(*order))[order[0]].alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_seg")
    parts = parts.withColumns({"_next": F.lead("_seg").over(later), "_before": F.lag("_seg").over(later)})
    spanning = parts.filter("_next IS NOT NULL OR _before IS NOT NULL").select(*portion, "_first", F.floor(F.col("_seg") / BLOCK).alias("_block"))
    typed = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key_types = ", ".join(f"`{k}` {typed[k]}" for k in keys)
    first_type = typed[order[0]]

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        states = fold.opening(pdf["_first"].iloc[0])
        for row in pdf.sort_values(list(order))[list(inputs)].itertuples(index=False):
            states = fold.sweep(states, *row)
        return pdf.iloc[:1][[*portion, "_block", "_first"]].reset_index(drop=True).assign(_exits=[np.asarray(states, np.int64)])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_seg"), None
        for first, exits in zip(pdf["_first"], pdf["_exits"]):
            out = exits if out is None else np.asarray(exits)[fold.index(out, first)]
        return pdf.iloc[:1][[*keys, "_block", "_first"]].assign(_exits=[np.asarray(out, np.int64)])

    def entries(place: str) -> Callable:
        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, state, out = pdf.sort_values(place), None, []
            start = int(pdf["_index"].iloc[0]) if "_index" in pdf else 0
            for first, exits in zip(pdf["_first"], pdf["_exits"]):
                entry = start if state is None else int(fold.index(np.array([state]), first)[0])
                out.append(entry)
                state = exits[entry]
            return pdf[[*keys, place]].assign(_index=out)

        return scan

    exits = join_segments(df.select(*portion, *[c for c in {*order, *inputs} if c not in portion]), spanning, keys).filter("_block IS NOT NULL")
    exits = exits.groupBy(*portion).applyInPandas(tables, f"{key_types}, _seg long, _block long, _first {first_type}, _exits array<bigint>")
    blocks = exits.groupBy(*keys, "_block").applyInPandas(product, f"{key_types}, _block long, _first {first_type}, _exits array<bigint>")
    opened = blocks.groupBy(*keys).applyInPandas(entries("_block"), f"{key_types}, _block long, _index long")
    opened = opened.withColumnRenamed("_block", "_seg")
    placed = join_segments(exits.withColumnsRenamed({"_seg": "_own", "_block": "_seg"}), opened, keys).withColumnsRenamed({"_seg": "_block", "_own": "_seg"})
    starts = placed.groupBy(*keys, "_block").applyInPandas(entries("_seg"), f"{key_types}, _seg long, _index long")
    return _folded(join_segments(df, starts, keys), keys, order, inputs, fold, output, output_type)


def _folded(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], fold: Fold, output: str, output_type: str
) -> DataFrame:
    """Run the fold over (keys, _seg) portions in partition order, from their entry states."""
    portion = [*keys, "_seg"]
    placed = df.repartition(*portion).sortWithinPartitions(*portion, *order)
    kept = [f for f in placed.schema.fields if f.name != "_index"]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{output}` {output_type}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            marks = list(zip(*[[None if pd.isna(v) else v for v in pdf[c]] for c in portion]))
            index = pdf["_index"].to_numpy(dtype="float64", na_value=np.nan)
            firsts = pdf[order[0]].to_numpy()
            for i, row in enumerate(zip(*[pdf[c] for c in inputs])):
                if marks[i] != current:
                    current = marks[i]
                    state = fold.opening(firsts[i])[0 if np.isnan(index[i]) else int(index[i])]
                state, value = fold.step(state, *row)
                out.append(value)
            result = pdf[names].copy()
            result[output] = out
            yield result

    return placed.mapInPandas(run, schema).drop("_seg")
