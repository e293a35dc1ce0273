"""Ordered running values and row numbers, one way for every size.

A plain window over (key, order) puts a whole key into one task. Here rows are range-partitioned by (key, order) and
written once, so that segments are balanced by rows whatever the keys and orders are, and a key of any size is spread.
Every segment is scanned on its own; one summary row per key and segment (no key has more of them than there are
partitions) is scanned per key; the two are joined on key and segment. Keys, orders and scores may be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import cut_lineage


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows as a written table with ``_seg``, the number of their range of (keys, order)."""
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_seg", F.spark_partition_id().cast("long")))


def join_segments(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys and segment, null keys included."""
    named = parts.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, "_seg") else F.col(c) for c in parts.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_seg") == F.col("_r__seg")]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return rows.join(named, on, "left").drop("_r__seg", *[f"_r_{k}" for k in keys])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add inclusive running values; kinds: sum, count, max, min, last (last non-null)."""
    df = ranged(df, keys, order)
    local = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    inner, total, prefix, merged = {}, [], [], {}
    for name, (kind, value) in values.items():
        own, seg, before = F.col(f"_own_{name}"), f"_tot_{name}", F.col(f"_pre_{name}")
        if kind in ("sum", "count"):
            part = F.sum(value) if kind == "sum" else F.count(value)
            inner[f"_own_{name}"] = part.over(local)
            total.append(part.alias(seg))
            prefix.append(F.sum(seg).over(across).alias(f"_pre_{name}"))
            merged[name] = F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0)))
        elif kind in ("max", "min"):
            agg, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            inner[f"_own_{name}"] = agg(value).over(local)
            total.append(agg(value).alias(seg))
            prefix.append(agg(seg).over(across).alias(f"_pre_{name}"))
            merged[name] = pick(own, before)
        elif kind == "last":
            inner[f"_own_{name}"] = F.last(value, ignorenulls=True).over(local)
            latest = F.max(F.when(value.isNotNull(), F.struct(*[F.col(o) for o in order], value.alias("_v"))))
            total.append(latest.getField("_v").alias(seg))
            prefix.append(F.last(seg, ignorenulls=True).over(across).alias(f"_pre_{name}"))
            merged[name] = F.coalesce(own, before)
        else:
            raise ValueError(kind)
    carried = df.groupBy(*keys, "_seg").agg(*total).select(*keys, "_seg", *prefix)
    out = join_segments(df.withColumns(inner), carried, keys).withColumns(merged)
    return out.drop("_seg", *[f"_own_{n}" for n in values], *[f"_pre_{n}" for n in values])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add the given values of the preceding row of the same key (null on the first row)."""
    df = ranged(df, keys, order)
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    local = Window.partitionBy(*keys, "_seg").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_seg")
    ends = (
        df.groupBy(*keys, "_seg")
        .agg(F.max_by(row, F.struct(*order)).alias("_end"))
        .select(*keys, "_seg", F.lag("_end").over(across).alias("_before"))
    )
    out = join_segments(df.withColumn("_lag", F.lag(row).over(local)), ends, keys)
    prior = F.coalesce("_lag", "_before")
    return out.withColumns({n: prior.getField(n) for n in values}).drop("_seg", "_lag", "_before")


def row_numbers(df: DataFrame, keys: Sequence[str], score: Column, tie: str, name: str) -> DataFrame:
    """Exact row number per key by (score desc, tie asc), for ties of any type: the place in its segment, behind the
    rows of the key's earlier segments."""
    df = ranged(df.withColumn("_score", score), keys, [F.desc("_score"), F.asc(tie)])
    across = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(F.desc("_score"), tie))
    joined = join_segments(df.withColumn("_rn", within), sizes, keys)
    return joined.withColumn(name, (F.col("_ahead") + F.col("_rn")).cast("long")).drop("_score", "_seg", "_ahead", "_rn")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key; the limit is applied before the shuffle (window group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by order, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
