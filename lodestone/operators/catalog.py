"""Catalog matching by agreement on attributes, without comparing all pairs.

Items that agree on a set of attributes share a key. For every set of attributes the smallest ids of
each key are enough to find an item's best partners, so the work is linear in items times sets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators.scans import top_rows


def _patterns(weights: dict[str, float]) -> list[tuple[tuple[str, ...], float]]:
    """Non-empty attribute sets with their weight, heaviest first."""
    sets = [c for n in range(1, len(weights) + 1) for c in combinations(weights, n)]
    return sorted(((s, round(sum(weights[a] for a in s), 6)) for s in sets), key=lambda p: (-p[1], p[0]))


def _leaders(items: DataFrame, key: str, attributes: tuple[str, ...], k: int) -> DataFrame:
    """The k smallest ids per combination of attribute values, combined map-side."""
    known = items.select(key, *attributes).dropna(subset=list(attributes))
    return top_rows(known, list(attributes), [key], k, "_n")


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add score, matches, differences and missing of pairs, from both rows of a pair once.

    left, right: the pairs' key column each and a struct of attributes (_s, _i). What either row does not show is
    missing and never equal.
    """
    rows = pairs.join(left, left.columns[0]).join(right, right.columns[0])
    score, matches, differs, missing = F.lit(0.0), [], [], []
    for name, weight in weights.items():
        a, b = F.col(f"_s.{name}"), F.col(f"_i.{name}")
        score = score + F.when(a == b, weight).otherwise(0.0)
        matches.append(F.when(a == b, F.lit(name)))
        differs.append(F.when(a != b, F.lit(name)))
        missing.append(F.when(a.isNull() | b.isNull(), F.lit(name)))
    listed = {n: F.array_join(F.array_compact(F.array(*v)), ",") for n, v in (("matches", matches), ("differences", differs), ("missing", missing))}
    return rows.withColumns({"score": F.round(score, 6), **listed})


def catalog_pairs(items: DataFrame, key: str, weights: dict[str, float], required: list[str]) -> DataFrame:
    """(key, partner, score, vetoed, matches, differences, missing): one row per pair of an item and a near partner.

    Partners of an item are, for every set of attributes that it agrees on with others, the one of the smallest id, and
    the one of the smallest id among those that hide the required attributes which the item shows beyond the set; so the
    best partner of all and the best one that is not vetoed are among them. Score, veto and lists come from both rows of the pair: a pair that
    differs in a required attribute is vetoed whatever its score; what either item does not show is missing, neither
    equal nor different.
    """
    rows, near = items.select(key, *weights), None
    for attributes, _ in _patterns(weights):
        two = _leaders(items, key, attributes, 2).withColumnRenamed(key, "_id")
        two = two.groupBy(*attributes).agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).filter("_a < _b")
        # Matching items find their key in a table with one row per key.
        found = [rows.join(two, list(attributes)).select(key, F.when(F.col(key) == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("partner"))]
        # Not vetoed are partners that do not show the required attributes which the item shows beyond this set.
        beyond = [a for a in required if a not in attributes]
        for n in range(1, len(beyond) + 1):
            for shown in combinations(beyond, n):
                hiding = items.dropna(subset=list(attributes))
                asking = rows
                for a in beyond:
                    asking = asking.filter(F.col(a).isNotNull() if a in shown else F.col(a).isNull())
                for a in shown:
                    hiding = hiding.filter(F.col(a).isNull())
                few = hiding.groupBy(*attributes).agg(F.min(key).alias("partner"))
                found.append(asking.join(few, list(attributes)).select(key, "partner"))
        for part in found:
            near = part if near is None else near.unionByName(part)
    left = items.select(key, F.struct(*weights).alias("_s"))
    right = items.select(F.col(key).alias("partner"), F.struct(*weights).alias("_i"))
    out = _compared(near.distinct(), left, right, weights)
    vetoed = F.lit(False)
    for a in required:
        vetoed = vetoed | F.coalesce(F.col(f"_s.{a}") != F.col(f"_i.{a}"), F.lit(False))
    return out.select(key, "partner", "score", vetoed.alias("vetoed"), "matches", "differences", "missing")


def unify_recommend(pairs: DataFrame, key: str) -> DataFrame:
    """Best partner per item that is not vetoed (score, then id), with the agreeing attributes as reason."""
    best = pairs.filter("NOT vetoed").groupBy(key).agg(
        F.min_by(F.struct("partner", "score", "matches", "missing"), F.struct(-F.col("score"), F.col("partner"))).alias("_b"))
    return best.select(key, "_b.partner", "_b.score", F.col("_b.matches").alias("reason"), "_b.missing")


def spec_topk(specs: DataFrame, items: DataFrame, spec_key: str, item_key: str, weights: dict[str, float], k: int = 3) -> DataFrame:
    """Top items per specification by weight of agreeing attributes, then id: matches, differences, missing.

    Exact: an item outside the k smallest ids of its set of agreeing attributes has k better ones.
    """
    found = None
    for attributes, _ in _patterns(weights):
        few = _leaders(items, item_key, attributes, k).drop("_n")
        part = specs.join(few, list(attributes)).select(spec_key, item_key)
        found = part if found is None else found.unionByName(part)
    left, right = specs.select(spec_key, F.struct(*weights).alias("_s")), items.select(item_key, F.struct(*weights).alias("_i"))
    scored = _compared(found.distinct(), left, right, weights).drop("_s", "_i")
    return top_rows(scored, [spec_key], [F.desc("score"), item_key], k)
