"""Element tables, parameters, version diff and bounded projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import best_value
from lodestone.functions.units import to_unit
from lodestone.operators.scans import top_rows
from lodestone.session import sized

PARAMETER_KEY = ["element_id", "source", "owner_id", "parameter_id"]
ELEMENT_ROWS = 262_144


def element_query(elements: DataFrame, categories: list[str], fields: list[str], in_view: DataFrame | None = None) -> DataFrame:
    """Elements of the categories with the wanted fields, in the whole document or one view (element_id)."""
    rows = elements.filter(F.col("category").isin(categories))
    if in_view is not None:
        rows = rows.join(in_view.select("element_id"), "element_id", "left_semi")
    return rows.select(*fields)


def resolve_properties(elements: DataFrame, requests: DataFrame, values: DataFrame) -> DataFrame:
    """One row per element and requested key: value, unit, origin, status.

    requests: category, key, place, class_filter (null, 'X' or 'notX'), identifier, source ('instance', 'type',
    'instanceThenType'), method. values: owner_id, identifier, number, text, spec. elements: element_id,
    type_id, class, category. The first request of a key that applies to the element is read, else its first one
    answers notApplicable. Requests are a short fixed list.

    Files of few bytes may hold many elements, so they are dealt by rows: ELEMENT_ROWS of them, with their requests, to a task.
    """
    cores = elements.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-elements.count() // ELEMENT_ROWS))
    wanted = elements.select("element_id", "type_id", "class", "category").repartition(parts).join(sized(requests), "category")
    applies = F.col("class_filter").isNull() | (F.col("class_filter") == F.col("class")) | (
        F.startswith("class_filter", F.lit("not")) & (F.substring("class_filter", 4, 200) != F.col("class")))
    order = F.struct(F.when(applies, 0).otherwise(1), F.col("place"))
    picked = wanted.withColumn("_ok", applies).groupBy("element_id", "type_id", "key").agg(
        F.min_by(F.struct("identifier", "source", "method", "_ok"), order).alias("_r"))
    rows = picked.select("element_id", "type_id", "key", "_r.*").repartition(parts, "element_id", "identifier")
    value = F.struct("number", "text", "spec")
    own = values.select(F.col("owner_id").alias("element_id"), "identifier", value.alias("_own"))
    typed = values.select(F.col("owner_id").alias("type_id"), "identifier", value.alias("_type"))
    typed = typed.join(elements.select("type_id").distinct(), "type_id", "left_semi")
    rows = rows.join(sized(own), ["element_id", "identifier"], "left").join(sized(typed), ["type_id", "identifier"], "left")
    has = lambda c: F.col(c).isNotNull() & (F.col(f"{c}.number").isNotNull() | F.col(f"{c}.text").isNotNull())
    use_type = (F.col("source") == "type") | ((F.col("source") == "instanceThenType") & ~has("_own"))
    rows = rows.withColumns({
        "_v": F.when(use_type, F.col("_type")).otherwise(F.col("_own")),
        "origin": F.when(use_type, "type").otherwise("instance"),
    }).withColumns({"number": F.col("_v.number"), "text": F.col("_v.text"), "spec": F.col("_v.spec")})
    measured = to_unit(rows, "number", "spec").withColumnRenamed("status", "_unit_status")
    status = (
        F.when(F.col("method") == "unsupported", "unsupported").when(~F.col("_ok"), "notApplicable")
        .when(F.col("number").isNotNull(), F.col("_unit_status")).when(F.trim("text") != "", "ok").otherwise("missing")
    )
    measured = measured.withColumn("status", status)
    good = F.col("status") == "ok"
    return measured.select(
        "element_id", "key", "origin", "status", F.when(good & F.col("number").isNotNull(), F.col("value")).alias("number"),
        F.when(good & F.col("number").isNull(), F.col("text")).alias("text"), F.when(good, F.col("unit")).alias("unit"))


def element_parameters(ids: DataFrame, elements: DataFrame, parameters: DataFrame) -> DataFrame:
    """Status per requested id: notFound, partial (a parameter failed) or ok, with parameter counts.

    Type parameters are counted once per type and joined. elements: element_id, type_id. parameters:
    owner_id, status.
    """
    wanted = ids.select("element_id").distinct()
    bad = F.max(F.col("status").isin("error", "partial"))
    owned = parameters.groupBy("owner_id").agg(F.count(F.lit(1)).alias("_n"), bad.alias("_bad"))
    found = elements.select("element_id", "type_id", F.lit(True).alias("_found"))
    rows = wanted.join(found, "element_id", "left")
    rows = rows.join(owned.select(F.col("owner_id").alias("element_id"), F.col("_n").alias("_in"), F.col("_bad").alias("_ib")), "element_id", "left")
    rows = rows.join(owned.select(F.col("owner_id").alias("type_id"), F.col("_n").alias("_tn"), F.col("_bad").alias("_tb")), "type_id", "left")
    failed = F.coalesce("_ib", F.lit(False)) | F.coalesce("_tb", F.lit(False))
    status = F.when(F.col("_found").isNull(), "notFound").when(failed, "partial").otherwise("ok")
    return rows.select("element_id", status.alias("status"), F.coalesce("_in", F.lit(0)).alias("instance_parameters"),
                       F.coalesce("_tn", F.lit(0)).alias("type_parameters"))


def snapshot_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Parameter-level difference of two versions, keyed by element, source, owner and parameter.

    Columns on both sides: the key, name, display, converted, raw, unit, data_type. kind is added, removed,
    changed or unchanged; equal shown values with a changed raw value give exact_values.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        shown = best_value(F.col("display"), F.col("converted"), F.col("raw"), F.col("unit"))
        return df.select(*PARAMETER_KEY, F.struct("name", shown.alias("shown"), "raw", "data_type").alias(tag))

    both = side(first, "a").join(side(second, "b"), PARAMETER_KEY, "full")
    old, new = F.col("a.shown.value"), F.col("b.shown.value")
    raw = ~F.col("a.raw").eqNullSafe(F.col("b.raw"))
    value = ~old.eqNullSafe(new) | raw
    meta = ~(F.col("a.name").eqNullSafe(F.col("b.name")) & F.col("a.data_type").eqNullSafe(F.col("b.data_type")))
    kind = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .when(value | meta, "changed").otherwise("unchanged")
    )
    exact = F.when((kind == "changed") & old.eqNullSafe(new) & raw, F.concat_ws(" → ", F.col("a.raw"), F.col("b.raw")))
    return both.select(
        *PARAMETER_KEY, F.coalesce("b.name", "a.name").alias("name"), kind.alias("kind"), old.alias("old"), new.alias("new"),
        exact.alias("exact_values"), ((kind == "changed") & meta).alias("metadata_changed"))


def element_changes(diff: DataFrame) -> DataFrame:
    """(element_id, change): added or removed where every parameter is, else changed or unchanged."""
    flags = diff.groupBy("element_id").agg(
        F.min(F.col("kind") == "added").alias("_added"), F.min(F.col("kind") == "removed").alias("_removed"),
        F.max(F.col("kind") != "unchanged").alias("_any"), F.sum(F.when(F.col("kind") != "unchanged", 1).otherwise(0)).alias("n_changes"))
    change = F.when(F.col("_added"), "added").when(F.col("_removed"), "removed").when(F.col("_any"), "changed").otherwise("unchanged")
    return flags.select("element_id", change.alias("change"), "n_changes")


def diff_summary(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of elements and changes per section and group."""
    return changes.groupBy(*keys, "change").agg(F.count(F.lit(1)).alias("n_elements"), F.sum("n_changes").alias("n_changes"))


def supersede_snapshots(results: DataFrame, keys: list[str]) -> DataFrame:
    """Drop a snapshot if a later successful complete comparison of its request covers its dimension.

    results: keys, pos, is_comparison, is_error, status, dimension.
    """
    done = results.filter(F.col("is_comparison") & ~F.col("is_error") & (F.col("status") == "complete"))
    last = done.groupBy(*keys, "dimension").agg(F.max("pos").alias("_last"))
    rows = results.join(last, [*keys, "dimension"], "left")
    covered = ~F.col("is_comparison") & ~F.col("is_error") & F.coalesce(F.col("_last") > F.col("pos"), F.lit(False))
    return rows.filter(~covered).drop("_last")


def current_projection(
    parameters: DataFrame, keys: list[str], ids: DataFrame | None = None, names: DataFrame | None = None, limit: int = 12
) -> tuple[DataFrame, DataFrame]:
    """First elements and parameters of each snapshot that match, and counts of what was left out.

    parameters: keys, element_id, parameter_id, name, value. ids: element_id; names: name (null = all).
    """
    named = parameters if names is None else parameters.join(names.select("name").distinct(), "name", "left_semi")
    matched = named.select(*keys, "element_id").distinct()
    if ids is not None:
        matched = matched.join(ids.select("element_id").distinct(), "element_id", "left_semi")
    shown = top_rows(matched, keys, ["element_id"], limit, "element_rank")
    picked = named.join(shown, [*keys, "element_id"])
    rows = top_rows(picked, [*keys, "element_id"], ["parameter_id"], limit, "parameter_rank")
    total = parameters.select(*keys, "element_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    match = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"))
    counts = total.join(match, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return rows, counts.withColumn("omitted", F.col("total") - F.least(F.col("matched"), F.lit(limit)))


def resolve_targets(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """Add status: references whose target is gone stay, as unresolved. refs: target_id; elements: element_id."""
    known = elements.select(F.col("element_id").alias("target_id"), F.lit(True).alias("_known"))
    out = refs.join(known, "target_id", "left")
    return out.withColumn("status", F.when(F.col("_known"), "ok").otherwise("unresolved")).drop("_known")


def rollup_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.when(F.max(~F.col("status").eqNullSafe(F.lit("ok"))), "partial").otherwise("complete").alias("status"))


def remember_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ids of batches whose ids are all positive."""
    bad = rows.filter(F.col("element_id").isNull() | (F.col("element_id") <= 0)).select(*keys).distinct()
    return rows.select(*keys, "element_id").distinct().join(bad, keys, "left_anti")
