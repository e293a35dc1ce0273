"""Version names: V001, numbers, latest and previous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def version_number(name: Column) -> Column:
    """Number of 'V###' (three digits or more) or of a plain positive number; null otherwise."""
    text = F.upper(F.trim(name))
    digits = F.coalesce(F.nullif(F.regexp_extract(text, r"^V(\d{3,})$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^(\d+)$", 1), F.lit("")))
    number = digits.cast("int")
    return F.when(number > 0, number)


def version_name(number: Column) -> Column:
    return F.concat(F.lit("V"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def resolve_version(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Resolve aliases per section: latest, previous (the next lower existing number) or a given version.

    requests: section, alias. versions: section, version. Adds version and status (ok, missing, invalid).
    """
    known = versions.select("section", version_number(F.col("version")).alias("_n")).filter("_n IS NOT NULL").distinct()
    last = known.groupBy("section").agg(F.max("_n").alias("_latest"))
    below = known.join(last, "section").filter("_n < _latest").groupBy("section").agg(F.max("_n").alias("_previous"))
    rows = requests.join(last, "section", "left").join(below, "section", "left")
    alias = F.lower(F.trim("alias"))
    given = F.when(alias == "latest", F.col("_latest")).when(alias == "previous", F.col("_previous")).otherwise(version_number(F.col("alias")))
    rows = rows.withColumn("_n", given)
    found = rows.join(known.withColumn("_known", F.lit(True)), ["section", "_n"], "left")
    invalid = ~alias.isin("latest", "previous") & F.col("_n").isNull()
    status = F.when(invalid, "invalid").when(F.col("_known"), "ok").otherwise("missing")
    return found.select("section", "alias", F.when(F.col("_known"), version_name(F.col("_n"))).alias("version"), status.alias("status"))


def next_version(versions: DataFrame) -> DataFrame:
    """(section, version): one above the highest 'V<digits>', V001 where there is none."""
    number = F.nullif(F.regexp_extract(F.upper("version"), r"^V(\d+)$", 1), F.lit("")).cast("int")
    top = versions.groupBy("section").agg(F.coalesce(F.max(number), F.lit(0)).alias("_n"))
    return top.select("section", version_name(F.col("_n") + 1).alias("version"))
