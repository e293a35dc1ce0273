"""Saved snapshots as element, parameter and relation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PARAMETER = T.StructType([
    T.StructField("parameterId", T.LongType()), T.StructField("name", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("ownerElementId", T.LongType()), T.StructField("storageType", T.StringType()), T.StructField("dataTypeId", T.StringType()),
    T.StructField("rawValue", T.StringType()), T.StructField("displayValue", T.StringType()), T.StructField("convertedValue", T.StringType()),
    T.StructField("unitTypeId", T.StringType()), T.StructField("status", T.StringType()),
])
ELEMENT = T.StructType([
    T.StructField("elementId", T.LongType()), T.StructField("category", T.StringType()), T.StructField("familyName", T.StringType()),
    T.StructField("typeName", T.StringType()), T.StructField("typeId", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("instanceParameters", T.ArrayType(PARAMETER)), T.StructField("typeParameters", T.ArrayType(PARAMETER)),
])
RELATION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("fromId", T.LongType()), T.StructField("toId", T.LongType())])
SNAPSHOT = T.StructType([T.StructField("snapshot", T.StructType([
    T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("relations", T.ArrayType(RELATION))]))])


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables elements, parameters and relations of every snapshot file under a path."""
    files = spark.read.schema(SNAPSHOT).json(path, multiLine=True).withColumn("snapshot_file", F.input_file_name())
    return snapshot_tables(files.select("snapshot_file", "snapshot"), "snapshot_file")


def snapshot_tables(files: DataFrame, key: str) -> dict[str, DataFrame]:
    elements = files.select(key, F.inline("snapshot.elements"))
    return {
        "elements": elements.drop("instanceParameters", "typeParameters"),
        "parameters": parameters_long(elements, [key]),
        "relations": files.select(key, F.inline("snapshot.relations")),
    }


def parameters_long(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Instance and type parameters of elements in one long table."""
    parts = []
    for column, source in (("instanceParameters", "instance"), ("typeParameters", "type")):
        rows = elements.select(*keys, "elementId", F.inline(column))
        parts.append(rows.withColumn("source", F.coalesce("source", F.lit(source))))
    return parts[0].unionByName(parts[1])
