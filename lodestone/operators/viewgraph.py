"""View graph: scope, edges and annotation kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Class, or class with category, to annotation kind.
CLASS_KINDS = {
    "Dimension": "dimension", "IndependentTag": "tag", "SpatialElementTag": "tag", "TextNote": "text",
    "DetailCurve": "detailCurve", "FilledRegion": "region", "RevisionCloud": "revisionCloud",
}
CATEGORY_KINDS = {
    ("Group", "OST_IOSDetailGroups"): "detailGroup", ("FamilyInstance", "OST_TitleBlocks"): "titleBlock",
    ("FamilyInstance", "OST_DetailComponents"): "detailComponent", ("FamilyInstance", "OST_GenericAnnotation"): "genericAnnotation",
}


def annotation_kind(class_name: Column, category: Column) -> Column:
    kind = F.lit(None).cast("string")
    for (name, group), value in CATEGORY_KINDS.items():
        kind = F.when((class_name == name) & (category == group), value).otherwise(kind)
    for name, value in CLASS_KINDS.items():
        kind = F.when(class_name == name, value).otherwise(kind)
    return kind


def scope_errors(requests: DataFrame, sheets: DataFrame, views: DataFrame) -> DataFrame:
    """(kind, id, problem): requested sheets or views that do not exist. requests: kind ('sheet' | 'view'), id."""
    known = sheets.select(F.lit("sheet").alias("kind"), F.col("sheet_id").alias("id")).unionByName(
        views.select(F.lit("view").alias("kind"), F.col("view_id").alias("id")))
    return requests.select("kind", "id").join(known, ["kind", "id"], "left_anti").withColumn("problem", F.lit("missing"))


def view_graph_scope(
    sheets: DataFrame, views: DataFrame, placements: DataFrame, scope: str = "document", ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sheets, views and placements of a document, of chosen sheets or of chosen views.

    Placements need both ends; a kept placement pulls in its other end. ids: id.
    """
    if (scope == "document") != (ids is None):
        raise ValueError("ids go with the scopes 'sheets' and 'views' only")
    whole = placements.join(sheets.select("sheet_id"), "sheet_id", "left_semi").join(views.select("view_id"), "view_id", "left_semi")
    if scope == "document":
        return sheets.select("sheet_id").distinct(), views.select("view_id").distinct(), whole
    column = {"sheets": "sheet_id", "views": "view_id"}[scope]
    chosen = ids.select(F.col("id").alias(column)).distinct()
    kept = whole.join(chosen, column, "left_semi")
    empty = chosen.limit(0)
    on_sheets = (chosen if scope == "sheets" else empty.select(F.col(column).alias("sheet_id"))).select("sheet_id")
    on_views = (chosen if scope == "views" else empty.select(F.col(column).alias("view_id"))).select("view_id")
    return (
        on_sheets.unionByName(kept.select("sheet_id")).distinct(), on_views.unionByName(kept.select("view_id")).distinct(), kept)


def view_graph_edges(
    sheets: DataFrame, views: DataFrame, placements: DataFrame, annotations: DataFrame, members: DataFrame, scope: str = "document"
) -> DataFrame:
    """(kind, from_id, to_id): onSheet, placedView, ownedBy and groupMember among the kept entities.

    placements: placement_id, sheet_id, view_id. annotations: element_id, owner_view_id. members: group_id,
    element_id. In view scope, annotations on sheets are left out.
    """
    owners = views.select(F.col("view_id").alias("owner_view_id"))
    if scope != "views":
        owners = owners.unionByName(sheets.select(F.col("sheet_id").alias("owner_view_id"))).distinct()
    kept = annotations.join(owners, "owner_view_id", "left_semi")

    def edge(df: DataFrame, kind: str, source: str, target: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(source).alias("from_id"), F.col(target).alias("to_id"))

    entities = kept.select("element_id")
    for df, column in ((sheets, "sheet_id"), (views, "view_id"), (placements, "placement_id")):
        entities = entities.unionByName(df.select(F.col(column).alias("element_id")))
    entities = entities.distinct()
    grouped = members.join(kept.select(F.col("element_id").alias("group_id")), "group_id", "left_semi").join(entities, "element_id", "left_semi")
    return (
        edge(placements, "onSheet", "placement_id", "sheet_id").unionByName(edge(placements, "placedView", "placement_id", "view_id"))
        .unionByName(edge(kept, "ownedBy", "element_id", "owner_view_id")).unionByName(edge(grouped, "groupMember", "group_id", "element_id")))
