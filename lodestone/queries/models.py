"""Queries over snapshots, view graph, catalog and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import catalog as K, snapshots as S, viewgraph as V
from lodestone.registry import query
from lodestone.session import cut_lineage, derive, table
from lodestone.sources import versions as R
from lodestone.sources.snapshots import SNAPSHOT, parameters_long, snapshot_tables

# --- versions ------------------------------------------------------------------------------------
VERSIONS = """SELECT c_mktsegment AS section, CASE WHEN o_orderkey % 3 = 0 THEN CAST(n AS STRING) ELSE 'V' || CASE WHEN n < 10 THEN '00' WHEN n < 100 THEN '0' ELSE '' END || n END AS version
  FROM (SELECT o_orderkey, c_mktsegment, o_orderkey % 37 * 5 + 1 AS n FROM orders JOIN customer ON o_custkey = c_custkey)"""
ALIASES = "SELECT c_mktsegment AS section, c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'latest' WHEN 1 THEN 'previous' WHEN 2 THEN CAST(c_custkey % 50 AS STRING) ELSE 'V0x' END AS alias FROM customer"


@query("resolve_version", f"""WITH v AS (SELECT DISTINCT section, CAST(ltrim(version, 'V') AS INTEGER) AS n FROM ({VERSIONS})), r AS (SELECT DISTINCT section, alias FROM ({ALIASES})),
t AS (SELECT section, max(n) AS l FROM v GROUP BY ALL), p AS (SELECT v.section, max(n) AS p FROM v JOIN t USING (section) WHERE n < l GROUP BY ALL),
g AS (SELECT r.*, CASE alias WHEN 'latest' THEN l WHEN 'previous' THEN p ELSE nullif(try_cast(alias AS INTEGER), 0) END AS n FROM r LEFT JOIN t USING (section) LEFT JOIN p USING (section))
SELECT g.section, alias, CASE WHEN v.n IS NOT NULL THEN 'V' || lpad(CAST(v.n AS VARCHAR), 3, '0') END AS version,
CASE WHEN alias NOT IN ('latest', 'previous') AND g.n IS NULL THEN 'invalid' WHEN v.n IS NOT NULL THEN 'ok' ELSE 'missing' END AS status FROM g LEFT JOIN v ON v.section = g.section AND v.n = g.n""")
def resolve_version(spark, d):
    return R.resolve_version(derive(spark, d, ALIASES).select("section", "alias").distinct(), derive(spark, d, VERSIONS))


@query("next_version", f"""SELECT section, 'V' || lpad(CAST(coalesce(max(CASE WHEN version LIKE 'V%' THEN CAST(substr(version, 2) AS INTEGER) END), 0) + 1 AS VARCHAR), 3, '0') AS version FROM ({VERSIONS}) GROUP BY section""")
def next_version(spark, d):
    return R.next_version(derive(spark, d, VERSIONS))


# --- snapshots -----------------------------------------------------------------------------------
ELEMENTS = "SELECT p_partkey AS element_id, p_size AS type_id, p_type AS category, p_name AS family_name, p_brand AS class FROM part"


@query("element_query", f"""SELECT element_id, family_name FROM ({ELEMENTS}) WHERE category IN ('SMALL', 'LARGE') AND element_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def element_query(spark, d):
    view = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("element_id"))
    return S.element_query(derive(spark, d, ELEMENTS), ["SMALL", "LARGE"], ["element_id", "family_name"], view)


REQUESTS = """SELECT DISTINCT p_type AS category, key, place, class_filter, identifier, source, method FROM part, (VALUES
  ('size', 1, 'Brand#3', 'LEN', 'instance', 'parameter'), ('size', 2, 'notBrand#3', 'LEN', 'instanceThenType', 'parameter'),
  ('area', 1, NULL, 'AREA', 'type', 'parameter'), ('mark', 1, 'Brand#5', 'MARK', 'instance', 'parameter'), ('raw', 1, NULL, 'RAW', 'instance', 'unsupported'))
  AS r(key, place, class_filter, identifier, source, method)"""
PROPERTY_VALUES = """SELECT p_partkey AS owner_id, 'LEN' AS identifier, p_retailprice AS number, CAST(NULL AS STRING) AS text, 'length' AS spec FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT DISTINCT -1 - p_size, 'LEN', 5.0, NULL, 'length' FROM part WHERE p_size % 4 = 0
  UNION ALL SELECT DISTINCT -1 - p_size, 'AREA', CAST(p_size AS DOUBLE), NULL, CASE WHEN p_size % 5 = 0 THEN 'mass' ELSE 'area' END FROM part
  UNION ALL SELECT p_partkey, 'MARK', NULL, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END, NULL FROM part"""


@query("resolve_properties", f"""WITH e AS (SELECT element_id, -1 - type_id AS type_id, category, class FROM ({ELEMENTS})), q AS ({REQUESTS}), v AS ({PROPERTY_VALUES}),
w AS (SELECT e.*, q.key, q.identifier, q.source, q.method, coalesce(class_filter IS NULL OR class_filter = class OR (class_filter LIKE 'not%' AND substr(class_filter, 4) <> class), false) AS ok, place FROM e JOIN q USING (category)),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY element_id, key ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, place) = 1),
g AS (SELECT f.*, source = 'type' OR (source = 'instanceThenType' AND a.owner_id IS NULL) AS ut, a.number AS an, a.text AS at_, a.spec AS asp, b.number AS bn, b.text AS bt, b.spec AS bsp FROM f
 LEFT JOIN v a ON a.owner_id = f.element_id AND a.identifier = f.identifier LEFT JOIN v b ON b.owner_id = f.type_id AND b.identifier = f.identifier),
h AS (SELECT element_id, key, ok, method, CASE WHEN ut THEN 'type' ELSE 'instance' END AS origin, CASE WHEN ut THEN bn ELSE an END AS n, CASE WHEN ut THEN bt ELSE at_ END AS t, CASE WHEN ut THEN bsp ELSE asp END AS sp FROM g),
s AS (SELECT *, CASE WHEN method = 'unsupported' THEN 'unsupported' WHEN NOT ok THEN 'notApplicable' WHEN n IS NOT NULL THEN CASE WHEN sp = 'mass' THEN 'notApplicable' ELSE 'ok' END WHEN trim(t) <> '' THEN 'ok' ELSE 'missing' END AS status FROM h)
SELECT element_id, key, origin, status, CASE WHEN status = 'ok' AND n IS NOT NULL THEN round(n * CASE sp WHEN 'length' THEN 304.8 ELSE 0.09290304 END, 6) END AS number,
CASE WHEN status = 'ok' AND n IS NULL THEN t END AS text, CASE WHEN status = 'ok' AND n IS NOT NULL THEN CASE sp WHEN 'length' THEN 'мм' ELSE 'м²' END END AS unit FROM s""")
def resolve_properties(spark, d):
    elements = derive(spark, d, ELEMENTS).withColumn("type_id", (-1 - F.col("type_id")).cast("long"))
    out = S.resolve_properties(elements, derive(spark, d, REQUESTS), derive(spark, d, PROPERTY_VALUES))
    return out.withColumn("number", F.round("number", 6))


def nested_elements(spark, d):
    """Line items as elements: three instance parameters and one type parameter each."""

    def parameter(number, name):
        return F.struct(F.lit(number).cast("long").alias("parameterId"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("source"),
                        F.col(f"l_{name}").cast("long").cast("string").alias("rawValue"))

    lines = table(spark, d, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("elementId"), F.array(parameter(1, "quantity"), parameter(2, "partkey"), parameter(3, "suppkey")).alias("instanceParameters"),
        F.array(parameter(4, "linenumber")).alias("typeParameters"))


@query("parameters_long", """SELECT l_orderkey AS "elementId", id AS "parameterId", name, source, CAST(CASE id WHEN 1 THEN CAST(l_quantity AS BIGINT) WHEN 2 THEN l_partkey WHEN 3 THEN l_suppkey ELSE l_linenumber END AS VARCHAR) AS "rawValue"
FROM lineitem, (VALUES (CAST(1 AS BIGINT), 'quantity', 'instance'), (2, 'partkey', 'instance'), (3, 'suppkey', 'instance'), (4, 'linenumber', 'type')) v(id, name, source)""")
def parameters_long_query(spark, d):
    return parameters_long(nested_elements(spark, d), []).select("elementId", "parameterId", "name", "source", "rawValue")


@query("read_snapshot", """SELECT p_type AS snapshot_file, p_partkey AS "elementId", p_brand AS category, CAST(p_size AS VARCHAR) AS "rawValue" FROM part""")
def read_snapshot_query(spark, d):
    parts = table(spark, d, "part")
    element = F.struct(F.col("p_partkey").alias("elementId"), F.col("p_brand").alias("category"), F.array(F.struct(
        F.lit(1).alias("parameterId"), F.lit("size").alias("name"), F.col("p_size").cast("string").alias("rawValue"))).alias("instanceParameters"),
        F.array().cast("array<struct<parameterId:bigint>>").alias("typeParameters"))
    files = parts.select(F.col("p_type").alias("snapshot_file"), F.to_json(F.struct(F.struct(
        F.array(element).alias("elements"), F.array().cast("array<struct<kind:string>>").alias("relations")).alias("snapshot"))).alias("json"))
    parsed = files.select("snapshot_file", F.from_json("json", SNAPSHOT).getField("snapshot").alias("snapshot"))
    tables = snapshot_tables(parsed, "snapshot_file")
    return tables["elements"].select("snapshot_file", "elementId", "category").join(
        tables["parameters"].select("snapshot_file", "elementId", "rawValue"), ["snapshot_file", "elementId"])


PARAMETERS = "SELECT l_partkey AS owner_id, CASE WHEN l_quantity = 50 THEN 'error' WHEN l_quantity = 49 THEN 'partial' ELSE 'ok' END AS status FROM lineitem UNION ALL SELECT DISTINCT -1 - p_size, CASE WHEN p_size = 7 THEN 'error' ELSE 'ok' END FROM part"


@query("element_parameters", f"""WITH p AS (SELECT owner_id, count(*) AS n, bool_or(status <> 'ok') AS bad FROM ({PARAMETERS}) GROUP BY ALL)
SELECT DISTINCT i.id AS element_id, CASE WHEN e.p_partkey IS NULL THEN 'notFound' WHEN coalesce(a.bad, false) OR coalesce(b.bad, false) THEN 'partial' ELSE 'ok' END AS status, coalesce(a.n, 0) AS instance_parameters, coalesce(b.n, 0) AS type_parameters
FROM (SELECT o_orderkey AS id FROM orders) i LEFT JOIN part e ON e.p_partkey = i.id LEFT JOIN p a ON a.owner_id = i.id LEFT JOIN p b ON b.owner_id = -1 - e.p_size""")
def element_parameters(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("element_id"))
    elements = derive(spark, d, "SELECT p_partkey AS element_id, CAST(-1 - p_size AS BIGINT) AS type_id FROM part")
    return S.element_parameters(ids, elements, derive(spark, d, PARAMETERS))


# Version two of the orders: one residue is removed, one repriced below the shown digits, one repriced, one retyped, one new.
V1 = """SELECT o_custkey AS element_id, 'instance' AS source, o_custkey AS owner_id, o_orderkey AS parameter_id, o_orderpriority AS name, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS display,
  CAST(NULL AS STRING) AS converted, CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS STRING) AS raw, 'mm' AS unit, o_orderstatus AS data_type FROM orders"""
V2 = """SELECT o_custkey + CASE WHEN o_orderkey % 11 = 3 THEN 10000000 ELSE 0 END AS element_id, 'instance' AS source, o_custkey AS owner_id, o_orderkey AS parameter_id, o_orderpriority AS name,
  CAST(CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 11 = 2 THEN 5 ELSE 0 END AS STRING) AS display, CAST(NULL AS STRING) AS converted,
  CAST(CAST(floor(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 11 IN (1, 2) THEN 7 ELSE 0 END AS STRING) AS raw, 'mm' AS unit, CASE WHEN o_orderkey % 11 = 4 THEN 'X' ELSE o_orderstatus END AS data_type
  FROM orders WHERE o_orderkey % 11 <> 0"""
DIFF = f"""diff AS (SELECT *, CASE WHEN kind = 'changed' AND old IS NOT DISTINCT FROM "new" AND ra <> rb THEN ra || ' → ' || rb END AS exact_values, kind = 'changed' AND md AS metadata_changed FROM (
 SELECT coalesce(a.element_id, b.element_id) AS element_id, coalesce(a.source, b.source) AS source, coalesce(a.owner_id, b.owner_id) AS owner_id, coalesce(a.parameter_id, b.parameter_id) AS parameter_id, coalesce(b.name, a.name) AS name,
 a.display AS old, b.display AS "new", a.raw AS ra, b.raw AS rb, a.data_type <> b.data_type AS md,
 CASE WHEN a.element_id IS NULL THEN 'added' WHEN b.element_id IS NULL THEN 'removed' WHEN a.display <> b.display OR a.raw <> b.raw OR a.data_type <> b.data_type THEN 'changed' ELSE 'unchanged' END AS kind
 FROM ({V1}) a FULL JOIN ({V2}) b ON a.element_id = b.element_id AND a.source = b.source AND a.owner_id = b.owner_id AND a.parameter_id = b.parameter_id))"""


def diff(spark, d):
    return S.snapshot_diff(derive(spark, d, V1), derive(spark, d, V2))


@query("snapshot_diff", f"""WITH {DIFF} SELECT element_id, source, owner_id, parameter_id, name, kind, old, "new", exact_values, metadata_changed FROM diff""")
def snapshot_diff(spark, d):
    return diff(spark, d)


@query("diff_summary", f"""WITH {DIFF}, e AS (SELECT element_id, CASE WHEN bool_and(kind = 'added') THEN 'added' WHEN bool_and(kind = 'removed') THEN 'removed' WHEN bool_or(kind <> 'unchanged') THEN 'changed' ELSE 'unchanged' END AS change,
 count(*) FILTER (WHERE kind <> 'unchanged') AS n FROM diff GROUP BY element_id) SELECT '3d' AS section, change, count(*) AS n_elements, CAST(sum(n) AS BIGINT) AS n_changes FROM e GROUP BY change""")
def diff_summary(spark, d):
    return S.diff_summary(S.element_changes(diff(spark, d)).withColumn("section", F.lit("3d")), ["section"])


RESULTS = """SELECT o_custkey AS request, o_orderkey AS pos, o_orderstatus = 'F' AS is_comparison, o_orderpriority = '5-LOW' AS is_error, CASE WHEN o_orderkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN '3d' ELSE '2d' END AS dimension FROM orders"""


@query("supersede_snapshots", f"""WITH r AS ({RESULTS}) SELECT * FROM r WHERE is_comparison OR is_error OR NOT EXISTS (SELECT 1 FROM r c WHERE c.request = r.request AND c.dimension = r.dimension AND c.pos > r.pos
AND c.is_comparison AND NOT c.is_error AND c.status = 'complete')""")
def supersede_snapshots(spark, d):
    return S.supersede_snapshots(derive(spark, d, RESULTS), ["request"]).select("request", "pos", "is_comparison", "is_error", "status", "dimension")


LINES = "SELECT l_suppkey AS snapshot, l_partkey AS element_id, l_orderkey * 10 + l_linenumber AS parameter_id, l_returnflag AS name, CAST(l_quantity AS BIGINT) AS value FROM lineitem"


@query("current_projection", f"""WITH p AS (SELECT DISTINCT * FROM ({LINES})), m AS (SELECT DISTINCT snapshot, element_id FROM p WHERE name IN ('A', 'R')),
s AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY element_id) AS element_rank FROM m QUALIFY element_rank <= 12),
r AS (SELECT p.*, element_rank, row_number() OVER (PARTITION BY p.snapshot, p.element_id ORDER BY parameter_id, name, value) AS parameter_rank FROM p JOIN s USING (snapshot, element_id) WHERE name IN ('A', 'R') QUALIFY parameter_rank <= 12),
t AS (SELECT snapshot, count(DISTINCT element_id) AS total FROM p GROUP BY ALL), k AS (SELECT snapshot, count(*) AS matched FROM m GROUP BY ALL)
SELECT r.snapshot, r.element_id, r.parameter_id, CAST(element_rank AS INTEGER) AS element_rank, total, coalesce(matched, 0) AS matched, total - least(coalesce(matched, 0), 12) AS omitted FROM r JOIN t USING (snapshot) LEFT JOIN k USING (snapshot)""")
def current_projection(spark, d):
    rows = derive(spark, d, LINES).distinct()
    names = spark.createDataFrame([("A",), ("R",)], "name string")
    shown, counts = S.current_projection(rows, ["snapshot"], names=names)
    return shown.join(counts, "snapshot").select("snapshot", "element_id", "parameter_id", "element_rank", "total", "matched", "omitted")


@query("resolve_targets", "SELECT l_orderkey, l_linenumber, l_partkey * 2 AS target_id, CASE WHEN p_partkey IS NULL THEN 'unresolved' ELSE 'ok' END AS status FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2")
def resolve_targets(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("target_id"))
    return S.resolve_targets(refs, table(spark, d, "part").select(F.col("p_partkey").alias("element_id")))


@query("rollup_status", f"SELECT owner_id, CASE WHEN bool_or(status <> 'ok') THEN 'partial' ELSE 'complete' END AS status FROM ({PARAMETERS}) GROUP BY owner_id")
def rollup_status(spark, d):
    return S.rollup_status(derive(spark, d, PARAMETERS), ["owner_id"])


BATCHES = "SELECT l_suppkey AS batch, CASE WHEN l_quantity = 50 AND l_discount > 0.095 THEN 0 ELSE l_partkey + 1 END AS element_id FROM lineitem"


@query("remember_ids", f"SELECT DISTINCT batch, element_id FROM ({BATCHES}) b WHERE NOT EXISTS (SELECT 1 FROM ({BATCHES}) x WHERE x.batch = b.batch AND x.element_id <= 0)")
def remember_ids(spark, d):
    return S.remember_ids(derive(spark, d, BATCHES), ["batch"])


# --- view graph: customers are sheets, parts are views, line items place them --------------------
PLACED = "SELECT DISTINCT l_orderkey * 10000000 + l_partkey AS placement_id, o_custkey AS sheet_id, l_partkey AS view_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def graph(spark, d):
    sheets = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("sheet_id"))
    views = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("view_id"))
    return sheets, views, derive(spark, d, PLACED)


WANTED = "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0"
SCOPED = f"""kept AS (SELECT * FROM ({PLACED}) p WHERE sheet_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND view_id IN (SELECT p_partkey FROM part WHERE p_size > 5) AND sheet_id IN ({WANTED})),
sheets AS (SELECT id AS sheet_id FROM ({WANTED}) UNION SELECT sheet_id FROM kept), views AS (SELECT DISTINCT view_id FROM kept)"""


@query("view_graph_scope", f"WITH {SCOPED} SELECT 'sheet' AS kind, sheet_id AS id FROM sheets UNION ALL SELECT 'view', view_id FROM views UNION ALL SELECT 'placement', placement_id FROM kept")
def view_graph_scope(spark, d):
    sheets, views, placed = V.view_graph_scope(*graph(spark, d), "sheets", derive(spark, d, WANTED))
    return (sheets.select(F.lit("sheet").alias("kind"), F.col("sheet_id").alias("id")).unionByName(views.select(F.lit("view").alias("kind"), F.col("view_id").alias("id")))
            .unionByName(placed.select(F.lit("placement").alias("kind"), F.col("placement_id").alias("id"))))


@query("view_graph_edges", f"""WITH {SCOPED}, notes AS (SELECT -1 - s_suppkey AS element_id, s_suppkey AS owner_view_id FROM supplier), own AS (SELECT * FROM notes WHERE owner_view_id IN (SELECT view_id FROM views UNION SELECT sheet_id FROM sheets)),
ents AS (SELECT element_id FROM own UNION SELECT sheet_id FROM sheets UNION SELECT view_id FROM views UNION SELECT placement_id FROM kept)
SELECT 'onSheet' AS kind, placement_id AS from_id, sheet_id AS to_id FROM kept UNION ALL SELECT 'placedView', placement_id, view_id FROM kept UNION ALL SELECT 'ownedBy', element_id, owner_view_id FROM own
UNION ALL SELECT 'groupMember', -1 - l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE -1 - l_suppkey IN (SELECT element_id FROM own) AND l_partkey IN (SELECT element_id FROM ents)""")
def view_graph_edges(spark, d):
    sheets, views, placed = [cut_lineage(x) for x in V.view_graph_scope(*graph(spark, d), "sheets", derive(spark, d, WANTED))]
    notes = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("element_id"), F.col("s_suppkey").alias("owner_view_id"))
    members = table(spark, d, "lineitem").select((-1 - F.col("l_suppkey")).alias("group_id"), F.col("l_partkey").alias("element_id")).distinct()
    return V.view_graph_edges(sheets, views, placed, notes, members, "sheets")


KINDS = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Dimension' WHEN 1 THEN 'FamilyInstance' WHEN 2 THEN 'TextNote' ELSE 'Wall' END AS class, CASE WHEN p_type = 'PROMO' THEN 'OST_TitleBlocks' ELSE 'OST_Other' END AS category FROM part"


@query("annotation_kind", f"SELECT p_partkey, CASE WHEN class = 'Dimension' THEN 'dimension' WHEN class = 'TextNote' THEN 'text' WHEN class = 'FamilyInstance' AND category = 'OST_TitleBlocks' THEN 'titleBlock' END AS kind FROM ({KINDS})")
def annotation_kind(spark, d):
    return derive(spark, d, KINDS).select("p_partkey", V.annotation_kind(F.col("class"), F.col("category")).alias("kind"))


# --- catalog -------------------------------------------------------------------------------------
ITEMS = "SELECT p_partkey AS item, p_brand AS brand, p_type AS kind, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS size FROM part"
COMPARED = """round(CASE WHEN {a}.brand = {b}.brand THEN 0.3 ELSE 0 END + CASE WHEN {a}.kind = {b}.kind THEN 0.4 ELSE 0 END + CASE WHEN {a}.size = {b}.size THEN 0.2 ELSE 0 END, 6) AS score,
 concat_ws(',', CASE WHEN {a}.brand = {b}.brand THEN 'brand' END, CASE WHEN {a}.kind = {b}.kind THEN 'kind' END, CASE WHEN {a}.size = {b}.size THEN 'size' END) AS matches,
 concat_ws(',', CASE WHEN {a}.brand <> {b}.brand THEN 'brand' END, CASE WHEN {a}.kind <> {b}.kind THEN 'kind' END, CASE WHEN {a}.size <> {b}.size THEN 'size' END) AS differences,
 concat_ws(',', CASE WHEN {a}.kind IS NULL OR {b}.kind IS NULL THEN 'kind' END, CASE WHEN {a}.size IS NULL OR {b}.size IS NULL THEN 'size' END) AS missing"""
HIDING = "SELECT item, brand, CASE WHEN item % 7 = 0 THEN NULL ELSE kind END AS kind, size FROM (" + ITEMS + ")"
WEIGHTS = {"brand": 0.3, "kind": 0.4, "size": 0.2}
NEAR = " UNION ".join(
    f"""SELECT a.item, min(b.item) AS partner FROM i a JOIN i b ON a.item <> b.item AND {" AND ".join(f"a.{c} = b.{c}" for c in p)} {veto} GROUP BY a.item"""
    for p, _ in K._patterns(WEIGHTS) for veto in ("", "AND a.kind IS NOT NULL AND b.kind IS NULL") if not veto or "kind" not in p)
PAIRS = f"""i AS ({HIDING}), near AS ({NEAR}), p AS (SELECT n.item, n.partner, {COMPARED.format(a='a', b='b')}, coalesce(a.kind <> b.kind, false) AS vetoed
 FROM near n JOIN i a ON a.item = n.item JOIN i b ON b.item = n.partner)"""


def near_items(spark, d):
    return K.catalog_pairs(derive(spark, d, HIDING), "item", WEIGHTS, ["kind"])


@query("catalog_pairs", f"WITH {PAIRS} SELECT item, partner, CAST(score AS DOUBLE) AS score, vetoed, matches, differences, missing FROM p")
def catalog_pairs(spark, d):
    return near_items(spark, d)


@query("unify_recommend", f"""WITH {PAIRS} SELECT item, partner, CAST(score AS DOUBLE) AS score, matches AS reason, missing FROM p WHERE NOT vetoed QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, partner) = 1""")
def unify_recommend(spark, d):
    return K.unify_recommend(near_items(spark, d), "item")


SPECS = "SELECT s_suppkey AS spec, 'Brand#' || (1 + s_nationkey % 25) AS brand, CASE s_suppkey % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'PROMO' ELSE 'HUGE' END AS kind, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 50 AS INT) END AS size FROM supplier"


@query("spec_topk", f"""WITH i AS ({ITEMS}), s AS ({SPECS}), p AS (SELECT spec, item, round(CASE WHEN s.brand = i.brand THEN 0.3 ELSE 0 END + CASE WHEN s.kind = i.kind THEN 0.4 ELSE 0 END + CASE WHEN s.size = i.size THEN 0.2 ELSE 0 END, 6) AS score,
 concat_ws(',', CASE WHEN s.brand = i.brand THEN 'brand' END, CASE WHEN s.kind = i.kind THEN 'kind' END, CASE WHEN s.size = i.size THEN 'size' END) AS matches,
 concat_ws(',', CASE WHEN s.brand <> i.brand THEN 'brand' END, CASE WHEN s.kind <> i.kind THEN 'kind' END, CASE WHEN s.size <> i.size THEN 'size' END) AS differences,
 CASE WHEN s.size IS NULL OR i.size IS NULL THEN 'size' ELSE '' END AS missing FROM s, i)
SELECT spec, item, CAST(score AS DOUBLE) AS score, matches, differences, missing, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY score DESC, item) AS rank FROM p WHERE score > 0) WHERE rank <= 3""")
def spec_topk(spark, d):
    return K.spec_topk(derive(spark, d, SPECS), derive(spark, d, ITEMS), "spec", "item", WEIGHTS)
