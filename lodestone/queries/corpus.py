"""A block corpus derived from parts: brands are sources, types are entities, parts are blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.session import cut_lineage, derive

BLOCKS = """SELECT * FROM (
WITH p AS (SELECT p_partkey, replace(p_brand, '#', '_') AS source, p_type, p_name, p_size, p_retailprice,
    CAST(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END AS BIGINT) * 1000000000 AS base
  FROM part),
heads AS (SELECT DISTINCT source, p_type, base FROM p)
SELECT source, base AS ordinal, p_type AS section, CASE p_type WHEN 'PROMO' THEN source || '_PROMO (v1)'
    WHEN 'LARGE' THEN source || '_LARGE / ' || source || '_MEDIUM' ELSE source || '_' || p_type END AS text,
  'heading' AS kind, 0 AS heading_level, CAST(NULL AS STRING) AS label, CAST(NULL AS STRING) AS asset FROM heads
UNION ALL SELECT source, base + 500000000, p_type, source || '_PROMO (v2)', 'heading', 0, NULL, NULL FROM heads WHERE p_type = 'PROMO'
UNION ALL SELECT source, base + p_partkey * 10 + 10, p_type || ' ' || p_size, 'Размеры ' || p_size, 'heading',
  CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, NULL, NULL FROM p WHERE p_size % 12 = 0 OR p_size % 7 = 0
UNION ALL SELECT source, base + p_partkey * 10 + 11, p_type, CASE p_size % 6
    WHEN 0 THEN 'Семейство предназначен для ' || p_name WHEN 1 THEN 'Нельзя ставить ' || p_name
    WHEN 2 THEN 'В этой статье описано всё об инструменте ' || source || '_SMALL.'
    WHEN 3 THEN 'См. ' || source || '_ECONOMY, ' || p_name
    ELSE 'Деталь ' || p_name || ', цена ' || CAST(CAST(p_retailprice AS BIGINT) AS STRING) END,
  'paragraph', NULL, NULL, CASE WHEN p_size % 4 = 0 THEN 'img' || CAST(p_size AS STRING) END FROM p
UNION ALL SELECT source, base + p_partkey * 10 + 12, p_type, source || '_ROW' || (p_size % 3) || ' | ' || p_name, 'table-row:1', NULL,
  source || '_ROW' || (p_size % 3), NULL FROM p WHERE p_size % 5 = 0)"""

NAME_RE = r"[\p{L}\p{N}][\p{L}\p{N}_№.+\-]*_[\p{L}\p{N}_№.+\-]+(?:[ ]+[\p{L}\p{N}_№.\-]+)*"


def own_name(e: str) -> str:
    return f"nullif(regexp_extract({e}, '^({NAME_RE})(?:\\s+\\([^\\r\\n]*\\))?$', 1), '')"


def listed(e: str) -> str:
    return f"list_transform(regexp_split_to_array({e}, '\\s*/\\s*|\\s*;\\s*'), lambda x: {own_name('x')})"


HEADINGS = f"""heads AS (SELECT source, ordinal, text, coalesce(heading_level, 0) AS lvl, {own_name('text')} AS own, {listed('text')} AS parts
  FROM blocks WHERE kind = 'heading'),
collided AS (SELECT source, lower(own) AS k FROM heads WHERE own IS NOT NULL GROUP BY ALL HAVING count(DISTINCT lower(text)) > 1),
named AS (SELECT source, ordinal, lvl, CASE WHEN own IS NOT NULL THEN CASE WHEN (source, lower(own)) IN (SELECT (source, k) FROM collided) THEN text ELSE own END
  WHEN len(parts) > 1 AND len(list_filter(parts, lambda x: x IS NULL)) = 0 THEN text END AS name FROM heads)"""
REGISTRY = f"""blocks AS MATERIALIZED ({BLOCKS}), {HEADINGS},
registry AS MATERIALIZED (SELECT source, lower(name) AS key, arg_min(name, ordinal) AS name FROM (SELECT source, ordinal, name FROM named WHERE name IS NOT NULL
  UNION ALL SELECT source, ordinal, {own_name('label')} FROM blocks WHERE label IS NOT NULL) WHERE name IS NOT NULL GROUP BY ALL)"""
OWNED = f"""{REGISTRY},
o1 AS (SELECT b.*, n.name AS hname, n.lvl, max(CASE WHEN n.name IS NOT NULL THEN b.ordinal END) OVER (PARTITION BY b.source ORDER BY b.ordinal) AS e
  FROM blocks b LEFT JOIN named n USING (source, ordinal)),
o2 AS (SELECT o1.*, n.name AS ename, n.lvl AS elvl FROM o1 LEFT JOIN named n ON n.source = o1.source AND n.ordinal = o1.e),
o3 AS (SELECT *, max(CASE WHEN kind = 'heading' AND hname IS NULL AND lvl <= elvl THEN ordinal END) OVER (PARTITION BY source ORDER BY ordinal) AS closed FROM o2),
owned AS MATERIALIZED (SELECT source, ordinal, section, text, kind, heading_level, asset,
  CASE WHEN label IS NOT NULL THEN label WHEN ename IS NOT NULL AND coalesce(closed, -1) < e THEN ename END AS owner_name FROM o3)"""
MEMBERS = f"CASE WHEN owner_name IS NULL THEN [] ELSE list_filter({listed('owner_name')}, lambda x: x IS NOT NULL) END"
REFERRED = f"""{OWNED},
refs AS MATERIALIZED (SELECT o.source, o.ordinal, sha256(o.source || '|family|' || upper(r.name)) AS entity_id FROM owned o JOIN registry r USING (source)
  WHERE coalesce(r.name <> o.owner_name, true) AND NOT list_contains(list_transform({MEMBERS}, lambda x: lower(x)), r.key)
  AND CASE WHEN contains(lower(o.text), r.key) THEN regexp_matches(o.text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_№.+\\-])' || regexp_replace(r.name, '([().|])', '\\\\\\1', 'g') || '(?:$|[^\\p{{L}}\\p{{N}}_№+.\\-]|\\.$|\\.[^\\p{{L}}\\p{{N}}])') ELSE false END),
classified AS MATERIALIZED (SELECT o.*, coalesce(n, 0) AS n_references, {MEMBERS} AS members,
  o.owner_name IS NOT NULL AND n > 0 AND regexp_matches(text, '(?i)^В этой статье.*(?:инструмент|семейств)') AS conflict
  FROM owned o LEFT JOIN (SELECT source, ordinal, count(*) AS n FROM refs GROUP BY ALL) USING (source, ordinal))"""


def entity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = derive(spark, sf_dir, BLOCKS)
    # The corpus is read several times by every pipeline step, as a stored block table would be.
    return cut_lineage(rows.withColumns({
        "family_names": F.when(F.col("label").isNotNull(), F.array("label")).otherwise(none),
        "asset_ids": F.when(F.col("asset").isNotNull(), F.array("asset")).otherwise(none),
    }).drop("label", "asset"))
