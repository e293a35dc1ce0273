"""Queries over entity registry, ownership and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import entities as E
from lodestone.queries.corpus import OWNED, REFERRED, REGISTRY, entity_blocks, listed
from lodestone.registry import query
from lodestone.session import cut_lineage, derive

ID = "sha256(source || '|family|' || upper({}))"


@query("entity_registry", f"WITH {REGISTRY} SELECT source, key, name, {ID.format('name')} AS entity_id FROM registry")
def entity_registry(spark, d):
    return E.entity_registry(entity_blocks(spark, d))


def owned(spark, d):
    blocks = entity_blocks(spark, d)
    registry = cut_lineage(E.entity_registry(blocks))
    return cut_lineage(E.assign_owner(blocks, registry)), registry


@query("assign_owner", f"WITH {OWNED} SELECT source, ordinal, owner_name, {ID.format('owner_name')} AS owner_id FROM owned")
def assign_owner(spark, d):
    return owned(spark, d)[0].select("source", "ordinal", "owner_name", "owner_id")


@query("references", f"WITH {REFERRED} SELECT source, ordinal, entity_id FROM refs")
def references(spark, d):
    return E.references(*owned(spark, d))


def classified(spark, d):
    blocks, registry = owned(spark, d)
    refs = cut_lineage(E.references(blocks, registry))
    return cut_lineage(E.classify_blocks(blocks, refs)), registry, refs


@query("classify_blocks", f"""WITH {REFERRED} SELECT source, ordinal, n_references, CASE WHEN conflict THEN 'ambiguous' WHEN owner_name IS NULL THEN 'general_article'
WHEN len(members) > 1 THEN 'shared_family_content' ELSE 'family_content' END AS classification,
CASE WHEN conflict THEN 'source_conflict: введение называет другое семейство' ELSE '' END AS warnings FROM classified""")
def classify_blocks(spark, d):
    rows = classified(spark, d)[0]
    return rows.select("source", "ordinal", "n_references", "classification", F.array_join("warnings", ";").alias("warnings"))


CARDS = f"""{REFERRED},
lines AS (SELECT source, owner_name, 'purpose' AS role, min(ordinal) AS ordinal, text FROM classified WHERE owner_name IS NOT NULL AND NOT conflict
    AND regexp_matches(text, '(?i)(?:используют для|предназначен|семейство содержит|позволяет моделировать)') GROUP BY ALL
  UNION ALL SELECT source, owner_name, 'constraints', ordinal, text FROM classified WHERE owner_name IS NOT NULL AND NOT conflict
    AND regexp_matches(text, '(?i)(?:нельзя|не допускается|ограничени|только для)')),
cards AS (SELECT r.source, r.name, {ID.format('r.name').replace('source', 'r.source')} AS entity_id,
  (SELECT count(*) FROM classified c WHERE c.source = r.source AND c.owner_name = r.name) AS n_blocks,
  (SELECT min(ordinal) FROM classified c WHERE c.source = r.source AND c.owner_name = r.name) AS first_ordinal,
  (SELECT max(ordinal) FROM classified c WHERE c.source = r.source AND c.owner_name = r.name) AS last_ordinal,
  (SELECT count(*) FROM classified c WHERE c.source = r.source AND c.owner_name = r.name AND conflict) AS n_warnings,
  (SELECT count(DISTINCT asset) FROM classified c WHERE c.source = r.source AND c.owner_name = r.name) AS n_assets,
  (SELECT count(DISTINCT f.entity_id) FROM classified c JOIN refs f USING (source, ordinal) WHERE c.source = r.source AND c.owner_name = r.name) AS n_references,
  coalesce((SELECT string_agg(DISTINCT asset, ' ' ORDER BY asset) FROM classified c WHERE c.source = r.source AND c.owner_name = r.name), '') AS asset_ids,
  coalesce((SELECT string_agg(DISTINCT f.entity_id, ' ' ORDER BY f.entity_id) FROM classified c JOIN refs f USING (source, ordinal) WHERE c.source = r.source AND c.owner_name = r.name), '') AS reference_ids,
  array_to_string(list_filter({listed('r.name')}, lambda x: x IS NOT NULL), '|') AS member_names,
  coalesce((SELECT string_agg(text, chr(10) ORDER BY ordinal) FROM lines l WHERE l.source = r.source AND l.owner_name = r.name AND role = 'purpose'), '') AS purpose,
  coalesce((SELECT string_agg(text, chr(10) ORDER BY ordinal) FROM lines l WHERE l.source = r.source AND l.owner_name = r.name AND role = 'constraints'), '') AS constraints
  FROM registry r)"""


@query("entity_cards", f"""WITH {CARDS} SELECT *, CASE WHEN n_warnings = 0 THEN 'identified' ELSE 'conflict' END AS status FROM cards""")
def entity_cards(spark, d):
    cards = E.entity_cards(*classified(spark, d))
    lists = {"asset_ids": " ", "reference_ids": " ", "member_names": "|"}
    return cards.withColumns({c: F.array_join(c, mark) for c, mark in lists.items()})


def corpus_assets(spark, d):
    blocks = entity_blocks(spark, d)
    assets = blocks.select("source", F.explode("asset_ids").alias("asset_id")).distinct()
    return assets.withColumn("status", F.when(F.col("asset_id").endswith("0"), "processed").otherwise("missing"))


@query("asset_owner", f"""WITH {OWNED} SELECT source, asset AS asset_id, CASE WHEN asset LIKE '%0' THEN 'processed' ELSE 'missing' END AS status,
  {ID.format('arg_min_null(owner_name, ordinal)')} AS owner_id FROM owned WHERE asset IS NOT NULL GROUP BY source, asset""")
def asset_owner(spark, d):
    return E.asset_owner(corpus_assets(spark, d), owned(spark, d)[0])


@query("integrity_report", f"""WITH {CARDS} SELECT source, CAST(ordinal AS VARCHAR) AS item, 'source_conflict: введение называет другое семейство' AS problem FROM classified WHERE conflict
UNION ALL SELECT DISTINCT source, asset, 'image_missing' FROM owned WHERE asset NOT LIKE '%0'
UNION ALL SELECT source, entity_id, 'empty_card' FROM cards WHERE n_blocks = 0""")
def integrity_report(spark, d):
    blocks, registry, refs = classified(spark, d)
    return E.integrity_report(blocks, corpus_assets(spark, d), E.entity_cards(blocks, registry, refs))


@query("backfill_shared", """WITH blocks AS (SELECT replace(p_brand, '#', '_') AS source, p_type, p_partkey FROM part)
SELECT source, p_partkey AS ordinal, CASE WHEN p_type = 'LARGE' THEN source || '_LARGE|' || source || '_MEDIUM' ELSE '' END AS names,
CASE WHEN p_type = 'LARGE' THEN sha256(source || '|family|' || upper(source || '_LARGE / ' || source || '_MEDIUM')) END AS owner_id FROM blocks""")
def backfill_shared(spark, d):
    rows = derive(spark, d, "SELECT replace(p_brand, '#', '_') AS source, p_type AS section, p_partkey AS ordinal FROM part")
    rows = rows.withColumns({"owner_id": F.lit(None).cast("string"), "family_names": F.array().cast("array<string>")})
    out = E.backfill_shared(entity_blocks(spark, d), rows)
    return out.select("source", "ordinal", F.array_join("family_names", "|").alias("names"), "owner_id")
