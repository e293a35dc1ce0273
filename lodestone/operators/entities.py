"""Entity registry, ownership, references, cards and integrity of blocks.

Blocks: source, ordinal (long), section, text, kind, heading_level, family_names, asset_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import (
    CLAIM_PATTERN, CONFLICT_WARNING, contains_name, entity_name, entity_names, stable_id, strip,
)
from lodestone.operators.scans import first_rows, running



def _none() -> Column:
    return F.array().cast("array<string>")


def entity_id(source: Column, name: Column) -> Column:
    return stable_id(source, F.lit("family"), F.upper(name))


def _headings(blocks: DataFrame) -> DataFrame:
    """Headings with their card name: the full heading where names collide or several are listed."""
    heads = blocks.filter(F.col("kind") == "heading").select(
        "source", "ordinal", strip(F.col("text")).alias("_full"), entity_name(F.col("text")).alias("_own"),
        F.coalesce("heading_level", F.lit(0)).alias("_level"),
    )
    named = heads.filter("_own IS NOT NULL").withColumn("_key", F.lower("_own"))
    collided = (
        named.groupBy("source", "_key").agg(F.min(F.lower("_full")).alias("_a"), F.max(F.lower("_full")).alias("_b"))
        .filter("_a <> _b").select("source", "_key", F.lit(True).alias("_collided"))
    )
    single = named.join(collided, ["source", "_key"], "left").select(
        "source", "ordinal", "_level", F.when(F.col("_collided"), F.col("_full")).otherwise(F.col("_own")).alias("name"))
    others = heads.filter("_own IS NULL").select(
        "source", "ordinal", "_level", F.when(F.size(entity_names(F.col("_full"))) > 1, F.col("_full")).alias("name"))
    return single.unionByName(others)


def entity_registry(blocks: DataFrame) -> DataFrame:
    """(source, key, name, entity_id): first spelling of every heading name and labelled row name."""
    rows = blocks.filter(F.col("kind").startswith("table-row")).select("source", "ordinal", F.explode("family_names").alias("_n"))
    labelled = rows.select("source", "ordinal", entity_name(F.col("_n")).alias("name"))
    found = _headings(blocks).select("source", "ordinal", "name").unionByName(labelled).filter("name IS NOT NULL")
    named = found.groupBy("source", F.lower("name").alias("key")).agg(F.min_by("name", "ordinal").alias("name"))
    return named.withColumn("entity_id", entity_id(F.col("source"), F.col("name")))


def assign_owner(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """Carry the entity of a heading down to the next entity heading or a plain heading not below it.

    Adds owner_name and owner_id. A row labelled with one registered name is owned by that name.
    """
    heads = _headings(blocks).withColumnRenamed("name", "_name")
    plain = blocks.filter("kind <> 'heading'").withColumns(
        {"_level": F.lit(None).cast("int"), "_name": F.lit(None).cast("string")}
    )
    rows = blocks.filter("kind = 'heading'").join(heads, ["source", "ordinal"], "left").unionByName(plain)
    entry = F.when(F.col("_name").isNotNull(), F.struct("ordinal", "_name", "_level"))
    rows = running(rows, ["source"], ["ordinal"], {"_e": ("last", entry)})
    closes = (F.col("kind") == "heading") & F.col("_name").isNull() & (F.col("_level") <= F.col("_e._level"))
    rows = running(rows, ["source"], ["ordinal"], {"_closed": ("max", F.when(closes, F.col("ordinal")))})
    open_ = F.col("_e").isNotNull() & (F.coalesce("_closed", F.lit(-1)) < F.col("_e.ordinal"))
    rows = rows.withColumn("owner_name", F.when(open_, F.col("_e._name"))).drop("_e", "_closed", "_level", "_name")
    labelled = F.col("kind").startswith("table-row") & (F.size("family_names") == 1)
    known = registry.select("source", F.col("key").alias("_key"), F.lit(True).alias("_known"))
    local = rows.filter(labelled).withColumn("_key", F.lower(F.get("family_names", F.lit(0)))).join(known, ["source", "_key"], "left")
    local = local.withColumn(
        "owner_name", F.when(F.col("_known"), F.get("family_names", F.lit(0))).otherwise(F.col("owner_name"))
    ).drop("_key", "_known")
    out = rows.filter(~labelled).unionByName(local)
    members = entity_names(F.col("owner_name"))
    names = F.when(F.col("owner_name").isNull(), _none()).when(F.size(members) > 1, members).otherwise(F.array("owner_name"))
    return out.withColumns(
        {"owner_id": F.when(F.col("owner_name").isNotNull(), entity_id(F.col("source"), F.col("owner_name"))), "family_names": names}
    )


RUN = r"[\p{L}\p{N}_№.+\-]+"


def run_keys(text: Column, joined_only: bool = True) -> Column:
    """Lower-case token runs, and their prefixes before a '.' that no letter or digit follows.

    A whole name can only start where a run starts. ``joined_only`` keeps runs with '_'.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))
    if joined_only:
        runs = F.filter(runs, lambda r: F.contains(r, F.lit("_")))

    def keys(run: Column) -> Column:
        stops = F.filter(
            F.sequence(F.lit(1), F.length(run)),
            lambda i: (F.substring(run, i, F.lit(1)) == ".") & ~F.substring(run, i + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]"),
        )
        return F.when(F.contains(run, F.lit(".")), F.concat(
            F.array(run), F.transform(stops, lambda i: F.substring(run, F.lit(1), i - 1)))).otherwise(F.array(run))

    return F.array_distinct(F.flatten(F.transform(runs, keys)))


def name_keys(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), f"^{RUN}", 0)


def names_met(texts: DataFrame, keys: list[str], text: str, names: DataFrame, within: list[str] | None = None, joined_only: bool = True) -> DataFrame:
    """(keys, names' columns): names that occur whole in a text.

    A name can only start at a token of the text, so texts and names meet on that token (and on the ``within`` columns);
    only keys and tokens travel there, and the text is read again for what meets. names: name and further columns.
    """
    within = within or []
    tokens = texts.select(*keys, F.explode(run_keys(F.col(text), joined_only)).alias("_k"))
    met = tokens.join(names.withColumn("_k", name_keys(F.col("name"))), [*within, "_k"]).drop("_k")
    whole = met.join(texts.select(*keys, F.col(text).alias("_text")), keys)
    return whole.filter(contains_name(F.col("_text"), F.col("name"))).drop("_text")


def references(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, ordinal, entity_id): registered names in a block, without its owner and members."""
    names = registry.select("source", "name", "key", "entity_id")
    hits = names_met(blocks, ["source", "ordinal"], "text", names, ["source"])
    members = F.transform(entity_names(F.col("owner_name")), F.lower)
    own = F.coalesce(F.col("entity_id") == F.col("owner_id"), F.lit(False)) | F.coalesce(F.array_contains(members, F.col("key")), F.lit(False))
    named = hits.join(blocks.select("source", "ordinal", "owner_id", "owner_name"), ["source", "ordinal"])
    return named.filter(~own).select("source", "ordinal", "entity_id").distinct()


def classify_blocks(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Add classification and warnings: an introduction that names another entity is a conflict."""
    named = refs.groupBy("source", "ordinal").agg(F.count(F.lit(1)).alias("_refs"))
    rows = blocks.join(named, ["source", "ordinal"], "left").withColumn("_refs", F.coalesce("_refs", F.lit(0)))
    conflict = F.col("owner_id").isNotNull() & (F.col("_refs") > 0) & F.col("text").rlike(CLAIM_PATTERN["conflict_intro"])
    members = F.size(entity_names(F.col("owner_name")))
    kind = (
        F.when(conflict, "ambiguous").when(F.col("owner_id").isNull(), "general_article")
        .when(members > 1, "shared_family_content").otherwise("family_content")
    )
    return rows.withColumns(
        {"classification": kind, "warnings": F.when(conflict, F.array(F.lit(CONFLICT_WARNING))).otherwise(_none())}
    ).withColumnRenamed("_refs", "n_references")


def card_lines(blocks: DataFrame) -> DataFrame:
    """(source, entity_id, role, ordinal, text): purpose and constraint blocks without warnings.

    Equal purpose texts of an entity keep their first block only.
    """
    owned = blocks.filter(F.col("owner_id").isNotNull() & (F.size("warnings") == 0)).select(
        "source", F.col("owner_id").alias("entity_id"), "ordinal", "text")
    purpose = first_rows(owned.filter(F.col("text").rlike(CLAIM_PATTERN["purpose"])), ["source", "entity_id", "text"], ["ordinal"])
    limits = owned.filter(F.col("text").rlike(CLAIM_PATTERN["constraints"]))
    return purpose.withColumn("role", F.lit("purpose")).unionByName(limits.withColumn("role", F.lit("constraints")))


def entity_cards(blocks: DataFrame, registry: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per entity: members, block range and count, warnings, assets, references, purpose and constraints.

    Block ordinals stay in the block table, and each line of purpose and constraints is also a row of ``card_lines``.
    """
    owned = blocks.filter("owner_id IS NOT NULL").withColumnRenamed("owner_id", "entity_id")
    stats = owned.groupBy("source", "entity_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"),
        F.sum(F.size("warnings")).alias("n_warnings"),
    )
    assets = owned.select("source", "entity_id", F.explode("asset_ids").alias("a"))
    assets = assets.groupBy("source", "entity_id").agg(F.array_sort(F.collect_set("a")).alias("asset_ids"))
    cited = refs.withColumnRenamed("entity_id", "_ref").join(owned.select("source", "ordinal", "entity_id"), ["source", "ordinal"])
    cited = cited.groupBy("source", "entity_id").agg(F.array_sort(F.collect_set("_ref")).alias("reference_ids"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    joined = card_lines(blocks).groupBy("source", "entity_id", "role").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("t"))
    texts = joined.groupBy("source", "entity_id").agg(
        F.max(F.when(F.col("role") == "purpose", F.col("t"))).alias("purpose"),
        F.max(F.when(F.col("role") == "constraints", F.col("t"))).alias("constraints"))
    members = F.filter(entity_names(F.col("name")), lambda n: n.isNotNull())
    cards = registry.select("source", "entity_id", "name", members.alias("member_names"))
    for part in (stats, assets, cited, texts):
        cards = cards.join(part, ["source", "entity_id"], "left")
    ids = {c: F.coalesce(c, _none()) for c in ("asset_ids", "reference_ids")}
    return cards.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in ("n_blocks", "n_warnings")},
        **ids,
        "n_assets": F.size(ids["asset_ids"]).cast("long"),
        "n_references": F.size(ids["reference_ids"]).cast("long"),
        "purpose": F.coalesce("purpose", F.lit("")),
        "constraints": F.coalesce("constraints", F.lit("")),
        "status": F.when(F.coalesce("n_warnings", F.lit(0)) == 0, "identified").otherwise("conflict"),
    })


def asset_owner(assets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Owner of the first block that holds the asset; assets: source, asset_id."""
    uses = blocks.select("source", F.explode("asset_ids").alias("asset_id"), "ordinal", "owner_id")
    first = uses.groupBy("source", "asset_id").agg(F.min_by(F.struct("owner_id"), "ordinal")["owner_id"].alias("owner_id"))
    return assets.join(first, ["source", "asset_id"], "left")


def integrity_report(blocks: DataFrame, assets: DataFrame, cards: DataFrame) -> DataFrame:
    """(source, item, problem): block warnings, assets not processed, cards without blocks."""
    warned = blocks.select("source", F.col("ordinal").cast("string").alias("item"), F.explode("warnings").alias("problem"))
    images = assets.filter("status <> 'processed'").select(
        "source", F.col("asset_id").alias("item"), F.concat(F.lit("image_"), "status").alias("problem"))
    empty = cards.filter("n_blocks = 0").select("source", F.col("entity_id").alias("item"), F.lit("empty_card").alias("problem"))
    return warned.unionByName(images).unionByName(empty)


def backfill_shared(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (blocks, chunks or assets with source, section, owner_id, family_names) without an owner, in a
    section whose heading lists several names, take the shared card of that heading."""
    heads = blocks.filter((F.col("kind") == "heading") & (F.size(entity_names(F.col("text"))) > 1))
    heads = heads.groupBy("source", "section").agg(F.min_by("text", "ordinal").alias("_h")).select(
        "source", "section", entity_id(F.col("source"), strip(F.col("_h"))).alias("_id"), entity_names(F.col("_h")).alias("_members"))
    joined = rows.join(heads, ["source", "section"], "left")
    takes = F.col("owner_id").isNull() & F.col("_id").isNotNull()
    return joined.withColumns({
        "family_names": F.when(takes, F.col("_members")).otherwise(F.col("family_names")),
        "owner_id": F.when(takes, F.col("_id")).otherwise(F.col("owner_id")),
    }).drop("_id", "_members")


def shared_cards(blocks: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards for shared headings that have none yet: (source, entity_id, name, status)."""
    heads = blocks.filter((F.col("kind") == "heading") & (F.size(entity_names(F.col("text"))) > 1))
    wanted = heads.groupBy("source", "section").agg(F.min_by("text", "ordinal").alias("_h"))
    rows = wanted.select("source", entity_id(F.col("source"), strip(F.col("_h"))).alias("entity_id"), strip(F.col("_h")).alias("name")).distinct()
    return rows.join(cards.select("source", "entity_id"), ["source", "entity_id"], "left_anti").withColumn("status", F.lit("shared"))
