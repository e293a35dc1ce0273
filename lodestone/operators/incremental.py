"""Incremental indexing: what changed, what lacks a vector, what can be reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import stable_id, strip
from lodestone.operators.scans import running

MAX_INPUT_TOKENS = 8191
MACHINE_WARNING = "machine_extracted_unverified"


def changed_documents(new: DataFrame, old: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change): added, removed or changed; documents equal in every compared column are left out."""
    a, b = new.select(key, *compared).alias("a"), old.select(key, *compared).alias("b")
    same = F.lit(True)
    for name in compared:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    # A flag on each side tells a missing row from a row of nulls.
    both = a.withColumn("_in_a", F.lit(True)).alias("a").join(b.withColumn("_in_b", F.lit(True)).alias("b"), key, "full")
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~same, "changed")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def input_key(model: str, dims: int, text: Column) -> Column:
    return stable_id(F.lit(model), F.lit(str(dims)), text)


def missing_inputs(chunks: DataFrame, cache: DataFrame, model: str, dims: int, text: str = "embedding_input") -> DataFrame:
    """(input_hash, text): distinct inputs without a vector of this model and size. cache: input_hash, model, embedding."""
    wanted = chunks.select(F.sha2(text, 256).alias("input_hash"), text)
    wanted = wanted.groupBy("input_hash").agg(F.any_value(text).alias(text))
    usable = cache.filter((F.col("model") == model) & (F.size("embedding") == dims)).select("input_hash")
    return wanted.join(usable, "input_hash", "left_anti")


def attach_vectors(chunks: DataFrame, cache: DataFrame, text: str = "embedding_input") -> DataFrame:
    """Give every chunk the vector of its input; equal inputs share one."""
    keyed = chunks.withColumn("input_hash", F.sha2(text, 256))
    vectors = cache.groupBy("input_hash").agg(F.any_value("embedding").alias("embedding"))
    return keyed.join(vectors, "input_hash", "left")


def oversize_inputs(chunks: DataFrame, tokens: Column, limit: int = MAX_INPUT_TOKENS) -> DataFrame:
    return chunks.withColumn("tokens", tokens).filter(F.col("tokens") > limit)


def reuse_asset_text(assets: DataFrame, previous: DataFrame, version: str) -> DataFrame:
    """Take over recognised text by content hash and processor version; failed ones stay to be retried.

    assets: asset_id, content_hash, status. previous: content_hash, processor_version, status, ocr_text, vision_text.
    Adds ocr_text, vision_text, action (reuse, process, keep).
    """
    usable = previous.filter((F.col("processor_version") == version) & F.col("status").isin("processed_unverified", "ocr_only_unverified"))
    best = usable.groupBy("content_hash").agg(F.min(F.struct("asset_order", "ocr_text", "vision_text", "status")).alias("_p"))
    with_hash = assets.filter("content_hash IS NOT NULL").join(best, "content_hash", "left")
    without = assets.filter("content_hash IS NULL").withColumn("_p", F.lit(None).cast(best.schema["_p"].dataType))
    rows = with_hash.unionByName(without)
    action = F.when(F.col("content_hash").isNull(), "keep").when(F.col("_p").isNotNull(), "reuse").otherwise("process")
    return rows.select(
        *[c for c in assets.columns if c != "status"], F.coalesce("_p.status", "status").alias("status"),
        F.col("_p.ocr_text").alias("ocr_text"), F.col("_p.vision_text").alias("vision_text"), action.alias("action"))


def append_machine_text(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Blocks plus one block per recognised text, after the last ordinal, marked as unverified.

    Earlier vision blocks of the same assets are replaced. blocks: source, ordinal, kind, text, asset_ids,
    warnings. assets: source, asset_id, media_part, ocr_text, vision_text, processor_version.
    """
    vision = "vision_interpretation"
    visual = assets.filter(F.col("vision_text").isNotNull()).select("source", "asset_id").distinct()
    marks = blocks.filter(F.col("kind") == vision).select("source", "ordinal", F.explode("asset_ids").alias("asset_id"))
    replaced = marks.join(visual, ["source", "asset_id"]).select("source", "ordinal").distinct()
    kept = blocks.join(replaced, ["source", "ordinal"], "left_anti")
    hosts = blocks.filter(~F.col("kind").isin(vision, "ocr")).select("source", F.explode("asset_ids").alias("asset_id"), "ordinal")
    hosts = hosts.groupBy("source", "asset_id").agg(F.min("ordinal").alias("_host"))
    texts = assets.select("source", "asset_id", "media_part", "processor_version", F.expr(
        f"stack(2, 'ocr', ocr_text, '{vision}', vision_text) AS (kind, _text)"))
    texts = texts.filter(F.coalesce(strip(F.col("_text")), F.lit("")) != "").join(hosts, ["source", "asset_id"])
    last = blocks.groupBy("source").agg(F.max("ordinal").alias("_last"))
    order = ["_host", "asset_id", "kind"]
    numbered = running(texts, ["source"], order, {"_n": ("count", F.lit(1))})
    note = F.concat(F.lit("["), "kind", F.lit(": машинное извлечение, требуется проверка по изображению "), "media_part", F.lit("]\n"), "_text")
    added = numbered.join(last, "source").select(
        "source", (F.col("_last") + F.col("_n")).cast(blocks.schema["ordinal"].dataType).alias("ordinal"), "kind", note.alias("text"),
        F.array("asset_id").alias("asset_ids"), F.array(F.lit(MACHINE_WARNING)).alias("warnings"),
        stable_id(F.col("asset_id"), F.col("kind"), F.col("processor_version")).alias("block_id"))
    return kept.unionByName(added, allowMissingColumns=True)
