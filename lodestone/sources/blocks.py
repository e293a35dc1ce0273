"""Blocks from lines of text and from structured raw elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import entity_name, stable_id, strip
from lodestone.operators.scans import running

# Fixed values.
NO_SECTION = "Без раздела"
PAGE_LABEL = "Страница "
IMAGE_TEXT = "[Изображение: содержимое ещё не распознано]"
IMAGE_ROW_TEXT = "[Изображение в таблице: содержимое ещё не распознано]"
NAME_FIELD = r"(?iuU)(?:Имя|Название)\s+семейства\s*[:：]\s*([^\r\n;]+)"
NAME_COLUMN = r"(?iuU)^(?:(?:имя|название)\s+)?семейств[оа]$"
LEVELS = range(9)


def blocks_from_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One block per non-blank line, labelled with its line number as page; ordinals start at 0."""
    lines = F.transform(
        F.split(F.col(text), "\n"), lambda line, i: F.struct((i + 1).alias("page"), strip(line).alias("text"))
    )
    kept = F.filter(lines, lambda r: r["text"] != "")
    return docs.select(key, F.posexplode(kept).alias("ordinal", "_b")).select(
        key,
        "ordinal",
        F.concat(F.lit(PAGE_LABEL), F.col("_b.page")).alias("section"),
        F.col("_b.text").alias("text"),
        F.lit("paragraph").alias("kind"),
    )


def structure_blocks(raw: DataFrame) -> DataFrame:
    """Blocks with section path, kind, ordinal, headers and inherited entity names.

    ``raw``: source, pos, level, kind ('paragraph' | 'row'), text, table_id, cells, asset_ids, deleted.
    """
    rows = raw.filter(~F.coalesce("deleted", F.lit(False)))
    has_asset = F.size(F.coalesce("asset_ids", F.array().cast("array<string>"))) > 0
    table_row = F.col("kind") == "row"
    rows = rows.withColumn("text", F.when(table_row, F.col("text")).otherwise(strip(F.col("text"))))
    blank = F.coalesce(strip(F.col("text")) == "", F.lit(True))
    rows = rows.filter(~blank | has_asset).withColumn(
        "text", F.when(~blank, F.col("text")).when(table_row, IMAGE_ROW_TEXT).otherwise(IMAGE_TEXT)
    )
    names = F.transform(F.regexp_extract_all("text", F.lit(NAME_FIELD), F.lit(1)), strip)
    rows = rows.withColumn("_explicit", F.when(~table_row & (F.size(names) > 0), names))
    heading = F.col("level").isNotNull()
    values: dict[str, tuple[str, Column]] = {
        f"_h{n}": ("last", F.when(F.col("level") == n, F.struct("pos", "text"))) for n in LEVELS
    }
    values["_named"] = ("last", F.when(F.col("_explicit").isNotNull(), F.struct("pos", F.col("_explicit").alias("names"))))
    values["ordinal"] = ("count", F.lit(1))
    rows = running(rows, ["source"], ["pos"], values)

    # A heading is live until one of its own or a higher level follows it.
    def position(n: int) -> Column:
        return F.coalesce(F.col(f"_h{n}.pos"), F.lit(-1))

    live = []
    for n in LEVELS:
        above = F.greatest(F.lit(-1), *[position(m) for m in range(n)]) if n else F.lit(-1)
        live.append(F.when(position(n) > above, F.col(f"_h{n}.text")))
    rows = rows.withColumn("_path", F.array_compact(F.array(*live)))
    last_heading = F.greatest(F.lit(-1), *[position(n) for n in LEVELS])
    inherited = F.array_distinct(F.filter("_path", lambda t: entity_name(t).isNotNull()))
    rows = rows.withColumns(
        {
            "section": F.when(F.size("_path") == 0, NO_SECTION).otherwise(F.array_join("_path", " / ")),
            "_names": F.when(F.coalesce(F.col("_named.pos") >= last_heading, F.lit(False)), F.col("_named.names")).otherwise(inherited),
        }
    ).drop("_path", "_named", *[f"_h{n}" for n in LEVELS])

    plain = rows.filter(F.col("table_id").isNull()).withColumns(
        {"row": F.lit(None).cast("long"), "table_headers": F.array().cast("array<string>"), "family_names": F.col("_names")}
    )
    tables = running(rows.filter(F.col("table_id").isNotNull()), ["source", "table_id"], ["pos"], {"row": ("count", F.lit(1))})
    heads = tables.filter("row = 1").select("source", "table_id", F.col("cells").alias("table_headers"))
    column = F.array_position(F.transform("table_headers", lambda c: strip(c).rlike(NAME_COLUMN)), True)
    named = F.when(column > 0, F.get(F.col("cells"), (column - 1).cast("int")))
    tables = tables.join(heads, ["source", "table_id"], "left").withColumn(
        "family_names", F.when(entity_name(named).isNotNull(), F.array(strip(named))).otherwise(F.col("_names"))
    )
    both = plain.unionByName(tables)
    return both.select(
        "source",
        F.col("ordinal").cast("long").alias("ordinal"),
        "section",
        "text",
        F.when(F.col("row").isNotNull(), F.concat(F.lit("table-row:"), F.col("row")))
        .when(F.col("level").isNotNull(), "heading")
        .otherwise("paragraph")
        .alias("kind"),
        F.col("level").cast("int").alias("heading_level"),
        "family_names",
        stable_id(F.col("source"), F.col("pos")).alias("block_id"),
        "table_id",
        "row",
        "cells",
        "table_headers",
        F.coalesce("asset_ids", F.array().cast("array<string>")).alias("asset_ids"),
    )


PAGE_TAGS = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"


def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Raw elements of web pages: headings, paragraphs and list items, in page order."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    zipped = F.arrays_zip(
        F.regexp_extract_all(clean, F.lit(PAGE_TAGS), F.lit(1)).alias("tag"),
        F.regexp_extract_all(clean, F.lit(PAGE_TAGS), F.lit(2)).alias("body"),
    )
    rows = pages.select(F.col(key).cast("string").alias("source"), F.posexplode(zipped).alias("pos", "_e"))
    return rows.select(
        "source",
        F.col("pos").cast("long").alias("pos"),
        F.when(F.lower("_e.tag").startswith("h"), F.substring("_e.tag", 2, 1).cast("int") - 1).alias("level"),
        F.lit("paragraph").alias("kind"),
        strip(F.regexp_replace("_e.body", r"<[^>]*>", " ")).alias("text"),
        F.lit(None).cast("string").alias("table_id"),
        F.array().cast("array<string>").alias("cells"),
        F.array().cast("array<string>").alias("asset_ids"),
        F.lit(False).alias("deleted"),
    )
