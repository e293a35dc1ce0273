"""Windows, structural groups, packing, spans, parents, passages, excerpts and quotes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import Pieces, bind, char_grams, retrieval_tokens, stable_id, strip, token_count, token_pieces
from lodestone.operators.folds import Fold, counted, segmented_fold
from lodestone.operators.scans import previous, running, top_rows
from lodestone.session import cut_lineage


SEGMENT = 4096


def _windows(pieces: Column, text: Column, size: int | Column, overlap: int | Column) -> Column:
    """Array of windows (start, end, text, tokens); offsets in code points, last window ends the text.

    One pass over the pieces finds where windows start and end; a window's text comes from the segments it touches, so
    the work is in proportion to the text.
    """
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    step = size - overlap
    n = F.size(pieces)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    none = F.array().cast("array<int>")

    def add(acc: Column, length: Column) -> Column:
        i, at = acc["i"], acc["at"]
        return F.struct(
            (at + length).alias("at"), (i + 1).alias("i"),
            F.when(i % step == 0, F.concat(acc["starts"], F.array(at))).otherwise(acc["starts"]).alias("starts"),
            F.when((i >= size - 1) & ((i - size + 1) % step == 0), F.concat(acc["ends"], F.array(at + length))).otherwise(acc["ends"]).alias("ends"))

    places = F.aggregate(F.transform(pieces, F.length), F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("starts"), none.alias("ends")), add)
    segments = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    held = F.struct(places.alias("places"), segments.alias("segments"), F.length(text).alias("total"), count.alias("count"), n.alias("n"))

    def window(h: Column, k: Column) -> Column:
        start = F.coalesce(F.get(h["places"]["starts"], k), F.lit(0))
        end = F.when(k == h["count"] - 1, h["total"]).otherwise(F.get(h["places"]["ends"], k))
        first = F.floor(start / SEGMENT).cast("int")
        touched = F.slice(h["segments"], first + 1, F.floor(end / SEGMENT).cast("int") - first + 1)
        body = F.substring(F.array_join(touched, ""), start - first * SEGMENT + 1, end - start)
        return F.struct(start.alias("start"), end.alias("end"), body.alias("text"), F.least(size, h["n"] - k * step).cast("int").alias("tokens"))

    return bind(held, lambda h: F.filter(F.transform(F.sequence(F.lit(0), h["count"] - 1), lambda k: window(h, k)), lambda w: strip(w["text"]) != ""))


def fixed_windows(
    df: DataFrame, keys: list[str], text: str = "text", size: int | Column = 600, overlap: int | Column = 100, pieces: Pieces = token_pieces,
) -> DataFrame:
    """Overlapping token windows of a text: (keys, window, start, end, text, token_count), by any tokenizer."""
    if isinstance(size, int) and isinstance(overlap, int) and (size < 8 or not 0 <= overlap < size):
        raise ValueError("size must be at least 8 and overlap smaller than size")
    sizes = [x if isinstance(x, Column) else F.lit(x) for x in (size, overlap)]
    cut = df.filter(strip(F.col(text)) != "").select(
        *keys, F.col(text).alias("_text"), pieces(F.col(text)).alias("_pieces"), sizes[0].alias("_size"), sizes[1].alias("_over"))
    rows = cut.select(*keys, F.posexplode(_windows(F.col("_pieces"), F.col("_text"), F.col("_size"), F.col("_over"))).alias("window", "_w"))
    return rows.select(*keys, "window", "_w.start", "_w.end", "_w.text", F.col("_w.tokens").alias("token_count"))


def structural_groups(blocks: DataFrame) -> DataFrame:
    """Add group_id: blocks of one entity, or of one section outside entities, in order.

    A boundary compares a block with the one before it, which agrees with the head of its group.
    """
    seen = previous(blocks, ["source"], ["ordinal"], {
        "_names": F.col("family_names"), "_kind": F.col("kind"), "_section": F.col("section")})
    vision = "vision_interpretation"
    outside = F.size("family_names") == 0
    boundary = (
        F.col("_names").isNull() | (F.col("family_names") != F.col("_names"))
        | (F.col("kind") == vision) | (F.col("_kind") == vision)
        | (outside & ((F.col("kind") == "heading") | (F.col("section") != F.col("_section"))))
        | ((F.col("kind") == "heading") & F.array_contains("family_names", F.col("text")))
    )
    starts = F.when(boundary, 1).otherwise(0)
    out = running(seen, ["source"], ["ordinal"], {"group_id": ("sum", starts)})
    return out.drop("_names", "_kind", "_section")


def _packing(size: int) -> Fold:
    """State: tokens in the open pack (0 = none). An oversized block stands alone."""

    def step(state, tokens):
        if tokens > size:
            return 0, True
        if state and state + tokens <= size:
            return state + tokens, False
        return tokens, True

    def sweep(states, tokens):
        if tokens > size:
            return np.zeros_like(states)
        return np.where((states > 0) & (states + tokens <= size), states + tokens, tokens)

    return Fold(step, sweep, **counted(size))


def pack_blocks(blocks: DataFrame, keys: list[str], size: int, tokens: str = "token_count") -> DataFrame:
    """Greedy packing of blocks in order: add pack (ordinal of its first block).

    The fold state is the token count of the open pack, so long groups are folded in segments.
    """
    marked = segmented_fold(blocks, keys, ["ordinal"], [tokens], _packing(size), "_starts", "boolean")
    first = F.when(F.col("_starts"), F.col("ordinal"))
    return running(marked, keys, ["ordinal"], {"pack": ("max", first)}).drop("_starts")


def pack_texts(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Text of every pack, blocks joined by a blank line; a pack holds at most ``size`` tokens or one block.

    Packs of blocks that come without texts list their ordinals only.
    """
    carried = [c for c in ("ordinal", "text") if c in packed.columns]
    grouped = packed.groupBy(*keys, "pack").agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("_b"))
    text = [F.array_join(F.transform("_b", lambda b: b["text"]), "\n\n").alias("text")] if "text" in carried else []
    return grouped.select(*keys, "pack", *text, F.transform("_b", lambda b: b["ordinal"]).alias("block_ordinals"))


def block_offsets(blocks: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Character range of every block in its joined text (blocks joined by a blank line)."""
    ends = running(blocks, keys, [ordinal], {"_end": ("sum", F.length("text") + 2)})
    end = (F.col("_end") - 2).cast("long")
    return ends.withColumns({"block_start": end - F.length("text"), "block_end": end}).drop("_end")


def chunk_spans(windows: DataFrame, blocks: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Which blocks every window covers, with the exact range on both sides.

    Windows and blocks are cut to cells of ``width`` characters and joined on (keys, cell); a pair is
    reported in the cell where it first overlaps, so a long document spreads over its cells.
    """

    def cells(start: str, end: str) -> Column:
        last = F.greatest(F.col(end) - 1, F.col(start))
        return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width)))

    left = windows.withColumn("_cell", cells("start", "end"))
    right = blocks.select(*keys, "ordinal", "block_start", "block_end", *[c for c in blocks.columns if c in ("owner_id", "block_id")])
    right = right.withColumn("_cell", cells("block_start", "block_end"))
    begin, finish = F.greatest("start", "block_start"), F.least("end", "block_end")
    hits = left.join(right, [*keys, "_cell"]).filter(
        (F.col("block_start") < F.col("end")) & (F.col("block_end") > F.col("start")) & (F.floor(begin / width) == F.col("_cell")))
    return hits.withColumns({
        "span_start": (begin - F.col("start")).cast("long"),
        "span_end": (finish - F.col("start")).cast("long"),
        "source_start": F.greatest(F.col("start") - F.col("block_start"), F.lit(0)).cast("long"),
        "source_end": (finish - F.col("block_start")).cast("long"),
    }).drop("_cell")


def chunk_rollup(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk: covered blocks, distinct sections in order, and the owner if there is only one.

    A chunk covers at most as many blocks as it has tokens. spans: keys, ordinal, section, owner_id.
    """
    distinct = F.array_sort(F.collect_list(F.struct(F.col("_first"), F.col("section"))))
    firsts = spans.groupBy(*keys, "section").agg(
        F.min("ordinal").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("owner_id").alias("_lo"), F.max("owner_id").alias("_hi"),
        F.sum(F.when(F.col("owner_id").isNull(), 1).otherwise(0)).alias("_null"))
    lo, hi = F.min("_lo"), F.max("_hi")
    return firsts.groupBy(*keys).agg(
        F.sum("_n").alias("n_blocks"),
        F.array_join(F.transform(distinct, lambda r: r["section"]), "; ").alias("section"),
        F.when((lo == hi) & (F.sum("_null") == 0), lo).alias("owner_id"),
    )


def link_parents(children: DataFrame, parents: DataFrame, key: str = "source") -> DataFrame:
    """First parent that holds all blocks of a child; (key, chunk_id, block_ordinals) on both sides.

    Parents and children meet on each child's first block, so a document is split by block.
    """
    p = parents.select(key, F.col("chunk_id").alias("parent_id"), F.col("block_ordinals").alias("_p"))
    p = p.withColumn("_at", F.explode("_p"))
    c = children.withColumn("_at", F.get("block_ordinals", F.lit(0)))
    inside = F.size(F.array_except("block_ordinals", "_p")) == 0
    hits = c.join(p, [key, "_at"]).filter(inside)
    best = hits.groupBy(key, "chunk_id").agg(F.min_by("parent_id", F.struct(F.get("_p", F.lit(0)), "parent_id")).alias("parent_id"))
    return children.join(best, [key, "chunk_id"], "left")


#: Lengths of the anchors on which texts meet the lines that may hold them.
ANCHORS = (16, 4, 1)


def _within_lines(texts: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): texts of one line that occur within a line, met on their first characters."""
    found = None
    for size, longer in zip(ANCHORS, (1 << 30, *ANCHORS)):
        some = texts.filter((F.length("text") >= size) & (F.length("text") < longer)).withColumn("_gram", F.substring("text", 1, size))
        grams = lines.join(some.select(*keys).distinct(), keys, "left_semi").select(*keys, "role", "place", F.explode(char_grams(F.col("line"), size)).alias("_gram"))
        met = some.join(grams, [*keys, "_gram"]).drop("_gram").join(lines, [*keys, "role", "place"]).filter(F.contains("line", "text"))
        met = met.select(*keys, "text").distinct()
        found = met if found is None else found.unionByName(met)
    return found


def _across_lines(texts: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): texts of several lines that occur in the joined lines of a role.

    The first line of such a text ends a line, the last one begins one, and those between are whole lines, each behind
    the other. Texts meet lines on the end of their first line; the rest is compared by place.
    """
    size = F.least(F.length("_first"), F.lit(ANCHORS[0]))
    rows = texts.withColumn("_l", F.split("text", "\n")).withColumn("_first", F.get("_l", F.lit(0)))
    rows = rows.withColumn("_end", F.struct(size.alias("n"), F.when(size > 0, F.expr("right(_first, least(length(_first), 16))")).otherwise("").alias("t")))
    ends = F.transform(F.sequence(F.lit(0), F.lit(ANCHORS[0])), lambda n: F.struct(
        n.alias("n"), F.when(n > 0, F.substring("line", F.length("line") - n + 1, n)).otherwise("").alias("t")))
    ending = lines.select(*keys, "role", "place", "line", F.explode(F.filter(ends, lambda e: e["n"] <= F.length("line"))).alias("_end"))
    begun = rows.join(ending, [*keys, "_end"]).filter(F.endswith("line", "_first")).select(*keys, "text", "role", F.col("place").alias("_at"), "_l")
    rest = begun.select(*keys, "text", "role", "_at", F.size("_l").alias("_n"), F.posexplode("_l").alias("_i", "_own")).filter("_i > 0")
    rest = rest.withColumn("place", F.col("_at") + F.col("_i"))
    same = F.when(F.col("_i") == F.col("_n") - 1, F.startswith("line", "_own")).otherwise(F.col("line") == F.col("_own"))
    held = rest.join(lines, [*keys, "role", "place"]).filter(same).groupBy(*keys, "text", "role", "_at", "_n").agg(F.count(F.lit(1)).alias("_same"))
    return held.filter("_same = _n - 1").select(*keys, "text").distinct()


def quoted_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks of an entity without warnings whose text is quoted in its purpose or its constraints, on one line or over several.

    Entities without a purpose have none. lines: source, entity_id, role, ordinal, text; the texts of a role, joined by
    line feeds in order, are what may quote a block.
    """
    keys = ["source", "owner_id"]
    owned = blocks.filter(F.col("owner_id").isNotNull() & (F.size("warnings") == 0))
    lines = lines.withColumnRenamed("entity_id", "owner_id")
    purposeful = lines.filter("role = 'purpose'").select(*keys).distinct()
    owned = owned.join(purposeful, keys, "left_semi")
    cut = lines.select(*keys, "role", "ordinal", F.posexplode(F.split("text", "\n")).alias("_i", "line"))
    placed = running(cut, [*keys, "role"], ["ordinal", "_i"], {"place": ("count", F.lit(1))}).select(*keys, "role", "place", "line")
    placed = cut_lineage(placed)
    texts = owned.select(*keys, "text").distinct()
    several = F.contains("text", F.lit("\n"))
    quoted = _within_lines(texts.filter(~several), placed, keys).unionByName(_across_lines(texts.filter(several), placed, keys))
    # An empty text is part of every other one.
    return owned.join(quoted.unionByName(texts.filter("text = ''")), [*keys, "text"], "left_semi")


def card_chunks(blocks: DataFrame, lines: DataFrame, size: int = 650, pieces: Pieces | None = None) -> DataFrame:
    """Separate chunks, kind 'family_card', from the blocks quoted in purpose or constraints of an entity.

    Entities without a purpose have no card chunk.
    """
    grouped = structural_groups(quoted_blocks(blocks, lines).withColumn("token_count", token_count(F.col("text"), pieces)))
    keys = ["source", "owner_id", "group_id"]
    chunks = pack_texts(pack_blocks(grouped, keys, size), keys)
    return chunks.withColumns({
        "kind": F.lit("family_card"),
        "chunk_id": stable_id(F.lit("card"), F.col("source"), F.col("owner_id"), F.col("pack").cast("string"), F.col("text")),
    })


def passages(chunks: DataFrame, key: str, size: int, overlap: int, heading: Column | None = None, pieces: Pieces = token_pieces) -> DataFrame:
    """Token windows of chunks as passages, with an optional heading line in front."""
    rows = fixed_windows(chunks, [key], "text", size, overlap, pieces)
    if heading is not None:
        heads = chunks.select(key, heading.alias("_heading"))
        rows = rows.join(heads, key).withColumn("text", F.concat_ws("\n", "_heading", "text")).drop("_heading")
    return rows


def best_excerpt(
    pairs: DataFrame, keys: list[str], size: int | Column, overlap: int | Column | None = None, pieces: Pieces = token_pieces,
) -> DataFrame:
    """Window of each text with most distinct query terms, then most hits, then earliest.

    pairs: keys, text, terms (array of distinct query terms).
    """
    if overlap is None:
        overlap = min(48, size // 4) if isinstance(size, int) else F.least(F.lit(48), F.floor(size / 4).cast("int"))
    windows = fixed_windows(pairs, keys, "text", size, overlap, pieces)
    scored = windows.join(pairs.select(*keys, "terms"), keys).withColumn("_t", retrieval_tokens(F.col("text")))
    scored = scored.withColumns({
        "distinct_hits": F.size(F.array_intersect("_t", "terms")),
        "hits": F.size(F.filter("_t", lambda t: F.array_contains("terms", t))),
    })
    best = top_rows(scored, keys, [F.desc("distinct_hits"), F.desc("hits"), "start"], 1, "_rank")
    return best.drop("_rank", "_t", "terms", "window")


def excerpt_spans(excerpts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of a chunk as the excerpt has them: those that it touches, cut at its ends on both sides.

    excerpts: keys, start, end. spans: keys, span_start, span_end, source_start, source_end and what else they carry.
    """
    rows = spans.join(excerpts.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b")), keys)
    inside = rows.filter((F.col("span_start") < F.col("_b")) & (F.col("span_end") > F.col("_a")))
    return inside.withColumns({
        "span_start": F.greatest("span_start", "_a") - F.col("_a"),
        "span_end": F.least("span_end", "_b") - F.col("_a"),
        "source_start": F.col("source_start") + F.greatest(F.lit(0), F.col("_a") - F.col("span_start")),
        "source_end": F.col("source_end") - F.greatest(F.lit(0), F.col("span_end") - F.col("_b")),
    }).drop("_a", "_b")


def evidence_lines(chunks: DataFrame, keys: list[str], limit: int = 220) -> DataFrame:
    """Lines as quotes of at most ``limit`` characters, broken at the last blank past 80, in order."""
    spans = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^\r\n]+"), F.lit(0)), strip), lambda s: s != "")
    # The rest if it fits; else up to the last blank after 81 characters or more; else exactly the limit.
    piece = rf"(?s).{{1,{limit}}}\z|.{{81,{limit - 1}}} |.{{{limit}}}"
    cut = F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(piece), F.lit(0)))
    quotes = F.flatten(F.transform(cut, lambda parts: F.transform(parts, strip)))
    return chunks.select(*keys, F.posexplode(quotes).alias("_i", "quote")).select(*keys, (F.col("_i") + 1).alias("line"), "quote")


def literal_slices(df: DataFrame, keys: list[str], text: str = "text", length: int = 600) -> DataFrame:
    """Fixed-length literal slices of a text."""
    slices = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    return df.select(*keys, F.posexplode(slices).alias("slice", "text"))
