"""Queries over chunking operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodestone.functions.text import retrieval_tokens, token_count
from lodestone.operators import chunking as C, entities as E
from lodestone.queries import duck as D
from lodestone.queries.corpus import OWNED
from lodestone.queries.entities import CARDS, classified, owned
from lodestone.queries.text import LINE_BLOCKS
from lodestone.registry import query
from lodestone.session import cut_lineage, table
from lodestone.sources.blocks import blocks_from_lines

PIECE = r"\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"


def windows_sql(source: str, keys: str, size: int, overlap: int) -> str:
    """Windows of ``text`` in a relation that has the key columns."""
    step = size - overlap
    return f"""SELECT {keys}, CAST(k AS INTEGER) AS "window", CAST(st AS INTEGER) AS "start", CAST(CASE WHEN k = cnt - 1 THEN length(text) ELSE st + length(body) END AS INTEGER) AS "end",
  CASE WHEN k = cnt - 1 THEN substr(text, st + 1) ELSE body END AS text FROM (
  SELECT {keys}, text, k, cnt, length(array_to_string(pieces[1 : k * {step}], '')) AS st, array_to_string(pieces[k * {step} + 1 : k * {step} + {size}], '') AS body FROM (
    SELECT *, unnest(range(cnt)) AS k FROM (SELECT *, CAST(CASE WHEN len(pieces) <= {size} THEN 1 ELSE ceil((len(pieces) - {size}) / {step}) + 1 END AS BIGINT) AS cnt FROM (
      SELECT {keys}, text, regexp_extract_all(text, '{PIECE}') AS pieces FROM {source} WHERE {D.strip('text')} <> ''))))"""


@query("fixed_windows", f"SELECT *, {D.token_count('text')} AS token_count FROM ({windows_sql('documents', 'doc_id', 600, 100)})")
def fixed_windows(spark, d):
    return C.fixed_windows(table(spark, d, "documents"), ["doc_id"])


GROUPS = f"""{OWNED},
named2 AS (SELECT *, CASE WHEN owner_name IS NULL THEN '' WHEN owner_name LIKE '% / %' THEN replace(owner_name, ' / ', '|') ELSE owner_name END AS names FROM owned),
lagged AS (SELECT *, lag(names) OVER w AS pn, lag(section) OVER w AS ps, lag(kind) OVER w AS pk FROM named2 WINDOW w AS (PARTITION BY source ORDER BY ordinal)),
grouped AS (SELECT *, sum(CASE WHEN pn IS NULL OR names <> pn OR (names = '' AND (kind = 'heading' OR section <> ps)) OR (kind = 'heading' AND list_contains(string_split(names, '|'), text))
  THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ordinal) AS group_id FROM lagged)"""


@query("structural_groups", f"WITH {GROUPS} SELECT source, ordinal, CAST(group_id AS BIGINT) AS group_id FROM grouped")
def structural_groups(spark, d):
    return C.structural_groups(owned(spark, d)[0]).select("source", "ordinal", F.col("group_id").cast("long").alias("group_id"))


PACK = 60
PACKED_LINES = f"""SELECT doc_id, ordinal, n, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ordinal) AS pack_no FROM (
  SELECT doc_id, unnest(f.o) AS ordinal, unnest(f.t) AS n, unnest(f.s) AS s FROM (SELECT doc_id, list_reduce(list_transform(l, lambda x: {{'open': 0, 'o': [x.ordinal], 't': [x.n], 's': [true]}}),
    lambda acc, x: {{'open': CASE WHEN x.t[1] > {PACK} THEN 0 WHEN acc.open > 0 AND acc.open + x.t[1] <= {PACK} THEN acc.open + x.t[1] ELSE x.t[1] END,
      'o': list_concat(acc.o, x.o), 't': list_concat(acc.t, x.t),
      's': list_append(acc.s, NOT (x.t[1] <= {PACK} AND acc.open > 0 AND acc.open + x.t[1] <= {PACK}))}},
    {{'open': 0, 'o': CAST([] AS INTEGER[]), 't': CAST([] AS INTEGER[]), 's': CAST([] AS BOOLEAN[])}}) AS f
  FROM (SELECT doc_id, list({{'ordinal': ordinal, 'n': n}} ORDER BY ordinal) AS l FROM (SELECT doc_id, ordinal, {D.token_count('text')} AS n FROM ({LINE_BLOCKS})) GROUP BY doc_id)))"""


def line_blocks(spark, d):
    return blocks_from_lines(table(spark, d, "documents")).withColumn("token_count", token_count(F.col("text")))


@query("pack_blocks", f"""SELECT doc_id, ordinal, n AS token_count, min(ordinal) OVER (PARTITION BY doc_id, pack_no) AS pack FROM ({PACKED_LINES})""")
def pack_blocks(spark, d):
    packed = C.pack_blocks(line_blocks(spark, d), ["doc_id"], PACK)
    return packed.select("doc_id", "ordinal", "token_count", "pack")


OFFSETS = f"""SELECT doc_id, ordinal, section, text AS block_text, CAST(e - length(text) AS BIGINT) AS block_start, CAST(e AS BIGINT) AS block_end FROM (
  SELECT *, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal) - 2 AS e FROM ({LINE_BLOCKS}))"""
JOINED = f"(SELECT doc_id, string_agg(block_text, chr(10) || chr(10) ORDER BY ordinal) AS text FROM ({OFFSETS}) GROUP BY doc_id)"
SPANS = f"""SELECT w.doc_id, w."window", b.ordinal, b.section, CAST(greatest(w."start", block_start) - w."start" AS BIGINT) AS span_start,
  CAST(least(w."end", block_end) - w."start" AS BIGINT) AS span_end, CAST(greatest(w."start" - block_start, 0) AS BIGINT) AS source_start,
  CAST(least(w."end", block_end) - block_start AS BIGINT) AS source_end
  FROM ({windows_sql(JOINED, 'doc_id', 120, 20)}) w JOIN ({OFFSETS}) b ON w.doc_id = b.doc_id AND block_start < w."end" AND block_end > w."start" """


def line_spans(spark, d):
    blocks = C.block_offsets(line_blocks(spark, d), ["doc_id"])
    texts = table(spark, d, "documents").select("doc_id", F.array_join(
        F.filter(F.transform(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(D.WHITE))), lambda s: s != ""), "\n\n").alias("text"))
    windows = C.fixed_windows(texts, ["doc_id"], "text", 120, 20).drop("text", "token_count")
    spans = C.chunk_spans(windows, blocks, ["doc_id"])
    return spans.join(blocks.select("doc_id", "ordinal", "section"), ["doc_id", "ordinal"])


@query("chunk_spans", f"SELECT * FROM ({SPANS})")
def chunk_spans(spark, d):
    return line_spans(spark, d).select("doc_id", "window", "ordinal", "section", "span_start", "span_end", "source_start", "source_end")


@query("chunk_rollup", f"""SELECT doc_id, "window", count(*) AS n_blocks, string_agg(section, '; ' ORDER BY ordinal) AS section,
CASE WHEN count(DISTINCT ordinal % 2) = 1 THEN CAST(min(ordinal % 2) AS VARCHAR) END AS owner_id FROM ({SPANS}) GROUP BY ALL""")
def chunk_rollup(spark, d):
    spans = line_spans(spark, d).withColumn("owner_id", (F.col("ordinal") % 2).cast("string"))
    return C.chunk_rollup(spans, ["doc_id", "window"])


def packs(sizes, size):
    grouped = C.pack_texts(C.pack_blocks(sizes, ["doc_id"], size), ["doc_id"])
    return grouped.select("doc_id", F.col("pack").cast("string").alias("chunk_id"), "block_ordinals")


def _packed(size: int) -> str:
    return PACKED_LINES.replace(f"> {PACK} ", f"> {size} ").replace(f"<= {PACK}", f"<= {size}")


@query("link_parents", f"""WITH c AS (SELECT doc_id, min(ordinal) AS chunk, list(ordinal ORDER BY ordinal) AS o FROM ({_packed(60)}) GROUP BY doc_id, pack_no),
p AS (SELECT doc_id, min(ordinal) AS chunk, list(ordinal ORDER BY ordinal) AS o FROM ({_packed(150)}) GROUP BY doc_id, pack_no)
SELECT c.doc_id, CAST(c.chunk AS VARCHAR) AS chunk_id, CAST(min(p.chunk) AS VARCHAR) AS parent_id FROM c LEFT JOIN p ON c.doc_id = p.doc_id AND list_has_all(p.o, c.o)
GROUP BY c.doc_id, c.chunk""")
def link_parents(spark, d):
    # Blocks are cut and counted once for both sizes; their texts have no part in which blocks a pack holds.
    sizes = cut_lineage(line_blocks(spark, d).select("doc_id", "ordinal", "token_count"))
    return C.link_parents(packs(sizes, 60), packs(sizes, 150), "doc_id").select("doc_id", "chunk_id", "parent_id")


# Blocks of two lines stand beside those of the corpus: a block with the one behind it of the same owner.
LINE_STEP = 1_000_000_000_000


@query("quoted_blocks", f"""WITH {CARDS}, plain AS (SELECT source, ordinal, owner_name, text FROM classified WHERE owner_name IS NOT NULL AND NOT coalesce(conflict, false)),
both_ AS (SELECT * FROM plain UNION ALL SELECT source, ordinal + {LINE_STEP}, owner_name, text || chr(10) || after
  FROM (SELECT *, lead(text) OVER (PARTITION BY source, owner_name ORDER BY ordinal) AS after FROM plain) WHERE after IS NOT NULL)
SELECT b.source, b.ordinal FROM both_ b JOIN cards c ON c.source = b.source AND c.name = b.owner_name
WHERE c.purpose <> '' AND (contains(c.purpose, b.text) OR contains(c.constraints, b.text))""")
def quoted_blocks(spark, d):
    blocks = classified(spark, d)[0]
    order = Window.partitionBy("source", "owner_id").orderBy("ordinal")
    plain = blocks.filter(F.col("owner_id").isNotNull() & (F.size("warnings") == 0))
    pairs = plain.withColumn("_after", F.lead("text").over(order)).filter("_after IS NOT NULL").withColumns({
        "ordinal": F.col("ordinal") + F.lit(LINE_STEP), "text": F.concat_ws("\n", "text", "_after")}).drop("_after")
    return C.quoted_blocks(blocks.unionByName(pairs), E.card_lines(blocks)).select("source", "ordinal")


@query("card_chunks")
def card_chunks(spark, d):
    blocks = classified(spark, d)[0]
    return C.card_chunks(blocks, E.card_lines(blocks)).select("source", "owner_id", "pack", "text", "kind", "chunk_id")


@query("passages", f"""SELECT doc_id, "window", "start", "end", lang || '; ' || source || chr(10) || p.text AS text, {D.token_count('p.text')} AS token_count
FROM ({windows_sql('documents', 'doc_id', 300, 50)}) p JOIN documents USING (doc_id)""".replace("p.text", "p.text"))
def passages(spark, d):
    docs = table(spark, d, "documents")
    return C.passages(docs, "doc_id", 300, 50, F.concat_ws("; ", "lang", "source"))


TERMS = "(SELECT doc_id, list_distinct(" + D.retrieval_tokens("substr(text, CAST(floor(n_chars / 2) AS BIGINT) + 1, 60)") + ") AS terms FROM documents)"


@query("best_excerpt", f"""SELECT doc_id, "start", "end", text, token_count, distinct_hits, hits FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distinct_hits DESC, hits DESC, "start") AS rn FROM (
 SELECT w.*, {D.token_count('text')} AS token_count, CAST(len(list_intersect(t, terms)) AS INTEGER) AS distinct_hits, CAST(len(list_filter(t, lambda x: list_contains(terms, x))) AS INTEGER) AS hits FROM (
  SELECT *, {D.retrieval_tokens('text')} AS t FROM ({windows_sql('documents', 'doc_id', 100, 25)})) w JOIN {TERMS} USING (doc_id))) WHERE rn = 1""".replace(
    "w.*", 'doc_id, "start", "end", text'))
def best_excerpt(spark, d):
    docs = table(spark, d, "documents")
    middle = F.substring("text", (F.floor(F.col("n_chars") / 2) + 1).cast("int"), F.lit(60))
    pairs = docs.select("doc_id", "text", F.array_distinct(retrieval_tokens(middle)).alias("terms"))
    return C.best_excerpt(pairs, ["doc_id"], 100)


SEGMENTS = """SELECT doc_id, CAST(k * 70 AS INTEGER) AS span_start, CAST(least((k + 1) * 70, length(text)) AS INTEGER) AS span_end,
  CAST(k * 70 + 1000 AS INTEGER) AS source_start, CAST(least((k + 1) * 70, length(text)) + 1000 AS INTEGER) AS source_end, CAST(k AS INTEGER) AS ordinal FROM ({unnested})"""


@query("excerpt_spans", f"""WITH w AS ({windows_sql('documents', 'doc_id', 100, 25)}), e AS (SELECT doc_id, "start" AS a, "end" AS b FROM w WHERE "window" = 1),
s AS ({SEGMENTS.format(unnested='SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 70) AS BIGINT))) AS k FROM documents')})
SELECT doc_id, ordinal, greatest(span_start, a) - a AS span_start, least(span_end, b) - a AS span_end, source_start + greatest(0, a - span_start) AS source_start,
 source_end - greatest(0, span_end - b) AS source_end FROM s JOIN e USING (doc_id) WHERE span_start < b AND span_end > a""")
def excerpt_spans(spark, d):
    docs = table(spark, d, "documents")
    second = C.fixed_windows(docs, ["doc_id"], "text", 100, 25).filter("window = 1")
    docs.createOrReplaceTempView("documents")
    cells = "SELECT doc_id, text, explode(sequence(0, CAST(ceil(length(text) / 70) AS BIGINT) - 1)) AS k FROM documents WHERE length(text) > 0"
    return C.excerpt_spans(second, spark.sql(SEGMENTS.format(unnested=cells)), ["doc_id"])


@query("evidence_lines", f"""SELECT doc_id, CAST(i AS INTEGER) AS line, q AS quote FROM (SELECT doc_id, unnest(l) AS q, generate_subscripts(l, 1) AS i FROM (
SELECT doc_id, flatten(list_transform(list_filter(list_transform(regexp_extract_all(text, '[^\\r\\n]+'), lambda s: {D.strip('s')}), lambda s: s <> ''),
 lambda s: list_transform(regexp_extract_all(s, '(?s).{{1,220}}\\z|.{{81,219}} |.{{220}}'), lambda x: {D.strip('x')}))) AS l FROM documents))""")
def evidence_lines(spark, d):
    return C.evidence_lines(table(spark, d, "documents"), ["doc_id"])


@query("literal_slices", """SELECT doc_id, CAST(k AS INTEGER) AS slice, substr(text, k * 600 + 1, 600) AS text FROM (
SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 600) AS BIGINT))) AS k FROM documents)""")
def literal_slices(spark, d):
    return C.literal_slices(table(spark, d, "documents"), ["doc_id"])
