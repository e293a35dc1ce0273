"""Queries over index building, checks, caches and model scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import token_count
from lodestone.operators import incremental as I, scoring as M
from lodestone.queries import duck as D
from lodestone.queries.chunks import windows_sql
from lodestone.registry import query
from lodestone.session import cut_lineage, derive, scratch_path, table
from lodestone.sources import index_store as X
from lodestone.sources.media import media_inventory

STORED = """SELECT CASE WHEN d.doc_id % 50 = 7 THEN 'same' WHEN d.doc_id % 50 = 8 THEN ' ' ELSE CAST(d.doc_id AS STRING) END AS chunk_id, CASE WHEN d.doc_id % 20 = 3 THEN 'fixed' ELSE 'structural' END AS strategy,
  CASE WHEN d.doc_id % 9 = 1 THEN '' ELSE d.text END AS text, d.lang AS section, d.source AS embedding_input, CASE WHEN d.doc_id % 30 = 4 THEN 'old' ELSE 'm' END AS embedding_model, e.embedding FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"""


@query("check_index", f"""WITH s AS ({STORED}) SELECT chunk_id, 'blank_id' AS problem FROM s WHERE trim(chunk_id) = '' UNION ALL SELECT chunk_id, 'wrong_strategy' FROM s WHERE strategy <> 'structural'
UNION ALL SELECT chunk_id, 'wrong_model' FROM s WHERE embedding_model <> 'm' UNION ALL SELECT chunk_id, 'blank_text' FROM s WHERE text = '' UNION ALL SELECT chunk_id, 'bad_vector' FROM s WHERE embedding IS NULL
UNION ALL SELECT chunk_id, 'duplicate_id' FROM s GROUP BY chunk_id HAVING count(*) > 1""")
def check_index(spark, d):
    return X.check_index(derive(spark, d, STORED), "structural", None, "m", 64)


MANIFEST_A = "SELECT source, CAST(count(*) AS STRING) AS build_id, min(lang) AS content_hash, 'm' AS model, 64 AS dims FROM documents GROUP BY source"
MANIFEST_B = "SELECT source, CAST(count(*) AS STRING) AS build_id, max(lang) AS content_hash, CASE WHEN source = 'src1' THEN 'n' ELSE 'm' END AS model, 64 AS dims FROM documents GROUP BY source"


@query("check_pair", f"""SELECT source, concat_ws(',', CASE WHEN a.build_id <> b.build_id THEN 'build_id' END, CASE WHEN a.content_hash <> b.content_hash THEN 'content_hash' END, CASE WHEN a.model <> b.model THEN 'model' END) AS differs
FROM ({MANIFEST_A}) a JOIN ({MANIFEST_B}) b USING (source) WHERE a.content_hash <> b.content_hash OR a.model <> b.model""")
def check_pair(spark, d):
    return X.check_pair(derive(spark, d, MANIFEST_A), derive(spark, d, MANIFEST_B), ["source"])


@query("write_index", "SELECT doc_id, text FROM documents")
def write_index(spark, d):
    path = scratch_path(spark, "index")
    docs = table(spark, d, "documents")
    X.write_index({"fixed": docs.select("doc_id"), "structural": docs.select("doc_id")}, path, "b1")
    X.write_index({"fixed": docs.select("doc_id", "text"), "structural": docs.select("doc_id", "text")}, path, "b2")
    return X.read_index(spark, path, "structural").select("doc_id", "text")


# Whole pages, behind the first bytes of an image in four of five.
MAGIC = {1: ("89504E470D0A1A0A", "image/png"), 2: ("FFD8FFE0", "image/jpeg"), 3: ("524946460000000057454250", "image/webp"), 4: ("5249464600000000", None)}
_HEAD = "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN unhex('{h}')" for k, (h, _) in MAGIC.items()) + " ELSE {none} END"


@query("media_inventory", f"""SELECT page_id, sha256({_HEAD.format(none="''::BLOB")} || encode(html)) AS content_hash,
  CASE page_id % 5 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN CASE WHEN strlen(html) > 0 THEN 'image/webp' END END AS mime,
  page_id % 5 IN (1, 2) OR (page_id % 5 = 3 AND strlen(html) > 0) AS supported FROM pages""")
def media_inventory_query(spark, d):
    head = F.expr(_HEAD.format(none="X''"))
    pages = table(spark, d, "pages").select("page_id", F.concat(head, F.col("html").cast("binary")).alias("content"))
    return media_inventory(pages).select("page_id", "content_hash", "mime", "supported")


OLD_DOCS = "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE lang END AS lang, n_chars + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 10 <> 5 UNION ALL SELECT doc_id + 1000000000, lang, n_chars FROM documents WHERE doc_id % 10 = 6"


@query("changed_documents", f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM documents a FULL JOIN ({OLD_DOCS}) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang IS DISTINCT FROM b.lang OR a.n_chars IS DISTINCT FROM b.n_chars""")
def changed_documents(spark, d):
    return I.changed_documents(table(spark, d, "documents"), derive(spark, d, OLD_DOCS), "doc_id", ["lang", "n_chars"])


CACHE = "SELECT sha256(text) AS input_hash, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'm' END AS model, doc_id FROM documents WHERE doc_id % 2 = 0"


def vector_cache(spark, d):
    rows = table(spark, d, "documents").filter("doc_id % 2 = 0")
    return rows.select(F.sha2("text", 256).alias("input_hash"), F.when(F.col("doc_id") % 4 == 0, "old").otherwise("m").alias("model"),
                       F.array(F.lit(1.0), F.length("text").cast("double")).alias("embedding"))


@query("missing_inputs", f"SELECT sha256(text) AS input_hash, any_value(length(text)) AS n FROM documents WHERE sha256(text) NOT IN (SELECT input_hash FROM ({CACHE}) WHERE model = 'm') GROUP BY 1")
def missing_inputs(spark, d):
    out = I.missing_inputs(table(spark, d, "documents"), vector_cache(spark, d), "m", 2, "text")
    return out.select("input_hash", F.length("text").cast("long").alias("n"))


@query("attach_vectors", f"SELECT doc_id, CASE WHEN sha256(text) IN (SELECT input_hash FROM ({CACHE})) THEN CAST(length(text) AS DOUBLE) END AS v FROM documents")
def attach_vectors(spark, d):
    return I.attach_vectors(table(spark, d, "documents"), vector_cache(spark, d), "text").select("doc_id", F.get("embedding", F.lit(1)).alias("v"))


@query("oversize_inputs", f"SELECT doc_id, {D.token_count('text')} AS tokens FROM documents WHERE {D.token_count('text')} > 1000")
def oversize_inputs(spark, d):
    return I.oversize_inputs(table(spark, d, "documents"), token_count(F.col("text")), 1000).select("doc_id", "tokens")


ASSETS = "SELECT page_id AS asset_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE sha256(url) END AS content_hash, 'external' AS status FROM pages"
PREVIOUS = "SELECT page_id AS asset_order, sha256(url) AS content_hash, CASE WHEN page_id % 3 = 0 THEN 'v0' ELSE 'v1' END AS processor_version, CASE page_id % 4 WHEN 1 THEN 'processing_failed' WHEN 2 THEN 'ocr_only_unverified' ELSE 'processed_unverified' END AS status, 'ocr ' || url AS ocr_text, 'see ' || url AS vision_text FROM pages"


def _spark_hash(sql: str) -> str:
    return sql.replace("sha256(url)", "sha2(url, 256)")


@query("reuse_asset_text", f"""WITH p AS (SELECT content_hash, min(asset_order) AS o, arg_min(status, asset_order) AS status, arg_min(ocr_text, asset_order) AS ocr_text, arg_min(vision_text, asset_order) AS vision_text FROM ({PREVIOUS}) WHERE processor_version = 'v1' AND status <> 'processing_failed' GROUP BY content_hash)
SELECT a.asset_id, a.content_hash, coalesce(p.status, a.status) AS status, p.ocr_text, p.vision_text, CASE WHEN a.content_hash IS NULL THEN 'keep' WHEN p.content_hash IS NOT NULL THEN 'reuse' ELSE 'process' END AS action FROM ({ASSETS}) a LEFT JOIN p USING (content_hash)""")
def reuse_asset_text(spark, d):
    return I.reuse_asset_text(derive(spark, d, _spark_hash(ASSETS)), derive(spark, d, _spark_hash(PREVIOUS)), "v1")


PICTURED = "SELECT CAST(doc_id % 10 AS STRING) AS source, doc_id AS ordinal, CASE WHEN doc_id % 17 = 0 THEN 'vision_interpretation' ELSE 'paragraph' END AS kind, lang AS text, 'a' || (doc_id % 40) AS asset FROM documents"
READ = "SELECT DISTINCT CAST(doc_id % 10 AS STRING) AS source, 'a' || (doc_id % 40) AS asset_id, 'm.png' AS media_part, CASE WHEN doc_id % 40 < 20 THEN 'ocr' ELSE '' END AS ocr_text, CASE WHEN doc_id % 40 < 10 THEN 'shape' END AS vision_text, 'v1' AS processor_version FROM documents"


@query("append_machine_text", f"""WITH b AS ({PICTURED}), a AS ({READ}), r AS (SELECT b.source, b.ordinal FROM b JOIN a ON a.source = b.source AND a.asset_id = b.asset WHERE kind = 'vision_interpretation' AND vision_text IS NOT NULL),
h AS (SELECT source, asset, min(ordinal) AS host FROM b WHERE kind = 'paragraph' GROUP BY ALL), t AS (SELECT source, asset_id, 'ocr' AS kind, ocr_text AS x FROM a WHERE ocr_text <> '' UNION ALL SELECT source, asset_id, 'vision_interpretation', vision_text FROM a WHERE vision_text IS NOT NULL)
SELECT b.source, b.ordinal, b.kind, b.text FROM b ANTI JOIN r ON b.source = r.source AND b.ordinal = r.ordinal
UNION ALL SELECT t.source, (SELECT max(ordinal) FROM b WHERE b.source = t.source) + row_number() OVER (PARTITION BY t.source ORDER BY host, asset_id, kind), kind, '[' || kind || ': машинное извлечение, требуется проверка по изображению m.png]' || chr(10) || x
FROM t JOIN h ON h.source = t.source AND h.asset = t.asset_id""")
def append_machine_text(spark, d):
    blocks = derive(spark, d, PICTURED).withColumns({"asset_ids": F.array("asset"), "warnings": F.array().cast("array<string>")}).drop("asset")
    return I.append_machine_text(blocks, derive(spark, d, READ)).select("source", "ordinal", "kind", "text")


# Words by white space; a word's slot is the crc32 of its UTF-8 bytes, bit by bit, modulo the free slots.
WORDS = "list_filter(regexp_split_to_array(lower({e}), '\\s+'), lambda w: w <> '')"
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, octet_length(encode(w))),
  lambda i: [CAST('0x' || substr(hex(encode(w)), i * 2 + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))::BIGINT[]), lambda h, e: xor(xor(h, e) >> 1, (xor(h, e) & 1) * 3988292384)), 4294967295::BIGINT)"""


@query("embed", f"""WITH t AS (SELECT doc_id, unnest({WORDS.format(e="'search_document: ' || text")}) AS w FROM documents WHERE text IS NOT NULL),
slots AS (SELECT w, {CRC} % 15 AS s FROM (SELECT DISTINCT w FROM t)),
n AS (SELECT doc_id, s, count(*) AS n FROM t JOIN slots USING (w) GROUP BY ALL)
SELECT doc_id, string_agg(coalesce(n, 0), ' ' ORDER BY s) || ' 1' AS embedding FROM (SELECT doc_id, s FROM documents, range(15) r(s)) LEFT JOIN n USING (doc_id, s) GROUP BY doc_id""")
def embed(spark, d):
    out = M.embed(table(spark, d, "documents"), "doc_id", "text", M.word_hash_encoder(16), 16)
    return out.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("embedding"))


def _scorer(question, texts):
    words = set(question.lower().split())
    return [sum(w in words for w in t.lower().split()) / (1 + len(t)) for t in texts]


def _flaky(question, texts):
    if len(question) % 3 == 0:
        raise TimeoutError("model is down")
    return _scorer(question, texts)


def dense_hits(spark, d):
    from lodestone.operators.dense import dense_topk
    from lodestone.queries.retrieval import chunks, questions

    asked, rows = questions(spark, d), chunks(spark, d)
    top = dense_topk(asked, rows, 20).join(rows.select("chunk_id", "text", F.concat_ws("\n", "owner_id", "section").alias("heading")), "chunk_id")
    return cut_lineage(top.join(asked.select("query_id", F.col("text").alias("question")), "query_id"))


def _reranked_sql() -> str:
    """Best passage of the 20 nearest chunks of each question: shared words over length."""
    from lodestone.queries.retrieval import QUESTIONS, base_sql

    return f"""WITH {base_sql(QUESTIONS)},
top AS (SELECT query_id, chunk_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM pairs) WHERE r <= 20),
parts AS (SELECT chunk_id, "window" AS k, concat_ws(chr(10), owner_id, section, w.text) AS passage FROM ({windows_sql('chunks', 'chunk_id', 300, 50)}) w JOIN chunks USING (chunk_id)),
asked AS (SELECT query_id, text, {WORDS.format(e='text')} AS words FROM questions),
scored AS (SELECT query_id, chunk_id, k, passage, len(list_filter({WORDS.format(e='passage')}, lambda w: list_contains(words, w))) / (1 + length(passage)) AS s
  FROM top JOIN parts USING (chunk_id) JOIN asked USING (query_id)),
best AS MATERIALIZED (SELECT query_id, chunk_id, max(s) AS s, arg_min(passage, {{'s': -s, 'k': k}}) AS passage FROM scored GROUP BY ALL)"""


@query("rerank", f"{_reranked_sql()} SELECT query_id, chunk_id, round(s, 9) AS rerank, 'cross_encoder:words' AS mode, passage FROM top LEFT JOIN best USING (query_id, chunk_id)")
def rerank(spark, d):
    return M.rerank(dense_hits(spark, d), _scorer, "words").select("query_id", "chunk_id", F.round("rerank", 9).alias("rerank"), "mode", "passage")


@query("rerank_or_fallback", f"""{_reranked_sql()},
state AS (SELECT query_id, CASE WHEN any_value(length(a.text)) % 3 = 0 THEN 'TimeoutError' WHEN bool_or(s IS NULL) THEN 'missing' END AS why
  FROM top LEFT JOIN best USING (query_id, chunk_id) JOIN asked a USING (query_id) GROUP BY query_id)
SELECT query_id, chunk_id, round(CASE WHEN why IS NULL THEN s ELSE similarity END, 9) AS rerank,
  CASE WHEN why IS NULL THEN 'cross_encoder:words' ELSE 'lexical_fallback:reranker_unavailable' END AS mode, 'reranker_' || why AS reason
FROM top LEFT JOIN best USING (query_id, chunk_id) JOIN state USING (query_id)""")
def rerank_or_fallback(spark, d):
    hits = dense_hits(spark, d)
    lexical = hits.select("query_id", "chunk_id", F.col("similarity").alias("rerank"))
    return M.rerank_or_fallback(M.rerank(hits, _flaky, "words"), lexical).select("query_id", "chunk_id", F.round("rerank", 9).alias("rerank"), "mode", "reason")


@query("query_vector_cache", "SELECT item_id AS query_id, sha256('m|2|search_query: ' || text) AS cache_key, item_id % 3 = 0 AS hit FROM benchmark")
def query_vector_cache(spark, d):
    from lodestone.functions.text import stable_id

    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    key = stable_id(F.lit("m"), F.lit("2"), F.concat(F.lit("search_query: "), "text"))
    cache = rows.filter("query_id % 3 <> 1").select(key.alias("cache_key"), F.when(F.col("query_id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))).alias("embedding"))
    return M.query_vector_cache(rows, cache, "m", 2).select("query_id", "cache_key", "hit")
