"""Queries over context assembly and evidence."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodestone.functions.text import token_count
from lodestone.operators import context as A, evidence as Q
from lodestone.operators.chunking import fixed_windows
from lodestone.plans import hybrid as P
from lodestone.queries import duck as D
from lodestone.queries.chunks import windows_sql
from lodestone.queries.corpus import OWNED
from lodestone.queries.entities import owned
from lodestone.queries.retrieval import STAGE_FINAL, chunks as doc_chunks, hybrid, questions
from lodestone.queries.vectors import TOPK, sides
from lodestone.registry import query
from lodestone.session import cut_lineage, derive, merged, table


def _fold(budget: int, extra: int) -> str:
    return f"""list_reduce(l, lambda acc, x: {{'c': x.c, 'o': x.o, 's': CASE WHEN acc.s + x.c + {extra} <= {budget} THEN acc.s + x.c + {extra} ELSE acc.s END,
  't': CASE WHEN acc.s + x.c + {extra} <= {budget} THEN list_append(acc.t, x.o) ELSE acc.t END}}, {{'c': CAST(0 AS BIGINT), 'o': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 't': CAST([] AS BIGINT[])}})"""


@query("pack_budget", f"""WITH h AS (SELECT conv_id, turn, CAST({D.token_count('text')} AS BIGINT) AS cost FROM conversations),
f AS (SELECT conv_id, {_fold(150, 4)} AS f FROM (SELECT conv_id, list({{'c': cost, 'o': turn, 's': CAST(0 AS BIGINT), 't': CAST([] AS BIGINT[])}} ORDER BY turn) AS l FROM h GROUP BY conv_id))
SELECT conv_id, turn, cost, list_contains(f.t, turn) AS fits FROM h JOIN f USING (conv_id)""")
def pack_budget(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", token_count(F.col("text")).cast("long").alias("cost"))
    return A.pack_budget(rows, ["conv_id"], "turn", "cost", 150)


@query("pack_bytes", """WITH h AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice / 40 AS BIGINT) AS f, 300 AS s FROM orders),
r AS (SELECT o_custkey, list_reduce(list({'o': o_orderkey, 'f': f, 's': CAST(s AS BIGINT), 'u': CAST(0 AS BIGINT), 'full': CAST([] AS BIGINT[]), 'stub': CAST([] AS BIGINT[])} ORDER BY o_orderkey),
 lambda a, x: {'o': x.o, 'f': x.f, 's': x.s, 'u': CASE WHEN a.u + x.f <= 49152 THEN a.u + x.f WHEN a.u + x.s <= 49152 THEN a.u + x.s ELSE a.u END,
  'full': CASE WHEN a.u + x.f <= 49152 THEN list_append(a.full, x.o) ELSE a.full END,
  'stub': CASE WHEN a.u + x.f > 49152 AND a.u + x.s <= 49152 THEN list_append(a.stub, x.o) ELSE a.stub END},
 {'o': CAST(0 AS BIGINT), 'f': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'u': CAST(0 AS BIGINT), 'full': CAST([] AS BIGINT[]), 'stub': CAST([] AS BIGINT[])}) AS a FROM h GROUP BY o_custkey)
SELECT o_custkey, o_orderkey, CASE WHEN list_contains(a.full, o_orderkey) THEN 'full' WHEN list_contains(a.stub, o_orderkey) THEN 'stub' ELSE 'omitted' END AS placement FROM h JOIN r USING (o_custkey)""".replace("CAST(o_totalprice / 40 AS BIGINT)", "CAST(floor(o_totalprice / 40) AS BIGINT)"))
def pack_bytes(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 40).alias("f"), F.lit(300).alias("s"))
    return A.pack_bytes(rows, ["o_custkey"], "o_orderkey", "f", "s").drop("f", "s")


@query("fragments", """SELECT doc_id AS chunk_id, '{"text":' || CAST(to_json(text) AS VARCHAR) || ',"section":' || CAST(to_json(lang) AS VARCHAR) || '}' AS fragment FROM documents""")
def fragments(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("section"))
    return A.fragments(docs, compact=True).select("chunk_id", "fragment")


def local_hits(spark, d):
    hits = hybrid(spark, d).select("query_id", "chunk_id", "rerank", "selected", "reason", "group_key", "exact", "section")
    ordered = cut_lineage(hits.withColumn("place", F.row_number().over(_by_rank())))
    asked = questions(spark, d).select("query_id", F.col("text").alias("question"))
    return merged(ordered).join(asked, "query_id")


def _by_rank():
    return Window.partitionBy("query_id").orderBy(F.desc("rerank"), "chunk_id")


@query("pack_local")
def pack_local(spark, d):
    # A text stays with its document: a question's hits are read in part only.
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return A.pack_local(local_hits(spark, d), 600, 3, texts=docs).select("query_id", "chunk_id", "verdict", "excerpt", "cost")


TABLED = """SELECT l_suppkey AS source, CAST(l_partkey * 1000000 + l_orderkey AS BIGINT) AS ordinal, l_returnflag || l_linestatus AS table_id, l_returnflag AS table_headers,
  CAST(l_partkey * 1000000 + l_orderkey AS STRING) AS block_id, l_orderkey FROM lineitem"""


@query("table_context", f"""WITH b AS ({TABLED}), h AS (SELECT source, table_id, min(ordinal) AS o FROM b GROUP BY ALL)
SELECT DISTINCT l_orderkey % 100 AS query_id, CAST(b.source AS VARCHAR) AS chunk_id, b.table_id, b.table_headers AS headers, CAST(h.o AS VARCHAR) AS header_block_id FROM b JOIN h USING (source, table_id)""")
def table_context(spark, d):
    blocks = derive(spark, d, TABLED)
    hits = blocks.select((F.col("l_orderkey") % 100).alias("query_id"), F.col("source").cast("string").alias("chunk_id"), "source", "ordinal").distinct()
    return A.table_context(hits, blocks.drop("l_orderkey").distinct())


@query("inherit_previous", f"""WITH {OWNED}, p AS (SELECT *, lag(text) OVER w AS pt, lag(kind) OVER w AS pk, lag(owner_name) OVER w AS po, lag(ordinal) OVER w AS pb FROM owned WINDOW w AS (PARTITION BY source ORDER BY ordinal))
SELECT section AS query_id, CAST(ordinal AS VARCHAR) || source AS chunk_id, pb AS ordinal, pt AS text FROM p WHERE pb IS NOT NULL AND po IS NOT DISTINCT FROM owner_name AND length(pt) < 200
AND (pk = 'heading' OR pt LIKE '%:' OR regexp_matches(pt, '^[\\p{{L}}\\p{{N}}_]+_[\\p{{L}}\\p{{N}}_]+$'))""")
def inherit_previous(spark, d):
    blocks = owned(spark, d)[0]
    hits = blocks.select(F.col("section").alias("query_id"), F.concat(F.col("ordinal").cast("string"), "source").alias("chunk_id"), "source", "ordinal", "owner_id")
    return A.inherit_previous(hits, blocks)


@query("request_budget", f"""SELECT conv_id, CAST(sum({D.token_count('text')}) AS BIGINT) AS tokens, sum({D.token_count('text')}) + 200 <= 900 AS fits FROM conversations GROUP BY conv_id""")
def request_budget(spark, d):
    rows = table(spark, d, "conversations").withColumn("tokens", token_count(F.col("text")))
    return A.request_budget(rows, ["conv_id"], 200, 900)


@query("linked_evidence")
def linked_evidence(spark, d):
    hits = cut_lineage(hybrid(spark, d).withColumn("place", F.row_number().over(_by_rank())))
    rows = doc_chunks(spark, d)
    visual = rows.select("chunk_id", "owner_id", F.col("chunk_id").alias("first_ordinal"), "conflict",
                         F.when(F.col("kind") == "family_card", F.col("text")).alias("visual"))
    exact = hits.filter("exact").select("query_id", "owner_id").distinct()
    return A.linked_evidence(hits, visual, exact)


# --- evidence ------------------------------------------------------------------------------------
ANSWERED = """SELECT conv_id AS request_id, turn + 1 AS pos, CASE WHEN turn = 3 THEN 9 ELSE turn + 1 END AS number, CASE WHEN turn = 5 THEN ' ' ELSE text END AS text,
  CASE role WHEN 'user' THEN 'supported' WHEN 'assistant' THEN 'unknown' ELSE 'weird' END AS status FROM conversations"""


@query("answer_shape", f"""WITH a AS ({ANSWERED}), n AS (SELECT request_id, count(*) AS given, count(*) FILTER (WHERE pos <> 8) AS asked FROM a GROUP BY ALL)
SELECT request_id, pos, CASE WHEN asked <> given THEN 'wrong_count' WHEN number <> pos THEN 'bad_number' WHEN trim(text) = '' OR status = 'weird' THEN 'bad_answer' ELSE 'ok' END AS shape FROM a JOIN n USING (request_id)""")
def answer_shape(spark, d):
    rows = derive(spark, d, ANSWERED)
    return Q.answer_shape(rows, rows.filter("pos <> 8").select("request_id", "pos")).select("request_id", "pos", "shape")


@query("quote_support", f"""WITH l AS (SELECT doc_id AS request_id, CAST(i AS INTEGER) AS seq, CASE WHEN i % 3 = 0 THEN q || ' nowhere' ELSE q END AS quote FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS q, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
c AS (SELECT doc_id AS request_id, "window" AS rank, CAST("window" AS VARCHAR) AS chunk_id, {D.squeeze('nfc_normalize(text)')} AS h FROM ({windows_sql('documents', 'doc_id', 120, 20)})),
q AS (SELECT *, {D.squeeze('nfc_normalize(quote)')} AS n FROM l)
SELECT request_id, seq, min_by_chunk AS chunk_id, min_by_chunk IS NOT NULL AS supported FROM (SELECT q.request_id, q.seq, arg_min(c.chunk_id, c.rank) AS min_by_chunk
 FROM q LEFT JOIN c ON q.request_id = c.request_id AND length(n) >= 8 AND contains(h, n) GROUP BY ALL)""")
def quote_support(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "request_id")
    lines = docs.select("request_id", F.posexplode(F.split("text", "\n")).alias("_i", "_q"))
    quotes = lines.select("request_id", (F.col("_i") + 1).alias("seq"), F.when((F.col("_i") + 1) % 3 == 0, F.concat("_q", F.lit(" nowhere"))).otherwise(F.col("_q")).alias("quote"))
    windows = fixed_windows(docs, ["request_id"], "text", 120, 20)
    contexts = windows.select("request_id", F.col("window").alias("rank"), F.col("window").cast("string").alias("chunk_id"), "text")
    return Q.quote_support(quotes, contexts, ["request_id"]).drop("quote")


@query("unverified_evidence", """SELECT doc_id, allowed, allowed AND visual AND NOT contains(lower(text), 'распознан') AS caveat FROM (SELECT doc_id, text, quality = 1 AS visual,
 NOT (doc_id % 2 = 0 AND toxic = 1) OR (doc_id % 3 = 0 AND quality = 1) AS allowed FROM documents JOIN labels USING (doc_id))""")
def unverified_evidence(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumns({
        "status": F.when(F.col("doc_id") % 2 == 0, "supported").otherwise("uncertain"),
        "question": F.when(F.col("doc_id") % 3 == 0, "Как выглядит?").otherwise("Сколько?"),
        "machine": F.col("toxic") == 1, "visual": F.col("quality") == 1})
    return Q.unverified_evidence(rows).select("doc_id", "allowed", "caveat")


INVENTED = """SELECT p_partkey AS request_id, 1 AS number, replace(p_brand, '#', '_') || '_' || p_type AS name, p_size FROM part"""


@query("invented_names", f"""SELECT request_id, number, name || '_X' || p_size AS name FROM ({INVENTED}) WHERE p_size % 3 = 0""")
def invented_names(spark, d):
    rows = derive(spark, d, INVENTED)
    extra = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" и "), "name", F.lit("_X"), F.col("p_size").cast("string"), F.lit("."))).otherwise(F.lit(" и Other_thing."))
    answers = rows.select("request_id", "number", F.concat(F.lit("Возьмите "), "name", extra).alias("text"))
    return Q.invented_names(answers, rows.select("request_id", "number", F.concat("name", F.lit(" два")).alias("name")))


@query("resolve_evidence_ids", """SELECT o_custkey AS request_id, 1 AS number, o_orderkey % 20 AS line, CASE WHEN o_orderkey % 20 BETWEEN 1 AND 10 THEN 'quote ' || (o_orderkey % 20) END AS quote,
 o_orderkey % 20 BETWEEN 1 AND 10 AS valid FROM orders""")
def resolve_evidence_ids(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_custkey").alias("request_id"), F.lit(1).alias("number"), (F.col("o_orderkey") % 20).alias("line"))
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit(1).alias("number"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("line"))
    return Q.resolve_evidence_ids(refs, lines.withColumn("quote", F.concat(F.lit("quote "), F.col("line").cast("string"))))


RENDER = """SELECT conv_id AS request_id, turn + 1 AS number, 'Какой параметр?' AS question, 'ответ ' || role AS text, CASE role WHEN 'system' THEN 'unknown' ELSE 'supported' END AS status, turn % 3 <> 2 AS valid FROM conversations"""


@query("render_answers", f"""SELECT request_id, string_agg(CASE WHEN status = 'unknown' OR NOT valid THEN '➤ Не знаю. Для корректного ответа укажите дополнительно - точное имя параметра, семейство и типоразмер, к которым относится вопрос «' || question || '».'
 ELSE '➤ ' || text || chr(10) || '▫️ Цитаты:' || chr(10) || '"q' || number || '"' || chr(10) || '▫️ Источники:' || chr(10) || 'chunk_id: c' || number END, chr(10) ORDER BY number) AS rendered FROM ({RENDER}) GROUP BY request_id""")
def render_answers(spark, d):
    rows = derive(spark, d, RENDER)
    n = F.col("number").cast("string")
    cites = rows.select("request_id", "number", F.lit(1).alias("seq"), F.concat(F.lit("q"), n).alias("quote"), F.concat(F.lit("c"), n).alias("chunk_id"))
    return Q.render_answers(rows, cites)


CASES = "SELECT c_custkey AS query_id, CAST(c_nationkey AS STRING) AS want, CAST(c_nationkey + 1 AS STRING) AS ban, c_mktsegment = 'MACHINERY' AS expect_empty FROM customer"
CASE_HITS = "SELECT o_custkey AS query_id, CAST(o_orderkey % 25 AS STRING) AS name, o_totalprice > 150000 AS selected, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 = 0 THEN 'lexical_fallback:x' ELSE 'cross' END AS mode FROM orders"


@query("score_cases", f"""WITH c AS ({CASES}), h AS ({CASE_HITS}), j AS (SELECT c.query_id, expect_empty, CASE WHEN bool_or(selected AND name = want) THEN 0 ELSE 1 END AS missing,
 CASE WHEN bool_or(selected AND name = ban) THEN 1 ELSE 0 END AS wrong, coalesce(bool_or(mode LIKE 'lexical_fallback%'), false) AS fallback, coalesce(bool_or(selected), false) AS any_ FROM c LEFT JOIN h USING (query_id) GROUP BY ALL)
SELECT query_id, CAST(missing AS BIGINT) AS missing, CAST(wrong AS BIGINT) AS wrong, fallback, missing = 0 AND wrong = 0 AND NOT (expect_empty AND any_) AND NOT fallback AS passed FROM j""")
def score_cases(spark, d):
    cases = derive(spark, d, CASES).select("query_id", F.array("want").alias("expected"), F.array("ban").alias("excluded"), "expect_empty")
    return Q.score_cases(derive(spark, d, CASE_HITS), cases)


@query("recall_at_k", f"""WITH t AS ({TOPK.replace('rank <= 10', 'rank <= 5')}), r AS (SELECT vec_id AS query_id, v % 10 AS name FROM embeddings, LATERAL (SELECT unnest([label, label + 1]) AS v))
SELECT query_id, round(count(g) / count(*), 6) AS recall FROM r LEFT JOIN (SELECT DISTINCT query_id, label AS name, 1 AS g FROM t JOIN embeddings e ON e.vec_id = t.chunk_id) USING (query_id, name) GROUP BY query_id""")
def recall_at_k(spark, d):
    asked, rows = sides(spark, d)
    top = P.baseline_search(asked, rows, 5).join(rows.select("chunk_id", F.col("owner_id").alias("name")), "chunk_id")
    relevant = rows.select(F.col("chunk_id").alias("query_id"), F.explode(F.array(F.col("owner_id") % 10, (F.col("owner_id") + 1) % 10)).alias("name"))
    return Q.recall_at_k(top, relevant, 5).withColumn("recall", F.round("recall", 6))


@query("replay_context", f"""WITH h AS (SELECT conv_id, turn, role, CAST({D.token_count('text')} AS BIGINT) AS cost FROM conversations),
f AS (SELECT conv_id, {_fold(150, 4)} AS f FROM (SELECT conv_id, list({{'c': cost, 'o': turn, 's': CAST(0 AS BIGINT), 't': CAST([] AS BIGINT[])}} ORDER BY turn) AS l FROM h GROUP BY conv_id)),
k AS (SELECT conv_id AS query_id, bool_or(list_contains(f.t, turn) AND role = 'assistant') AS got, bool_or(list_contains(f.t, turn) AND role = 'system') AS bad FROM h JOIN f USING (conv_id) GROUP BY ALL)
SELECT query_id, CAST(NOT got AS BIGINT) AS missing, CAST(bad AS BIGINT) AS wrong, false AS fallback, got AND NOT bad AS passed FROM k""")
def replay_context(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("name"), token_count(F.col("text")).cast("long").alias("cost"))
    kept = A.pack_budget(rows, ["conv_id"], "turn", "cost", 150)
    hits = kept.select(F.col("conv_id").alias("query_id"), "name", F.col("fits").alias("selected"), F.lit("stored").alias("mode"))
    cases = rows.select(F.col("conv_id").alias("query_id")).distinct().withColumns({
        "expected": F.array(F.lit("assistant")), "excluded": F.array(F.lit("system")), "expect_empty": F.lit(False)})
    return Q.score_cases(hits, cases)


# --- composed searches ---------------------------------------------------------------------------
@query("baseline_search", TOPK)
def baseline_search(spark, d):
    return P.baseline_search(*sides(spark, d), 10)


# Two chunkings of the same rows: each row alone, and windows of two neighbours whose vector is their sum.
def _best(name: str, chunks: str) -> str:
    sim = "round(greatest(-1, least(1, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))), 6) + 0"
    return f"""(SELECT query_id, count(*) AS {name}_hits, max(similarity) AS {name}_best, arg_min(chunk_id, r) AS {name}_top FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM (
  SELECT q.vec_id AS query_id, c.chunk_id, {sim} AS similarity FROM embeddings q, ({chunks}) c)) WHERE r <= 5 GROUP BY query_id)"""


PAIRED_DUCK = """SELECT chunk_id, CASE WHEN len(v) = 1 THEN v[1] ELSE list_transform(list_zip(v[1], v[2]), lambda x: x[1] + x[2]) END AS embedding
 FROM (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS chunk_id, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS v FROM embeddings GROUP BY 1)"""


@query("compare_strategies", f"""SELECT * FROM {_best('single', 'SELECT vec_id AS chunk_id, embedding FROM embeddings')} s JOIN {_best('paired', PAIRED_DUCK)} p USING (query_id)""")
def compare_strategies(spark, d):
    asked, rows = sides(spark, d)
    # Every row lies in the window of its half id, alone where its neighbour is missing.
    wide = rows.select(F.floor(F.col("chunk_id") / 2).alias("chunk_id"), F.struct("chunk_id", F.col("embedding").cast("array<double>").alias("v")).alias("row"))
    pairs = wide.groupBy("chunk_id").agg(F.array_sort(F.collect_list("row")).alias("r"))
    first, second = F.get("r", F.lit(0))["v"], F.get("r", F.lit(1))["v"]
    paired = pairs.select("chunk_id", F.coalesce(F.zip_with(first, second, lambda x, y: x + y), first).alias("embedding"))
    return P.compare_strategies(asked, {"single": rows, "paired": paired}, 5)


@query("retrieval_diagnostics", f"""{STAGE_FINAL} SELECT query_id, chunk_id, dense_rank, lexical_rank, similarity, lexical, fusion, rerank, 'lexical_fallback' AS mode, exact, selected, verdict AS reason,
CAST(position AS INTEGER) AS position, substr(c.text, 1, 400) AS excerpt, CAST(NULL AS VARCHAR) AS reranker_error,
array_to_string(list_filter(qt.toks, lambda t, i: list_position(qt.toks, t) = i AND list_contains(dt.toks, t)), ' ') AS matched_terms
FROM final JOIN chunks c USING (chunk_id) JOIN questionst qt USING (query_id) JOIN docs dt USING (chunk_id)""")
def retrieval_diagnostics(spark, d):
    rows = P.retrieval_diagnostics(hybrid(spark, d), table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id"))
    return rows.withColumn("matched_terms", F.array_join("matched_terms", " "))


@query("multi_question", f"""SELECT conv_id * 1000 + turn AS message_id, n AS number, question, (conv_id * 1000 + turn) || '#' || n AS query_id FROM (
 SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CASE n WHEN 1 THEN role || ' one?' ELSE trim(text) END AS question FROM conversations, (VALUES (1), (2)) v(n))""".replace("trim(text)", D.strip("text")))
def multi_question(spark, d):
    rows = derive(spark, d, "SELECT conv_id * 1000 + turn AS message_id, '1. ' || role || ' one? 2. ' || text AS text FROM conversations")
    return P.multi_question(rows)
