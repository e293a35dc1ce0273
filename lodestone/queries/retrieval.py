"""Queries over lexical and hybrid retrieval: benchmark texts ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import search_tokens
from lodestone.functions.vectors import HASH_DIMS, hashing_vectors
from lodestone.operators import retrieval as R
from lodestone.operators.dedup import near_duplicates, signatures
from lodestone.operators.dense import dense_candidates
from lodestone.operators.lexical import asked_tokens, bm25, corpus_stats, lexical_rerank, query_terms, tokenize
from lodestone.operators.scans import top_rows
from lodestone.plans import hybrid as P
from lodestone.queries import duck as D
from lodestone.queries.chunks import windows_sql
from lodestone.registry import query
from lodestone.session import cut_lineage, derive, merged, table

# Labelled quality makes a document a card of its source; labelled toxicity marks it as conflicting.
CHUNKS = """SELECT d.doc_id AS chunk_id, d.text, d.lang AS section, d.source AS owner_id,
  CASE WHEN l.quality = 1 THEN 'family_card' ELSE 'block' END AS kind, coalesce(l.toxic = 1, false) AS conflict
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
QUESTIONS = """SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN text || ' src' || (item_id % 8) ELSE text END AS text FROM benchmark"""


def chunks(spark, d):
    rows = derive(spark, d, CHUNKS).withColumn("family_names", F.array("owner_id"))
    vectors = hashing_vectors(rows, "chunk_id", F.col("text"))
    return cut_lineage(rows.join(vectors, "chunk_id"))


def questions(spark, d):
    rows = derive(spark, d, QUESTIONS)
    return cut_lineage(rows.join(hashing_vectors(rows, "query_id", F.col("text")), "query_id"))


# --- SQL building blocks -------------------------------------------------------------------------
SLOT = f"(CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % {HASH_DIMS - 1})"


def _vectors(name: str, key: str) -> str:
    return f"""{name}t AS MATERIALIZED (SELECT {key}, {D.retrieval_tokens('text')} AS toks FROM {name}),
{name}v AS MATERIALIZED (SELECT {key}, {SLOT} AS slot, count(*) AS n FROM (SELECT {key}, unnest(toks) AS t FROM {name}t) GROUP BY ALL
  UNION ALL SELECT {key}, {HASH_DIMS - 1}, 1 FROM {name}),
{name}n AS (SELECT {key}, sum(n * n) AS norm FROM {name}v GROUP BY ALL)"""


def base_sql(questions: str) -> str:
    return f"""chunks AS MATERIALIZED ({CHUNKS}), questions AS MATERIALIZED ({questions}),
{_vectors('chunks', 'chunk_id')}, {_vectors('questions', 'query_id')},
pairs AS MATERIALIZED (SELECT query_id, chunk_id, round(CAST(dot AS DOUBLE) / sqrt(CAST(qn.norm * cn.norm AS DOUBLE)), 6) AS similarity FROM (
  SELECT q.query_id, c.chunk_id, sum(q.n * c.n) AS dot FROM questionsv q JOIN chunksv c USING (slot) GROUP BY ALL) JOIN questionsn qn USING (query_id) JOIN chunksn cn USING (chunk_id))"""


LEXICAL = f"""docs AS MATERIALIZED (SELECT chunk_id, {D.retrieval_tokens("text || chr(10) || section || chr(10) || owner_id")} AS toks FROM chunks),
stats AS (SELECT count(*) AS n, greatest(1, avg(len(toks))) AS mean FROM docs),
terms AS MATERIALIZED (SELECT query_id, unnest(list_distinct(toks)) AS term FROM questionst),
tf AS MATERIALIZED (SELECT chunk_id, term, len, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS len, unnest(toks) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
lexical AS MATERIALIZED (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS lexical
  FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY ALL)"""
FOUND = "regexp_matches({t}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_№.+\\-])' || {n} || '(?:$|[^\\p{{L}}\\p{{N}}_№+.\\-]|\\.$|\\.[^\\p{{L}}\\p{{N}}])')"
EXACT = f"""asked AS MATERIALIZED (SELECT query_id, owner_id FROM questions q, (SELECT DISTINCT owner_id FROM chunks) o WHERE {FOUND.format(t='q.text', n='owner_id')}),
exact AS MATERIALIZED (SELECT query_id, chunk_id, contains(lower(text), lower(owner_id)) AND {FOUND.format(t='text', n='owner_id')} AS in_text FROM asked JOIN chunks USING (owner_id))"""
RANKED = """ranked AS MATERIALIZED (SELECT p.query_id, p.chunk_id, similarity, coalesce(lexical, 0) AS lexical, row_number() OVER (PARTITION BY p.query_id ORDER BY similarity DESC, p.chunk_id) AS dense_rank,
  coalesce(lexical_rank, 0) AS lexical_rank FROM pairs p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS lexical_rank FROM lexical WHERE lexical > 0) l USING (query_id, chunk_id))"""
CANDIDATES = """cards AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM (
   SELECT p.*, row_number() OVER (PARTITION BY query_id, owner_id ORDER BY similarity DESC, chunk_id) AS rn FROM pairs p JOIN chunks c USING (chunk_id) WHERE kind = 'family_card') WHERE rn = 1) WHERE r <= 20),
cands AS MATERIALIZED (SELECT r.*, e.query_id IS NOT NULL AS exact, coalesce(e.in_text, false) AS in_text, k.query_id IS NOT NULL AS card,
  round(1 / (60 + dense_rank) + CASE WHEN lexical_rank > 0 THEN 1 / (60 + lexical_rank) ELSE 0 END, 9) AS fusion
  FROM ranked r LEFT JOIN exact e USING (query_id, chunk_id) LEFT JOIN cards k USING (query_id, chunk_id)
  WHERE dense_rank <= 60 OR lexical_rank BETWEEN 1 AND 40 OR e.query_id IS NOT NULL OR k.query_id IS NOT NULL)"""
RERANK = f"""pool AS (SELECT query_id, count(*) AS pool, greatest(1, avg(len(toks))) AS mean FROM cands JOIN chunkst USING (chunk_id) GROUP BY ALL),
bt AS MATERIALIZED (SELECT chunk_id, len, term, list(pos) AS positions FROM (SELECT chunk_id, len(toks) AS len, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM chunkst) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
rh AS MATERIALIZED (SELECT c.query_id, c.chunk_id, term, len, positions FROM cands c JOIN terms t USING (query_id) JOIN bt USING (chunk_id, term)),
rw AS (SELECT query_id, term, ln(1 + (pool - df + 0.5) / (df + 0.5)) AS w, mean FROM (SELECT query_id, term, count(*) AS df FROM rh GROUP BY ALL) JOIN pool USING (query_id)),
full_ AS (SELECT query_id, chunk_id, count(*) AS covered, sum(w * len(positions) * 2.2 / (len(positions) + 1.2 * (0.25 + 0.75 * len / mean))) AS f FROM rh JOIN rw USING (query_id, term) GROUP BY ALL),
ptf AS (SELECT query_id, chunk_id, p, term, w, mean, len, count(*) AS tf FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - 127) / 96)) AS BIGINT), CAST(floor(pos / 96) AS BIGINT) + 1)) AS p
  FROM (SELECT query_id, chunk_id, term, w, mean, len, unnest(positions) AS pos FROM rh JOIN rw USING (query_id, term))) GROUP BY ALL),
best AS (SELECT query_id, chunk_id, max(s) AS b FROM (SELECT query_id, chunk_id, p, sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * least(128, len - p * 96) / least(128, mean)))) AS s FROM ptf GROUP BY ALL) GROUP BY ALL),
heads AS (SELECT chunk_id, unnest(list_distinct({D.retrieval_tokens("owner_id || ' ' || section")})) AS term FROM chunks),
titled AS (SELECT query_id, chunk_id, count(*) AS titled FROM cands JOIN heads USING (chunk_id) JOIN terms USING (query_id, term) GROUP BY ALL),
counts AS (SELECT query_id, count(*) AS nt FROM terms GROUP BY ALL),
worded AS MATERIALIZED (SELECT c.*, round(CASE WHEN nt IS NULL THEN similarity ELSE 0.30 * similarity + 0.45 * (0.4 * coalesce(f, 0) + 0.6 * greatest(coalesce(f, 0), coalesce(b, 0))) /
  (1 + 0.4 * coalesce(f, 0) + 0.6 * greatest(coalesce(f, 0), coalesce(b, 0))) + 0.15 * coalesce(covered, 0) / nt + 0.10 * coalesce(titled, 0) / nt END, 8) AS rerank
  FROM cands c LEFT JOIN full_ USING (query_id, chunk_id) LEFT JOIN best USING (query_id, chunk_id) LEFT JOIN titled USING (query_id, chunk_id) LEFT JOIN counts USING (query_id))"""
PLAIN = "reranked AS MATERIALIZED (SELECT *, false AS semantic FROM worded)"
JUDGED = """hits AS MATERIALIZED (SELECT r.*, conflict, owner_id, section, max(CAST(exact AS INTEGER)) OVER (PARTITION BY query_id) = 1 AS eq,
  CASE WHEN semantic THEN rerank ELSE similarity END AS judge FROM reranked r JOIN chunks USING (chunk_id)),
top20 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY judge DESC, chunk_id) AS i FROM hits WHERE NOT conflict AND (NOT eq OR exact) AND (semantic OR lexical = 0)),
gaps AS (SELECT query_id, max(CASE WHEN i > CASE WHEN eq THEN 1 ELSE 3 END AND prev - judge > CASE WHEN semantic THEN 2.0 ELSE 0.15 END THEN prev END) AS g FROM (
  SELECT *, lag(judge) OVER (PARTITION BY query_id ORDER BY i) AS prev FROM top20 WHERE i <= 20) GROUP BY ALL),
cutoffs AS (SELECT query_id, greatest(floor, coalesce(g, floor)) AS cutoff FROM (SELECT DISTINCT query_id, CAST(CASE WHEN semantic THEN -2.5 ELSE 0.25 END AS DOUBLE) AS floor FROM hits) LEFT JOIN gaps USING (query_id)),
judged AS MATERIALIZED (SELECT h.*, CASE WHEN conflict THEN 'source_conflict' WHEN eq AND NOT exact THEN 'different_owner'
  WHEN CASE WHEN semantic THEN rerank < cutoff ELSE similarity < cutoff AND lexical <= 0 END THEN 'threshold' END AS reason
  FROM hits h JOIN cutoffs USING (query_id))"""
SHINGLES = "list_distinct(list_transform(range(1, greatest(1, len({t}) - 1)), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]))"
DEDUP = f"""words AS MATERIALIZED (SELECT chunk_id, toks, hash(list_filter(toks, lambda w: regexp_matches(w, '\\p{{Nd}}') OR w IN ('не', 'нельзя', 'без'))) AS crit, {SHINGLES.format(t='toks')} AS sh
  FROM (SELECT chunk_id, {D.search_tokens('text')} AS toks FROM chunks)),
edges AS MATERIALIZED (SELECT a.chunk_id AS a, b.chunk_id AS b FROM words a JOIN words b ON a.chunk_id <> b.chunk_id AND (a.toks = b.toks OR (a.crit = b.crit AND len(a.sh) >= 10 AND len(b.sh) >= 10
  AND len(a.sh) * 0.87 <= len(b.sh) AND len(b.sh) * 0.87 <= len(a.sh) AND len(list_intersect(a.sh, b.sh)) / (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))) >= 0.88)))"""


def _greedy(rows: str, group: str, item: str) -> str:
    """Rows with an earlier neighbour, folded in order; others are kept. rows: group, item, rn, owner."""
    return f"""prior AS MATERIALIZED (SELECT y.{group}, y.{item}, y.rn, list(x.{item}) AS earlier FROM {rows} x JOIN edges e ON x.{item} = e.a JOIN {rows} y ON y.{item} = e.b AND x.{group} = y.{group} AND x.owner = y.owner AND x.rn < y.rn GROUP BY ALL),
folded AS (SELECT {group}, list_reduce(list({{'drop': CAST([] AS BIGINT[]), 'item': {item}, 'earlier': earlier}} ORDER BY rn),
  lambda acc, x: {{'drop': CASE WHEN len(list_filter(x.earlier, lambda e: NOT list_contains(acc.drop, e))) > 0 THEN list_append(acc.drop, x.item) ELSE acc.drop END, 'item': x.item, 'earlier': x.earlier}},
  {{'drop': CAST([] AS BIGINT[]), 'item': CAST(0 AS BIGINT), 'earlier': CAST([] AS BIGINT[])}}) AS f FROM prior GROUP BY ALL),
dups AS (SELECT {group}, unnest(f.drop) AS {item} FROM folded)"""


SELECTED = f"""elig AS MATERIALIZED (SELECT query_id, chunk_id, owner_id AS owner, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS rn FROM judged WHERE reason IS NULL),
{DEDUP}, {_greedy('elig', 'query_id', 'chunk_id')},
marked AS MATERIALIZED (SELECT j.* REPLACE (CASE WHEN d.query_id IS NOT NULL THEN 'duplicate' ELSE reason END AS reason) FROM judged j LEFT JOIN dups d USING (query_id, chunk_id)),
deep AS (SELECT *, row_number() OVER (PARTITION BY query_id, owner_id ORDER BY rerank DESC, chunk_id) AS depth,
  first_value(rerank) OVER (PARTITION BY query_id, owner_id ORDER BY rerank DESC, chunk_id) AS fr, first_value(chunk_id) OVER (PARTITION BY query_id, owner_id ORDER BY rerank DESC, chunk_id) AS fc
  FROM marked WHERE reason IS NULL),
chosen AS (SELECT query_id, chunk_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, fr DESC, fc) AS position FROM deep WHERE depth <= CASE WHEN eq THEN 8 ELSE 2 END) WHERE position <= 8),
final AS (SELECT m.*, position, position IS NOT NULL AS selected, coalesce(m.reason, CASE WHEN position IS NOT NULL THEN 'selected' ELSE 'family_limit' END) AS verdict FROM marked m LEFT JOIN chosen USING (query_id, chunk_id))"""



def final_sql(questions: str, reranked: str = PLAIN) -> str:
    """All stages for other questions, or with other scores of the second stage."""
    return f"WITH {base_sql(questions)}, {LEXICAL}, {EXACT}, {RANKED}, {CANDIDATES}, {RERANK}, {reranked}, {JUDGED}, {SELECTED}"


STAGE_LEX = f"WITH {base_sql(QUESTIONS)}, {LEXICAL}"
STAGE_RANK = f"{STAGE_LEX}, {EXACT}, {RANKED}, {CANDIDATES}"
STAGE_RERANK = f"{STAGE_RANK}, {RERANK}, {PLAIN}"
STAGE_JUDGED = f"{STAGE_RERANK}, {JUDGED}"
STAGE_FINAL = final_sql(QUESTIONS)


# --- queries -------------------------------------------------------------------------------------
def token_tables(spark, d):
    rows = derive(spark, d, CHUNKS)
    whole = cut_lineage(tokenize(rows, "chunk_id", F.concat_ws("\n", "text", "section", "owner_id")))
    return rows, whole, query_terms(derive(spark, d, QUESTIONS))


@query("corpus_stats", f"""WITH docs AS (SELECT doc_id AS chunk_id, {D.retrieval_tokens('text')} AS toks FROM documents)
SELECT term, count(*) AS df, (SELECT count(*) FROM docs) AS n_chunks, (SELECT round(greatest(1, avg(len(toks))), 6) FROM docs) AS mean_length
FROM (SELECT unnest(list_distinct(toks)) AS term FROM docs) GROUP BY term""")
def corpus_stats_query(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id")
    tokens = cut_lineage(tokenize(docs, "chunk_id", F.col("text")))
    return corpus_stats(tokens).withColumn("mean_length", F.round("mean_length", 6))


@query("bm25", f"{STAGE_LEX} SELECT query_id, chunk_id, lexical, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rank FROM lexical) WHERE rank <= 10")
def bm25_query(spark, d):
    _, tokens, terms = token_tables(spark, d)
    return top_rows(bm25(terms, tokens), ["query_id"], [F.desc("lexical"), "chunk_id"], 10)


@query("exact_entity_match", f"WITH chunks AS ({CHUNKS}), questions AS ({QUESTIONS}), {EXACT} SELECT query_id, chunk_id, true AS exact, in_text FROM exact")
def exact_entity_match(spark, d):
    rows = derive(spark, d, CHUNKS).withColumn("family_names", F.array("owner_id"))
    return R.exact_entity_match(derive(spark, d, QUESTIONS), rows)


# Ranks are wanted for the best of either channel only; they are places among all chunks.
BEST = "dense_rank <= 60 OR lexical_rank BETWEEN 1 AND 40"


@query("rank_channels", f"{STAGE_LEX}, {RANKED} SELECT query_id, chunk_id, similarity, lexical, dense_rank, lexical_rank FROM ranked WHERE {BEST}")
def rank_channels(spark, d):
    _, tokens, terms = token_tables(spark, d)
    words = cut_lineage(R.lexical_ranks(bm25(terms, tokens)))
    dense = dense_candidates(questions(spark, d), chunks(spark, d), R.DENSE_WINDOW, words.filter(F.col("lexical_rank") <= R.LEXICAL_WINDOW))
    return R.rank_channels(dense, words)


@query("rrf", f"""{STAGE_LEX}, {RANKED} SELECT query_id, chunk_id, round(1 / (60 + dense_rank) + CASE WHEN lexical_rank > 0 THEN 1 / (60 + lexical_rank) ELSE 0 END, 9) AS fusion FROM ranked WHERE {BEST}""")
def rrf(spark, d):
    return rank_channels(spark, d).select("query_id", "chunk_id", R.rrf(F.col("dense_rank"), F.col("lexical_rank")).alias("fusion"))


def found(asked, rows):
    return cut_lineage(P.hybrid_candidates(asked, rows))


@query("candidates", f"{STAGE_RANK} SELECT query_id, chunk_id, similarity, lexical, dense_rank, lexical_rank, exact, card, fusion FROM cands")
def candidates(spark, d):
    return found(questions(spark, d), chunks(spark, d)).select("query_id", "chunk_id", "similarity", "lexical", "dense_rank", "lexical_rank", "exact", "card", "fusion")


def reranked(spark, d):
    asked, rows = questions(spark, d), chunks(spark, d)
    cands = found(asked, rows)
    terms = query_terms(asked)
    bodies = cut_lineage(asked_tokens(tokenize(rows, "chunk_id", F.col("text")), terms, placed=True))
    heads = tokenize(rows, "chunk_id", F.concat_ws(" ", "owner_id", "section"))
    return lexical_rerank(cands, terms, bodies, heads), rows


@query("lexical_rerank", f"{STAGE_RERANK} SELECT query_id, chunk_id, rerank FROM reranked")
def lexical_rerank_query(spark, d):
    return reranked(spark, d)[0].select("query_id", "chunk_id", "rerank")


def hits(spark, d):
    rows, facts = reranked(spark, d)
    return cut_lineage(merged(rows).join(facts.select("chunk_id", "conflict", "owner_id", "family_names", "section"), "chunk_id"))


@query("gap_cutoff", f"{STAGE_JUDGED} SELECT query_id, cutoff FROM cutoffs")
def gap_cutoff(spark, d):
    return R.gap_cutoff(hits(spark, d))


@query("reject_reason", f"{STAGE_JUDGED} SELECT query_id, chunk_id, reason FROM judged")
def reject_reason(spark, d):
    rows = hits(spark, d)
    return R.reject_reason(rows, R.gap_cutoff(rows)).select("query_id", "chunk_id", "reason")


@query("near_duplicates", f"{STAGE_FINAL} SELECT e.query_id, e.chunk_id, d.chunk_id IS NOT NULL AS duplicate FROM elig e LEFT JOIN dups d USING (query_id, chunk_id)")
def near_duplicates_query(spark, d):
    rows = hits(spark, d)
    judged = R.reject_reason(rows, R.gap_cutoff(rows)).filter("reason IS NULL").withColumn("_r", -F.col("rerank"))
    words = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), search_tokens(F.col("text")).alias("_t"))
    out = near_duplicates(judged, ["query_id", "owner_id"], "chunk_id", ["_r"], signatures(words, "chunk_id", "_t"))
    return out.select("query_id", "chunk_id", "duplicate")


@query("corpus_near_duplicates", f"""WITH chunks AS (SELECT doc_id AS chunk_id, text FROM documents), rows AS (SELECT 0 AS g, doc_id AS chunk_id, lang AS owner, doc_id AS rn FROM documents),
{DEDUP}, {_greedy('rows', 'g', 'chunk_id')} SELECT r.chunk_id AS doc_id, d.chunk_id IS NOT NULL AS duplicate FROM rows r LEFT JOIN dups d USING (g, chunk_id)""")
def corpus_near_duplicates(spark, d):
    docs = table(spark, d, "documents").withColumn("_t", search_tokens(F.col("text")))
    return near_duplicates(docs, ["lang"], "doc_id", [], signatures(docs, "doc_id", "_t")).select("doc_id", "duplicate")


@query("diversify", f"{STAGE_FINAL} SELECT query_id, chunk_id, CAST(position AS INTEGER) AS position FROM final WHERE selected")
def diversify(spark, d):
    return hybrid(spark, d).filter("selected").select("query_id", "chunk_id", "position")


def hybrid(spark, d):
    return P.hybrid_search(questions(spark, d), chunks(spark, d))


@query("hybrid_search", f"""{STAGE_FINAL} SELECT query_id, chunk_id, similarity, lexical, dense_rank, lexical_rank, fusion, rerank, exact, selected, verdict AS reason FROM final""")
def hybrid_search(spark, d):
    return hybrid(spark, d).select(
        "query_id", "chunk_id", "similarity", "lexical", "dense_rank", "lexical_rank", "fusion", "rerank", "exact", "selected", "reason")


# --- modes and lists of questions ----------------------------------------------------------------
MODEL_OF = "CASE item_id % 3 WHEN 1 THEN 'sizes' WHEN 2 THEN 'flaky' END"
SCORED = f"""windows AS (SELECT chunk_id, concat_ws(chr(10), owner_id, section, w.text) AS passage FROM ({windows_sql('chunks', 'chunk_id', 300, 50)}) w JOIN chunks USING (chunk_id)),
scores AS MATERIALIZED (SELECT chunk_id, max(CAST(length(passage) % 13 - 5 AS DOUBLE)) AS s FROM windows GROUP BY chunk_id),
models AS (SELECT item_id AS query_id, {MODEL_OF} AS model, text FROM benchmark),
asked_of AS (SELECT query_id, model, model = 'flaky' AND length(q.text) % 2 = 0 AS down FROM models JOIN questions q USING (query_id) WHERE model IS NOT NULL),
lacking AS (SELECT DISTINCT query_id FROM worded w LEFT JOIN scores USING (chunk_id) WHERE s IS NULL),
good AS (SELECT query_id, model FROM asked_of WHERE NOT down AND query_id NOT IN (SELECT query_id FROM lacking)),
reranked AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN g.query_id IS NULL THEN rerank ELSE s END AS rerank), g.query_id IS NOT NULL AS semantic,
  CASE WHEN g.query_id IS NOT NULL THEN 'cross_encoder:' || g.model WHEN a.query_id IS NOT NULL THEN 'lexical_fallback:reranker_unavailable' ELSE 'lexical_fallback' END AS mode,
  CASE WHEN g.query_id IS NULL AND a.query_id IS NOT NULL THEN CASE WHEN a.down THEN 'reranker_TimeoutError' ELSE 'reranker_missing' END END AS reranker_error
  FROM worded w LEFT JOIN scores USING (chunk_id) LEFT JOIN asked_of a USING (query_id) LEFT JOIN good g USING (query_id))"""


def _sizes(question, texts):
    return [len(t) % 13 - 5.0 for t in texts]


def _flaky(question, texts):
    if len(question) % 2 == 0:
        raise TimeoutError("model is down")
    return _sizes(question, texts)


@query("hybrid_search_modes", f"""{final_sql(QUESTIONS, SCORED)} SELECT query_id, chunk_id, rerank, mode, reranker_error, selected, verdict AS reason FROM final""")
def hybrid_search_modes(spark, d):
    asked = questions(spark, d).join(derive(spark, d, f"SELECT item_id AS query_id, {MODEL_OF} AS model FROM benchmark"), "query_id")
    hits = P.hybrid_search(asked, chunks(spark, d), models={"sizes": _sizes, "flaky": _flaky})
    return hits.select("query_id", "chunk_id", "rerank", "mode", "reranker_error", "selected", "reason")


LISTED = """SELECT a.item_id AS message_id, '1. ' || a.text || '? 2. ' || b.text || '!' AS text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 AND a.item_id % 2 = 0"""
EACH = f"""SELECT message_id || '#' || number AS query_id, {D.strip('question')} AS text FROM (
  SELECT item_id - item_id % 2 AS message_id, item_id % 2 + 1 AS number, text || CASE WHEN item_id % 2 = 0 THEN '?' ELSE '!' END AS question FROM benchmark
  WHERE item_id - item_id % 2 + 1 IN (SELECT item_id FROM benchmark) AND item_id - item_id % 2 IN (SELECT item_id FROM benchmark))"""


@query("multi_question_search", f"""{final_sql(EACH)},
each_ AS (SELECT query_id, CAST(split_part(query_id, '#', 1) AS BIGINT) AS message_id, CAST(split_part(query_id, '#', 2) AS INTEGER) AS number FROM questions),
counts_ AS (SELECT query_id, count(*) AS n FROM final GROUP BY query_id),
given AS (SELECT query_id, message_id, number, position, chunk_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY number, position) AS INTEGER) AS place,
  number > min(number) OVER (PARTITION BY message_id, chunk_id) AS repeated FROM final JOIN each_ USING (query_id) WHERE selected)
SELECT e.message_id, e.number, (SELECT count(*) FROM chunks) AS n_scanned, CAST(coalesce(n, 0) AS BIGINT) AS n_candidates, place, CAST(position AS INTEGER) AS position, chunk_id, repeated
FROM each_ e LEFT JOIN counts_ USING (query_id) LEFT JOIN given USING (query_id)""")
def multi_question_search(spark, d):
    encode = lambda rows: hashing_vectors(rows, "query_id", F.col("text"))
    contexts, _ = P.multi_question_search(derive(spark, d, LISTED), chunks(spark, d), encode)
    contexts = cut_lineage(contexts)
    sources = P.message_sources(contexts).select("message_id", "number", "place", "position", "chunk_id", "repeated")
    return contexts.select("message_id", "number", "n_scanned", "n_candidates").join(sources, ["message_id", "number"], "left")
