"""Queries over scalar and per-row expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import messages as M, text as X
from lodestone.functions.units import status_of, to_unit
from lodestone.functions.vectors import text_rotation
from lodestone.queries import duck as D
from lodestone.registry import query
from lodestone.session import derive, table
from lodestone.sources.blocks import blocks_from_lines, page_elements, structure_blocks

# Names with joined identifiers, made of brand and type of every part.
PART_NAMES = """SELECT p_partkey, replace(p_brand, '#', '_') || '_' || p_type AS name,
  p_name, p_size, p_retailprice FROM part"""


@query("stable_id", "SELECT doc_id, sha256(doc_id || '|' || source || '|' || text) AS id FROM documents")
def stable_id(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.stable_id(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("id")
    )


@query("search_tokens", f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {D.search_tokens('text')} AS t FROM documents)""")
def search_tokens(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", X.search_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("stem", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{{L}}\\p{{N}}_]+')) AS word
FROM documents) SELECT word, {D.stem('word')} AS stem FROM w""")
def stem(spark, d):
    words = table(spark, d, "documents").select(
        F.explode(F.regexp_extract_all(X.fold(F.col("text")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")
    ).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


@query("retrieval_tokens", f"""SELECT p_partkey, array_to_string({D.retrieval_tokens("'Part ' || name || ' for ' || p_name")}, ' ') AS tokens
FROM ({PART_NAMES})""")
def retrieval_tokens(spark, d):
    parts = derive(spark, d, PART_NAMES)
    text = F.concat(F.lit("Part "), "name", F.lit(" for "), "p_name")
    return parts.select("p_partkey", F.array_join(X.retrieval_tokens(text), " ").alias("tokens"))


HEADINGS = f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN name WHEN 1 THEN name || ' №' || p_size || ' (' || p_name || ')'
  WHEN 2 THEN p_name ELSE name || ' / ' || name || '_B; ' || upper(name) END AS heading, name FROM ({PART_NAMES})"""
NAME_RE = r"[\p{L}\p{N}][\p{L}\p{N}_№.+\-]*_[\p{L}\p{N}_№.+\-]+(?:[ ]+[\p{L}\p{N}_№.\-]+)*"


@query("entity_name", f"""SELECT p_partkey, heading, nullif(regexp_extract(heading, '^({NAME_RE})(?:\\s+\\([^\\r\\n]*\\))?$', 1), '') AS entity
FROM ({HEADINGS})""")
def entity_name(spark, d):
    return derive(spark, d, HEADINGS).select("p_partkey", "heading", X.entity_name(F.col("heading")).alias("entity"))


@query("entity_names", f"""SELECT p_partkey, CASE WHEN len(list_filter(n, lambda x: x IS NULL)) = 0 THEN array_to_string(list_filter(n,
  lambda x, i: list_position(list_transform(n, lambda y: lower(y)), lower(x)) = i), '|') ELSE '' END AS names
FROM (SELECT p_partkey, list_transform(regexp_split_to_array(heading, '\\s*/\\s*|\\s*;\\s*'),
  lambda p: nullif(regexp_extract(p, '^({NAME_RE})(?:\\s+\\([^\\r\\n]*\\))?$', 1), '')) AS n FROM ({HEADINGS}))""")
def entity_names(spark, d):
    return derive(spark, d, HEADINGS).select("p_partkey", F.array_join(X.entity_names(F.col("heading")), "|").alias("names"))


@query("contains_name", f"""SELECT p_partkey, regexp_matches(heading, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_№.+\\-])' || name ||
  '(?:$|[^\\p{{L}}\\p{{N}}_№+.\\-]|\\.$|\\.[^\\p{{L}}\\p{{N}}])') AS found FROM ({HEADINGS})""")
def contains_name(spark, d):
    return derive(spark, d, HEADINGS).select("p_partkey", X.contains_name(F.col("heading"), F.col("name")).alias("found"))


INPUT_DOCS = """SELECT doc_id, lang, source, 'ОБЩАЯ ИНФОРМАЦИЯ' || chr(10) || text || chr(10) ||
  'В этой статье описано всё' AS text FROM documents"""


@query("embedding_input", f"""SELECT doc_id, sha256(array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), chr(10))) AS input_hash FROM (
SELECT doc_id, list_filter([lang || '; ' || source, source, lang, array_to_string(list_filter(string_split(text, chr(10)),
 lambda l: NOT regexp_matches({D.strip('l')}, '(?i)^(?:В этой статье описано|ОБЩАЯ ИНФОРМАЦИЯ$|ПАРАМЕТРЫ И СВОЙСТВА$|РАЗМЕЩЕНИЕ В МОДЕЛИ$|РАБОТА С ЭКЗЕМПЛЯРОМ$)')),
 chr(10))], lambda x: {D.strip('x')} <> '') AS p FROM ({INPUT_DOCS}))""")
def embedding_input(spark, d):
    docs = derive(spark, d, INPUT_DOCS)
    value = X.embedding_input(F.col("text"), F.col("lang"), F.array("lang", "source"), F.col("source"))
    return docs.select("doc_id", F.sha2(value, 256).alias("input_hash"))


@query("mask_secrets", f"""SELECT doc_id, {D.squeeze(f"regexp_replace(regexp_replace(text, '(?i)\\b(?:sk-[\\w-]+|Bearer\\s+\\S+|(?:api[_ -]?key|token|password|secret|пароль|токен)\\s*[:=]\\s*\\S+)', '[скрыто]', 'g'), '[\\p{{Cc}}\\p{{Cf}}]', ' ', 'g')")} AS masked FROM documents""")
def mask_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.mask_secrets(F.col("text")).alias("masked"))


def describe_sql(e: str) -> str:
    """The first part that is not blank; a sentence end before a capital becomes a mark, since there is no looking around."""
    marked = f"regexp_replace({D.strip(e)}, '([.!?])\\s+([А-ЯЁA-Z])', '\\1' || chr(30) || '\\2', 'g')"
    parts = f"regexp_split_to_array({marked}, '\\r?\\n|;\\s+|' || chr(30))"
    return D.squeeze(f"coalesce(list_filter({parts}, lambda x: {D.strip('x')} <> '')[1], {e})")


@query("describe", f"SELECT doc_id, {describe_sql('text')} AS description FROM documents")
def describe(spark, d):
    return table(spark, d, "documents").select("doc_id", X.describe(F.col("text")).alias("description"))


@query("strip_after_marker", """SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1)
ELSE text END AS head FROM documents""")
def strip_after_marker(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_after_marker(F.col("text"), "\n").alias("head"))


ANSWERS = """SELECT conv_id, turn, '✅ 1. ' || text || chr(10) || '▫️ Цитаты:' || chr(10) || '"' || text || '"' || chr(10) ||
  '✅ 2. ' || text || chr(10) || '▫️ Источники:' || chr(10) || 'chunk_id: x' AS answer FROM conversations"""


@query("strip_citations", "SELECT conv_id, turn, '✅ 1. ' || text || chr(10) || '✅ 2. ' || text AS kept FROM conversations")
def strip_citations(spark, d):
    return derive(spark, d, ANSWERS).select("conv_id", "turn", M.strip_citations(F.col("answer")).alias("kept"))


PROMPTS = """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Compare my model, please. ' WHEN 1 THEN 'Как выглядит элемент? '
  WHEN 2 THEN 'Расскажи подробно. ' WHEN 3 THEN 'Какой параметр, толщина? ' WHEN 4 THEN 'Прочитай текущую модель: ' ELSE '' END || text AS text
  FROM conversations"""


def _flag(pattern: str) -> str:
    pattern = pattern.replace(r"\w*", r"[\p{L}\p{N}_]*")
    return f"regexp_matches(text, '(?i){pattern}')"


# RE2 has ASCII \b only, so the word-final form is spelled out here.
_APPEARS = _flag(r"выгляд|внешн\p{L}*\s+вид|форм[аыуе](?:$|[^\p{L}\p{N}_])|изображен|картинк|эскиз|визуальн")


@query("intent_labels", f"""SELECT conv_id, turn, {_flag(M.MODEL_DATA)} AS needs_model_data, {_APPEARS} AS appearance,
{_flag(M.DETAILED)} AS detailed, {_flag(M.PARAMETER_LIKE)} AS parameter_like,
CASE WHEN {_APPEARS} THEN 'image' WHEN {_flag(M.PARAMETER_LIKE)} THEN 'parameter' ELSE 'category' END AS hint FROM ({PROMPTS})""")
def intent_labels(spark, d):
    prompts = derive(spark, d, PROMPTS)
    return prompts.select("conv_id", "turn", *[c.alias(n) for n, c in M.intent_labels(F.col("text")).items()])


LISTS = """SELECT conv_id * 1000 + turn AS msg, CASE turn % 3 WHEN 0 THEN '1. ' || role || ' one? 2. ' || role || ' two! 3. ' || role
  WHEN 1 THEN '1. ' || role || '? 3. gap' ELSE text END AS text FROM conversations"""


@query("split_questions", """SELECT conv_id * 1000 + turn AS msg, CAST(n AS INTEGER) AS number,
  CASE WHEN turn % 3 = 0 THEN role || [' one?', ' two!', ''][n] WHEN turn % 3 = 1 THEN '1. ' || role || '? 3. gap' ELSE text END AS question
FROM conversations, (VALUES (1), (2), (3)) v(n) WHERE n = 1 OR turn % 3 = 0""")
def split_questions(spark, d):
    return M.split_questions(derive(spark, d, LISTS), "msg", "text")


DECLARING = """SELECT conv_id, turn, 'Цель: build ' || role || '. Ограничение: only turn ' || turn || '. ' || text AS text FROM conversations"""


@query("explicit_declarations", """SELECT conv_id, turn, 1 AS seq, 'goal' AS category, 'set' AS action, 'build ' || role AS value,
  'Цель: build ' || role AS evidence FROM conversations UNION ALL
SELECT conv_id, turn, 2, 'constraints', 'add', 'only turn ' || turn, ' Ограничение: only turn ' || turn FROM conversations""")
def explicit_declarations(spark, d):
    return M.explicit_declarations(derive(spark, d, DECLARING), ["conv_id", "turn"], "text")


@query("resolve_query", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text
 WHEN 1 THEN text || chr(10) || 'Уточнения из состояния чата: ' || 'Family_' || conv_id
 ELSE text || chr(10) || 'Уточнения из состояния чата: ' || 'Family_' || conv_id || '; Параметр ' || turn END AS resolved FROM conversations""")
def resolve_query(spark, d):
    rows = table(spark, d, "conversations")
    asked = F.element_at(F.array(F.lit("Что это?"), F.lit("Как поставить это семейство?"), F.lit("Где тот параметр?")),
                         (F.col("turn") % 3 + 1).cast("int"))
    selections = F.array(F.concat(F.lit("Family_"), F.col("conv_id").cast("string")))
    terms = F.array(F.concat(F.lit("Параметр "), F.col("turn").cast("string")), F.lit("иное"))
    return rows.select("conv_id", "turn", M.resolve_query(asked, F.col("text"), selections, terms, selections).alias("resolved"))


VALUES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_discount = 0 THEN ' ' WHEN l_discount < 0.03 THEN NULL ELSE l_returnflag END AS display,
  CASE WHEN l_tax > 0.01 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS converted, l_linestatus AS raw FROM lineitem"""


@query("best_value", f"""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN blank THEN coalesce(converted, raw) ELSE display END AS value,
CASE WHEN blank AND converted IS NOT NULL THEN 'mm' END AS unit FROM (SELECT *, display IS NULL OR trim(display) = '' AS blank FROM ({VALUES}))""")
def best_value(spark, d):
    rows = derive(spark, d, VALUES)
    best = X.best_value(F.col("display"), F.col("converted"), F.col("raw"), F.lit("mm"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", best.alias("b")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "b.value", "b.unit")


MEASURES = """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'length' WHEN 1 THEN 'area' WHEN 2 THEN 'volume' WHEN 3 THEN 'length' ELSE 'mass' END AS spec,
  CASE WHEN p_size % 10 = 3 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS v FROM part"""


@query("to_unit", f"""SELECT p_partkey, spec, CASE WHEN spec = 'mass' THEN 'notApplicable' WHEN isnan(v) THEN 'error' ELSE 'ok' END AS status,
CASE WHEN spec = 'mass' OR isnan(v) THEN NULL ELSE round(v * CASE spec WHEN 'length' THEN 304.8 WHEN 'area' THEN 0.09290304 ELSE 0.028316846592 END, 6) END AS value,
CASE WHEN spec = 'mass' OR isnan(v) THEN NULL ELSE CASE spec WHEN 'length' THEN 'мм' WHEN 'area' THEN 'м²' ELSE 'м³' END END AS unit FROM ({MEASURES})""")
def to_unit_query(spark, d):
    out = to_unit(derive(spark, d, MEASURES), "v", "spec")
    return out.select("p_partkey", "spec", "status", F.round("value", 6).alias("value"), "unit")


@query("pick_fields", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k":' || (props->>'k') || ',"user":' || user_id || '}' ELSE '{"k":' || (props->>'k') || '}' END AS picked
FROM events""")
def pick_fields(spark, d):
    events = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    even = F.concat(F.lit('{"noise":[1,2],"k":'), k, F.lit(',"user":'), F.col("user_id").cast("string"), F.lit("}"))
    json = F.when(F.col("event_id") % 2 == 0, even).otherwise(F.col("props"))
    return events.select("event_id", M.pick_fields(json, ["k", "user"]).alias("picked"))


@query("utf8_bytes", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, strlen(text) + 300 + 64 + 512 <= 4096 AS fits FROM documents")
def utf8_bytes(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.utf8_bytes(F.col("text")).alias("bytes"), X.fits_budget(F.col("text"), 300, 512, 4096).alias("fits"))


@query("token_estimate", "SELECT doc_id, CAST(floor((strlen(text) + 3) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("token_count", f"SELECT doc_id, {D.token_count('text')} AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query("tag_ocr_lines", """SELECT doc_id, string_agg(CASE WHEN (length(l) % 10) / 10 >= 0.8 THEN l ELSE '[неуверенное OCR] ' || l END, chr(10) ORDER BY i) AS ocr_text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id""")
def tag_ocr_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return M.tag_ocr_lines(lines.withColumn("confidence", F.length("text") % 10 / 10), ["doc_id"])


MARKDOWN = """SELECT conv_id, turn, '## ' || role || chr(10) || '**bold** ' || turn || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) ||
  '| ' || turn || ' | x |' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || 'see [doc](u)' AS md FROM conversations"""


@query("markdown_to_plain", """SELECT conv_id, turn, role || chr(10) || 'bold ' || turn || chr(10) || 'a; b' || chr(10) || '- a: ' || turn || '; b: x' || chr(10) ||
  '# code' || chr(10) || 'see doc (u)' AS plain FROM conversations""")
def markdown_to_plain(spark, d):
    return derive(spark, d, MARKDOWN).select("conv_id", "turn", M.markdown_to_plain(F.col("md")).alias("plain"))


@query("requested_filters", """WITH q AS (SELECT event_id AS question_id, 'Элемент ID: ' || event_id || ', ' || user_id || ' и ' || event_type AS question FROM events)
SELECT DISTINCT question_id, 'id' AS kind, unnest(regexp_extract_all(regexp_extract(question, 'ID: ([0-9, ]+)', 1), '[0-9]+')) AS value FROM q
UNION ALL SELECT question_id, 'name', p_type FROM q, (SELECT DISTINCT event_type AS p_type FROM events) n WHERE length(p_type) >= 3 AND contains(question, p_type)""")
def requested_filters(spark, d):
    events = table(spark, d, "events")
    asked = F.concat(F.lit("Элемент ID: "), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit(" и "), "event_type")
    questions = events.select(F.col("event_id").alias("question_id"), asked.alias("question"))
    return M.requested_filters(questions, events.select(F.col("event_type").alias("name")))


@query("valid_messages", f"SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND {D.strip('text')} <> ''")
def valid_messages(spark, d):
    return M.valid_messages(table(spark, d, "conversations"), "role", "text")


READS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS errors, o_totalprice > 200000 AS has_value, o_orderpriority < '3' AS was_read FROM orders"


@query("status_of", f"""SELECT o_orderkey, CASE WHEN errors > 0 THEN CASE WHEN was_read THEN 'partial' ELSE 'error' END WHEN NOT has_value THEN 'noValue' ELSE 'ok' END AS status
FROM ({READS})""")
def status_of_query(spark, d):
    rows = derive(spark, d, READS)
    return rows.select("o_orderkey", status_of(F.col("errors"), F.col("has_value"), F.col("was_read")).alias("status"))


DIRECTIONS = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS bx, l_discount * 100 AS b_y, l_tax * 100 AS bz FROM lineitem"""


@query("text_rotation", f"SELECT l_orderkey, l_linenumber, l_partkey, round(atan2(b_y + bz, bx - b_y), 6) AS angle FROM ({DIRECTIONS})")
def text_rotation_query(spark, d):
    def vector(x, y, z):
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))

    base = F.struct(F.col("bx").alias("x"), F.col("b_y").alias("y"), F.col("bz").alias("z"))
    angle = text_rotation(base, vector(0.0, 1.0, 1.0), vector(1.0, -1.0, 0.0))
    return derive(spark, d, DIRECTIONS).select("l_orderkey", "l_linenumber", "l_partkey", F.round(angle, 6).alias("angle"))


@query("question_limits", f"""SELECT doc_id, CASE WHEN {D.strip('text')} = '' THEN 'blank' WHEN {D.token_count('text')} > 8191 THEN 'too_long'
WHEN n_chars % 150 NOT BETWEEN 1 AND 100 THEN 'bad_top_k' ELSE 'ok' END AS validity FROM documents""")
def question_limits(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", M.question_limits(F.col("text"), X.token_count(F.col("text")), F.col("n_chars") % 150).alias("validity"))


LINE_BLOCKS = f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, 'Страница ' || b.page AS section, b.text AS text FROM (
SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
lambda s, i: {{'page': i, 'text': {D.strip('s')}}}), lambda s: s.text <> '') AS l FROM documents))"""


@query("blocks_from_lines", f"SELECT *, 'paragraph' AS kind FROM ({LINE_BLOCKS})")
def blocks_from_lines_query(spark, d):
    return blocks_from_lines(table(spark, d, "documents"))


@query("structure_blocks")
def structure_blocks_query(spark, d):
    return structure_blocks(page_elements(table(spark, d, "pages"))).select(
        "source", "ordinal", "section", "text", "kind", "heading_level", "block_id")
