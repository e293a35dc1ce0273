"""Column expressions over questions, chat messages and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import char_grams, strip
from lodestone.session import sized

# Routing patterns and declaration labels.
MODEL_DATA = (
    r"\bmcp[1-6]?\b|\b(get-model|get-documentation|compare-model-versions|extract-family-library|"
    r"compare-family-library|recommend-family-unification|recommend-family-from-passport)\b|"
    r"(?:прочитай|получи|покажи|проверь|проанализируй|считай|сравни|сравнить|изменения).{0,80}"
    r"(?:текущ\w* модел|мо\w* модел|верс\w* модел|снимк\w*|модел\w* revit)|"
    r"(?:текущ\w* модел|мо\w* модел|верс\w* модел).{0,80}(?:параметр|элемент|изменени|сравни)|"
    r"\b(read|inspect|compare|fetch|changes)\b.{0,80}\b(current model|my model|model versions|snapshots)\b"
)
APPEARANCE = r"выгляд|внешн\p{L}*\s+вид|форм[аыуе]\b|изображен|картинк|эскиз|визуальн"
DETAILED = r"подроб|деталь|detail|in depth"
PARAMETER_LIKE = r"параметр|размер|толщин"
DECLARATIONS = {
    "цель": "goal",
    "ограничение": "constraints",
    "уточнение": "clarifications",
    "термин": "terms",
    "решение": "decisions",
}
DECLARED = r"(?iuU)(?:^|(?<=[.!?])\s+)(Цель|Ограничение|Уточнение|Термин|Решение):\s*(.+?)(?=[.!?](?:\s|$)|$)"
DEFINED = r"(?iuU)Под (.+?) (?:дальше )?понимаем (.+?)(?=[.!?](?:\s|$)|$)"
LIST_MARK = r"(?U)(?:^\s*|(?<=[?!])\s*)([1-9][0-9]*)\.\s*"
CITATION_HEADS = ("▫️ Источники:", "▫️ Цитаты:")
ANSWER_HEAD = r"(?U)^[\p{S}\p{M}]+\s+[1-9]\d*\.\s"
SUBJECT_REFERENCE = r"(?iuU)(?:эт\p{L}*|выбранн\p{L}*)\s+семейств"
PARAMETER_REFERENCE = r"(?iuU)(?:тот|того|тому|тем|том|эт\p{L}*)\s+параметр"
ANCHOR_LABEL = "\nУточнения из состояния чата: "
ID_MENTION = r"(?iu)(?:\bElementId|\bID|элемент(?:а|ов)?)[\s:#№]*(\d+(?:\s*[,;]\s*\d+)*)"
FENCE = r"(?U)^\s*(`{3,}|~{3,})"
RULE_ROW = r"(?U)^\s*\|?\s*:?-{3,}:?\s*\|[\s|:\-]*$"
HEADING_MARK = r"(?U)^\s{0,3}#{1,6}\s+"
EMPHASIS = r"\*\*(.+?)\*\*|__(.+?)__"
INLINE_CODE = r"`+([^`]+)`+"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
MAX_TOKENS = 8191
MAX_FACT = 600


def intent_labels(text: Column) -> dict[str, Column]:
    """Routing flags of a message."""
    flags = {"needs_model_data": MODEL_DATA, "appearance": APPEARANCE, "detailed": DETAILED, "parameter_like": PARAMETER_LIKE}
    out = {name: text.rlike(f"(?iuU){pattern}") for name, pattern in flags.items()}
    out["hint"] = (
        F.when(out["appearance"], "image").when(out["parameter_like"], "parameter").otherwise("category")
    )
    return out


def split_questions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, number, question): a list 1., 2., … at the start and after '?' or '!', else one row."""
    value = F.col(text)
    numbers = F.regexp_extract_all(value, F.lit(LIST_MARK), F.lit(1))
    # Splitting at the marks keeps the text before the first one in front.
    parts = F.split(value, LIST_MARK)
    items = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), strip)
    counted = F.forall(F.transform(numbers, lambda n, i: n == (i + 1).cast("string")), lambda ok: ok)
    listed = (
        (F.size(numbers) >= 2) & (strip(F.element_at(parts, 1)) == "") & counted
        & (F.size(items) == F.size(numbers)) & F.forall(items, lambda q: q != "")
    )
    chosen = F.when(listed, items).otherwise(F.array(value))
    return df.select(key, F.posexplode(chosen).alias("_i", "question")).select(
        key, (F.col("_i") + 1).alias("number"), "question"
    )


def explicit_declarations(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Change rows stated outright in a message: labelled sentences and definitions."""
    value = F.col(text)
    kinds = F.create_map(*[F.lit(x) for pair in DECLARATIONS.items() for x in pair])
    rows = F.arrays_zip(
        F.regexp_extract_all(value, F.lit(DECLARED), F.lit(1)).alias("label"),
        F.regexp_extract_all(value, F.lit(DECLARED), F.lit(2)).alias("value"),
        F.regexp_extract_all(value, F.lit(DECLARED), F.lit(0)).alias("evidence"),
    )
    labelled = F.transform(
        F.filter(
            rows, lambda r: (strip(r["value"]) != "") & (F.length(strip(r["value"])) <= MAX_FACT)
            & (F.length(r["evidence"]) <= MAX_FACT)
        ),
        lambda r: F.struct(
            kinds[F.lower(r["label"])].alias("category"),
            F.when(F.lower(r["label"]) == "цель", "set").otherwise("add").alias("action"),
            strip(r["value"]).alias("value"),
            r["evidence"].alias("evidence"),
        ),
    )
    whole = F.regexp_extract(value, DEFINED, 0)
    definition = F.struct(
        F.lit("terms").alias("category"),
        F.lit("add").alias("action"),
        F.concat(F.regexp_extract(value, DEFINED, 1), F.lit(" = "), F.regexp_extract(value, DEFINED, 2)).alias("value"),
        whole.alias("evidence"),
    )
    defined = F.when((whole != "") & (F.length(whole) <= MAX_FACT), F.array(definition)).otherwise(
        F.slice(F.array(definition), 1, 0)
    )
    return df.select(*keys, F.posexplode(F.concat(labelled, defined)).alias("seq", "_c")).select(
        *keys, (F.col("seq") + 1).alias("seq"), "_c.*"
    )


def resolve_query(original: Column, query: Column, selections: Column, terms: Column, clarifications: Column) -> Column:
    """Append known anchors that a question refers to ('this …', 'that parameter') and does not name."""
    subject, parameter = original.rlike(SUBJECT_REFERENCE), original.rlike(PARAMETER_REFERENCE)
    named = F.filter(F.concat(terms, clarifications), lambda v: F.contains(F.lower(v), F.lit("параметр")))
    none = F.array().cast("array<string>")
    anchors = F.concat(
        F.when(subject | parameter, selections).otherwise(none), F.when(parameter, named).otherwise(none)
    )
    folded = F.transform(anchors, F.lower)
    missing = F.filter(
        anchors,
        lambda v, i: (F.array_position(folded, F.lower(v)) == i + 1) & ~F.contains(F.lower(query), F.lower(v)),
    )
    return F.when(F.size(missing) > 0, F.concat(query, F.lit(ANCHOR_LABEL), F.array_join(missing, "; "))).otherwise(query)


PART = 256


def _kept(acc: Column, line: Column) -> dict[str, Column]:
    """Append a line to a fold's output: full parts are joined, so that each line is copied a bounded number of times."""
    full = F.size(acc["part"]) >= PART
    return {
        "part": F.when(full, F.array(line)).otherwise(F.concat(acc["part"], F.array(line))),
        "done": F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["part"], "\n")))).otherwise(acc["done"])}


def _all_kept(acc: Column) -> Column:
    last = F.when(F.size(acc["part"]) > 0, F.array(F.array_join(acc["part"], "\n"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(acc["done"], last), "\n")


def strip_citations(answer: Column) -> Column:
    """Drop quote and source lines until the next numbered answer."""
    lines = F.split(answer, "\n")
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        reopened = F.when(line.rlike(ANSWER_HEAD), F.lit(False)).otherwise(acc["skip"])
        heads = [F.startswith(line, F.lit(h)) for h in CITATION_HEADS]
        skip = reopened | heads[0] | heads[1]
        kept = _kept(acc, F.rtrim(line, F.lit("\r")))
        return F.struct(skip.alias("skip"), *[F.when(skip, acc[n]).otherwise(c).alias(n) for n, c in kept.items()])

    start = F.struct(F.lit(False).alias("skip"), none.alias("part"), none.alias("done"))
    return F.aggregate(lines, start, step, _all_kept)


def valid_messages(df: DataFrame, role: str, content: str) -> DataFrame:
    return df.filter(F.col(role).isin("user", "assistant") & (strip(F.col(content)) != ""))


def question_limits(text: Column, tokens: Column, k: Column) -> Column:
    """Validity of a question row: ok, blank, too_long or bad_top_k."""
    return (
        F.when(text.isNull() | (strip(text) == ""), "blank")
        .when(tokens > MAX_TOKENS, "too_long")
        .when(k.isNotNull() & ~k.between(1, 100), "bad_top_k")
        .otherwise("ok")
    )


def requested_ids(question: Column) -> Column:
    mentions = F.regexp_extract_all(question, F.lit(ID_MENTION), F.lit(1))
    return F.array_distinct(F.regexp_extract_all(F.array_join(mentions, " "), F.lit(r"\d+"), F.lit(0)))


def requested_filters(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (question_id, kind, value): element ids and names of three letters or more in a question.

    ``questions``: question_id, question; ``names``: name. Containment has no token boundary, so questions and names meet
    on the first three characters of a name, at any position of the question; the question is read again for what meets.
    Grams and questions are more than the planner guesses from the files, so neither is ever broadcast.
    """
    ids = questions.select("question_id", F.lit("id").alias("kind"), F.explode(requested_ids(F.col("question"))).alias("value"))
    wanted = names.select("name").filter(F.length("name") >= 3).distinct()
    grams = questions.select("question_id", F.explode(char_grams(F.lower("question"), 3)).alias("_gram"))
    met = grams.join(sized(wanted.withColumn("_gram", F.substring(F.lower("name"), 1, 3))), "_gram").select("question_id", "name").distinct()
    named = met.hint("merge").join(questions.select("question_id", "question").hint("merge"), "question_id").filter(F.contains(F.lower("question"), F.lower("name")))
    return ids.unionByName(named.select("question_id", F.lit("name").alias("kind"), F.col("name").alias("value")).distinct())


def tag_ocr_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Join recognised lines per asset in order; low confidence stays visible."""
    tagged = F.when(F.col("confidence") >= 0.8, F.col("text")).otherwise(F.concat(F.lit("[неуверенное OCR] "), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("line"), tagged.alias("t"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), "\n").alias("ocr_text"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|"), strip)


def markdown_to_plain(text: Column) -> Column:
    """Plain lines: no fences, headings, emphasis; links as text; table rows as 'header: cell' bullets."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    none = F.array().cast("array<string>")

    def step(acc: Column, item: Column) -> Column:
        raw, following = item["line"], item["next"]
        fence = raw.rlike(FENCE)
        plain = F.regexp_replace(raw, HEADING_MARK, "")
        plain = F.regexp_replace(plain, EMPHASIS, "$1$2")
        plain = F.regexp_replace(plain, INLINE_CODE, "$1")
        plain = F.regexp_replace(plain, LINK, "$1 ($2)")
        piped = F.contains(plain, F.lit("|"))
        opens = piped & following.isNotNull() & following.rlike(RULE_ROW)
        in_table = acc["headers"].isNotNull() & piped
        row = F.transform(
            _cells(plain),
            lambda cell, i: F.when(i < F.size(acc["headers"]), F.concat(F.get(acc["headers"], i), F.lit(": "), cell)).otherwise(cell),
        )
        body = (
            F.when(acc["code"], raw)
            .when(opens, F.array_join(_cells(plain), "; "))
            .when(in_table, F.concat(F.lit("- "), F.array_join(row, "; ")))
            .otherwise(plain)
        )
        quiet = acc["skip"] | fence
        headers = (
            F.when(quiet | acc["code"], acc["headers"]).when(opens, _cells(plain)).when(in_table, acc["headers"])
        )
        return F.struct(
            F.when(~acc["skip"] & fence, ~acc["code"]).otherwise(acc["code"]).alias("code"),
            (~quiet & ~acc["code"] & opens).alias("skip"),
            headers.alias("headers"),
            *[F.when(quiet, acc[n]).otherwise(c).alias(n) for n, c in _kept(acc, body).items()],
        )

    # Each line with the one behind it: a lambda that looked into the lines would split the text anew for each.
    behind = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string")))
    items = F.zip_with(lines, behind, lambda line, after: F.struct(line.alias("line"), after.alias("next")))
    start = F.struct(
        F.lit(False).alias("code"), F.lit(False).alias("skip"), F.lit(None).cast("array<string>").alias("headers"), none.alias("part"), none.alias("done")
    )
    return strip(F.aggregate(items, start, step, _all_kept))


def pick_fields(json: Column, fields: list[str]) -> Column:
    """A JSON object cut to the listed keys that it has, values as stored."""
    kept = [(F.get_json_object(json, f"$.{name}"), name) for name in fields]
    parts = F.array(*[
        F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), F.to_json(F.variant_get(F.try_parse_json(json), f"$.{name}", "variant"))))
        for value, name in kept
    ])
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
