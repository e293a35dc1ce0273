"""Audit of answers and citations, and retrieval evaluation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from lodestone.functions.messages import APPEARANCE, PARAMETER_LIKE
from lodestone.functions.text import char_grams, squeeze, strip
from lodestone.session import cut_lineage

# Fixed values.
ASK_MORE = "Не знаю. Для корректного ответа укажите дополнительно - "
ASK = {
    "image": "читаемое изображение общего вида или разреза элемента для вопроса «",
    "parameter": "точное имя параметра, семейство и типоразмер, к которым относится вопрос «",
    "other": "категорию элемента, семейство или условия применения для вопроса «",
}
IMAGE_CAVEAT = "По распознанному изображению: "
QUOTES, SOURCES = "▫️ Цитаты:", "▫️ Источники:"
MACHINE = "machine_extracted_unverified"
ANSWER_NAME = r"[\p{L}\p{N}][\p{L}\p{N}_№.\-]*_[\p{L}\p{N}_№.\-]+"
ANSWER = ["request_id", "number"]


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


#: Characters that composition never changes, nor joins with another one of them: those below the first combining mark.
COMPOSED = r"\x00-\u02FF"
GRAM, WORDS = 8, 3
PAIRS = 1 << 18


def normalize(text: Column) -> Column:
    """Composed characters, single blanks; only texts that composition may change leave the JVM."""
    changing = F.when(text.rlike(f"[^{COMPOSED}]"), text)
    return squeeze(F.coalesce(_nfc(changing), text))


def answer_shape(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Add shape: ok, wrong_count (voids a whole request), bad_number or bad_answer.

    answers: request_id, pos (place in the payload), number, text, status. questions: request_id, number.
    """
    asked = questions.groupBy("request_id").agg(F.count(F.lit(1)).alias("_asked"))
    given = answers.groupBy("request_id").agg(F.count(F.lit(1)).alias("_given"))
    rows = answers.join(asked, "request_id", "left").join(given, "request_id")
    empty = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    known = F.coalesce(F.col("status").isin("supported", "uncertain", "unknown"), F.lit(False))
    shape = (
        F.when(~F.col("_asked").eqNullSafe(F.col("_given")), "wrong_count")
        .when(~F.col("number").eqNullSafe(F.col("pos")), "bad_number").when(empty | ~known, "bad_answer").otherwise("ok")
    )
    return rows.withColumn("shape", shape).drop("_asked", "_given")


def quote_support(citations: DataFrame, contexts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add chunk_id of the first context of the same question that holds the quote, and supported.

    A quote must have eight characters or more once blanks are single. citations: keys, seq, quote.
    contexts: keys, rank, chunk_id, text, purpose, inherited, headers (missing columns are skipped).

    Questions with up to PAIRS pairs of a quote and a context compare these. For others, the words inside a quote are
    whole words of any context that holds it, so a quote of three words or more meets the
    contexts of its question on that of its WORDS longest inner ones which the fewest hold. Shorter quotes meet contexts on their first
    GRAM characters; only contexts of questions with such quotes are taken apart for that.
    """
    keys = keys or ANSWER
    parts = [c for c in ("text", "purpose", "inherited", "headers") if c in contexts.columns]
    # Each source must hold the quote by itself, so they stay apart under a mark no text contains.
    haystack = cut_lineage(contexts.select(
        *keys, "rank", "chunk_id", normalize(F.concat_ws(" \x1f ", *parts)).alias("_h")).withColumn("_at", F.monotonically_increasing_id()))
    wanted = citations.withColumn("_q", normalize(strip(F.col("quote"))))
    asked = cut_lineage(wanted.select(*keys, "seq", "_q").filter(F.length("_q") >= GRAM).withColumn("_n", F.size(F.split("_q", " "))))
    # A question with few quotes and contexts compares them all; the number of such pairs is bounded per question.
    many = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a")).join(haystack.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b")), keys)
    many = cut_lineage(many.filter(F.col("_a") * F.col("_b") > PAIRS).select(*keys))
    few = asked.join(many, keys, "left_anti").join(haystack, keys).filter(F.contains("_h", "_q")).select(*keys, "seq", "rank", "chunk_id")
    asked, haystack = asked.join(many, keys, "left_semi"), haystack.join(many, keys, "left_semi")
    # Any inner word will do; of the longest ones, which tend to be rare, the rarest is taken. Texts stay behind.
    parts_of = F.split("_q", " ")
    inner = F.transform(F.array_distinct(F.slice(parts_of, F.lit(2), F.greatest(F.size(parts_of) - 2, F.lit(0)))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    words = asked.filter("_n > 2").select(*keys, "seq", F.explode(F.slice(F.array_sort(inner), 1, WORDS)).alias("_i")).select(*keys, "seq", F.col("_i.w").alias("_key"))
    held = haystack.select(*keys, "_at", F.explode(F.array_distinct(F.split("_h", " "))).alias("_key"))
    held = cut_lineage(held.join(words.select(*keys, "_key").distinct(), [*keys, "_key"], "left_semi"))
    # A word that no context holds leaves its quote without any.
    common = held.groupBy(*keys, "_key").agg(F.count(F.lit(1)).alias("_n"))
    rare = words.join(common, [*keys, "_key"], "left").groupBy(*keys, "seq").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("_r"))
    rare = rare.filter("_r.n > 0").select(*keys, "seq", F.col("_r.key").alias("_key"))
    short = cut_lineage(asked.filter("_n < 3").select(*keys, "seq", F.substring("_q", 1, GRAM).alias("_key")))
    near = haystack.join(short.select(*keys).distinct(), keys, "left_semi")
    grams = near.select(*keys, "_at", F.explode(char_grams(F.col("_h"), GRAM)).alias("_key")).join(short.select(*keys, "_key").distinct(), [*keys, "_key"], "left_semi")
    met = rare.join(held, [*keys, "_key"]).unionByName(short.join(grams, [*keys, "_key"])).drop("_key")
    found = met.join(asked.select(*keys, "seq", "_q"), [*keys, "seq"]).join(haystack.select("_at", "rank", "chunk_id", "_h"), "_at").filter(F.contains("_h", "_q"))
    found = found.select(*keys, "seq", "rank", "chunk_id").unionByName(few)
    first = found.groupBy(*keys, "seq").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    out = wanted.drop("_q").join(first, [*keys, "seq"], "left")
    return out.withColumn("supported", F.col("chunk_id").isNotNull())


def unverified_evidence(supported: DataFrame) -> DataFrame:
    """Add allowed and caveat for machine-extracted support.

    supported: status, question, text (answer), machine (bool), visual (quote lies in visual evidence).
    """
    appearance = F.col("question").rlike(f"(?iuU){APPEARANCE}")
    strict = (F.col("status") == "supported") & F.col("machine")
    allowed = ~strict | (appearance & F.col("visual"))
    caveat = allowed & F.col("visual") & ~F.contains(F.lower("text"), F.lit("распознан"))
    return supported.withColumns({"allowed": allowed, "caveat": caveat})


def invented_names(answers: DataFrame, names: DataFrame) -> DataFrame:
    """(request_id, number, name): names in an answer with a known prefix that are no known name.

    names: request_id, number, name. A prefix ends at the first '_', so tokens and names meet on it.
    """
    tokens = answers.select(*ANSWER, F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(ANSWER_NAME), F.lit(0)), lambda t: F.rtrim(t, F.lit("."))))).alias("name"))
    tokens = tokens.withColumn("_p", F.lower(F.substring_index("name", "_", 1)))
    prefixes = names.select(*ANSWER, F.lower(F.substring_index("name", "_", 1)).alias("_p")).distinct()
    words = F.split("name", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    known = names.select(*ANSWER, F.explode(starts).alias("name")).distinct()
    suspects = tokens.join(prefixes, [*ANSWER, "_p"], "left_semi")
    return suspects.join(known, [*ANSWER, "name"], "left_anti").select(*ANSWER, "name")


def resolve_evidence_ids(refs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Evidence ids to literal quotes of the same question; add quote and valid. refs, quotes: request_id, number, line.

    Both sides grow with the questions, and lines that were exploded are more than the planner guesses: they are merged.
    """
    out = refs.join(quotes.select(*ANSWER, "line", "quote").hint("merge"), [*ANSWER, "line"], "left")
    return out.withColumn("valid", F.col("quote").isNotNull())


def unknown_text(question: Column) -> Column:
    ask = (
        F.when(question.rlike("(?iu)выгляд|внешн.*вид"), ASK["image"])
        .when(question.rlike(f"(?iu){PARAMETER_LIKE}"), ASK["parameter"]).otherwise(ASK["other"])
    )
    return F.concat(F.lit(ASK_MORE), ask, F.substring(question, 1, 180), F.lit("»."))


def _numbered(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.when(F.size(lines) == 1, F.concat(F.lit("➤ "), F.get(lines, F.lit(0)))).otherwise(F.array_join(F.transform(
        lines, lambda x, i: F.concat(F.when(i == 0, "➤ ").otherwise("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n"))


def render_answers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(request_id, rendered): numbered texts with their quotes and sources, or what is missing.

    answers: request_id, number, question, text, status, valid. citations: request_id, number, seq, quote, chunk_id.
    """
    listed = citations.groupBy(*ANSWER).agg(F.array_sort(F.collect_list(F.struct("seq", "quote", "chunk_id"))).alias("_c"))
    quotes = F.array_join(F.transform("_c", lambda c: F.concat(F.lit('"'), c["quote"], F.lit('"'))), "\n")
    ids = F.array_join(F.transform(F.array_distinct(F.transform("_c", lambda c: c["chunk_id"])), lambda c: F.concat(F.lit("chunk_id: "), c)), "\n")
    rows = answers.join(listed, ANSWER, "left")
    cited = F.concat_ws("\n", _numbered(F.col("text")), F.lit(QUOTES), quotes, F.lit(SOURCES), ids)
    specific = F.startswith(F.col("text"), F.lit(ASK_MORE)) & (F.length("text") > len(ASK_MORE) + 12)
    fallback = _numbered(unknown_text(F.col("question")))
    body = (
        F.when(F.col("status") == "unknown", F.when(specific, _numbered(F.col("text"))).otherwise(fallback))
        .when(F.col("valid") & F.col("_c").isNotNull(), cited).otherwise(fallback)
    )
    ordered = rows.select("request_id", "number", body.alias("_t"))
    joined = F.array_sort(F.collect_list(F.struct("number", "_t")))
    return ordered.groupBy("request_id").agg(F.array_join(F.transform(joined, lambda r: r["_t"]), "\n").alias("rendered"))


def score_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: missing expected names, present excluded names, and passed.

    hits: query_id, name, selected, mode (one row per hit and name). cases: query_id, expected, excluded, expect_empty.
    """
    want = cases.select("query_id", F.explode("expected").alias("name")).distinct()
    ban = cases.select("query_id", F.explode("excluded").alias("name")).distinct()
    got = hits.filter("selected").select("query_id", "name").distinct()
    missing = want.join(got, ["query_id", "name"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("missing"))
    wrong = ban.join(got, ["query_id", "name"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("wrong"))
    seen = hits.groupBy("query_id").agg(
        F.max("selected").alias("_any"), F.max(F.startswith("mode", F.lit("lexical_fallback"))).alias("fallback"))
    out = cases.select("query_id", "expect_empty")
    for part in (missing, wrong, seen):
        out = out.join(part, "query_id", "left")
    out = out.withColumns({"missing": F.coalesce("missing", F.lit(0)), "wrong": F.coalesce("wrong", F.lit(0)),
                           "fallback": F.coalesce("fallback", F.lit(False)), "_any": F.coalesce("_any", F.lit(False))})
    passed = (F.col("missing") == 0) & (F.col("wrong") == 0) & ~(F.col("expect_empty") & F.col("_any")) & ~F.col("fallback")
    return out.withColumn("passed", passed).drop("_any", "expect_empty")


def recall_at_k(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall) over queries that expect something. hits: query_id, name, rank; relevant: query_id, name."""
    want = relevant.select("query_id", "name").distinct()
    top = hits.filter(F.col("rank") <= k).select("query_id", "name").distinct().withColumn("_got", F.lit(1))
    joined = want.join(top, ["query_id", "name"], "left")
    return joined.groupBy("query_id").agg((F.count("_got") / F.count(F.lit(1))).alias("recall"))


def mean_recall(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.avg("recall").alias("mean_recall"), F.count(F.lit(1)).alias("n_queries"))
