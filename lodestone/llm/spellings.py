"""Spelling variants of the words of a corpus by PartEnum signatures of their letters.

A word is the binary vector of its letter multiset (one dimension per letter and copy). Two words that differ by one
inserted, deleted or replaced character have vectors at a Hamming distance of at most two. Letters are partitioned into
``PARTS`` parts; such words agree on all parts but two, so for one of the ways to leave out two parts the rest is equal.
Each word has one signature per way, and words meet in an equi-join on signatures. Next to the letters a signature holds
the first or the last characters of the word, of which near words of ``least`` or more characters always share one end;
that keeps the groups of frequent letters small. A pair is verified under the first signature it shares only, so it comes
out once, and nothing but verified pairs leaves the join, whose large groups adaptive execution splits.

Forms lead from a word to its most frequent near word, if that is ``RATIO`` times as frequent. Counts grow along them, so
they have no cycles and at most log10 of the largest count steps; roots are found by pointer doubling.

Defined cases: a null or empty text has no words; repeated rows count as often as they stand there; a row without an id
keeps its words as they are; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.registry import query
from lodestone.session import cut_lineage, table

LEAST_LENGTH, LEAST_COUNT = 7, 2
RATIO = 10
PARTS, DIFFER = 4, 2
PART_BITS = 64 // PARTS
EVERY = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(id, run): every run of letters of at least ``least`` characters, A-Z in lower case."""
    # A greedy match of a long run starts where the run starts, so runs stay maximal.
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))


def misspelt(runs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word): runs, of which those whose hash with the id is divisible by ``every`` lose one character."""
    h = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(h % every == 0, short).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of at least ``least`` characters that occur at least ``count`` times."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def _ways() -> list[tuple[int, ...]]:
    """The parts that stay, for each way to leave out DIFFER parts."""
    return list(combinations(range(PARTS), PARTS - DIFFER))


def _mask(parts: tuple[int, ...]) -> int:
    bits = sum(((1 << PART_BITS) - 1) << PART_BITS * i for i in parts)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def packed_letters(word: Column) -> Column:
    """One number with a hash of PART_BITS bits for each part of the letter multiset."""
    letters = F.array_sort(F.split(word, ""))
    out = F.lit(0).cast("bigint")
    for i in range(PARTS):
        part = F.array_join(F.filter(letters, lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)) == i), "")  # noqa: B023
        out = out.bitwiseOR(F.shiftleft(F.xxhash64(part).bitwiseAND((1 << PART_BITS) - 1), PART_BITS * i))
    return out


def signatures(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """The rows of ``words`` with letters, way and key: a row per way to leave out parts and end of the word."""
    ends = [F.substring("word", 1, least // 2), F.col("word").substr(-F.lit(least - least // 2), F.lit(least - least // 2))]
    rows = [
        F.struct(F.lit(2 * w + side).cast("tinyint").alias("way"), F.xxhash64(F.lit(2 * w + side), end, F.col("letters").bitwiseAND(_mask(parts))).alias("key"))
        for w, parts in enumerate(_ways()) for side, end in enumerate(ends)]
    return words.withColumn("letters", packed_letters(F.col("word"))).withColumn("_s", F.explode(F.array(*rows))).select("*", "_s.*").drop("_s")


def near_words(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(a, b, n_a, n_b), a before b: words that differ by one inserted, deleted or replaced character, each pair once.

    words: word (distinct, of at least ``least`` characters), n.
    """
    signed = signatures(words.select("word", "n"), least)
    left, right = signed.alias("l"), signed.alias("r")
    apart = F.col("l.letters").bitwiseXOR(F.col("r.letters"))
    first = F.lit(False)
    for w, parts in enumerate(_ways()):
        earlier = [k for k in range(max(parts)) if k not in parts]
        here = (F.floor(F.col("l.way") / 2) == w) & (apart.bitwiseAND(_mask(parts)) == 0)
        for k in earlier:
            here = here & (apart.bitwiseAND(_mask((k,))) != 0)
        first = first | here
    head = F.substring("l.word", 1, least // 2) == F.substring("r.word", 1, least // 2)
    near = (
        (F.col("l.key") == F.col("r.key")) & (F.col("l.way") == F.col("r.way")) & (F.col("l.word") < F.col("r.word"))
        & (F.abs(F.length("l.word") - F.length("r.word")) <= 1) & ((F.col("l.way") % 2 == 0) == head) & first
        & (F.levenshtein("l.word", "r.word", 1) == 1))
    return left.join(right, near).select(
        F.col("l.word").alias("a"), F.col("r.word").alias("b"), F.col("l.n").alias("n_a"), F.col("r.n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follow word -> form to the end; each round doubles the steps, and the longest chain sets their number."""
    current = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        current = cut_lineage(current.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if current.filter("_moved").isEmpty():
            return current.select("word", "root")
        current = current.drop("_moved")


def spelling_groups(words: DataFrame, ratio: int = RATIO, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table of distinct words and counts."""
    words = cut_lineage(words.select("word", "n"))
    pairs = near_words(words, least)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    near = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    rows = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    rows = cut_lineage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), *[
        F.when(form_n >= ratio * F.col("n"), c).alias(a) for c, a in ((F.col("best.other"), "form"), (form_n, "form_n"))]))
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


OP12_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
told AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
steps AS (
  SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch), 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, unicode(ch) - 64, 0, 0, 0, 0, 0, 0, 0] END)) AS s FROM told),
hashed AS (
  SELECT doc_id, run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, s::BIGINT[]), lambda h, e: xor(xor(h, e) >> 1, (xor(h, e) & 1) * 3988292384)), 4294967295::BIGINT) AS h FROM steps),
spelt AS (
  SELECT CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN concat(run[1 : h % length(run)], run[h % length(run) + 2 :]) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cuts AS MATERIALIZED (SELECT word, i, concat(word[1 : i - 1], word[i + 1 :]) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT word, rest FROM cuts WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cuts WHERE rest IN (SELECT word FROM words)),
near AS MATERIALIZED (
  SELECT a AS word, count(*) AS n_near, min({'less': -w.n, 'other': b}) AS best FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.other END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN near ON near.word = words.word),
walk(word, stop) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.stop WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.stop AS root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.stop WHERE e.form IS NULL
"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark, sf_dir):
    words = word_counts(misspelt(letter_runs(table(spark, sf_dir, "documents"))))
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")
