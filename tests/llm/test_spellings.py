"""Spelling variants against a plain version: all edits, accents, ties, chains, and groups of equal letters."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import spellings
from tests.llm import brute

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Whether two words differ by one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def counted(rows):
    found = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def groups(words, ratio=10):
    form, close = {}, {}
    for w in words:
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
        close[w] = len(others)
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, close[w], None if form[w] is None else words[form[w]]))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_words_of_texts(spark):
    pick = random.Random(5)
    known = ["Abenteuer", "ÀÉîõü×÷ÿabc", "schreiben", "Zeitungen", "longerword", "shorter", "abcdefg", "abcdefgh"]
    rows = [(i, " ".join(pick.choice(known) + pick.choice(["", ".", "1", "-x"]) for _ in range(60))) for i in range(80)]
    rows += [(None, "Abenteuer Abenteuer onlynullid onlynullid"), (7, None), (8, ""), (9, " \n"), (3, "ab" * 4000 + " " + "ab" * 4000), (3, rows[3][1]), (10, "中文abcdefgž abcdefgž")]
    docs = spark.createDataFrame([(k, t, "clash", 5) for k, t in rows], "doc_id int, text string, word string, n int").repartition(3)
    words = spellings.word_counts(spellings.misspelt(spellings.letter_runs(docs)))
    want = counted(rows)
    assert {r.word: r.n for r in words.collect()} == want
    assert found(spellings.spelling_groups(words)) == groups(want)
    empty = docs.limit(0)
    assert spellings.spelling_groups(spellings.word_counts(spellings.misspelt(spellings.letter_runs(empty)))).count() == 0


def test_every_near_pair_once(spark):
    pick = random.Random(11)
    words = set()
    for _ in range(260):
        w = "".join(pick.choice("abcé") for _ in range(pick.randint(7, 10)))
        words.add(w)
        for _ in range(3):
            i = pick.randrange(len(w))
            words.add(pick.choice([w[:i] + w[i + 1 :], w[:i] + pick.choice("abcdé") + w[i:], w[:i] + pick.choice("abcdé") + w[i + 1 :]]))
    words = {w: pick.choice([2, 3, 20, 30, 400]) for w in sorted(words) if len(w) >= 7}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    pairs = [tuple(r) for r in spellings.near_words(table).select("a", "b").collect()]
    want = [(a, b) for a in words for b in words if a < b and near(a, b)]
    assert sorted(pairs) == sorted(want)
    assert found(spellings.spelling_groups(table)) == groups(words)


def test_many_words_of_equal_letters(spark):
    """Permutations of the same letters all have one letter part, and few of them are near."""
    pick = random.Random(2)
    words = {"".join(pick.sample("abcdefghij", 10)): 2 for _ in range(3000)}
    words |= {w[:-1]: 2 for w in list(words)[:40]}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {tuple(r) for r in spellings.near_words(table).select("a", "b").collect()}
    assert pairs == {(w[:-1], w) for w in words if len(w) == 10 and w[:-1] in words} | {(a, b) for a in words for b in words if len(a) == 9 == len(b) and a < b and near(a, b)}


def test_chains_of_forms(spark):
    words = {"abcdefgh"[:7] + "x" * i: 2 * 10**i for i in range(12)}
    rows = {r.word: r for r in spellings.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    last = max(words, key=len)
    assert all(r.root == last for r in rows.values()) and rows[last].form is None
    assert rows["abcdefg"].form == "abcdefgx" and rows["abcdefg"].form_n == 20


def test_letters_agree_on_all_parts_but_two(spark):
    made = [("abcdefghi", "abcdefghj"), ("abcdefghi", "abcdefgh"), ("ééabcde", "éabcdee")]
    for a, b in made:
        x, y = (spark.range(1).select(spellings.packed_letters(F.lit(w))).first()[0] for w in (a, b))
        apart = (x ^ y) & (2**64 - 1)
        assert sum(bool(apart >> spellings.PART_BITS * i & (2**spellings.PART_BITS - 1)) for i in range(spellings.PARTS)) <= 2
