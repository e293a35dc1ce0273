"""Spot signatures against plain sets of tuples, edited texts, and matches against all pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprints
from lodestone.llm.words import ALNUM, split
from tests.llm import brute

SHARE = 1 / 40


def hashes(words):
    return split(pa.array(words, pa.large_string()), ALNUM).hashes() if words else np.zeros(0, np.uint64)


def common(texts, share=SHARE):
    found = Counter(w for t in texts for w in brute.ALNUM.findall(brute.lower(t)))
    return {w for w, n in found.items() if n >= share * sum(found.values())}


def spots(text, anchors, chain=fingerprints.CHAIN):
    words = brute.ALNUM.findall(brute.lower(text))
    if not words:
        return {("bytes", text)} if text else set()
    spare = {w for w, h in zip(words, hashes(words).tolist()) if h % fingerprints.SPARE == 0}
    marks, last = [], -1
    for i, w in enumerate(words):
        if w in anchors:
            last = i
        marks.append(w in anchors or (i - last >= fingerprints.GAP and w in spare))
    content = [(i, w) for i, (w, m) in enumerate(zip(words, marks)) if not m]
    if not content:
        return {("words", *words)}
    out = {("start", *[w for _, w in content[:chain]])}
    for i, w in enumerate(words):
        after = [c for j, c in content if j > i][:chain] if marks[i] else []
        if len(after) == chain:
            out.add((w, *after))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def texts(n=90, seed=4):
    pick = random.Random(seed)
    common_ = ["the", "Of", "and", "la", "é"]
    rare = [f"{a}{b}" for a in "ba ku ïn st".split() for b in range(60)]
    body = lambda k: " ".join(pick.choice(common_) if pick.random() < 0.4 else pick.choice(rare) for _ in range(k))
    rows = [(3 * i, body(pick.choice([1, 5, 40, 200]))) for i in range(n)]
    rows += [(1, None), (2, ""), (4, " \n"), (5, "!!! --"), (7, "the of"), (8, "ku1 " * 300), (10, " | ".join(rare[:90])), (None, body(30)), (None, None),
             (11, body(3000)), (13, rows[4][1]), (14, body(60)), (14, body(60)), (14, rows[0][1]), (14, rows[0][1]), (16, "中文 🙂 é " * 9)]
    return rows


def ordered(rows, spark):
    """Rows in the order the operator states: null ids first, then ids, ties by hash of the text."""
    table = spark.createDataFrame(rows, "id int, text string").select("id", "text", F.xxhash64("text").alias("h"))
    return [(r.id, r.text) for r in sorted(table.collect(), key=lambda r: (r.id is not None, r.id or 0, r.h))]


@pytest.mark.parametrize("size", [2000, 1 << 24])
def test_fingerprints_of_edits(spark, size):
    rows = texts()
    anchors = common([t for _, t in rows])
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id int, text string, lent string, part int").repartition(5)
    found = fingerprints.fingerprint_edits(docs, share=SHARE, range_bytes=size).collect()
    want, line = [], ordered(rows, spark)
    prints = {}
    for (k, t), (_, n) in zip(line, line[1:] + line[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        own, new, after = (spots(x, anchors) for x in (t, edited, n))
        prints[t], prints[edited] = frozenset(own), frozenset(new)
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, new), jaccard(own, after), len(own)))
    key = lambda r: (str(r[0]), r[1:])
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_spots) for r in found), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    # Equal sets have equal fingerprints, others do not; likeness follows from the returned strings alone.
    marks = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    assert len({r.fingerprint for r in found}) == len({prints[t or ""] for _, t in rows})
    for r in found:
        assert r.near_edited == pytest.approx(jaccard(marks(r.fingerprint), marks(r.edited_fingerprint)))
        assert r.fingerprint == "".join(sorted(marks(r.fingerprint))) and len(marks(r.fingerprint)) == r.n_spots


def test_few_rows(spark):
    docs = spark.createDataFrame([(4, "one two")], "doc_id int, text string")
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0 and fingerprints.fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.fingerprint_edits(docs).first()
    assert (alone.n_chars, alone.near_next) == (7, 1.0) and alone.edited_sha256 == hashlib.sha256(b"one one").hexdigest()
    blank = fingerprints.fingerprint_edits(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).collect()
    assert [(r.fingerprint, r.near_edited, r.near_next) for r in blank] == [("", 1.0, 1.0)] * 2


def test_common_words_are_counted_over_all(spark):
    rows = [("a " * 50 + "b " * 49 + "c",)] * 3 + [("d " * 400,), ("e",), (None,)]
    docs = spark.createDataFrame(rows, "text string").repartition(4)
    known, n, size = fingerprints.common_words(docs, 1 / 5)
    assert known.tolist() == sorted(hashes(["a", "b", "d"]).tolist())  # 150, 147 and 400 of 701 words
    assert n == 6 and size == sum(len((t or "").encode()) for (t,) in rows)


def test_matches(spark):
    pick = random.Random(8)
    sets = []
    for _ in range(60):
        base = {f"{pick.randrange(1 << 32):08x}" for _ in range(pick.choice([1, 4, 9, 30, 80]))}
        sets.append(base)
        for _ in range(4):
            other = set(base)
            for _ in range(pick.randint(0, max(1, len(base) // 5))):
                other.discard(pick.choice(sorted(other)))
                if pick.random() < 0.5 or not other:
                    other.add(f"{pick.randrange(1 << 32):08x}")
            sets.append(other)
    sets += [set(list(sets[0])), set()]
    table = spark.createDataFrame([(i, "".join(sorted(s))) for i, s in enumerate(sets)], "doc_id int, fingerprint string").repartition(3)
    for least in (0.8, 0.5):
        pairs, members = fingerprints.matches(table, least)
        held = {r.doc_id: r["class"] for r in members.collect()}
        assert held[len(sets) - 1] is None and len(set(held.values()) - {None}) == len({frozenset(s) for s in sets if s})
        found = {(r.a, r.b): r.likeness for r in pairs.collect()}
        want = {}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and held[i] < held[j] and jaccard(a, b) >= least:
                    want[held[i], held[j]] = jaccard(a, b)
        assert found == pytest.approx(want)
