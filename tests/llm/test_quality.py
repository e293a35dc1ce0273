"""Features and scores of the quality classifier against a plain version, byte by byte and table by table."""

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import quality
from tests.llm import brute

TEXTS = [t for _, t, *_ in brute.odd_rows()] + [
    "Hello, World! 123\n\nHello, World! 123\n\x00\x07 | <b> {x} |", "!!! ??? ...", "a\nb\na\n", "é É 中文 ÀB #tag $5 50%", "\n", "one two three four one two three four five", "x" * 3000, "WORD " * 300]


def plain(text):
    raw = (text or "").encode()
    white = {0x20, *range(0x09, 0x0E)}
    words, now = [], b""
    for byte in raw:
        if byte in white:
            words, now = words + [now] if now else words, b""
        else:
            now += bytes([byte])
    words += [now] if now else []
    upper, letter = lambda b: 0x41 <= b <= 0x5A, lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0
    kinds = {
        "upper": upper, "digit": lambda b: 0x30 <= b <= 0x39, "stop": lambda b: b in b".,;:?!'\"", "shout": lambda b: b in b"?!",
        "symbol": lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~", "bar": lambda b: b in b"|<>{}", "beyond": lambda b: b >= 0xC0, "control": lambda b: b < 0x20 and b != 0x0A}
    letters, lines = sum(map(letter, raw)), [line for line in raw.split(b"\n") if line]
    distinct = lambda items: len(set(items)) / len(items) if items else 0.0
    mean = lambda test: sum(map(test, words)) / max(len(words), 1)
    out = [math.log1p(len(raw)), math.log1p(len(words)), mean(len), math.log1p(max(map(len, words), default=0))]
    out += [sum(map(test, raw)) / max(letters if name == "upper" else len(raw), 1) for name, test in kinds.items()]
    out += [math.log1p(len(words) / max(len(lines), 1)), distinct(words), distinct([tuple(words[i : i + 4]) for i in range(len(words) - 3)]), distinct(lines),
            mean(lambda w: not any(map(letter, w))), mean(lambda w: kinds["symbol"](w[-1]) or kinds["shout"](w[-1]))]
    return out


def scored(model, row):
    total = model.intercept
    for table, cuts, x in zip(model.tables, model.cuts, row):
        total += table[bisect_left(cuts.tolist(), x)]
    for (a, b), grid in zip(model.chosen, model.grids):
        total += grid[bisect_left(model.coarse[a].tolist(), row[a])][bisect_left(model.coarse[b].tolist(), row[b])]
    return 1 / (1 + math.exp(-total))


def test_features_equal_plain_ones():
    found = quality.features(pa.array(TEXTS))
    assert found.shape == (len(TEXTS), len(quality.FEATURES))
    for text, row in zip(TEXTS, found):
        assert row.tolist() == pytest.approx(plain(text), abs=1e-12), text[:40] if text else text
    assert (quality.features(pa.array(TEXTS).slice(3)) == found[3:]).all()


def test_scores_of_whole_tables_equal_plain_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(quality.crc_remainder("doc_id", 5) != 0)
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    assert model.chosen and len(model.tables) == len(quality.FEATURES)
    found = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Cuts lie on values of the sample, so the last bit of a feature decides; both features are compared above and here.
    rows = dict(zip(texts, quality.features(pa.array(list(texts.values())))))
    assert all(row.tolist() == pytest.approx(plain(texts[k]), abs=1e-12) for k, row in rows.items())
    assert found == pytest.approx({k: scored(model, row) for k, row in rows.items()}, abs=1e-12)
    query = {r.doc_id: r for r in quality.op1(spark, sf_dir).collect()}
    assert {k: r.score for k, r in query.items()} == pytest.approx(found)
    assert all(r.held_out == (brute.crc(k) % 5 == 0) and r.predicted == (r.score >= 0.3) for k, r in query.items())


def test_trees_take_the_best_cuts():
    """A step of one feature splits where a plain search over all cuts gains most."""
    pick = np.random.default_rng(3)
    g, h = pick.normal(size=12), pick.uniform(0.5, 2, 12)
    leaf = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 1)
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cut = max(range(1, 12), key=lambda i: worth(0, i) + worth(i, 12))
    assert quality.Gam._tree(g, h, 2).tolist() == pytest.approx([leaf(0, cut)] * cut + [leaf(cut, 12)] * (12 - cut))
