"""Alignment of two tokenizers against the libraries and a plain count."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestone.llm import alignment
from tests.llm import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a\n", "\nb", "a\n\nb", " lead", "trail ", "a  b", "a \n b", "tab\there", "nul\x00l", "▁ in text", "x▁y z", "<s> </s> <unk> <0x41>", "<|endoftext|>a",
       "déjà vu 中文 🙂 é", "it's they'll 12345 1.5e10", " nbsp", "a b", "-" * 50, "aaaa" * 400, "\n", " ", "ﬁ ﬀ", "\x7f\x85\x01"]
ROWS = brute.odd_rows() + [(100 + i, t, "clash", 1, 0.5, "clash") for i, t in enumerate(ODD)]
PAIRS = [(k, t) for k, t, *_ in ROWS]


@pytest.fixture(scope="module")
def want():
    return brute.alignments(PAIRS, brute.tokens_of_both(A, B))


@pytest.mark.parametrize("block", [1, 1000, alignment.BLOCK_POSTINGS])
def test_alignment(spark, want, block):
    docs = spark.createDataFrame(ROWS, brute.SCHEMA).repartition(3)
    found = alignment.align(docs, A, B, block_postings=block)
    key = lambda rows: sorted(rows, key=repr)
    assert key(tuple(r) for r in found.collect()) == key((k, *w) for (k, _), w in zip(PAIRS, want[0]))
    counts = alignment.pair_counts(alignment.postings(docs, A, B, block_postings=block)).collect()
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in counts} == want[1]
    groups = {r.doc_id: r.groups for r in alignment.aligned_groups(docs.filter("doc_id >= 100"), A, B).collect()}
    assert groups[100].count(";") + 1 == next(w[2] for (k, _), w in zip(PAIRS, want[0]) if k == 100)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_blocks_of_many_documents(spark):
    """Dense bitmaps, several planes and several blocks."""
    texts = [" ".join(["the and of"] * (1 + i % 9) + [f"w{i % 13}", "the" if i % 5 else "x"]) for i in range(3000)]
    made = list(enumerate(texts))
    encode = brute.tokens_of_both(A, B)
    rows, counts = brute.alignments(made, encode)
    docs = spark.createDataFrame(made, "doc_id int, text string").repartition(2)
    assert {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, A, B).collect()} == dict(enumerate(rows))
    found = alignment.pair_counts(alignment.postings(docs, A, B)).collect()
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in found} == counts


def test_packed_block_round_trip():
    pick = np.random.default_rng(1)
    for n_docs in (1, 7, 64, 5000):
        keys = np.unique(pick.integers(0, 30, 4000) ** 3 % 17 * 100_000 + pick.integers(0, n_docs, 4000))
        pair, doc, times = keys // 100_000, keys % 100_000, pick.integers(1, 40, len(keys))
        rows = alignment.packed_block(pair, doc, times, n_docs)
        row, back, n = alignment.unpacked(rows["n"], rows["bits"], rows["docs"], rows["planes"], n_docs)
        assert (rows["pair"][row] == pair).all() and (back == doc).all() and (n == times).all()


def test_units_are_aligned_as_whole_texts():
    both = alignment.Aligner(A, B)
    texts = pa.array([t for _, t in PAIRS] * 2)
    assert both.cuts
    by_units, whole = both.texts(texts), [both.texts(pa.array([t])) for t in texts.to_pylist()]
    alone = [both.align_alone([" " + t]) if t else None for t in texts.fill_null("").to_pylist()]
    first = np.cumsum(by_units.n_links) - by_units.n_links
    for i, (one, lone) in enumerate(zip(whole, alone)):
        for other in filter(None, (one, lone)):
            assert by_units.groups[i].as_py() == other.groups[0].as_py()
            assert by_units.pairs[first[i] : first[i] + by_units.n_links[i]].tolist() == other.pairs.tolist()
