"""Operators over texts against plain versions, on documents with every odd case, on copies and on empty tables."""

import pickle
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, katz, licenses, near_duplicates, quality, sentence_pieces, substrings, tokens, words
from tests.llm import brute

ROWS = brute.odd_rows()
PAIRS = [(k, t) for k, t, *_ in ROWS]
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(values):
    return sorted(values, key=repr)


def test_words_of_a_slice():
    texts = pa.array(["zero", "a b", None, "", "c\x0bD"]).slice(1)
    found = words.split(texts, lower=True)
    assert [found.data[a:b].tobytes() for a, b in zip(found.start, found.end)] == [b"a", b"b", b"c", b"d"]
    assert found.first.tolist() == [0, 2, 2, 2, 4]
    assert found.shingles(2)[0].tolist() == [0, 2]


def test_repeats(docs, empty, spark):
    want = [(k, *w) for (k, _), w in zip(PAIRS, brute.without_repeats(PAIRS))]
    assert rows(substrings.remove_repeats(docs)) == expected(want)
    assert rows(substrings.remove_repeats(docs, bucket_bytes=2000, hot_share=0.5)) == expected(want)
    assert rows(substrings.remove_repeats(empty)) == []
    left = substrings.strip_repeats(docs)
    assert left.columns == docs.columns
    assert expected((r.doc_id, r.text, r.id) for r in left.collect()) == expected(
        (k, kept if gone else t, "clash") for (k, t), (_, gone, kept) in zip(PAIRS, brute.without_repeats(PAIRS)))


def test_repeats_of_a_frequent_line(spark):
    line = " ".join(f"w{i}" for i in range(12))
    made = [(i, f"{' '.join(f'a{i * j % 97}' for j in range(40))} {line} {' '.join(f'b{i + j}' for j in range(40))}") for i in range(120)]
    made += [(200 + i, f"c{i} {line} {line} {line} {line}") for i in range(60)]
    found = substrings.remove_repeats(spark.createDataFrame(made, "doc_id int, text string"), bucket_bytes=4096)
    assert rows(found) == expected((k, *w) for (k, _), w in zip(made, brute.without_repeats(made)))


def test_windows_of_equal_hash_are_compared():
    text = pa.array([" ".join(f"w{i % 7}" for i in range(30)), " ".join(f"w{i % 5}" for i in range(30))])
    exact = substrings.leaders(words.split(text), 4)[1]
    assert (substrings.leaders(words.split(text), 4, bits=2)[1] == exact).all()


def test_near_duplicates(docs, empty):
    want = [(k, n, low, k == low) for (k, _), (n, low, _) in zip(PAIRS, brute.groups(PAIRS))]
    assert rows(near_duplicates.near_duplicates(docs)) == expected(want)
    assert rows(near_duplicates.near_duplicates(empty)) == []
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    by_group = {}
    for (k, t), (n, _, group) in zip(PAIRS, brute.groups(PAIRS, 5)):
        by_group.setdefault((group, k, t) if not n else group, []).append((k is None, k or 0, t))
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(by_group)
    assert sorted(k for k in (r.doc_id for r in kept.collect()) if k) == sorted(min(g)[1] for g in by_group.values() if not min(g)[0])


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    pick = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    made = []
    for i in range(150):
        own = list(base)
        for j in pick.integers(0, 150, pick.integers(0, 9)):
            own[j] = f"x{i}_{j}"
        made.append((i, " ".join(own)))
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 3000)
    found = near_duplicates.near_duplicates(spark.createDataFrame(made, "doc_id int, text string"))
    assert rows(found) == expected((k, n, low, k == low) for (k, _), (n, low, _) in zip(made, brute.groups(made)))


def test_shingles_in_common():
    pick = np.random.default_rng(1)
    for m in (3, 90):
        sets = [np.unique(pick.integers(0, 60, 40)).astype(np.uint64) for _ in range(m)]
        common = near_duplicates.common_shingles(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
        for i in range(m):
            for j in range(m):
                assert i == j or common[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_contamination(docs, empty, spark):
    body = PAIRS[0][1].split()
    items = [(1, " ".join(body[10:40])), (2, "b C"), (3, None), (4, "?!"), (None, "one"), (2, "B c"), (5, " ".join(body[50:62]) + " never seen")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = [(k, *brute.hits(t, [("" if i is None else i, x) for i, x in items])) for k, t in PAIRS]
    for size in (decontaminate.GROUP_BYTES, 40):
        found = decontaminate.decontaminate(docs, bench, group_bytes=size)
        assert rows(found.select("doc_id", "n_words", "n_hit", "items")) == expected(want)
    for r in decontaminate.decontaminate(docs.filter("doc_id = 1"), bench).collect():
        assert [PAIRS[0][1][p.start : p.stop] for p in r.passages] == [" ".join(body[10:40])]
    assert rows(decontaminate.decontaminate(empty, bench)) == []
    assert decontaminate.decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not (h > 0 and 20 * h >= n) for _, n, h, _ in want)


def test_contamination_by_one_repeated_item(docs, spark, monkeypatch):
    body = PAIRS[0][1].split()
    items = [(i, " ".join(body[10:60])) for i in range(200)] + [(1000 + i, " ".join(body[i : i + 14])) for i in range(100)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    sizes, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sizes.append(len(pickle.dumps(value))), send(self, value))[1])
    found = decontaminate.decontaminate(docs, bench, group_bytes=4000)
    want = [(k, *brute.hits(t, items)) for k, t in PAIRS]
    assert rows(found.select("doc_id", "n_words", "n_hit", "items")) == expected(want)
    assert max(sizes) < 8000 and len(sizes) < 12  # ten thousands of bytes of one text came in one group


def test_licenses(spark, empty):
    made = [(1, "Released under the MIT License.\nReleased under the mit, LICENSE"), (2, None), (3, ""), (4, "mit\nlicense"), (5, "License the under released MIT stuff"),
            (6, "x\nLicensed under CC BY-NC 4.0.\nThe GNU General Public License and the Apache License"), (6, "x"), (None, "general  public-license")]
    found = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(spark.createDataFrame([(*m, 0, 0) for m in made], "doc_id int, text string, places int, n_words int")).collect()}
    assert [(p.label, p.start) for p in found[1, 10].places] == [("mit", 3), ("mit", 8)]
    assert sorted((m.label, m.line, m.first_word, m.last_word) for m in found[1, 10].matches) == [("mit", 0, 0, 4), ("mit", 1, 5, 9)]
    assert not found[2, 0].places and not found[3, 0].matches
    assert [p.start for p in found[4, 2].places] == [0] and not found[4, 2].matches
    assert not found[5, 6].places and [m.label for m in found[5, 6].matches] == ["mit"]
    assert {p.label for p in found[6, 17].places} == {"gpl", "apache"} and [(m.label, m.line) for m in found[6, 17].matches] == [("cc-by-nc", 1)]
    assert [p.label for p in found[None, 3].places] == ["gpl"]
    assert rows(licenses.scan_licenses(empty)) == []


def test_wrapped_licenses(spark):
    made, want = [], {}
    for t, (label, text) in enumerate(licenses.TEMPLATES):
        own = text.split()
        half = len(own) // 2
        for n, joint in enumerate((" ", "\n", "\r\n * ", "\n\n", "\n//\n  // ")):
            made.append((10 * t + n, f"before it\n\n{' '.join(own[:half])}{joint}{' '.join(own[half:])}\n\nbehind it"))
            want[10 * t + n] = (label, t, 2, 2 + joint.count("\n"), 1.0)
        made.append((10 * t + 5, "\n".join(w for word in own for w in ("", word))))  # a word in every second line
        want[10 * t + 5] = (label, t, 1, 2 * len(own) - 1, 1.0)
        made.append((10 * t + 6, " ".join(f"{w} {' '.join(['x'] * 80)}" for w in own)))  # far apart on one line
    long = licenses.TEMPLATES[1][1].split()
    made += [(900, f"{' '.join(long[:9])} and\nsome inserted words of one more line\n{' '.join(long[9:])}"), (901, f"{' '.join(long[:9])}\n\n{'x ' * 60}\n\n{' '.join(long[9:])}")]
    filler = "x " * 60
    made += [(902, f"{' '.join(long)}\n{filler}\n{' '.join(long)}\n{filler}\n{' '.join(long)}"), (903, None), (904, "\n\n")]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(made, "doc_id int, text string").coalesce(1)).collect()}
    for key, span in want.items():
        # A statement that repeats its first words is cut to the shorter block.
        own = [(m.label, m.template, max(m.line, span[2]) if m.line <= span[2] + 4 else m.line, m.last_line, m.containment) for m in found[key].matches if m.template == span[1]]
        assert own in ([span], [(*span[:2], span[2] + 4, *span[3:])]) and len(own) == 1, key
    assert not any(found[10 * t + 6].matches for t in range(len(licenses.TEMPLATES)))
    assert [(m.label, m.line, m.last_line) for m in found[900].matches] == [("mit", 0, 2)]
    assert not found[901].matches
    assert [m.containment for m in found[902].matches] == [1.0] * 3 and sorted(m.line for m in found[902].matches) == [0, 2, 4]
    assert not found[903].matches and not found[904].matches


def test_license_join_is_exact(docs):
    """Every block of twice the template's words, against plain sets."""
    picked = [("one", "ab1 ab2 é3"), ("two", " ".join(PAIRS[0][1].split()[:30])), ("none", "")]
    found = {}
    for r in licenses.scan_licenses(docs, templates=picked, threshold=0.4).collect():
        spans = sorted((m.first_word, m.last_word, m.template) for m in r.matches)
        for t in range(len(picked)):
            own = [s for s in spans if s[2] == t]
            assert all(a[1] < b[0] for a, b in zip(own, own[1:]))  # matches of a template do not overlap
        best = {}
        for m in r.matches:
            best[m.template] = max(best.get(m.template, 0), round(m.containment, 9))
        found[r.doc_id, r.n_words] = best
    for key, text in PAIRS:
        words, want = brute.ALNUM.findall(brute.lower(text)), {}
        for t, (_, template) in enumerate(picked):
            need = brute.ALNUM.findall(brute.lower(template))
            most = max((len(set(words[i : i + 2 * len(need)]) & set(need)) for i in range(len(words))), default=0)
            if need and most >= 0.4 * len(set(need)) - 1e-9:
                want[t] = round(most / len(set(need)), 9)
        assert found[key, len(words)] == want


def test_token_files(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    manifest = tokens.write_tokens(docs, str(tmp_path / "planes"), BPE)
    found = tokens.read_tokens(spark, manifest).collect()
    ids = {p: [*plain.encode(p[1] or "", add_special_tokens=False).ids, 2] for p in PAIRS}
    order = sorted(PAIRS, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""))
    start, want = 0, []
    for p in order:
        want.append((p[0], start, len(ids[p]), zlib.crc32(np.array(ids[p], "<u4").tobytes())))
        start += len(ids[p])
    assert expected(tuple(r) for r in found) == expected(want)
    first = sorted(manifest.collect(), key=lambda r: r.part)[0]
    store, name = tokens.filesystem(first.path)
    with store.open_input_file(name) as source:
        reader = tokens.PlaneReader(source)
        whole = np.concatenate(list(reader.blocks()))
        assert len(whole) == first.n_ids and (reader.ids(1, len(whole) - 1) == whole[1:-1]).all()
    assert rows(tokens.read_tokens(spark, tokens.write_tokens(empty, str(tmp_path / "none"), BPE))) == []


def test_token_units():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(BPE), tokens.Encoder(BPE)
    odd = ["", " ", "\n", "a", "  a  b \n\n c\n", "a\n", "it's don't  x's", "héé 中文\n\n x", "a\tb \t c", "x y z", "a <|endoftext|> b", "\r\n a", "12 34a5 !!", "a \x1c b", "a  ", "b \n", "q\nr s"]
    found = own.encode(pa.array(odd, pa.large_string()))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_blocks_of_a_token_file(tmp_path):
    ids = np.arange(tokens.BLOCK_IDS * 2 + 77, dtype="<u4") * 7 % 50257
    with open(tmp_path / "f", "wb") as sink:
        writer = tokens.PlaneWriter(sink, pa.int64())
        for i in range(0, len(ids), 5000):
            writer.add(i, ids[i : i + 5000].tobytes())
        writer.close()
    with tokens.filesystem(str(tmp_path))[0].open_input_file(str(tmp_path / "f")) as source:
        reader = tokens.PlaneReader(source)
        assert reader.chunks.num_rows == 3 and (np.concatenate(list(reader.blocks())) == ids).all()
        assert (reader.ids(65000, 66000) == ids[65000:66000]).all()


def test_katz(docs, empty):
    held = [brute.crc(k) % 7 == 2 for k, _ in PAIRS]
    want = brute.katz(PAIRS, lambda n: katz.discounted(np.array(n)), held)
    for settings in ({}, {"hot_share": 0.01, "part_tokens": 1500}):
        found = katz.score_texts(docs, quality.crc_remainder("doc_id", 7) == 2, **settings).collect()
        by = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.base_score), r) for r in found)
        plain = sorted(((k is not None, k or 0, w[1], w[4]), w) for (k, _), w in zip(PAIRS, want))
        for (_, r), (_, w) in zip(by, plain, strict=True):
            assert tuple(r)[1:5] == w[:4]
            assert abs(r.base_score - w[4]) < 1e-6 and abs(r.score - w[5]) < 1e-6
    assert rows(katz.score_texts(empty, F.lit(False))) == []
    assert all(r.score == 0 and r.train_tokens == 0 for r in katz.score_texts(docs, F.lit(True)).collect())


@pytest.mark.parametrize("order", [3, 4])
def test_katz_of_higher_order(docs, empty, order):
    held = [brute.crc(k) % 7 == 2 for k, _ in PAIRS]
    want = brute.katz_of_order(PAIRS, lambda n: katz.discounted(np.array(n)), held, order)
    for settings in ({}, {"hot_share": 0.01, "part_tokens": 1500}):
        found = katz.score_texts(docs, quality.crc_remainder("doc_id", 7) == 2, order=order, **settings).collect()
        by = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.base_score, r.score) for r in found)
        plain = sorted((k is not None, k or 0, *w) for (k, _), w in zip(PAIRS, want))
        for r, w in zip(by, plain, strict=True):
            assert r[:3] == w[:3] and abs(r[3] - w[3]) < 1e-6 and abs(r[4] - w[4]) < 1e-6
    assert rows(katz.score_texts(empty, F.lit(False), order=order)) == []
    assert all(r.score == 0 for r in katz.score_texts(docs, F.lit(True), order=order).collect())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_from_stored_tables(docs, empty, order):
    held = [brute.crc(k) % 7 == 2 for k, _ in PAIRS]
    want = brute.katz_of_order(PAIRS, lambda n: katz.discounted(np.array(n)), held, order)
    for settings in ({}, {"hot_share": 0.01, "part_tokens": 1500}):
        model, _ = katz.train_and_score(docs, quality.crc_remainder("doc_id", 7) == 2, order=order, **settings)
        found = sorted((r.doc_id is not None, r.doc_id or 0, len(r.log_p), sum(r.log_p)) for r in katz.token_scores(docs, model).collect())
        plain = sorted((k is not None, k or 0, w[0], w[2]) for (k, _), w in zip(PAIRS, want))
        for r, w in zip(found, plain, strict=True):
            assert r[:3] == w[:3] and abs(r[3] - w[3]) < 1e-6
    assert rows(katz.token_scores(empty, model)) == []


def test_pieces(docs, empty):
    model = sentence_pieces.Pieces(PIECE)

    def plain(text):
        if not text:
            return 0, []
        best, back = model.forward(" " + text, {0: 0})
        return best[-1], model.trace(" " + text, back, len(text) + 1)[1]

    short = docs.filter("doc_id <> 14 OR doc_id IS NULL")
    want = expected((k, t, plain(t)[1], plain(t)[0]) for k, t in PAIRS if k != 14)
    for chunk in (sentence_pieces.CHUNK, 50):
        found = sentence_pieces.encode_pieces(short, PIECE, chunk=chunk, block=3)
        assert expected((r.doc_id, r.text, list(r.pieces), r.score) for r in found.collect()) == want
    whole = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs, PIECE), PIECE)
    assert whole.filter("coalesce(text, '') <> decoded").count() == 0 and whole.count() == len(ROWS)
    assert rows(sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(empty, PIECE), PIECE)) == []


@pytest.mark.parametrize("chunk", [1, 3, 7, 20])
def test_pieces_across_chunks(chunk):
    import random

    model, pick = sentence_pieces.Pieces(PIECE), random.Random(chunk)
    parts = [" ", "  ", "\n", "a", "the", " of ", "ing", "中文", "▁", "xyz", "." * 9, "=" * 30]
    width = model.longest
    for _ in range(60):
        text = " " + "".join(pick.choice(parts) for _ in range(pick.randint(1, 40)))
        best, back = model.forward(text, {0: 0})
        cut = [(text[a : a + chunk + width - 1], min(chunk, len(text) - a)) for a in range(0, len(text), chunk)]
        entry, entries = np.where(np.arange(width) == 0, 0, sentence_pieces.NONE), []
        for part, size in cut:
            entries.append(entry.tolist())
            entry = sentence_pieces.times(entry[None], model.transfer(part, size))[0]
        assert entry[0] == best[-1]
        exit_cut, ids = 0, []
        for (part, size), seeds in zip(cut[::-1], entries[::-1]):
            head, ways = model.paths(part, size, seeds)
            exit_cut, raw = ways[exit_cut]
            ids.append(head + raw)
        assert np.frombuffer(b"".join(ids[::-1]), "<i4").tolist() == model.trace(text, back, len(text))[1]


def test_quality(docs, empty, spark):
    made = [(i, ("plain words of a text " * 8 if i % 3 else "### $$$ x%%% &&& " * 9) + f" {i}", "clash") for i in range(300)] + [(None, None, "x"), (5, "", "x")]
    texts = spark.createDataFrame(made, "doc_id int, text string, score string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(0, 300, 2)] + [(4, None), (6, 0), (6, 0), (None, 1)], "doc_id int, quality int")
    model = quality.train(texts, labels, "doc_id", "text", "quality")
    found = {r.doc_id: r.score for r in quality.score_quality(texts, model).collect()}
    assert len(found) == 301 and all(0 <= s <= 1 for s in found.values())
    assert all((found[i] >= 0.3) == bool(i % 3) for i in range(1, 300, 2) if i != 5)
    kept = quality.keep_quality(texts, model)
    assert kept.columns == texts.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(300) if i % 3 and i != 5}
    none = quality.train(texts, labels.limit(0), "doc_id", "text", "quality")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert rows(quality.score_quality(empty, model)) == []


def test_boosted_tables_learn_a_pair():
    pick = np.random.default_rng(0)
    x = pick.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Gam().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_hashes_of_words_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([" ".join(f"w{i % 90}é" for i in range(2000)), "w1é", "x" * 5000])
    whole = words.split(texts)
    before = [whole.hashes(which) for which in (0, 1)]
    monkeypatch.setattr(words, "PIECE_BYTES", 64)
    assert all((whole.hashes(which) == h).all() for which, h in enumerate(before))
    assert before[0][2000] == before[0][1] and before[0][2000] != before[1][2000]


def test_steps_of_any_number_of_keys():
    """Larger vocabularies take further places where hashes meet."""
    pick = np.random.default_rng(5)
    keys = np.unique(pick.integers(0, 1 << 40, 300_000))
    steps = sentence_pieces.Steps(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    found = steps.find(keys, np.ones(len(keys), bool))
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all() and steps.probes > 1
    assert (steps.find(keys, np.zeros(len(keys), bool)) == -1).all()


def test_units_together_equal_the_plain_way():
    model = sentence_pieces.model(PIECE)
    units = [" the", " naïve", "\nLine", " 中文", " 🙂x", " a\x00b", " tab\there", " " + "long" * 12, " ▁x", "\n", " Zürich's", " é", " \x7f"] + [f" w{i}é{i * 7 % 13}" for i in range(300)]
    assert model.many(units) == [model.unit(u) for u in units]
