"""Revisits, neighbours, components and the pipeline."""

import numpy as np
import pytest

from lodestone.llm import neighbours
from lodestone.llm.components import components
from lodestone.llm.revisits import canonical_url, resolve_revisits
from pyspark.sql import functions as F

RECORD = "record_id string, kind string, url string, seconds long, headers map<string,string>, digest string, body string, site string, base string"


def record(key, kind, url, seconds, headers=None, digest=None, body=None):
    return (key, kind, url, seconds, headers, digest, body, "clash", "clash")


def test_canonical_urls(spark):
    urls = ["HTTP://www.A.example:80/x?b=2&utm_source=q&a=1#f", "https://user@a.example/x?a=1&b=2", "https://a.example", "nonsense", None, "https://a.example/?utm_x=1"]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()
    assert [r[0] for r in found] == ["a.example/x?a=1&b=2", "a.example/x?a=1&b=2", "a.example/", None, None, "a.example/"]


@pytest.mark.parametrize("width", [1, 10, 3600])
def test_revisits(spark, width):
    u = "http://a.example/p"
    made = [
        record("r1", "response", u, 5, {"etag": '"1"', "content-type": "t", "expires": "old"}, "d1", "one"),
        record("r2", "response", u + "?utm_a=1", 20, {"etag": 'W/"2"'}, "d2", "two"),
        record("r3", "response", u, 20, None, "d3", None), record("r0", "response", u, 20, {"etag": '"0"'}, None, "zero"),
        record("r9", "response", None, 1, None, None, "x"), record("r8", "response", u, None, None, None, "x"),
        record("v1", "revisit", "https://www.a.example/p#x", 10, {"etag": 'W/"1"', "expires": "new", "content-length": "0"}),
        record("v2", "revisit", u, 5), record("v3", "revisit", u, 99, {"etag": '"2"'}), record("v3", "revisit", u, 99, {"etag": '"2"'}),
        record("v4", "revisit", u, 30, {"etag": '"9"'}), record("v5", "revisit", u, 15, None, "d1"), record("v6", "revisit", u, 15, None, "dx"),
        record("v7", "revisit", u, 21), record("v8", "revisit", None, 9), record("v9", "revisit", u, None)]
    found = resolve_revisits(spark.createDataFrame(made, RECORD), width).collect()
    by = {r.record_id: (r.base_id, r.status, r.body) for r in found}
    assert len(found) == 10
    assert by == {"v1": ("r1", "resolved", "one"), "v2": (None, "no_base", None), "v3": ("r2", "resolved", "two"), "v4": ("r2", "mismatch", None),
                  "v5": ("r1", "resolved", "one"), "v6": ("r1", "mismatch", None), "v7": ("r2", "unchecked", "two"), "v8": (None, "no_base", None), "v9": (None, "no_base", None)}
    assert next(r.headers for r in found if r.record_id == "v1") == {"etag": 'W/"1"', "content-type": "t", "expires": "new"}
    assert resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (3, 2)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(20, 16))
    made = [(i, (centres[i % 20] + 0.5 * pick.normal(size=16)).tolist(), "clash") for i in range(3000)]
    made += [(3000 + i, made[7][1], "clash") for i in range(50)]
    made += [(4000, None, ""), (4020, [0.0] * 16, ""), (4040, [float("nan")] + [1.0] * 15, ""), (4060, [float("inf")] + [1.0] * 15, ""), (None, [1.0] * 16, ""), (4080, [None] + [1.0] * 15, ""), (4100, [1.0, 2.0], ""), (4101, [2.0, 1.0], "")]
    return spark.createDataFrame(made, "vec_id int, embedding array<float>, score string"), made


def test_neighbours(spark, vectors):
    df, made = vectors
    good = [(k, np.asarray(v, np.float32).astype(float)) for k, v, _ in made if k is not None and k < 4000]
    ids, x = np.array([k for k, _ in good]), np.stack([v for _, v in good])
    found = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=700).toPandas()
    assert set(found.query_id) == {*ids[ids % 20 == 0].tolist(), 4100} and not found.duplicated(["query_id", "vec_id"]).any()
    assert found[found.query_id == 4100].values.tolist() == [[4100, 1, 4101, 4.0]]
    hit = total = 0
    for key, part in found[found.query_id < 4000].groupby("query_id"):
        score = x @ x[ids == key][0]
        score[ids == key] = -np.inf
        order = np.lexsort((ids, -score))[:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, [score[ids == v][0] for v in part.vec_id])
        assert part.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == part.vec_id.tolist()
        hit += len(set(order) & set(np.searchsorted(ids, part.vec_id)))
        total += 20
    assert hit / total >= 0.9
    few = neighbours.nearest(df.filter("vec_id < 5"), df.filter("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = lambda df: [tuple(r) for r in df.collect()]
    columns = docs.columns
    at, text = columns.index("doc_id"), columns.index("text")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = read(docs)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        after = read(docs)
        pairs = [(r[at], r[text]) for r in before]
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
            gone = {r[at] for r in before} - {r[at] for r in after}
            assert set(after) <= set(before) and len(gone & bad) >= 0.8 * len(bad & {k for k, _ in pairs}) and len(gone) < 0.3 * len(before)
        elif name == "near_duplicates":
            keep = {low for _, low, _ in brute.groups(pairs, 5)}
            assert sorted(after) == sorted(r for r in before if r[at] in keep)
        elif name == "repeated_passages":
            want = [(k, kept if n else t) for (k, t), (_, n, kept) in zip(pairs, brute.without_repeats(pairs))]
            assert sorted((r[at], r[text]) for r in after) == sorted(want)
        elif name == "decontamination":
            want = [k for k, t in pairs if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute.hits(t, bench))]
            assert sorted(r[at] for r in after) == sorted(want) and set(after) <= set(before)
        else:
            assert len(after) == len(before) and all(r.round_trip for r in docs.collect())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        before = after


def test_pipeline_stages_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns and an empty table, stage by stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm import brute

    names = ["doc_id", "text", "lang", "source", "n_chars", "id", "n_words", "kept", "k1", "score", "label", "c1", "spans"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, id string, n_words int, kept string, k1 string, score string, label string, c1 string, spans string"
    rows = [(k, t, "en", None if i % 3 else "s", None if t is None else len(t), *[f"clash{i}"] * 1, i, *["x"] * 6) for i, (k, t, *_) in enumerate(brute.odd_rows())]
    rows += [tuple([None] * len(names)), (None, "", None, None, None, None, None, None, None, None, None, None, None)]
    assert all(len(r) == len(names) for r in rows)
    docs = spark.createDataFrame(rows, kinds).repartition(3)
    empty = docs.limit(0)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after, none = spark.read.parquet(path), stage(spark, empty, sf_dir)
        assert none.count() == 0 and none.columns == after.columns
        before, found = [tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()]
        if name == "encoding":
            assert sorted(r.n_pieces for r in after.filter("doc_id IS NULL").collect())[:2] == [0, 0] and len(found) == len(before) and all(r.round_trip for r in after.collect())
            break
        assert after.columns == names and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
        rest = lambda r: (r[0], *r[2:4], *r[5:])
        assert not {rest(r) for r in found} - {rest(r) for r in before}
        if name == "near_duplicates":
            # Rows without words stay, repeated rows leave one.
            assert sum(not (r[1] or "").strip() for r in found) == sum(not (r[1] or "").strip() for r in before)
            assert sum(r[0] == 19 for r in found) <= 1
        docs = after
