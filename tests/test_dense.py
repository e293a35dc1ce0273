"""Dense search against the full product: bounds, skipped tiles, ties, odd vectors, empty sides, string ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.operators.dense import card_recall, dense_candidates, dense_ranks, dense_topk, search, tiles, tiles_met

DIMS = 12
ODD = [None, [0.0] * DIMS, [float("nan")] + [1.0] * (DIMS - 1), [float("inf")] + [1.0] * (DIMS - 1), [None] + [1.0] * (DIMS - 1)]


def grouped(n, groups, seed=1, spread=0.05):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(groups, DIMS))
    return [(centres[i % groups] + spread * pick.normal(size=DIMS)).tolist() for i in range(n)]


def product(queries, chunks):
    """query -> (chunk, similarity) in order."""
    out = {}
    good = [(k, np.asarray(v)) for k, v in chunks if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, x in queries:
        if x is None or None in x or not np.isfinite(x).all() or not np.any(x):
            continue
        x = np.asarray(x)
        rows = [(k, round(float(min(1, max(-1, x @ v / np.sqrt((x @ x) * (v @ v))))), 6) + 0.0) for k, v in good]
        out[q] = sorted(rows, key=lambda r: (-r[1], r[0]))
    return out


def frames(spark, queries, chunks, names=True):
    kind = "string" if names else "long"
    q = spark.createDataFrame(queries, f"query_id {kind}, embedding array<double>").repartition(2)
    return q, spark.createDataFrame(chunks, f"chunk_id {kind}, embedding array<double>").repartition(3)


@pytest.fixture(scope="module")
def sides():
    vectors = grouped(1500, 12) + [[1.0] + [0.0] * (DIMS - 1)] * 40  # a tie of forty
    chunks = [(f"c{i:05d}", v) for i, v in enumerate(vectors)] + [(f"odd{i}", v) for i, v in enumerate(ODD)]
    queries = [(f"q{i}", v) for i, v in enumerate(grouped(30, 12, 5, 0.2) + [[1.0] + [0.0] * (DIMS - 1), [-1.0] * DIMS])]
    return queries + [(f"odd{i}", v) for i, v in enumerate(ODD)], chunks


@pytest.mark.parametrize("rows", [50, 4000])
def test_topk_equals_the_product(spark, sides, rows):
    q, c = frames(spark, *sides)
    want = product(*sides)
    held = tiles(c, tile_rows=rows)
    found = search(q, held, 10)[0].collect()
    assert {(r.query_id, r.chunk_id): (r.similarity, r["rank"]) for r in found} == {
        (k, i): (s, n + 1) for k, hits in want.items() for n, (i, s) in enumerate(hits[:10])}
    assert len(found) == 10 * len(want)


def test_far_tiles_are_skipped(spark, sides):
    q, c = frames(spark, *sides)
    met = {r.query_id: r.n_met / r.n_tiles for r in tiles_met(q.filter("query_id like 'q_' or query_id like 'q__'"), tiles(c, tile_rows=50), 10).collect()}
    assert len(met) == 32 and np.mean(list(met.values())) < 0.5


def test_best_cards_of_owners(spark, sides):
    queries, chunks = sides
    made = [(k, v, None if i % 7 == 0 else f"o{i % 45}", i % 3 == 0) for i, (k, v) in enumerate(chunks)]
    q, _ = frames(spark, *sides)
    c = spark.createDataFrame(made, "chunk_id string, embedding array<double>, owner_id string, card boolean").repartition(3)
    want, owner = product(queries, [(k, v) for k, v, _, card in made if card]), {k: o for k, _, o, _ in made}
    expect = {}
    for k, hits in want.items():
        seen = []
        for i, s in hits:
            if owner[i] not in [owner[j] for j, _ in seen]:
                seen.append((i, s))
        expect |= {(k, i): (s, owner[i], n + 1) for n, (i, s) in enumerate(seen[:6])}
    top, cards = search(q, tiles(c, tile_rows=60), 5, 6)
    assert {(r.query_id, r.chunk_id): (r.similarity, r.owner_id, r["rank"]) for r in cards.collect()} == expect
    assert {(r.query_id, r.chunk_id) for r in top.collect()} == {(k, i) for k, hits in product(queries, chunks).items() for i, _ in hits[:5]}
    alone = card_recall(q, c.filter("card"), 6)
    assert {(r.query_id, r.chunk_id): (r.similarity, r.owner_id, r["rank"]) for r in alone.collect()} == expect
    assert search(q, tiles(c.withColumn("card", F.lit(False))), 3, 6)[1].count() == 0


def test_ranks_of_wanted_pairs(spark, sides):
    queries, chunks = sides
    q, c = frames(spark, *sides)
    want = {(k, i): (s, n + 1) for k, hits in product(*sides).items() for n, (i, s) in enumerate(hits)}
    pick = np.random.default_rng(4)
    names = [k for k, _ in chunks]
    asked = [(k, names[i]) for k, _ in queries for i in pick.integers(0, len(names), 40).tolist()] * 2 + [("q30", f"c{i:05d}") for i in range(1500, 1540)]
    wanted = spark.createDataFrame(asked, "query_id string, chunk_id string")
    expect = {p: want[p] for p in asked if p in want}
    for rows in (50, 4000):
        found = dense_ranks(q, c, wanted, tiles(c, tile_rows=rows)).collect()
        assert {(r.query_id, r.chunk_id): (r.similarity, r.dense_rank) for r in found} == expect and len(found) == len(expect)
    both = dense_candidates(q, c, 10, wanted).collect()
    assert {(r.query_id, r.chunk_id): (r.similarity, r.dense_rank) for r in both} == expect | {p: v for p, v in want.items() if v[1] <= 10}
    assert len(both) == len({(r.query_id, r.chunk_id) for r in both})


@pytest.mark.parametrize("names", [True, False])
def test_empty_sides(spark, names):
    one = "a" if names else 1
    q, c = frames(spark, [(one, [1.0, 0.0])], [(one, [1.0, 1.0])], names)
    assert [(r.chunk_id, r["rank"]) for r in dense_topk(q, c, 5).collect()] == [(one, 1)]
    assert dense_topk(q.limit(0), c, 5).count() == 0 and dense_topk(q, c.limit(0), 5).count() == 0 and dense_topk(q.limit(0), c.limit(0), 5).count() == 0
    cards = c.withColumn("owner_id", F.lit("o"))
    assert card_recall(q, cards.limit(0)).count() == 0 and card_recall(q, cards).count() == 1
    assert dense_ranks(q, c, c.limit(0).select(F.col("chunk_id").alias("query_id"), "chunk_id")).count() == 0
    with pytest.raises(ValueError):
        dense.dense_topk(q, c, 0)


def test_questions_with_many_pairs_rank_all_their_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 3, (300, 6)).astype("float32")
    vectors[:, 5] = 1
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<float>")
    queries = chunks.filter("chunk_id < 4").withColumnRenamed("chunk_id", "query_id")
    wanted = queries.select("query_id").crossJoin(chunks.select("chunk_id")).filter("query_id < 3 OR chunk_id < 5")
    held = tiles(chunks, tile_rows=64)
    plain = {tuple(r) for r in dense_ranks(queries, chunks, wanted, held).collect()}
    monkeypatch.setattr(dense, "WHOLE", 100)
    met, sent = [], dense._sent
    monkeypatch.setattr(dense, "_sent", lambda q, *rest: met.append(q.columns) or sent(q, *rest))
    whole = {tuple(r) for r in dense_ranks(queries, chunks, wanted, held).collect()}
    assert len(plain) == 905 and whole == plain
    assert ["query_id", "embedding"] in met  # without the lists of pairs


def test_a_question_travels_once_per_lot_of_tiles(spark, sides, monkeypatch):
    monkeypatch.setattr(dense, "LOTS", 2)
    made, plain = [], dense._lots
    monkeypatch.setattr(dense, "_lots", lambda queries, rings, per, choose: made.append((plain(queries, rings, per, choose), per)) or made[-1][0])
    q, c = frames(spark, *sides)
    held = tiles(c, tile_rows=50)
    found = search(q, held, 10)[0].collect()
    assert {(r.query_id, r.chunk_id): (r.similarity, r["rank"]) for r in found} == {
        (k, i): (s, n + 1) for k, hits in product(*sides).items() for n, (i, s) in enumerate(hits[:10])}
    sent, per = made[0]
    rows, slots = sent.count(), sent.selectExpr("sum(size(_slots))").first()[0]
    assert per > 1 and rows == sent.select("query_id", "_lot").distinct().count() and slots >= rows
