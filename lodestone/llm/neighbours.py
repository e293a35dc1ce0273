"""Approximate nearest neighbours by inner product with robust-pruned directed graphs, one per shard.

Equal vectors are one point that keeps its smallest ids (one more than are asked for; no later one can be returned).
Points are dealt to shards of about ``SHARD_ROWS`` by a hash. In each shard every point is inserted by a greedy search
from the medoid: what the search visits are the proposed neighbours, and robust pruning keeps a proposal only if no kept
one is nearer to it by a relaxed factor, so edges point in different directions. A query block meets every shard, a
beam search walks the graph, and the best of all shards are ranked together by exact inner products in double precision.

Inner products become distances by one more coordinate, which fills points up to the largest norm of the shard.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither as query nor as
candidate; vectors of different lengths never meet; ids are expected to be distinct, rows of a null id take no part;
repeated rows of an id count once; further columns are ignored; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.words import column
from lodestone.registry import query
from lodestone.session import cut_lineage

K = 20
SHARD_ROWS = 8192
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 96
RELAX = 1.2
WIDTH = 4
QUERY_BLOCK = 512


def _distances(points: np.ndarray, norms: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to the points named in its row (infinite where the name is -1)."""
    near = points[ids]
    d = norms[ids] - 2 * np.matmul(near, queries[:, :, None])[:, :, 0] + np.einsum("ij,ij->i", queries, queries)[:, None]
    return np.where(ids < 0, np.inf, d)


def greedy(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches of all queries together: the ids and distances of each beam, nearest first."""
    rows = np.arange(len(queries))[:, None]
    ids = np.full((len(queries), beam), -1, np.int64)
    ids[:, 0] = start
    dist = _distances(points, norms, queries, ids)
    done = ids < 0
    seen = np.zeros((len(queries), len(points)), bool)
    seen[:, start] = True
    active = np.arange(len(queries))
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(open_dist, min(WIDTH, beam - 1), axis=1)[:, :WIDTH]
        chosen = np.where(np.isfinite(np.take_along_axis(open_dist, pick, 1)), np.take_along_axis(ids[active], pick, 1), -1)
        marks = done[active]
        np.put_along_axis(marks, pick, True, 1)
        done[active] = marks
        new = np.where(chosen[:, :, None] >= 0, graph[chosen], -1).reshape(len(active), -1)
        new = np.where((new >= 0) & ~seen[active[:, None], new], new, -1)
        order = np.sort(new, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        new = order
        flat = np.nonzero(new >= 0)
        seen[active[flat[0]], new[flat]] = True
        both = np.concatenate([ids[active], new], 1)
        both_dist = np.concatenate([dist[active], _distances(points, norms, queries[active], new)], 1)
        both_done = np.concatenate([done[active], new < 0], 1)
        best = np.argpartition(both_dist, beam - 1, axis=1)[:, :beam]
        ids[active], dist[active], done[active] = (np.take_along_axis(a, best, 1) for a in (both, both_dist, both_done))
        active = active[(~done[active] & np.isfinite(dist[active])).any(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    return ids[rows, order], dist[rows, order]


def prune(points: np.ndarray, norms: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Robust pruning of the proposals of several points at once: at most ``degree`` diverse neighbours each."""
    ids = np.sort(np.where(ids == own[:, None], -1, ids), axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    dist = _distances(points, norms, points[own], ids)
    near = points[ids]
    cross = norms[ids][:, :, None] + norms[ids][:, None] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    rows = np.arange(len(own))
    alive = dist.copy()
    out = np.full((len(own), degree), -1, np.int64)
    for n in range(degree):
        best = np.argmin(alive, axis=1)
        some = np.isfinite(alive[rows, best])
        if not some.any():
            break
        out[:, n] = np.where(some, ids[rows, best], -1)
        alive[(relax * cross[rows, best] <= dist) & some[:, None]] = np.inf
        alive[rows, best] = np.inf
    return out


def build(points: np.ndarray, seed: int, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, batch: int = 256) -> tuple[np.ndarray, int]:
    """The graph [points, degree] (-1: no edge) and its start, by two passes of batch insertion."""
    n = len(points)
    norms = np.einsum("ij,ij->i", points, points)
    start = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    if n <= degree + 1:
        whole = np.array([[j for j in range(n) if j != i] for i in range(n)], np.int64).reshape(n, n - 1)
        return np.concatenate([whole, np.full((n, degree - n + 1), -1, np.int64)], 1), start
    random = np.random.default_rng(seed)
    graph = random.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    for factor in (1.0, relax):
        order = random.permutation(n)
        for i in range(0, n, batch):
            own = order[i : i + batch]
            found, _ = greedy(points, norms, graph, start, points[own], beam)
            graph[own] = prune(points, norms, own, np.concatenate([found, graph[own]], 1), degree, factor)
            source, target = np.repeat(own, degree), graph[own].reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            count = np.diff(np.append(first, len(target)))
            place = np.arange(len(target)) - np.repeat(first, count)
            extra = np.full((len(first), int(count.max())), -1, np.int64)
            extra[np.repeat(np.arange(len(first)), count), place] = source
            heads = target[first]
            for j in range(0, len(heads), batch):
                part = heads[j : j + batch]
                wide = np.concatenate([graph[part], extra[j : j + batch]], 1)
                graph[part] = prune(points, norms, part, wide, degree, factor)
    return graph, start


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _blob(rows: pa.Array, kind=np.float64) -> np.ndarray:
    return np.stack([np.asarray(r, kind) for r in rows.to_pylist()]) if len(rows) else np.zeros((0, 0))


def build_index(points: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its vectors, the ids of each, and the graph, as binary columns."""

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["c1", "c2"])
        vectors = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
        size = (vectors**2).sum(axis=1)
        filled = np.concatenate([vectors, np.sqrt(np.maximum(size.max() - size, 0))[:, None]], 1).astype(np.float32)
        graph, start = build(filled, int(key[1]))
        ids = [list(v) for v in pdf["ids"]]
        return pd.DataFrame([{
            "dim": int(key[0]), "shard": int(key[1]), "start": start, "vectors": vectors.tobytes(), "filled": filled.tobytes(),
            "graph": graph.astype(np.int32).tobytes(), "ids": np.array([i for v in ids for i in v], np.int64).tobytes(),
            "counts": np.array([len(v) for v in ids], np.int64).tobytes()}])

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("c1", "c2"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(
        pack, "dim int, shard int, start int, vectors binary, filled binary, graph binary, ids binary, counts binary")


def _searcher(k: int, beam: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: column(batch, n)[i].as_py() for n in batch.schema.names}
                dim = row["dim"]
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                filled = np.frombuffer(row["filled"], np.float32).reshape(-1, dim + 1)
                graph = np.frombuffer(row["graph"], np.int32).reshape(len(vectors), -1).astype(np.int64)
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64)
                begin = np.cumsum(counts) - counts
                asked = np.frombuffer(row["queries"], np.float64).reshape(-1, dim)
                names = np.frombuffer(row["names"], np.int64)
                wide = np.concatenate([asked, np.zeros((len(asked), 1))], 1).astype(np.float32)
                found, _ = greedy(filled, np.einsum("ij,ij->i", filled, filled), graph, row["start"], wide, max(beam, k + 1))
                score = np.where(found >= 0, np.einsum("qbd,qd->qb", vectors[found], asked), -np.inf)
                order = np.argsort(-score, axis=1, kind="stable")[:, : 2 * k + 2]
                found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
                q, c = np.nonzero(found >= 0)
                point, value = found[q, c], score[q, c]
                n = counts[point]
                at = np.repeat(begin[point] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                query_id, vec_id, value = np.repeat(names[q], n), ids[at], np.repeat(value, n)
                other = vec_id != query_id
                query_id, vec_id, value = query_id[other], vec_id[other], value[other]
                order = np.lexsort((vec_id, -value, query_id))
                query_id, vec_id, value = query_id[order], vec_id[order], value[order]
                first = np.flatnonzero(np.concatenate([[True], query_id[1:] != query_id[:-1]])) if len(order) else order
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                keep = place < k
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]) for a in (query_id, vec_id, value)], names=["query_id", "vec_id", "score"])

    return search


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """The k nearest found of each query by inner product: query_id, rank, vec_id, score. Ids are long integers."""
    shape = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(
        _usable(F.col("vector")) & F.col("id").isNotNull())
    rows = shape(vectors).withColumns({"c1": F.xxhash64("vector"), "c2": F.xxhash64(F.lit(1), "vector"), "dim": F.size("vector")})
    # Of equal vectors only the k + 1 smallest ids can be among a query's nearest (one may be the query itself).
    small = rows.select("c1", "c2", "id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))).filter(F.col("n") <= k + 1)
    listed = small.groupBy("c1", "c2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = cut_lineage(rows.dropDuplicates(["c1", "c2"]).drop("id").join(listed, ["c1", "c2"]))
    shards = max(1, -(-points.count() // shard_rows))
    index = cut_lineage(build_index(points, shards))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = column(batch, "dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for i in range(0, part.num_rows, QUERY_BLOCK):
                    held = part.slice(i, QUERY_BLOCK)
                    yield pa.RecordBatch.from_pydict(
                        {"dim": pa.array([int(dim)], pa.int32()), "queries": [_blob(column(held, "vector")).tobytes()], "names": [column(held, "id").to_numpy().tobytes()]})

    asked = shape(queries).dropDuplicates(["id"]).withColumn("dim", F.size("vector"))
    blocks = asked.mapInArrow(block, "dim int, queries binary, names binary").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = blocks.join(index, ["dim", "shard"]).mapInArrow(_searcher(k, beam), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op9_nearest_neighbours")
def op9(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
