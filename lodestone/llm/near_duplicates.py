"""Near-duplicate groups by b-bit MinHash with exact confirmation.

Texts of equal content form a class; classes, not copies, are compared. A class has ``HASHES`` minima of its shingle
hashes. Bands of ``ROWS`` whole minima name the buckets in which classes meet (a pair at the threshold misses all bands
with a chance of 5e-8). What travels into the buckets is the packed signature, the lowest ``BITS`` bits of each minimum:
the number of equal entries, corrected for chance collisions, estimates the similarity. A pair whose estimate is within
six standard deviations of the threshold stays a candidate.

No group is expanded into all its pairs. A bucket beyond a block is dealt into tiles, a tile of two blocks is compared in
arrays, and only a spanning star of its candidate groups leaves it. Connected candidates form clusters; the texts
of a cluster meet once, again in tiles bounded by rows and shingles, where links are confirmed on full shingle sets,
and again only spanning stars leave. Components of confirmed links are the groups.

Shingles are compared as 64-bit hashes of their words. Defined cases: a text without words (or null) has no shingles
and is linked with nothing; fewer words than a shingle are one shingle; repeated rows are one class and keep a row each;
a null id takes no part in the smallest id of a group; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm.components import components
from lodestone.llm.words import PLAIN, Words, column, give_back, mix, pieces, ragged, span_hashes, split
from lodestone.registry import query
from lodestone.session import cut_lineage, table

SHINGLE = 4
PERCENT = 80
BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
SIGMAS = 6
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 400_000

_random = np.random.default_rng(7)
_A = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) << 1) | 1
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_LOW = np.uint64(0x5555555555555555)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in order, and where each row's begin."""
    at, hashes = words.shingles(n)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    own = span_hashes(words.hashes(), words.first[short], words.first[short + 1])
    row = np.concatenate([words.row[at], short])
    hashes = np.concatenate([hashes, own])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[fresh], np.searchsorted(row[fresh], np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys [rows, BANDS] and packed low bits [rows, HASHES * BITS / 64] of non-empty sets."""
    small = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((HASHES, len(first) - 1), np.uint32)
    for i in range(HASHES):
        minima[i] = np.minimum.reduceat(small * _A[i] + _B[i], first[:-1])
    keys = np.zeros((BANDS, minima.shape[1]), np.uint64)
    for band in range(BANDS):
        key = np.full(minima.shape[1], band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[i])
        keys[band] = key
    per = 64 // BITS
    packed = np.zeros((HASHES // per, minima.shape[1]), np.uint64)
    for i in range(HASHES):
        packed[i // per] |= (minima[i].astype(np.uint64) & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (i % per))
    return keys.T.view(np.int64), packed.T


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal entries of packed signatures (last axis: words)."""
    apart = a ^ b
    return HASHES - np.bitwise_count((apart | (apart >> np.uint64(1))) & _LOW).sum(axis=-1, dtype=np.int64)


def least_matches(percent: int) -> int:
    """Equal entries below which a pair's collision-corrected similarity is surely under the threshold."""
    chance = 1 / (1 << BITS)
    p = percent / 100 * (1 - chance) + chance
    return int(np.floor(HASHES * (p - SIGMAS * np.sqrt(p * (1 - p) / HASHES))))


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a linked group to its first member."""
    m = len(linked)
    label = np.arange(m)
    while True:
        lower = label.copy()
        for i in range(0, m, 512):
            lower[i : i + 512] = np.minimum(label[i : i + 512], np.where(linked[i : i + 512], label, m).min(axis=1))
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            break
        label = lower
    node = np.flatnonzero(label != np.arange(m))
    return node, label[node]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys from sorted batches: each table holds complete runs only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(column(held[-1], k)[-1].as_py() != column(batch, k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(change)
        if len(cuts):
            if cuts[-1] or held:
                yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))]).combine_chunks()
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    give_back()


def _edges(t: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    c1, c2 = t["c1"].to_numpy(), t["c2"].to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (c1[a], c2[a], c1[b], c2[b])], names=["a1", "a2", "b1", "b2"])


def _spans(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for k in keys:
        v = t[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    begin = np.flatnonzero(change)
    return begin, np.append(begin[1:], t.num_rows)


def _candidates(keys: list[str], least: int, few: int = 6) -> Callable:
    """Stars of the pairs of a tile whose estimate reaches the threshold; runs of few rows are compared together."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            sig = np.stack([t[f"s{i}"].to_numpy().view(np.uint64) for i in range(HASHES * BITS // 64)], axis=1)
            begin, end = _spans(t, keys)
            run = np.repeat(np.arange(len(begin)), end - begin)
            small = (end - begin <= few)[run]
            left, right = [], []
            for d in range(1, few):
                i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d]) if d < len(run) else np.zeros(0, np.int64)
                i = i[matches(sig[i], sig[i + d]) >= least]
                left.append(i)
                right.append(i + d)
            for x, y in zip(begin[end - begin > few].tolist(), end[end - begin > few].tolist()):
                part = sig[x:y]
                linked = np.empty((y - x, y - x), bool)
                for i in range(0, y - x, 256):
                    linked[i : i + 256] = matches(part[i : i + 256, None], part[None]) >= least
                node, root = stars(linked)
                left.append(node + x)
                right.append(root + x)
            yield _edges(t, np.concatenate(left), np.concatenate(right))

    return find


def common_shingles(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of the sets of a tile."""
    m = len(first) - 1
    owner = np.repeat(np.arange(m), np.diff(first))
    order = np.argsort(hashes, kind="stable")
    value, owner = hashes[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(value)))
    common = np.zeros((m, m), np.float32)
    flat = common.reshape(-1)
    for d in range(1, 8):  # shingles of few sets: add each pair
        use = (count > d) & (count <= 8)
        for shift in range(8 - d):
            at = begin[use & (count > d + shift)] + shift
            flat += np.bincount(owner[at] * m + owner[at + d], minlength=m * m) if m <= 64 else 0
            if m > 64:
                np.add.at(flat, owner[at] * m + owner[at + d], 1)
    common += common.T
    often = np.flatnonzero(count > 8)
    for i in range(0, len(often), 2048):  # shingles of many sets: products of incidence matrices
        part = often[i : i + 2048]
        held = np.zeros((m, len(part)), np.float32)
        held[owner[ragged(begin[part], count[part])], np.repeat(np.arange(len(part)), count[part])] = 1
        common += held @ held.T
    return common


def _confirmed(keys: list[str], shingle: int, percent: int) -> Callable:
    """Stars of the links of a tile, on full shingle sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            begin, end = _spans(t, keys)
            for x, y in zip(begin.tolist(), end.tolist()):
                if y - x < 2:
                    continue
                hashes, first = shingle_sets(split(t["text"].slice(x, y - x), PLAIN, lower=True), shingle)
                size = np.diff(first).astype(np.int64)
                common = common_shingles(hashes, first).astype(np.int64)
                union = size[:, None] + size[None] - common
                node, root = stars((100 * common >= percent * union) & (common > 0))
                if len(node):
                    yield _edges(t, node + x, root + x)

    return confirm


def _tiles(rows: DataFrame, key: list[str], blocks: F.Column) -> DataFrame:
    """Deal the rows of each key to the tiles (ti <= tj) of its blocks, so that any two rows meet in a tile."""
    own = F.pmod(F.xxhash64("c1", "c2"), F.col("blocks"))
    dealt = rows.withColumn("blocks", blocks.cast("bigint")).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"ti": F.least("own", "other"), "tj": F.greatest("own", "other")}).drop("blocks", "own", "other")
    return dealt.repartition(*key, "ti", "tj").sortWithinPartitions(*key, "ti", "tj")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")).alias("a"), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")).alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of its group) and kept (id = component_id)."""
    signed, found = _grouped(docs, id_col, text_col, shingle, percent)
    out = signed.select("id", "c1", "c2", "n_shingles").join(found, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = PERCENT,
) -> DataFrame:
    """The rows and columns of ``docs`` with one row of each group (smallest id first), and all rows without words."""
    signed, found = _grouped(docs, id_col, text_col, shingle, percent)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit(1), id_col).alias("k2"), F.struct(*docs.columns).alias("row"))
    stay = found.filter("first").select("k.k1", "k.k2", F.lit(True).alias("single"))
    free = signed.filter("n_shingles = 0").select("k1", "k2", F.lit(False).alias("single")).distinct()
    rows = rows.join(stay.unionByName(free).hint("merge"), ["k1", "k2"])
    # A row that is repeated whole has one key; its first copy stays.
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("single")))
    return rows.filter("NOT single OR n = 1").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their keys, classes and set sizes; and per class its component_id, first row's key and whether it leads its group."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({
        "c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(1), "text"), "k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", F.lit(1), "id")})
    kind = docs.schema[id_col].dataType.simpleString()
    n_words = HASHES * BITS // 64
    parts = [f"s{i}" for i in range(n_words)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, first = shingle_sets(split(column(batch, "text"), PLAIN, lower=True), shingle)
            size = np.diff(first)
            some = size > 0
            keys, packed = np.zeros((len(size), BANDS), np.int64), np.zeros((len(size), n_words), np.uint64)
            if some.any():
                keys[some], packed[some] = signatures(hashes, np.append(first[:-1][some], first[-1]))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(size) + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, n) for n in ("id", "c1", "c2", "k1", "k2")], pa.array(size, pa.int64()), bands, *[pa.array(packed[:, i].view(np.int64)) for i in range(n_words)]],
                names=["id", "c1", "c2", "k1", "k2", "n_shingles", "bands", *parts])

    signed = cut_lineage(source.mapInArrow(
        sign, f"id {kind}, c1 bigint, c2 bigint, k1 bigint, k2 bigint, n_shingles bigint, bands array<bigint>, " + ", ".join(f"{p} bigint" for p in parts)))
    filled = signed.filter("n_shingles > 0")
    # Copies of a text fold into one class by aggregates; its first row by id and key stands for it.
    heads = cut_lineage(filled.groupBy("c1", "c2").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("k"), F.max("n_shingles").alias("n_shingles")))
    classes = filled.dropDuplicates(["c1", "c2"]).select("c1", "c2", *parts, F.explode("bands").alias("band"))
    sizes = filled.select("c1", "c2", F.explode("bands").alias("band")).distinct().groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = ["band", "ti", "tj"]
    edge_type = "a1 bigint, a2 bigint, b1 bigint, b2 bigint"
    tiles = _tiles(classes.join(sizes, "band"), ["band"], F.ceil(F.col("n") / BLOCK_ROWS)).select(*keys, "c1", "c2", *parts)
    clusters = cut_lineage(components(_pairs(tiles.mapInArrow(_candidates(keys, least_matches(percent)), edge_type))))
    members = clusters.select(F.col("node.c1").alias("c1"), F.col("node.c2").alias("c2"), F.xxhash64("root").alias("r1"), F.col("root.c1").alias("r2"))
    members = cut_lineage(members.join(heads, ["c1", "c2"]).select("c1", "c2", "r1", "r2", "k.k1", "k.k2", "n_shingles"))
    weights = members.groupBy("r1", "r2").agg(F.greatest(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).alias("n"))
    # A row that is repeated whole would bring its text twice; within a tile that is one more equal set.
    # Members grow with the corpus: they meet the texts in one way at every size, and are never broadcast.
    texts = members.join(weights, ["r1", "r2"]).join(source.select("k1", "k2", "text").hint("merge"), ["k1", "k2"]).select("c1", "c2", "r1", "r2", "n", "text")
    keys = ["r1", "r2", "ti", "tj"]
    tiles = _tiles(texts, ["r1", "r2"], F.col("n")).select(*keys, "c1", "c2", "text")
    groups = components(_pairs(tiles.mapInArrow(_confirmed(keys, shingle, percent), edge_type)))
    groups = cut_lineage(groups.select(F.col("node.c1").alias("c1"), F.col("node.c2").alias("c2"), "root").join(heads.select("c1", "c2", "k"), ["c1", "c2"]))
    lowest = groups.groupBy("root").agg(F.min("k").alias("low"))
    found = groups.join(lowest, "root").select("c1", "c2", "low")
    found = heads.join(found, ["c1", "c2"], "left").select(
        "c1", "c2", "k", F.coalesce("low.id", "k.id").alias("component_id"), (F.col("low").isNull() | (F.col("low") == F.col("k"))).alias("first"))
    return signed, found


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN low ON low.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op4_near_duplicates", OP4_SQL)
def op4(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
