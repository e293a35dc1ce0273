"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one text. Its minimiser is the least hash of the runs of ``seed`` words
in it. Consecutive windows that share a minimiser travel as one packed string (their words, joined by blanks) to the
bucket of that minimiser, so all copies of a window meet in one bucket, where sorting counts them. Hashes only sort:
windows of equal hash are compared byte by byte before they count as copies. Only distinct strings and their counts meet
in a bucket. Its verdicts, the repeated passages of a string, go back by the string's name (128 bits) in a join with the
places of all strings, so the copies of one passage need not be in one group.

Hot minimisers: runs of words with a large share of all runs (counted per piece of text, no run above the share can be
missed) come last in the order of minimisers, so text around a frequent line is dealt by its other words. Only a window
made of such runs alone has one as its minimiser, and equal packed strings of a piece travel once.
The list of hot runs has at most ``1 / share`` entries.

Defined cases: a null or empty text has no words; a text shorter than a window keeps all its words; repeated rows are
copies of each other, so all their windows repeat; rows are told apart by a 128-bit hash of id and text (equal rows get
equal results); further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.words import PLAIN, Words, column, covered, give_back, mix, pieces, ragged, span_hashes, split
from lodestone.registry import query
from lodestone.session import cut_lineage, table

WINDOW = 35
SEED_WORDS = 4
BUCKET_BYTES = 4 << 20
HOT_SHARE = 1 / 8192


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(values) - width + 1], out[width - span :][: len(values) - width + 1])


def hot_seeds(docs: DataFrame, seed: int, share: float) -> tuple[list[int], int]:
    """Hashes of runs of ``seed`` words that hold at least ``share`` of all runs, and the bytes of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = 0, 0
        sums: dict[int, int] = defaultdict(int)
        for batch in pieces(batches, "text"):
            words = split(column(batch, "text"))
            seeds = words.shingles(seed)[1]
            total, size = total + len(seeds), size + len(words.data)
            found, n = np.unique(seeds, return_counts=True)
            # A run of this share overall has half of it or more in some piece, and loses less than half elsewhere.
            often = n >= max(2, len(seeds) * share / 2)
            for h, c in zip(found[often].view(np.int64).tolist(), n[often].tolist()):
                sums[h] += c
        yield pa.RecordBatch.from_pydict(
            {"seed": pa.array([None, *sums], pa.int64()), "n": pa.array([total, *sums.values()], pa.int64()),
             "size": pa.array([size] + [0] * len(sums), pa.int64())})

    counts = cut_lineage(
        docs.select("text").mapInArrow(count, "seed bigint, n bigint, size bigint").groupBy("seed").agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    whole = counts.filter("seed IS NULL").first()
    if whole is None:
        return [], 0
    limit = int(1 / share)
    hot = counts.filter("seed IS NOT NULL").filter(F.col("n") >= max(2, whole.n * share / 2)).orderBy(F.desc("n"), "seed").limit(limit)
    return sorted(r.seed for r in hot.select("seed").collect()), int(whole.size or 0)


def super_kmers(words: Words, window: int, seed: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window (word numbers of their starts) and minimiser of each run of windows that share one."""
    at, hashes = words.shingles(seed)
    order = np.full(len(words.start), np.iinfo(np.uint64).max, np.uint64)
    late = np.isin(hashes, hot)
    order[at] = (mix(hashes) >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    row = words.row
    n = len(order) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    least = _sliding_min(order, window - seed + 1)[:n]
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    value = least[starts]
    breaks = np.flatnonzero((np.diff(starts) != 1) | (value[1:] != value[:-1]) | (row[starts[1:]] != row[starts[:-1]]))
    first = np.concatenate([[0], breaks + 1])
    last = np.concatenate([breaks, [len(starts) - 1]])
    return starts[first], starts[last], value[first]


def _spans(batch: pa.RecordBatch, window: int, seed: int, hot: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a piece, and first word, word behind the last, and minimiser of each of its packed strings."""
    words = split(column(batch, "text"))
    first, last, minimiser = super_kmers(words, window, seed, hot)
    return words, first, last + window, minimiser


def _names(words: Words, first: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """128 bits that name the words of each span, the same in every text."""
    return [span_hashes(words.hashes(which), first, stop, which).view(np.int64) for which in (0, 1)]


def _packer(window: int, seed: int, hot: np.ndarray, buckets: int):
    """Frames of packed strings: per piece and bucket the distinct strings and how often each stands there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches, "text"):
            words, first, stop, minimiser = _spans(batch, window, seed, hot)
            if not len(first):
                continue
            sizes = words.end - words.start + 1
            spaced = np.full(int(sizes.sum()), 0x20, np.uint8)
            begin = np.cumsum(sizes) - sizes
            spaced[ragged(begin, sizes - 1)] = words.data[ragged(words.start, sizes - 1)]
            raw = spaced.tobytes()
            low, high = begin[first], begin[stop - 1] + sizes[stop - 1] - 1
            bucket = (mix(minimiser) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            rows = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                held: dict[bytes, int] = defaultdict(int)
                for i, j in zip(low[order[x:y]].tolist(), high[order[x:y]].tolist()):
                    held[raw[i:j]] += 1
                rows.append((squeeze(b"\n".join(held)), squeeze(np.array(list(held.values()), np.int64).tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order[cuts[:-1]]]), *[pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)]], names=["bucket", "body", "counts"])

    return pack


def _placer(window: int, seed: int, hot: np.ndarray):
    """Names of packed strings and where they stand: the row's key and the first word."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, first, stop, _ = _spans(batch, window, seed, hot)
            row = words.row[first] if len(first) else first
            keys = [column(batch, k).take(pa.array(row)) for k in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, _names(words, first, stop)), *keys, pa.array(first - words.first[row], pa.int64())], names=["s1", "s2", "k1", "k2", "base"])

    return place


def leaders(words: Words, window: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and for each the number of the first window with the same words (itself, if new)."""
    at, hashes = words.shingles(window)
    if bits < 64:
        hashes = hashes & np.uint64((1 << bits) - 1)
    order = np.argsort(hashes, kind="stable")
    fresh = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(order) else np.zeros(0, bool)
    lead = np.empty(len(at), np.int64)
    lead[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else 0
    copies = np.flatnonzero(lead != np.arange(len(at)))
    if len(copies):
        # Copies that follow each other, as their leaders do, are one passage and are compared as one.
        follow = (np.diff(copies) == 1) & (np.diff(at[copies]) == 1) & (np.diff(lead[copies]) == 1) & (np.diff(at[lead[copies]]) == 1)
        edge = np.concatenate([[True], ~follow, [True]])
        runs = np.flatnonzero(edge)
        a, b = copies[runs[:-1]], copies[runs[1:] - 1]
        raw = words.data.tobytes()
        here, there = words.start[at[a]], words.start[at[lead[a]]]
        size, other = words.end[at[b] + window - 1] - here, words.end[at[lead[b]] + window - 1] - there
        same = all(raw[x : x + n] == raw[y : y + m] for x, y, n, m in zip(here.tolist(), there.tolist(), size.tolist(), other.tolist()))
        if not same:
            seen: dict[bytes, int] = {}
            for i, (x, y) in enumerate(zip(words.start[at].tolist(), words.end[at + window - 1].tolist())):
                lead[i] = seen.setdefault(raw[x:y], i)
    return at, lead


def repeated_spans(words: Words, counts: np.ndarray, window: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages (record, first word, word after the last) of packed strings whose windows stand in two places or more."""
    at, lead = leaders(words, window, bits)
    row = words.row[at]
    total = np.bincount(lead, weights=counts[row], minlength=len(at))
    again = np.flatnonzero(total[lead] >= 2)
    if not len(again):
        return again, again, again
    edge = np.flatnonzero((np.diff(at[again]) != 1) | (np.diff(row[again]) != 0))
    first, last = again[np.concatenate([[0], edge + 1])], again[np.concatenate([edge, [len(again) - 1]])]
    base = words.first[row[first]]
    return row[first], at[first] - base, at[last] - base + window


def _counter(window: int):
    """Per bucket, the repeated passages of its distinct strings, by name of the string."""

    def verdicts(held: dict[bytes, int]) -> pa.RecordBatch:
        words = split(pa.array(list(held), pa.large_binary()).cast(pa.large_string()))
        record, start, stop = repeated_spans(words, np.fromiter(held.values(), np.int64, len(held)), window)
        names = _names(words, words.first[record], words.first[record + 1])
        return pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["s1", "s2", "start", "stop"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        current, held = None, {}
        for batch in batches:
            for i, bucket in enumerate(column(batch, "bucket").to_pylist()):
                if bucket != current and held:
                    yield verdicts(held)
                    held = {}
                current = bucket
                body, counts = (expand(column(batch, n)[i].as_buffer()) for n in ("body", "counts"))
                # Equal strings of many pieces fold here, so a bucket is as large as its distinct strings.
                for record, n in zip(body.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                    held[record] = held.get(record, 0) + n
        if held:
            yield verdicts(held)
        held = {}
        give_back()

    return count


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words = split(column(batch, "text"))
        spans = column(batch, "spans")
        length = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, flat = np.repeat(np.arange(batch.num_rows), length), spans.flatten()
        start, stop = (words.first[rows] + flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "stop"))
        keep = np.flatnonzero(~covered(words.first, start, stop))
        left = np.searchsorted(keep, words.first)
        sizes = words.end[keep] - words.start[keep] + 1
        joined = np.full(int(sizes.sum()) + 1, 0x20, np.uint8)
        begin = np.cumsum(sizes) - sizes
        joined[ragged(begin, sizes - 1)] = words.data[ragged(words.start[keep], sizes - 1)]
        raw, edge = joined.tobytes(), np.append(begin, int(sizes.sum()))[left]
        kept = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        n_words = np.diff(words.first)
        rest = [n for n in batch.schema.names if n != "spans" and (with_text or n != "text")]
        yield pa.RecordBatch.from_arrays(
            [*[column(batch, n) for n in rest], pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(left), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*rest, "n_words", "n_removed", "kept"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED_WORDS,
    bucket_bytes: int = BUCKET_BYTES, hot_share: float = HOT_SHARE,
) -> DataFrame:
    """One row per document: id, n_words, n_removed and kept, the words left of the text joined by single blanks."""
    return _removed(docs, id_col, text_col, window, seed, bucket_bytes, hot_share, []).withColumnRenamed("id", id_col)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """The rows and columns of ``docs`` with repeated words gone from the text; other texts stay as they are."""
    rest = [c for c in docs.columns if c != text_col]
    found = _removed(docs, id_col, text_col, window, SEED_WORDS, BUCKET_BYTES, HOT_SHARE, rest, True)
    carried = {c: F.col(f"_c{i}") for i, c in enumerate(rest)}
    changed = F.col("n_removed") > 0
    if length_col:
        carried[length_col] = F.when(changed, F.length("kept").cast(docs.schema[length_col].dataType)).otherwise(carried[length_col])
    carried[text_col] = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return found.select(*[carried[c].alias(c) for c in docs.columns])


def _removed(
    docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, bucket_bytes: int, hot_share: float, carry: list[str], with_text: bool = False,
) -> DataFrame:
    carried = [f"_c{i}" for i in range(len(carry))]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, carried)])
    source = source.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", F.lit(1), "id")})
    hot, size = hot_seeds(source, seed, hot_share)
    buckets = max(1, 3 * size // bucket_bytes)
    late = np.array(hot, np.int64).view(np.uint64)
    packed = source.select("text").mapInArrow(_packer(window, seed, late, buckets), "bucket bigint, body binary, counts binary")
    found = cut_lineage(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counter(window), "s1 bigint, s2 bigint, start bigint, stop bigint"))
    places = source.select("text", "k1", "k2").mapInArrow(_placer(window, seed, late), "s1 bigint, s2 bigint, k1 bigint, k2 bigint, base bigint")
    spans = places.join(found, ["s1", "s2"]).select("k1", "k2", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("stop")).alias("stop"))
    # Equal rows have equal spans, which the set folds before the shuffle; a set is as long as its text at most.
    spans = cut_lineage(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    kind = docs.schema[id_col].dataType.simpleString()
    marked = source.join(spans, ["k1", "k2"], "left").select("id", *carried, "text", "spans")
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, carried))
    text = ", text string" if with_text else ""
    return marked.mapInArrow(lambda batches: _remove(batches, with_text), f"id {kind}{kinds}{text}, n_words bigint, n_removed bigint, kept string")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT k, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
  FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT k, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS p FROM again),
marks AS (SELECT k, list(p) AS ps, count(*) AS n FROM gone GROUP BY k),
flat AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS t FROM flat ANTI JOIN gone USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN marks USING (k) LEFT JOIN kept USING (k)
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
