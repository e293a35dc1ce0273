"""Quality classifier: a generalised additive model with pairwise interactions.

Numbers of a text (shares of kinds of characters, lengths, repetition) are cut into bins. Boosting goes round the features
in turn: each step fits a tree of a few leaves to the gradient of one feature's bins and adds a fraction of it to
that feature's lookup table. Then the pairs of features with the largest gain left are boosted alike on grids of coarse bins.
A score is the logistic function of an intercept plus one table entry per feature and pair.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` rows, the first by a hash of the id, from all
labels); features of those rows alone reach the driver. Every text is scored in its task, from tables of some
kilobytes.

Defined cases: a null or empty text has all features 0 and is scored like any other; null labels are left out, repeated
labels of an id count once (the larger one); without labels of both kinds every score is the share of label 1 (0.5
without any); a null id is held out; repeated rows are scored alike; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.words import PLAIN, column, pieces, span_hashes, split
from lodestone.registry import query
from lodestone.session import table

SAMPLE = 20_000
THRESHOLD = 0.3
PIECE_BYTES = 512 << 10

_every = np.arange(256)
_UPPER = (_every >= 0x41) & (_every <= 0x5A)
_LETTER = _UPPER | ((_every >= 0x61) & (_every <= 0x7A)) | (_every >= 0xC0)
_KINDS = {
    "upper": _UPPER,
    "digit": (_every >= 0x30) & (_every <= 0x39),
    "stop": np.isin(_every, [ord(c) for c in ".,;:?!'\""]),
    "shout": np.isin(_every, [ord(c) for c in "?!"]),
    "symbol": np.isin(_every, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]),
    "bar": np.isin(_every, [ord(c) for c in "|<>{}"]),
    "beyond": _every >= 0xC0,
    "control": (_every < 0x20) & (_every != 0x0A),
}
FEATURES = (
    "size", "words", "mean_word", "longest_word", *_KINDS, "line_words", "distinct_words", "distinct_runs", "distinct_lines", "bare_words", "marked_words",
)


def _distinct_share(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    total = np.bincount(row, minlength=n)
    return np.where(total, np.bincount(r[fresh], minlength=n) / np.maximum(total, 1), 0.0)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, whole texts; null is empty."""
    words = split(texts, PLAIN)
    n, low, high = len(words.offsets) - 1, words.offsets[:-1], words.offsets[1:]

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[words.data], dtype=np.int64)])
        return (total[high] - total[low]) / np.maximum(of, 1)

    size, count, row = high - low, np.diff(words.first), words.row
    letters = share(_LETTER, np.ones(n))
    length = words.end - words.start
    letter_sum = np.concatenate([[0], np.cumsum(_LETTER[words.data], dtype=np.int64)])
    bare = letter_sum[words.end] == letter_sum[words.start]
    marked = _KINDS["symbol"][words.data[words.end - 1]] | _KINDS["shout"][words.data[words.end - 1]] if len(length) else bare
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    at, runs = words.shingles(4)
    inner = np.zeros(len(words.data) + 2, bool)
    inner[1:-1] = words.data != 0x0A
    first, last = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    some = high > low
    first[low[some]] = inner[1:-1][low[some]]
    last[high[some] - 1] = inner[1:-1][high[some] - 1]
    line_start, line_end = np.flatnonzero(first), np.flatnonzero(last) + 1
    line_row = np.searchsorted(words.offsets, line_start, side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    mean = lambda flags: np.bincount(row, weights=flags, minlength=n) / np.maximum(count, 1)
    columns = [np.log1p(size), np.log1p(count), mean(length), np.log1p(longest)]
    columns += [share(kind, letters if name == "upper" else size) for name, kind in _KINDS.items()]
    columns += [
        np.log1p(count / np.maximum(lines, 1)), _distinct_share(row, words.hashes(), n), _distinct_share(row[at], runs, n),
        _distinct_share(line_row, span_hashes(words.data.astype(np.uint64) + np.uint64(1), line_start, line_end), n), mean(bare), mean(marked)]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Gam:
    """Lookup tables over binned features and pairs of features."""

    bins: int = 64
    grid: int = 12
    pairs: int = 8
    rounds: int = 60
    rate: float = 0.15
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    chosen: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))

    def _binned(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
        """Leaf values of a tree of a few leaves over ordered bins, split where the gain is largest."""
        edges = [0, len(g)]
        gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
        for _ in range(leaves - 1):
            best, where = 1e-9, None
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    at = np.arange(a + 1, b)
                    gain = worth(a, at) + worth(at, b) - worth(a, b)
                    i = int(np.argmax(gain))
                    if gain[i] > best:
                        best, where = gain[i], int(at[i])
            if where is None:
                break
            edges = sorted([*edges, where])
        out = np.empty(len(g))
        for a, b in zip(edges, edges[1:]):
            out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
        return out

    @staticmethod
    def _quarters(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
        """The cross cut of a grid with the largest gain: gain and leaf values."""
        pad = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        gs, hs = pad(g), pad(h)
        rows, cols = g.shape
        if rows < 2 or cols < 2:
            return 0.0, np.zeros_like(g)
        i, j = np.arange(1, rows)[:, None], np.arange(1, cols)[None]
        quarters = [(0, i, 0, j), (i, rows, 0, j), (0, i, j, cols), (i, rows, j, cols)]
        part = lambda s, a, b, c, d: s[b, d] - s[a, d] - s[b, c] + s[a, c]
        gain = sum(part(gs, *q) ** 2 / (part(hs, *q) + ridge) for q in quarters) - gs[-1, -1] ** 2 / (hs[-1, -1] + ridge)
        a, b = (int(v) + 1 for v in np.unravel_index(np.argmax(gain), gain.shape))
        out = np.empty_like(g)
        for rs in (slice(0, a), slice(a, rows)):
            for cs in (slice(0, b), slice(b, cols)):
                out[rs, cs] = g[rs, cs].sum() / (h[rs, cs].sum() + ridge)
        return float(gain.max()), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Gam":
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.intercept = float(np.log(mean / (1 - mean)))
        width = x.shape[1]
        self.cuts = [self._cuts(x[:, i], self.bins) if len(y) else np.zeros(0) for i in range(width)]
        self.coarse = [self._cuts(x[:, i], self.grid) if len(y) else np.zeros(0) for i in range(width)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        if not len(y) or y.min() == y.max():
            return self
        fine, rough = self._binned(x, self.cuts), self._binned(x, self.coarse)
        total = np.full(len(y), self.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for f in range(width):
                g, h = slopes()
                n = len(self.tables[f])
                step = self.rate * self._tree(np.bincount(fine[f], g, n), np.bincount(fine[f], h, n), 4)
                self.tables[f] += step
                total += step[fine[f]]
        g, h = slopes()
        shape = [len(c) + 1 for c in self.coarse]
        flat = lambda a, b: rough[a] * shape[b] + rough[b]
        grid = lambda a, b, w: np.bincount(flat(a, b), w, shape[a] * shape[b]).reshape(shape[a], shape[b])
        gains = sorted(((self._quarters(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(width) for b in range(a)), reverse=True)
        self.chosen = [(a, b) for gain, a, b in gains[: self.pairs] if gain > 0]
        self.grids = [np.zeros((shape[a], shape[b])) for a, b in self.chosen]
        for _ in range(self.rounds // 2):
            for k, (a, b) in enumerate(self.chosen):
                g, h = slopes()
                step = self.rate * self._quarters(grid(a, b, g), grid(a, b, h))[1]
                self.grids[k] += step
                total += step.reshape(-1)[flat(a, b)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self._binned(x, self.cuts), self._binned(x, self.coarse)
        total = np.full(len(x), self.intercept)
        for entry, where in zip(self.tables, fine):
            total += entry[where]
        for (a, b), entry in zip(self.chosen, self.grids):
            total += entry[rough[a], rough[b]]
        return 1 / (1 + np.exp(-total))


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Gam:
    """Fit the model on at most ``sample`` labelled rows; their ids (some hundred kilobytes) are broadcast."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            found = features(column(batch, "text"))
            kept = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "label"), kept], names=["key", "label", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.select(F.xxhash64("id", "text").alias("key"), "label", "text").mapInArrow(describe, "key bigint, label double, x array<double>")
    # An id of several rows could bring more than the bound; the order makes the sample the same in any partitioning.
    found = rows.orderBy("key").limit(sample).collect()
    return Gam().fit(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.label for r in found]))


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` but with a score: id and score, one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(model.score(features(column(batch, "text"))))], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, score double")
    return scored.withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, unchanged, whose score reaches the threshold."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, PIECE_BYTES):
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


@query("op1_quality")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_remainder("doc_id", 5) != 0)
    model = train(docs, labels, "doc_id", "text", "quality")
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
