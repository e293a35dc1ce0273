"""Document fingerprints by spot signatures, their likeness, and near-duplicate groups.

Anchors are the common words of the corpus: those with at least ``SHARE`` of all words, so never more than 1 / SHARE. A
spot signature is an anchor with the chain of the ``CHAIN`` content words that follow it, anchors between them left out.
The start of a text is an anchor too, and so is, ``GAP`` words or more behind the last common word, every word whose hash
is divisible by ``SPARE``: lists and junk without common words have signatures as well. The fingerprint of a text is the set of its signatures as 32-bit numbers, written
as sorted hexadecimal digits, eight each. Likeness is the Jaccard similarity of two such sets.

``matches`` finds all pairs above a threshold: sets are partitioned by length so that only sets of one partition or of
neighbouring ones can be alike, meet on the rarest signatures of each (as many as the threshold demands), and are
compared through Jaccard pruned by length and by what is left behind the first common signature. Equal sets are one class.

``fingerprint_edits`` compares each text with its successor in id order and with a text that ends in the successor's
beginning. Rows are dealt to ranges of ids; the first row of the next range is lent to each range, so every row meets its
successor in one streamed task, whatever the ranges are.

Defined cases: null is an empty text; an empty text has an empty fingerprint, like to another empty one (1.0) and unlike
all others (0.0); a text without words has one signature of its bytes, one without content words one of its words; a null
id comes first; rows of one id follow each other by hash of the text; repeated rows keep a row each; a single row is its
own successor; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.words import ALNUM, Words, column, mix, pieces, ragged, span_hashes, split
from lodestone.registry import query
from lodestone.session import cut_lineage, table

SHARE = 1 / 1024
CHAIN = 3
GAP, SPARE = 16, 8
DIGITS = 8
PIECE_BYTES = 2 << 20
RANGE_BYTES, RANGES = 16 << 20, 20_000
IDS_A_RANGE = 20
_START = np.uint64(0x5851F42D4C957F2D)


def _counted(docs: DataFrame, known: np.ndarray | None, share: float) -> DataFrame:
    """(word, n) with the number of words, texts and bytes of all under null: counts of ``known`` words, or of all
    words that are frequent in a piece of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = defaultdict(int)
        total = texts = size = 0
        for batch in pieces(batches, "text", PIECE_BYTES):
            words = split(column(batch, "text"), ALNUM, lower=True)
            found, n = np.unique(words.hashes(), return_counts=True)
            total, texts, size = total + len(words.start), texts + batch.num_rows, size + len(words.data)
            use = np.isin(found, known) if known is not None else n >= len(words.start) * share / 2
            for h, c in zip(found[use].view(np.int64).tolist(), n[use].tolist()):
                sums[h] += c
        rows = len(sums)
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([None, *sums], pa.int64()), "n": pa.array([total, *sums.values()], pa.int64()),
            "texts": pa.array([texts] + [0] * rows, pa.int64()), "size": pa.array([size] + [0] * rows, pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint, texts bigint, size bigint")
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "texts", "size")])


def common_words(docs: DataFrame, share: float = SHARE) -> tuple[np.ndarray, int, int]:
    """Hashes of the words with at least ``share`` of all words, exactly counted; the number of texts, and their bytes.

    docs: text. A first pass adds up the pieces of text in which a word has half the share or more: a word with the whole
    share loses less than half of it elsewhere, so at most 2 / share words come into question. A second pass counts these.
    """
    some = cut_lineage(_counted(docs, None, share))
    whole = some.filter("word IS NULL").first()
    if whole is None or not whole.n:
        return np.zeros(0, np.uint64), int(whole.texts or 0) if whole else 0, int(whole.size or 0) if whole else 0
    heavy = some.filter(F.col("word").isNotNull() & (F.col("n") >= share / 2 * whole.n))
    known = np.array([r.word for r in heavy.collect()], np.int64).view(np.uint64)
    counts = _counted(docs, known, share).filter(F.col("word").isNotNull() & (F.col("n") >= share * whole.n)).collect()
    return np.sort(np.array([r.word for r in counts], np.int64).view(np.uint64)), int(whole.texts), int(whole.size)


def spots(texts: pa.Array, anchors: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures of each text in order, and where each text's begin."""
    words = split(texts, ALNUM, lower=True)
    n, row, hashes = len(words.first) - 1, words.row, words.hashes()
    anchor = np.isin(hashes, anchors)
    place = np.arange(len(hashes))
    last = np.maximum(np.maximum.accumulate(np.where(anchor, place, -1)), words.first[row] - 1) if len(place) else place
    anchor |= (place - last >= GAP) & (hashes % np.uint64(SPARE) == 0)
    content = np.flatnonzero(~anchor)
    own, own_row = hashes[content], row[content]
    heads = np.flatnonzero(anchor)
    at = np.searchsorted(content, heads)
    full = at + chain <= len(content)
    full[full] = own_row[at[full] + chain - 1] == row[heads[full]]
    heads, at = heads[full], at[full]
    begin = np.searchsorted(own_row, np.arange(n + 1))
    filled = np.flatnonzero(np.diff(begin))
    first = begin[filled]
    bare = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(begin) == 0))
    blank = np.flatnonzero((np.diff(words.first) == 0) & (np.diff(words.offsets) > 0))
    bytes_ = np.array([zlib.crc32(words.data[words.offsets[i] : words.offsets[i + 1]]) for i in blank.tolist()], np.uint64)
    mark = [
        mix(hashes[heads] * np.uint64(0x9E3779B97F4A7C15) + span_hashes(own, at, at + chain)),
        mix(_START + span_hashes(own, first, np.minimum(first + chain, begin[filled + 1]))),
        mix(_START ^ span_hashes(hashes, words.first[bare], words.first[bare + 1])), bytes_]
    where = np.concatenate([row[heads], filled, bare, blank]).astype(np.uint64)
    keys = np.unique(where << np.uint64(32) | (np.concatenate(mark) & np.uint64(0xFFFFFFFF)))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(keys >> np.uint64(32), np.arange(n + 1))


def printed(marks: np.ndarray, first: np.ndarray) -> list[str]:
    """Fingerprints as sorted hexadecimal digits."""
    digits = marks.astype(">u4").tobytes().hex()
    return [digits[a * DIGITS : b * DIGITS] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> np.ndarray:
    """Jaccard similarity of the i-th set of one list with the i-th of the other; two empty sets are alike.

    Pairs whose lengths alone keep them below ``least`` are 0 and not compared.
    """
    n_a, n_b = np.diff(a[1]), np.diff(b[1])
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    out = np.where(large == 0, 1.0, 0.0)
    use = np.flatnonzero((small > 0) & (small >= least * large))
    pair = np.arange(len(use), dtype=np.uint64) << np.uint64(32)
    keys = np.concatenate([np.repeat(pair, n[use]) | marks[ragged(first[use], n[use])] for (marks, first), n in ((a, n_a), (b, n_b))])
    keys.sort()
    twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)
    common = np.bincount(twice.astype(np.int64), minlength=len(use))
    out[use] = common / (n_a[use] + n_b[use] - common)
    return np.where(out >= least, out, 0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, chain: int = CHAIN) -> DataFrame:
    """(id, n_spots, fingerprint) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    anchors = common_words(source, share)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            marks, first = spots(column(batch, "text"), anchors, chain)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(np.diff(first), pa.int64()), pa.array(printed(marks, first), pa.string())], names=["id", "n_spots", "fingerprint"])

    return source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_spots bigint, fingerprint string").withColumnRenamed("id", id_col)


def _dealt(source: DataFrame, texts: int, size: int, range_bytes: int) -> tuple[DataFrame, int]:
    """Rows with the range of their id, and the first row of the next range lent to each (the last one gets the first of all)."""
    ranges = max(1, min(RANGES, size // range_bytes))
    ids = source.filter("id IS NOT NULL").select("id")
    sample = sorted(r.id for r in ids.sample(min(1.0, IDS_A_RANGE * ranges / max(texts, 1)), seed=1).collect()) if ranges > 1 else []
    cuts = pd.Series(sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else [], dtype=object).to_numpy()

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        out = np.zeros(len(keys), np.int32)
        known = keys.notna().to_numpy()
        out[known] = [] if not known.any() else np.searchsorted(cuts, keys[known].astype(object).to_numpy(), side="right")
        return pd.Series(out)

    dealt = source.withColumn("part", part("id")) if len(cuts) else source.withColumn("part", F.lit(0))
    heads = dealt.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("k")).orderBy("part").collect()
    if not heads:
        return dealt.withColumn("lent", F.lit(False)).limit(0), 1
    # One row per range goes through the driver: its first id.
    kind = source.schema["id"].dataType.simpleString()
    lend = source.sparkSession.createDataFrame([(h.k.id, heads[i - 1].part) for i, h in enumerate(heads)], f"id {kind}, part int")
    held = source.join(F.broadcast(lend.select(F.col("id").alias("_id"), "part")), F.col("id").eqNullSafe(F.col("_id")))
    held = held.groupBy("part").agg(F.min(F.struct("h1", "h2")).alias("h"), F.min_by(F.struct("id", "text", "h1", "h2"), F.struct("h1", "h2")).alias("r"))
    lent = held.select("r.*", "part").withColumn("lent", F.lit(True))
    return dealt.withColumn("lent", F.lit(False)).unionByName(lent), len(cuts) + 1


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, chain: int = CHAIN, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_spots."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    anchors, texts, size = common_words(source, share)
    keyed = source.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    dealt, ranges = _dealt(keyed, texts, size, range_bytes)
    rows = dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "lent", F.col("id").asc_nulls_first(), "h1", "h2").select("id", "text", "lent")

    def compare(ids: list, kept: list[str], after: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        half = [len(t) // 2 for t in kept]
        edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(kept, after, half)]
        own, other, new = (spots(pa.array(x, pa.large_string()), anchors, chain) for x in (kept, after[-1:], edited))
        following = np.concatenate([own[0][own[1][1] :], other[0]]), np.concatenate([own[1][1:], own[1][-1:] + len(other[0])]) - own[1][1]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array([len(t) for t in kept], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
             pa.array(printed(*own)), pa.array(printed(*new)), pa.array(likeness(own, new)), pa.array(likeness(own, following)), pa.array(np.diff(own[1]), pa.int64())],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in pieces(batches, "text", PIECE_BYTES):
            ids, texts, lent = column(batch, "id").to_pylist(), [t or "" for t in column(batch, "text").to_pylist()], column(batch, "lent").to_pylist()
            if held:
                ids, texts, lent = [held[0], *ids], [held[1], *texts], [False, *lent]
            held = None if lent[-1] else (ids[-1], texts[-1])
            begin = 0
            for stop in [*[i for i, x in enumerate(lent) if x], *([] if lent[-1] else [len(lent) - 1])]:
                if stop > begin:
                    yield compare(ids[begin:stop], texts[begin:stop], texts[begin + 1 : stop + 1], column(batch, "id").type)
                begin = stop + 1

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots bigint")
    return out.withColumnRenamed("id", id_col)


def matches(prints: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints with likeness of at least ``least``, and the class of every row.

    prints: fingerprint and any other columns. Returns (a, b, likeness) of classes, a before b, and the rows with their
    class (the fingerprint's hash); empty fingerprints have no class.
    """
    name = F.sha2("fingerprint", 256)
    members = prints.withColumn("class", F.when(F.length("fingerprint") > 0, name))
    digits = F.expr(f"transform(sequence(0, length(fingerprint) div {DIGITS} - 1), i -> substring(fingerprint, i * {DIGITS} + 1, {DIGITS}))")
    classes = cut_lineage(prints.filter("fingerprint <> ''").select("fingerprint").distinct().select(name.alias("class"), digits.alias("marks")))
    each = classes.select("class", F.size("marks").alias("size"), F.explode("marks").alias("mark"))
    often = each.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Rarest first; a mark of one set alone joins nothing but takes its place in the order.
    placed = each.join(often, "mark", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    order = Window.partitionBy("class").orderBy("n", "mark")
    placed = placed.withColumn("place", F.row_number().over(order))
    needed = lambda size: F.ceil(F.round(size * least, 9))
    prefix = placed.filter((F.col("place") <= F.col("size") - needed(F.col("size")) + 1) & (F.col("n") > 1)).withColumn("room", _room(F.col("size"), least))
    prefix = cut_lineage(prefix.select("class", "size", "mark", "place", "room"))
    # A set waits in its own partition and visits the next larger one.
    visits = prefix.withColumn("room", F.col("room") + 1)
    own = prefix.alias("l")
    rest = lambda side: F.col(f"{side}.size") - F.col(f"{side}.place")

    def meet(other: DataFrame, tie: Column) -> DataFrame:
        both = own.join(other.alias("r"), (F.col("l.room") == F.col("r.room")) & (F.col("l.mark") == F.col("r.mark")) & tie)
        total = F.col("l.size") + F.col("r.size")
        # Common marks are at most those before the two places, this one, and the fewer of those behind.
        most = F.least(F.col("l.place"), F.col("r.place")) + F.least(rest("l"), rest("r"))
        long_enough = F.least("l.size", "r.size") >= F.greatest("l.size", "r.size") * least - 1e-9
        return both.filter(long_enough & (most >= total * (least / (1 + least)) - 1e-9)).select(F.col("l.class").alias("x"), F.col("r.class").alias("y"))

    found = meet(prefix, F.col("l.class") < F.col("r.class")).unionByName(meet(visits, F.lit(True)))
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    held = found.join(classes.select(F.col("class").alias("a"), F.col("marks").alias("p")), "a").join(classes.select(F.col("class").alias("b"), F.col("marks").alias("q")), "b")
    common = F.size(F.array_intersect("p", "q"))
    like = common / (F.size("p") + F.size("q") - common)
    return held.select("a", "b", like.alias("likeness")).filter(F.col("likeness") >= least), members


def _room(size: Column, least: float) -> Column:
    """The partition of a set's length: lengths of two sets with this likeness lie in one partition or in neighbours."""
    return F.floor(F.log(size.cast("double")) / float(-np.log(least)) + 1e-9).cast("int")


@query("op13_spot_signatures")
def op13(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))
