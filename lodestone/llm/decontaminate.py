"""Benchmark decontamination with Aho-Corasick automata over normalised test items.

Every window of ``width`` consecutive words of an item is one pattern of an automaton (an item of fewer words is one
pattern). A text is normalised once (A-Z lower-cased, words joined by single blanks) and scanned once per automaton;
matches are mapped back to word numbers and to character offsets of the original text.

Items reach the executors by broadcast. Equal texts are folded first, with their ids (in several rows, where all ids
exceed ``group_bytes``). These rows are dealt to buckets, the buckets measured and packed into groups of at most
``group_bytes``, one automaton each, and the texts pass through the automata one after the other. Only a single row beyond
that size makes a larger group: a text of an item is never split.

Defined cases: a null or empty text has no words and no hits; a null or wordless item has no pattern; a null item id
counts as the id ""; repeated items and rows each count for themselves, the same id once; further columns of the
inputs are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.words import ALNUM, LOWER, column, covered, pieces, split
from lodestone.registry import query
from lodestone.session import cut_lineage, table

WIDTH = 13
GROUP_BYTES = 32 << 20

_plain = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)
_automata: dict[str, tuple] = {}


def _normal(data: bytes) -> str:
    """Lower-cased words between single blanks, a blank at both ends; one character per byte."""
    return (b" " + b" ".join(data.split()) + b" ").decode("latin-1")


def patterns(texts: list[str], width: int) -> dict[str, tuple[int, set[int]]]:
    """Normalised window -> (its number of words, the numbers of the texts that hold it)."""
    found: dict[str, tuple[int, set[int]]] = {}
    for number, text in enumerate(texts):
        words = bytes(_plain[np.frombuffer((text or "").encode(), np.uint8)]).split()
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            window = _normal(b" ".join(words[i : i + size]))
            found.setdefault(window, (size, set()))[1].add(number)
    return found


def grouped(items: DataFrame, group_bytes: int) -> tuple[DataFrame, list[list[int]]]:
    """Rows (ids, text, bucket) of distinct texts of ``items`` (item, text), and the buckets of each group, packed by measured size."""
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item")).alias("all"), F.sum(F.octet_length("item")).alias("ids")).first()
    salts = max(1, -(-int(total.ids or 0) // group_bytes))
    folded = cut_lineage(items.groupBy("text", F.pmod(F.xxhash64("item"), F.lit(salts)).alias("salt")).agg(F.collect_set("item").alias("ids")).withColumn(
        "size", F.octet_length("text") + F.aggregate("ids", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x))))
    buckets = 4 * max(1, -(-int(total["all"] or 0) // group_bytes))
    while True:
        dealt = folded.withColumn("bucket", F.pmod(F.xxhash64("text", "salt"), F.lit(buckets)))
        sizes = dealt.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("bucket").collect()
        if all(r["size"] <= group_bytes or r.n == 1 for r in sizes):
            break
        buckets *= 4
    groups, held = [[]], 0
    for r in sizes:
        if groups[-1] and held + r["size"] > group_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r.bucket)
        held += r["size"]
    return dealt.select("ids", "text", "bucket"), groups


def _automaton(key: str, held, width: int) -> tuple:
    """The automaton of a broadcast group, built once in each Python worker."""
    if key not in _automata:
        rows = held.value
        windows = patterns([text for _, text in rows], width)
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        entries = []
        for i, (window, (size, texts)) in enumerate(windows.items()):
            machine.add_word(window, i)
            entries.append((size, sorted(texts)))
        if windows:
            machine.make_automaton()
        _automata.clear()  # a worker outlives its query, and needs one automaton at a time
        _automata[key] = (machine if windows else None, entries, [ids for ids, _ in rows])
    return _automata[key]


def _scanner(held, width: int):
    """Append the spans (word numbers) and item ids that one group's automaton finds."""
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            machine, entries, names = _automaton(key, held, width)
            if machine is None:
                yield batch
                continue
            spans, ids = column(batch, "_spans").to_pylist(), column(batch, "_items").to_pylist()
            texts = column(batch, "text").cast(pa.large_string()).fill_null("")
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i in range(batch.num_rows):
                text = _normal(_plain[data[offsets[i] : offsets[i + 1]]].tobytes())
                hits = list(machine.iter(text))
                if hits:
                    blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
                    stops = np.searchsorted(blanks, [end for end, _ in hits])
                    found, texts_hit, known = set(), set(), set(ids[i])
                    for stop, (_, entry) in zip(stops.tolist(), hits):
                        size, held_by = entries[entry]
                        found.add((stop - size, stop))
                        texts_hit.update(held_by)
                    for number in texts_hit:
                        known.update(names[number])
                    spans[i] = spans[i] + [{"start": a, "stop": b} for a, b in sorted(found)]
                    ids[i] = sorted(known)
            arrays = [column(batch, n) for n in batch.schema.names]
            arrays[batch.schema.get_field_index("_spans")] = pa.array(spans, batch.schema.field("_spans").type)
            arrays[batch.schema.get_field_index("_items")] = pa.array(ids, batch.schema.field("_items").type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return scan


def _summary(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Word counts, hit words and merged hit passages in characters of the original text."""
    for batch in pieces(batches, "text"):
        words = split(column(batch, "text"), ALNUM)
        counts = np.diff(words.first)
        spans = column(batch, "_spans")
        rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False).astype(np.int64))
        flat = spans.flatten()
        start = words.first[rows] + flat.field("start").to_numpy()
        stop = words.first[rows] + flat.field("stop").to_numpy()
        hit = covered(words.first, start, stop)
        totals = np.concatenate([[0], np.cumsum(hit)])
        n_hit = totals[words.first[1:]] - totals[words.first[:-1]]
        passages: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i in np.flatnonzero(n_hit).tolist():
            a, b = words.first[i], words.first[i + 1]
            mine = np.concatenate([[False], hit[a:b], [False]])
            edges = np.flatnonzero(mine[1:] != mine[:-1])
            raw = words.data[words.offsets[i] : words.offsets[i + 1]]
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            for begin, end in zip(edges[::2], edges[1::2]):
                at = (words.start[a + begin] - words.offsets[i], words.end[a + end - 1] - words.offsets[i])
                passages[i].append({"start": int(chars[at[0]]), "stop": int(chars[at[1]])})
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        rest = [n for n in batch.schema.names if n not in ("_spans", "_items") and (with_text or n != "text")]
        yield pa.RecordBatch.from_arrays(
            [*[column(batch, n) for n in rest], pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), column(batch, "_items"), pa.array(passages, kinds)],
            names=[*rest, "n_words", "n_hit", "items", "passages"])


def decontaminate(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", width: int = WIDTH, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), passages (character spans of the original)."""
    return _found(docs, bench, id_col, text_col, item_col, item_text, width, group_bytes, []).withColumnRenamed("_id", id_col)


def drop_contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows and columns of ``docs`` without contaminated documents."""
    rest = [c for c in docs.columns if c != text_col]
    found = _found(docs, bench, id_col, text_col, item_col, item_text, WIDTH, GROUP_BYTES, rest, True).filter(~contaminated())
    carried = {c: F.col(f"_c{i}") for i, c in enumerate(rest)} | {text_col: F.col("text")}
    return found.select(*[carried[c].alias(c) for c in docs.columns])


def _found(
    docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, width: int, group_bytes: int, carry: list[str], with_text: bool = False,
) -> DataFrame:
    carried = [f"_c{i}" for i in range(len(carry))]
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, carried))
    spark = docs.sparkSession
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    folded, groups = grouped(items, group_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    inner = f"_id {kind}{kinds}, text string, _spans array<struct<start:bigint,stop:bigint>>, _items array<string>"
    out = docs.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(n) for c, n in zip(carry, carried)], F.col(text_col).alias("text"),
        F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("_spans"), F.expr("cast(array() as array<string>)").alias("_items"))
    for group, buckets in enumerate(groups):
        part = folded.filter(F.col("bucket").isin(buckets)) if len(groups) > 1 else folded
        held = spark.sparkContext.broadcast([(r.ids, r.text) for r in part.collect()])
        scan = _scanner(held, width)
        if group < len(groups) - 1:
            out = out.mapInArrow(scan, inner)
    text = ", text string" if with_text else ""
    final = f"_id {kind}{kinds}{text}, n_words bigint, n_hit bigint, items array<string>, passages array<struct<start:bigint,stop:bigint>>"
    return out.mapInArrow(lambda batches: _summary(scan(batches), with_text), final)


def contaminated() -> F.Column:
    """The contamination rule over n_hit and n_words: at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS k FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, lens)),
hits AS (SELECT k, i, bw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
items AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM split LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
