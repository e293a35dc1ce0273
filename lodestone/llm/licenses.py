"""License scan: an exact set-similarity join of text blocks with license templates.

A text block is a run of consecutive words of one text, ``REACH`` times as many as the template has (statements are wrapped
over lines, commented and reformatted, but their words stay close). A block meets a template when it holds at least
``threshold`` of the template's distinct words. Words are ordered globally by the number of lines that hold them (counted
over the whole corpus). A text can only hold such a block if it holds a word of the template's prefix, the
``size - needed + 1`` rarest ones (prefix filter), enough distinct words (length filter), and enough of them behind the
first common one (positional filter). For texts that pass, every block that starts at a word of the template is counted
exactly. Only words of templates matter, so a text is reduced to those before any work.

Matches are the fullest blocks of a text and template, of equal ones the shortest, that do not overlap, each cut to the
words it needs.

Templates are a parameter of this operator and travel with the task; the join itself needs no shuffle of texts.
Beside the join, places of fixed phrases are listed.

Defined cases: a null text is empty and has no places, labels or matches (score 0); repeated rows each get their own
result; a template without words never matches; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.words import ALNUM, LOWER, Words, column, pieces, ragged, split
from lodestone.registry import query
from lodestone.session import table

THRESHOLD = 0.9
REACH = 2

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening statements of public licenses and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced without permission"),
)


def words_of(text: str) -> list[str]:
    words = split(pa.array([text]), ALNUM, lower=True)
    return [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end)]


@dataclass
class Vocabulary:
    """The words that templates and phrases use, found in a piece by their hashes."""

    words: list[str]

    def __post_init__(self):
        own = split(pa.array(self.words), ALNUM, lower=True).hashes() if self.words else np.zeros(0, np.uint64)
        self.order = np.argsort(own)
        self.sorted = own[self.order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of a piece that are in the vocabulary, and which entry each is."""
        if not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == hashes)
        entry = self.order[at[hit]]
        lengths = np.array([len(w.encode()) for w in self.words])
        same = words.end[hit] - words.start[hit] == lengths[entry]
        return hit[same], entry[same]


def _blocks(words: Words) -> np.ndarray:
    """The block (line) of each word, numbered through the piece."""
    lines = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
    return lines[words.start] + words.row


def _runs(at: np.ndarray, entry: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the run of ``length`` words from each hit on: its distinct entries, and the word at which the last of them is first seen."""
    held, end = np.zeros(len(at), np.int64), at.copy()
    for e in np.unique(entry):
        own = np.append(at[entry == e], np.iinfo(np.int64).max)
        seen = own[np.searchsorted(own, at)]
        inside = seen < at + length
        held += inside
        end = np.where(inside, np.maximum(end, seen), end)
    return held, end


def _apart(order: list[int], start: list[int], end: list[int]) -> Iterator[int]:
    """Of intervals in order of preference, those that do not overlap one taken before."""
    starts, ends = [], []
    for i in order:
        k = bisect_left(starts, start[i])
        if (k == 0 or ends[k - 1] < start[i]) and (k == len(starts) or starts[k] > end[i]):
            starts.insert(k, start[i])
            ends.insert(k, end[i])
            yield i


def _pairs(block: np.ndarray, entry: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (block, entry) pairs in order."""
    both = np.unique(block * size + entry)
    return both // size, both % size


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many blocks of the corpus each word of the vocabulary stands; one number per word reaches the driver."""
    known = Vocabulary(list(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.words), np.int64)
        for batch in pieces(batches, "text"):
            words = split(column(batch, "text"), ALNUM, lower=True)
            hit, entry = known.find(words)
            total += np.bincount(_pairs(_blocks(words)[hit], entry, len(total))[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["entry", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "entry bigint, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))
    return {known.words[r.entry]: r.n for r in found.collect()}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: id, n_words, places (phrase starts by label) and matches (blocks that meet a template)."""
    lengths = [len(words_of(text)) for _, text in templates]
    sets = [sorted(set(words_of(text))) for _, text in templates]
    phrase_words = [words_of(text) for text, _ in phrases]
    vocabulary = sorted({w for s in [*sets, *phrase_words] for w in s})
    frequency = word_frequencies(docs, text_col, vocabulary)
    # Entries are numbered from rare to frequent, so an entry is its own place in the global order.
    known = Vocabulary(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))
    number = {w: i for i, w in enumerate(known.words)}
    ranked = [np.array(sorted(number[w] for w in s), np.int64) for s in sets]
    needed = np.array([max(1, int(np.ceil(threshold * len(r) - 1e-9))) for r in ranked], np.int64)
    index: list[list[tuple[int, int]]] = [[] for _ in known.words]
    for t, ranks in enumerate(ranked):
        for place, entry in enumerate(ranks[: len(ranks) - needed[t] + 1] if len(ranks) else []):
            index[entry].append((t, place))
    n_posting = np.array([len(p) for p in index], np.int64)
    posting = np.array([pair for p in index for pair in p], np.int64).reshape(-1, 2)
    first_posting = np.cumsum(n_posting) - n_posting
    member = np.zeros((len(sets), max(1, len(known.words))), bool)
    for t, ranks in enumerate(ranked):
        member[t, ranks] = True
    sizes = np.array([max(1, len(r)) for r in ranked], np.int64)
    sequences = [np.array([number[w] for w in ws], np.int64) for ws in phrase_words]
    labels, phrase_labels = [label for label, _ in templates], [label for _, label in phrases]
    kind = docs.schema[id_col].dataType.simpleString()
    place_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    match_type = pa.list_(pa.struct([
        ("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("line", pa.int64()), ("last_line", pa.int64()), ("containment", pa.float64())]))

    def joined(block: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (text, template) with enough common words, from distinct pairs in order."""
        total = np.bincount(block, minlength=int(block[-1]) + 1) if len(block) else np.zeros(1, np.int64)
        place = np.arange(len(block)) - (np.cumsum(total) - total)[block]
        source = np.repeat(np.arange(len(block)), n_posting[entry])
        posted = posting[ragged(first_posting[entry], n_posting[entry])]
        template = posted[:, 0]
        left = np.minimum(sizes[template] - posted[:, 1], total[block[source]] - place[source])
        # A later common word has less left; the first one decides, so its bound may be tested on each.
        passed = (total[block[source]] >= needed[template]) & (left >= needed[template])
        candidates = np.unique(block[source][passed] * len(sets) + template[passed])
        block_of, template_of = candidates // len(sets), candidates % len(sets)
        begin = np.cumsum(total) - total
        rows = np.repeat(np.arange(len(candidates)), total[block_of])
        held = member[template_of[rows], entry[ragged(begin[block_of], total[block_of])]]
        common = np.bincount(rows, weights=held, minlength=len(candidates)).astype(np.int64)
        good = common >= needed[template_of]
        return block_of[good], template_of[good]

    def blocks_of(hit: np.ndarray, entry: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, template, first word, last word, common words) of the matches of a piece."""
        owner = row[hit]
        for r, t in zip(*(x.tolist() for x in joined(*_pairs(owner, entry, len(known.words))))):
            a, b = np.searchsorted(owner, [r, r + 1])
            mine = member[t, entry[a:b]]
            at = hit[a:b][mine]
            held, end = _runs(at, entry[a:b][mine], REACH * lengths[t])
            able = np.flatnonzero(held >= needed[t])
            order = able[np.lexsort((at[able], (end - at)[able], -held[able]))]
            for i in _apart(order.tolist(), at, end):
                yield r, t, int(at[i]), int(end[i]), int(held[i])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = split(column(batch, "text"), ALNUM, lower=True)
            blocks, row = _blocks(words), words.row
            hit, entry = known.find(words)
            places: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            matches: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            entries = np.full(len(words.start) + 16, -1, np.int64)
            entries[hit] = entry
            rows = np.concatenate([row, np.full(16, -1, np.int64)])
            for label, sequence in zip(phrase_labels, sequences):
                at = hit[entry == sequence[0]]
                for i, wanted in enumerate(sequence[1:], 1):
                    at = at[(entries[at + i] == wanted) & (rows[at + i] == rows[at])]
                for i in at.tolist():
                    places[row[i]].append({"label": label, "start": int(i - words.first[row[i]])})
            newlines = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
            for i, t, a, b, n in blocks_of(hit, entry, row):
                line, last = (int(blocks[x]) - i - int(newlines[words.offsets[i]]) for x in (a, b))
                first = int(words.first[i])
                matches[i].append({"label": labels[t], "template": t, "first_word": a - first, "last_word": b - first,
                                   "line": line, "last_line": last, "containment": n / int(sizes[t])})
            yield pa.RecordBatch.from_arrays(
                [column(batch, "_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(places, place_type), pa.array(matches, match_type)],
                names=["_id", "n_words", "places", "matches"])

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"_id {kind}, n_words bigint, places array<struct<label:string,start:bigint>>, "
        "matches array<struct<label:string,template:int,first_word:bigint,last_word:bigint,line:bigint,last_line:bigint,containment:double>>")
    return found.withColumnRenamed("_id", id_col)


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql() -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"('{label}', {words_of(text)!r})" for text, label in PHRASES)
    templates = ", ".join(
        f"({t}, '{label}', {sorted(set(words_of(text)))!r}, {max(1, int(np.ceil(THRESHOLD * len(set(words_of(text))) - 1e-9)))}, {REACH * len(words_of(text))})"
        for t, (label, text) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {_lower('text')} AS t FROM documents),
w AS (SELECT doc_id, k, regexp_extract_all(t, {words}) AS w FROM d),
phrase(label, p) AS (VALUES {phrases}),
template(tid, label, s, need, reach) AS (VALUES {templates}),
places AS (
  SELECT k, label, i - 1 AS start
  FROM (SELECT k, label, p, w, unnest(range(1, len(w) - len(p) + 2)) AS i FROM w, phrase)
  WHERE w[i : i + len(p) - 1] = p),
flat AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
member AS (SELECT tid, unnest(s) AS word FROM template),
hits AS MATERIALIZED (SELECT k, tid, word, i FROM flat JOIN member USING (word)),
may AS (SELECT k, tid FROM hits JOIN template USING (tid) GROUP BY k, tid HAVING count(DISTINCT word) >= any_value(need)),
held AS (
  SELECT k, tid, (SELECT count(DISTINCT h.word) FROM hits h WHERE h.k = x.k AND h.tid = x.tid AND h.i BETWEEN x.i AND x.i + reach - 1) AS n
  FROM hits x JOIN may USING (k, tid) JOIN template USING (tid)),
matches AS (
  SELECT k, any_value(label) AS label, max(n) / any_value(len(s)) AS c
  FROM held JOIN template USING (tid) GROUP BY k, tid HAVING max(n) >= any_value(need)),
base AS (
  SELECT k, count(*) AS n, min(start) AS a, max(start) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY k),
every AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM places UNION ALL SELECT k, label FROM matches) GROUP BY k),
best AS (SELECT k, max(c) AS c FROM (SELECT k, 1.0::DOUBLE AS c FROM places UNION ALL SELECT k, c::DOUBLE FROM matches) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word,
       CAST(b AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(c, 0.0) AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN every USING (k) LEFT JOIN best USING (k)
"""


@query("op5_license_scan", _sql())
def op5(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts, own = F.col("places.start"), F.array_distinct(F.col("places.label"))
    contained = F.array_max("matches.containment")
    joined = lambda labels: F.concat_ws(",", F.array_sort(labels))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(own).alias("base_labels"),
        joined(F.array_union(own, "matches.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(contained, F.lit(0.0))).alias("score"))
