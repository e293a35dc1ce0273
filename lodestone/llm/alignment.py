"""Alignment of two tokenizers: byte-exact groups and links of each text, and how many documents hold a linked pair.

Texts are cut into units, a blank or line feed with the word behind it. Neither tokenizer joins across the front of a
unit (checked on the vocabulary), so both have a token end there, and groups and links of a text are those of its units.
A distinct unit is encoded and aligned once for a piece of text and kept in a bounded cache; odd texts are one unit.

Counts are inverted pair bitmaps. Documents of a task are numbered within blocks. A block has, for every linked pair of
ids, the bitmap of the documents that hold it, compressed as sorted 16-bit numbers where it is sparse; pieces of a block
are merged by OR. How often a document holds the pair, less one, stands in bit planes over the set bits of the bitmap.
Document counts are popcounts, link counts popcounts of the planes weighted by their powers of two, and both add up
over blocks. The counts of all pairs go back along the postings, block by block, to score the documents.

Defined cases: a text that is null or empty, or whose bytes the tokens do not give back, has no tokens, zeros and empty
groups; repeated rows count as documents of their own and keep a row each; a null id is an id like others; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.words import column, give_back, pieces, ragged
from lodestone.registry import query
from lodestone.session import cut_lineage, table

PIECE_BYTES = 1 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1_000_000
CACHE_UNITS = 100_000
#: Units that are encoded as one text, and texts that are encoded at once.
JOINED, TEXTS = 256, 32

#: White space other than single blanks and line feeds: such texts are one unit.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n| $"
_aligners: dict[tuple[str, str], "Aligner"] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


@dataclass
class Vocabulary:
    """Bytes of every token of one tokenizer, one after the other."""

    data: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> "Vocabulary":
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.first[ids], self.size[ids])]


@dataclass
class Aligned:
    """Groups and links of a list of units: counts of each, the pairs of all links, and the groups as text."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: pa.Array

    @classmethod
    def joined(cls, parts: list["Aligned"]) -> "Aligned":
        arrays = {n: np.concatenate([getattr(p, n) for p in parts]) for n in ("good", "n_a", "n_b", "n_groups", "n_links", "pairs")}
        return cls(**arrays, groups=pa.concat_arrays([p.groups for p in parts]))


def _flat(encode: Callable[[list[str]], list[list[int]]], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and how many each has; lists of ids live for TEXTS texts at a time."""
    ids, sizes = [np.zeros(0, np.int64)], []
    for i in range(0, len(texts), TEXTS):
        lists = encode(texts[i : i + TEXTS])
        sizes += map(len, lists)
        ids.append(np.fromiter(itertools.chain.from_iterable(lists), np.int64, sum(sizes[-len(lists) :])))
    return np.concatenate(ids), np.array(sizes, np.int64)


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids, right-aligned in rows, and how many there are."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    rows = np.empty((len(ids), width), np.uint8)
    rest = ids.copy()
    for i in range(width - 1, -1, -1):
        rows[:, i] = 48 + rest % 10
        rest //= 10
    return rows, np.maximum(1, np.floor(np.log10(np.maximum(ids, 1))).astype(np.int64) + 1)


class Aligner:
    """Two tokenizers over one text: a byte-level BPE (A) and a piece model that puts a blank before the text (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        tokens_a = [b""] * (entries[-1][1] + 1)
        for token, i in entries:
            tokens_a[i] = bytes(map(byte_of.get, token)) if all(c in byte_of for c in token) else token.encode()
        tokens_b, normal = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            tokens_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            normal += [] if self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i) else [piece]
        self.bytes_a, self.bytes_b = Vocabulary.of(tokens_a), Vocabulary.of(tokens_b)
        #: Whether a piece of B can only have blanks in front, so that it never crosses the front of a unit.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in normal) and len(self.b.encode("\n")) == 2
        self.blank = self.b.encode("\n")[0] if self.cuts else -1
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = Aligned(np.zeros(0, bool), *[np.zeros(0, np.int64) for _ in range(5)], pa.array([], pa.large_string()))
        self.first_pair = np.zeros(0, np.int64)

    @property
    def width(self) -> int:
        return len(self.bytes_b.size)

    def _encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(lambda part: [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)], texts)

    def _encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with the blank that B adds itself, or with a line feed (the blank is taken off again)."""
        def encode(part: list[str]) -> list[list[int]]:
            lists = self.b.encode([t[1:] if t[0] == " " else t for t in part], num_threads=1)
            return [ids if t[0] == " " else ids[1:] for t, ids in zip(part, lists)]

        return _flat(encode, texts)

    def align(self, units: list[str]) -> Aligned:
        """Units begin with a blank or line feed and hold no other one."""
        if not units:
            return Aligned.joined([Aligned(np.zeros(0, bool), *[np.zeros(0, np.int64) for _ in range(5)], pa.array([], pa.large_string()))])
        # Many units are encoded as one text, which is cut again where units end; what does not fit is encoded alone.
        texts = ["".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)]
        texts = [t if t[0] == " " else " " + t for t in texts]
        extra = np.zeros(len(units), np.int64)
        extra[::JOINED] = [u[0] != " " for u in units[::JOINED]]
        size = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        (a, _), (b, _) = self._encode_a(texts), self._encode_b(texts)
        end_a, end_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        edges = np.cumsum(size + extra)
        at_a, at_b = np.searchsorted(end_a, edges), np.searchsorted(end_b, edges)
        fits = len(a) and len(b) and end_a[-1] == len(raw) == end_b[-1] and (end_a[at_a] == edges).all() and (end_b[at_b] == edges).all()
        starts = edges - size
        if fits and extra.any():  # the blank put before a line feed has to be a token of its own
            more = starts[extra > 0]
            fits = (end_a[np.searchsorted(end_a, more)] == more).all() and (end_b[np.searchsorted(end_b, more)] == more).all()
        if not (fits and (self.bytes_a.bytes_of(a) == raw).all() and (self.bytes_b.bytes_of(b) == raw).all()):
            return self.align_alone(units)
        keep_a = np.searchsorted(end_a, starts, side="right"), at_a + 1
        keep_b = np.searchsorted(end_b, starts, side="right"), at_b + 1
        n_a, n_b = keep_a[1] - keep_a[0], keep_b[1] - keep_b[0]
        return self._grouped(a[ragged(keep_a[0], n_a)], n_a, b[ragged(keep_b[0], n_b)], n_b, np.ones(len(units), bool))

    def align_alone(self, texts: list[str]) -> Aligned:
        """Each text by itself; one whose bytes the tokens do not give back has none."""
        (a, n_a), (b, n_b) = self._encode_a(texts), self._encode_b(texts)
        good = np.zeros(len(texts), bool)
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        for i, text in enumerate(texts):
            raw = text.encode()
            good[i] = all(raw == v.bytes_of(ids[k : k + n]).tobytes() for v, ids, k, n in (
                (self.bytes_a, a, at_a[i], n_a[i]), (self.bytes_b, b, at_b[i], n_b[i])))
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        return self._grouped(a, n_a * good, b, n_b * good, good)

    def _grouped(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, good: np.ndarray) -> Aligned:
        """Groups and links of tokens whose bytes are the same on both sides, unit by unit."""
        units = len(good)
        if not len(a):
            zero = np.zeros(units, np.int64)
            return Aligned(good, zero, zero, zero, zero, np.zeros(0, np.int64), pa.array([""] * units, pa.large_string()))
        end_a, end_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        start_a, start_b = end_a - self.bytes_a.size[a], end_b - self.bytes_b.size[b]
        close_a = end_b[np.searchsorted(end_b, end_a)] == end_a
        close_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        low, high = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a)
        links = high - low
        pairs = np.repeat(a, links) * self.width + b[ragged(low, links)]
        unit_a = np.repeat(np.arange(units), n_a)
        # Every token takes its digits and a mark behind them; tokens of a group stand together, those of A first.
        total = int(group_a[-1]) + 1
        ahead_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=total))])
        ahead_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=total))])
        place_a, place_b = np.arange(len(a)) + ahead_b[group_a], np.arange(len(b)) + ahead_a[group_b + 1]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a], mark[place_b] = np.where(close_a, ord("|"), ord(",")), np.where(close_b, ord(";"), ord(","))
        rows, width = _digits(ids)
        begin = np.cumsum(width + 1) - width - 1
        text = np.empty(int(begin[-1] + width[-1] + 1), np.uint8)
        text[begin + width] = mark
        text[ragged(begin, width)] = rows.reshape(-1)[ragged(np.arange(len(ids)) * rows.shape[1] + rows.shape[1] - width, width)]
        # A unit ends behind its last token of B; its closing mark is left out.
        own = n_a + n_b
        last = np.cumsum(own) - 1
        stop = np.where(own > 0, (begin + width)[np.maximum(last, 0)], 0)
        start = np.where(own > 0, begin[np.minimum(last + 1 - own, len(begin) - 1)], 0)
        size = stop - start
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = text[ragged(start, size)]
        groups = pa.LargeStringArray.from_buffers(units, pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
        count = lambda which, weight: np.bincount(which, weights=weight, minlength=units).astype(np.int64)
        return Aligned(good, n_a, n_b, count(unit_a, close_a), count(unit_a, links), pairs, groups)

    def _rows(self, units: list[str]) -> np.ndarray:
        """Places of distinct units in the pool; new ones are aligned first."""
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > CACHE_UNITS:
            self._forget()
            new = units
        if new:
            lone = [u for u in new if u == "\n"]
            rest = [u for u in new if u != "\n"]
            at = len(self.known)
            self.known.update(zip([*rest, *lone], range(at, at + len(new))))
            parts = [self.align([u if u[:1] == "\n" else " " + u for u in rest]), self.align_alone(lone) if lone else self.align([])]
            self.pool = Aligned.joined([self.pool, *parts])
            self.first_pair = np.cumsum(self.pool.n_links) - self.pool.n_links
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def texts(self, texts: pa.Array) -> Aligned:
        """Groups and links of each text of a piece."""
        texts = texts.cast(pa.large_string()).fill_null("")
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(led, _ODD).to_numpy(zero_copy_only=False) | (not self.cuts)
        alone, plain, rest = (np.flatnonzero(x) for x in (filled & odd, filled & ~odd, ~filled))
        zero = np.zeros(len(rest), np.int64)
        parts = [self.align_alone(led.take(pa.array(alone)).to_pylist()) if len(alone) else self.align([]), self._by_units(texts.take(pa.array(plain))),
                 Aligned(np.zeros(len(rest), bool), zero, zero, zero, zero, np.zeros(0, np.int64), pa.array([""] * len(rest), pa.large_string()))]
        whole, order = Aligned.joined(parts), np.argsort(np.concatenate([alone, plain, rest]))
        first = np.cumsum(whole.n_links) - whole.n_links
        return Aligned(*[getattr(whole, n)[order] for n in ("good", "n_a", "n_b", "n_groups", "n_links")],
                       whole.pairs[ragged(first[order], whole.n_links[order])], whole.groups.take(pa.array(order)))

    def _by_units(self, texts: pa.Array) -> Aligned:
        if not len(texts):
            return self.align([])
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        pool = self.pool
        good = np.logical_and.reduceat(pool.good[rows], first)
        rows_of = np.diff(np.append(first, len(rows)))
        sums = [np.add.reduceat(getattr(pool, n)[rows], first) * good for n in ("n_a", "n_b", "n_groups", "n_links")]
        used = rows[np.repeat(good, rows_of)]
        pairs = pool.pairs[ragged(self.first_pair[used], pool.n_links[used])]
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int64()), pool.groups.take(pa.array(rows)))
        groups = pc.if_else(pa.array(good), pc.binary_join(lists, pa.scalar(";", pa.large_string())), "")
        return Aligned(good, *sums, pairs, groups)


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): the groups of each text as `a1,a2|b1;a3|b2,b3`, decimal ids of A and B in order."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([column(batch, "id"), both.texts(column(batch, "text")).groups.cast(pa.string())], names=["id", "groups"])

    return source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, groups string").withColumnRenamed("id", id_col)


def packed_block(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_docs: int) -> dict[str, np.ndarray | pa.Array]:
    """Bitmaps and multiplicity planes of postings sorted by (pair, document): one row per pair.

    ``docs`` holds sorted 16-bit numbers, or, where that is not larger, one bit per document of the block (``bits``).
    ``planes`` holds plane after plane of ceil(n / 8) bytes: bit r of plane j is bit j of the r-th document's links less one.
    """
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    n = np.diff(np.append(begin, len(pair)))
    row = np.repeat(np.arange(len(begin)), n)
    whole = -(-n_docs // 8)
    bits = 2 * n >= whole
    size = np.where(bits, whole, 2 * n)
    first = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    dense, sparse = bits[row], np.flatnonzero(~bits[row])
    # Bits of one byte follow each other, so a sum over their run is their OR.
    _set_bits(data, first[row[dense]] + doc[dense] // 8, doc[dense] % 8)
    rank = np.arange(len(pair)) - begin[row]
    at = first[row[sparse]] + 2 * rank[sparse]
    data[at], data[at + 1] = doc[sparse] & 255, doc[sparse] >> 8
    top = np.maximum.reduceat(times, begin) - 1
    depth = np.zeros(len(begin), np.int64)
    while (top >> depth).any():
        depth += (top >> depth) > 0
    plane = -(-n // 8)
    total = depth * plane
    base = np.cumsum(total) - total
    planes = np.zeros(int(total.sum()), np.uint8)
    for j in range(int(depth.max(initial=0))):
        use = np.flatnonzero((times - 1 >> j) & 1)
        _set_bits(planes, base[row[use]] + j * plane[row[use]] + rank[use] // 8, rank[use] % 8)
    return {"pair": pair[begin], "n": n, "bits": bits, "docs": _binary(data, size), "planes": _binary(planes, total)}


def _set_bits(data: np.ndarray, byte: np.ndarray, bit: np.ndarray) -> None:
    if len(byte):
        begin = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        data[byte[begin]] |= np.bitwise_or.reduceat(np.uint8(1) << bit.astype(np.uint8), begin)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(n: np.ndarray, bits: np.ndarray, docs: pa.Array, planes: pa.Array, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and links of every posting of rows of one block."""
    data, first = _bytes(docs)
    whole = -(-n_docs // 8)
    dense, sparse = np.flatnonzero(bits), np.flatnonzero(~bits)
    at = ragged(first[sparse], 2 * n[sparse]).reshape(-1, 2)
    row, doc = [np.repeat(sparse, n[sparse])], [data[at[:, 0]].astype(np.int64) | data[at[:, 1]].astype(np.int64) << 8]
    for i in range(0, len(dense), 256):
        part = dense[i : i + 256]
        which, number = np.nonzero(np.unpackbits(data[first[part][:, None] + np.arange(whole)], axis=1, bitorder="little"))
        row.append(part[which])
        doc.append(number)
    row, doc = np.concatenate(row), np.concatenate(doc)
    order = np.argsort(row, kind="stable")
    row, doc = row[order], doc[order]
    times = np.ones(len(row), np.int64)
    data, first = _bytes(planes)
    plane = -(-n // 8)
    depth = np.diff(np.append(first, len(data))) // np.maximum(plane, 1)
    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    for j in range(int(depth.max(initial=0))):
        use = np.flatnonzero(depth[row] > j)
        own = row[use]
        times[use] += ((data[first[own] + j * plane[own] + rank[use] // 8] >> (rank[use] % 8).astype(np.uint8)) & 1).astype(np.int64) << j
    return row, doc, times


def _bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if array.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0]


class _Block:
    """Postings and documents of a block while its pieces come in."""

    def __init__(self, key: int, postings: int):
        self.key, self.postings, self.docs, self.keys, self.times, self.rows = key, postings, 0, [], [], []

    @property
    def full(self) -> bool:
        return self.docs >= BLOCK_DOCS or sum(map(len, self.keys)) >= self.postings

    def add(self, ids: pa.Array, found: Aligned, digests: list[str]) -> None:
        doc = self.docs + np.repeat(np.arange(len(ids)), found.n_links)
        keys = np.sort(found.pairs << 16 | doc)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys.append(keys[begin])
        self.times.append(np.diff(np.append(begin, len(keys))).astype(np.int32))
        numbers = pa.array(np.arange(self.docs, self.docs + len(ids)), pa.int32())
        self.rows.append([ids, numbers, *[pa.array(getattr(found, n), pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string())])
        self.docs += len(ids)

    def batches(self, schema: pa.Schema, width: int) -> Iterator[pa.RecordBatch]:
        for arrays in self.rows:
            held = dict(zip(("id", "number", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), arrays))
            yield self._batch(schema, held, len(arrays[0]))
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        self.keys, self.times = [], []
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order].astype(np.int64)
        del order
        rows = packed_block(keys >> 16, keys & 0xFFFF, times, self.docs)
        pair = rows["pair"]
        held = {"a": pa.array(pair // width, pa.int32()), "b": pa.array(pair % width, pa.int32()), "n": pa.array(rows["n"], pa.int32()),
                "bits": pa.array(rows["bits"]), "docs": rows["docs"], "planes": rows["planes"]}
        for i in range(0, len(pair), 20_000):
            part = {k: v.slice(i, 20_000) for k, v in held.items()}
            yield self._batch(schema, part, len(part["a"]))

    def _batch(self, schema: pa.Schema, held: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
        held = {**held, "block": pa.array(np.full(rows, self.key), pa.int64()), "n_docs": pa.array(np.full(rows, self.docs), pa.int32())}
        return pa.RecordBatch.from_arrays([held.get(f.name, pa.nulls(rows, f.type)).cast(f.type) for f in schema], schema=schema)


def postings(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """The written table of blocks: a row per document (number, id, counts) and a row per block and linked pair (bitmap, planes)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, blocks, schema = aligner(path_a, path_b), TaskContext.get().partitionId(), itertools.count(), None
        block = _Block(part << 32 | next(blocks), block_postings)
        for batch in pieces(batches, "text", PIECE_BYTES):
            for at in range(0, batch.num_rows, BLOCK_DOCS // 2):
                slim = batch.slice(at, BLOCK_DOCS // 2)
                ids = column(slim, "id")
                if schema is None:
                    schema = pa.schema([
                        ("block", pa.int64()), ("n_docs", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32()), ("bits", pa.bool_()),
                        ("docs", pa.binary()), ("planes", pa.binary()), ("number", pa.int32()), ("id", ids.type),
                        *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
                if block.docs + slim.num_rows > BLOCK_DOCS or block.full:
                    yield from block.batches(schema, both.width)
                    block = _Block(part << 32 | next(blocks), block_postings)
                found = both.texts(column(slim, "text"))
                digests = [hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(found.groups, found.n_a.tolist())]
                block.add(ids, found, digests)
        if block.docs:
            yield from block.batches(schema, both.width)

    return cut_lineage(source.mapInArrow(
        run, "block bigint, n_docs int, a int, b int, n int, bits boolean, docs binary, planes binary, number int, "
        f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links) of every linked pair: popcounts of its bitmaps, and of its planes by their powers of two."""
    held = F.when(F.col("bits"), F.bitmap_count("docs")).otherwise(F.length("docs") / 2).cast("bigint")
    wide = F.ceil(F.col("n") / 8).cast("int")
    depth = (F.length("planes") / wide).cast("int")
    plane = lambda j: F.bitmap_count(F.expr("substring(planes, 1)").substr(j * wide + 1, wide))
    more = F.aggregate(F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("bigint"),
                       lambda total, j: total + plane(j) * F.pow(F.lit(2), j).cast("bigint"))
    return blocks.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum(held).alias("n_docs"), F.sum(F.col("n") + more).alias("n_links"))


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and the hash of its groups."""
    blocks = postings(docs, path_a, path_b, id_col, text_col, block_postings)
    counts = cut_lineage(blocks.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n_pair")))
    best = counts.groupBy("a").agg(F.max("n_pair").alias("n_most"))
    scores = counts.join(best, "a").select("a", "b", "n_pair", (F.col("n_pair") == F.col("n_most")).alias("top"))
    slim = ("block", "n_docs", "a", "n", "bits", "docs", "planes")
    held = ("number", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    # Pairs grow with the corpus: they are never broadcast.
    scored = blocks.filter("a IS NOT NULL").join(scores.hint("merge"), ["a", "b"]).select(*slim, "n_pair", "top")
    rows = blocks.filter("a IS NULL").select("block", "n_docs", *held).unionByName(scored, allowMissingColumns=True)
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.repartition("block").sortWithinPartitions("block", F.col("a").isNotNull()).mapInArrow(
        _score, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the counts of each pair to the documents of its bitmap; rows come block by block, documents first."""
    current, docs, best, total = None, [], None, None

    def done() -> Iterator[pa.RecordBatch]:
        for part in docs:
            at = column(part, "number").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[column(part, n) for n in ("id", "n_a", "n_b", "n_groups", "n_links")], pa.array(best[at]), pa.array(total[at]), column(part, "groups_sha256")],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    for batch in batches:
        blocks = column(batch, "block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x == y:
                continue
            part, key = batch.slice(x, y - x), int(blocks[x])
            n_docs = column(part, "n_docs")[0].as_py()
            if key != current:
                if current is not None:
                    yield from done()
                current, docs, best, total = key, [], np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
            is_doc = pc.is_valid(column(part, "number"))
            if pc.any(is_doc).as_py():
                docs.append(part.filter(is_doc).select(["number", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]))
            part = part.filter(pc.invert(is_doc))
            if part.num_rows:
                n, bits, times_of, top = (column(part, c).to_numpy(zero_copy_only=False) for c in ("n", "bits", "n_pair", "top"))
                row, doc, times = unpacked(n.astype(np.int64), bits.astype(bool), column(part, "docs"), column(part, "planes"), n_docs)
                np.add.at(total, doc, times * times_of[row].astype(np.int64))
                lead = top[row].astype(bool)
                np.add.at(best, doc[lead], times[lead])
    if current is not None:
        yield from done()
    give_back()


@query("op11_tokenizer_alignment")
def op11(spark, sf_dir):
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
