"""Words of Arrow text columns as numpy arrays: one pass over the bytes of a piece, no Python step per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_every = np.arange(256)
#: Bytes of words that white space separates: all but 0x20 and 0x09-0x0D.
PLAIN = (_every != 0x20) & ~((_every >= 0x09) & (_every <= 0x0D))
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and everything beyond ASCII.
ALNUM = (
    ((_every >= 0x30) & (_every <= 0x39)) | ((_every >= 0x41) & (_every <= 0x5A)) | ((_every >= 0x61) & (_every <= 0x7A)) | (_every >= 0x80)
)
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.where((_every >= 0x41) & (_every <= 0x5A), _every + 32, _every).astype(np.uint8)

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose low and high bits all depend on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least n of them."""
    size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1 << 16
    for known in (size, size * 2, size * 4):
        if (known, which) in _powers:
            return _powers[known, which]
    step = _STEP[which]
    inverse = np.uint64(pow(int(step), -1, 1 << 64))
    both = []
    for base in (step, inverse):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        both.append(np.multiply.accumulate(row))
    if len(_powers) > 8:
        _powers.clear()
    _powers[size, which] = (both[0], both[1])
    return _powers[size, which]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0, own: bool = False) -> np.ndarray:
    """64-bit hash of values[start:end] for every span, from one prefix sum; ``own`` values may be overwritten."""
    up, down = powers(len(values) + 1, which)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(np.multiply(values, up[: len(values)], out=values if own else None), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a piece: byte spans in ``data``, the row they belong to, and where each row's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """Hash of each word, from slices of the bytes: a hash does not depend on where its word stands."""
        out, at = np.empty(len(self.start), np.uint64), 0
        while at < len(out):
            low = int(self.start[at])
            stop = max(at + 1, int(np.searchsorted(self.end, low + PIECE_BYTES, side="right")))
            raw = _BYTE[which][self.data[low : int(self.end[stop - 1])]]
            out[at:stop] = span_hashes(raw, self.start[at:stop] - low, self.end[at:stop] - low, which, own=True)
            at = stop
        return out

    def shingles(self, n: int, which: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) and hashes of all runs of n words that lie in one row."""
        count = len(self.start)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        row = self.row
        at = np.flatnonzero(row[: count - n + 1] == row[n - 1 :])
        return at, span_hashes(self.hashes(which) if hashes is None else hashes, at, at + n, which)


def split(column: pa.Array, table: np.ndarray = PLAIN, lower: bool = False) -> Words:
    """Split a string column into words; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if buffers[1] else np.zeros(1, np.int64)
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(buffers[2], np.uint8)[low:high] if buffers[2] and high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    begin, stop = offsets[:-1], offsets[1:]
    some = stop > begin
    opens[begin[some]] = inside[1:-1][begin[some]]
    closes[stop[some] - 1] = inside[1:-1][stop[some] - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        total = np.cumsum(np.asarray(sizes.fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def give_back() -> None:
    """Return what the task no longer uses to the system: a worker outlives its tasks, and free memory would stay in it."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + length[i] - 1 of all i, one after the other."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(total)


def covered(first: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of first[-1] words lie in some span [start, stop) of word numbers."""
    steps = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, stop, -1)
    return np.cumsum(steps[:-1]) > 0
