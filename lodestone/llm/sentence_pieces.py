"""SentencePiece encoding and decoding as a best path in the max-plus semiring, parallel within giant documents.

A text (a blank in front, blanks as the pieces' word mark) is cut into pieces of the vocabulary so that the sum of piece
scores is greatest; of equal sums, the path with the longer last piece wins at every cut, seen from the end. The
scores follow Zipf's law over the model's own order, -ln(rank + 2) in millionths, so sums are exact integers. Characters
without a piece are spelled in byte pieces.

Documents up to a chunk are encoded in one go. A longer one is split into chunks, which are rows of their own:

1. each chunk yields its transfer matrix: the best sum from cut ``e`` characters behind its start to cut ``f`` characters
   behind its end (a piece may reach over the end, by less than the longest piece);
2. matrices of a block of chunks are multiplied (max-plus is associative), block products are scanned per document, and
   each chunk gets the best sums up to its own entry cuts;
3. with those, each chunk is traced back on its own, from every exit cut to its entry cut;
4. per document, exits are picked from the last chunk to the first.

No piece holds a blank behind another character, so every word start is a cut; words are encoded once per worker and
kept in a bounded cache, and only the ends of a chunk need the matrices' states.

Defined cases: a null or empty text has no pieces; decoding inverts encoding exactly for every text; repeated rows are
encoded alike (chunks are named by a 128-bit hash of id and text); null ids stay null; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.words import column, give_back, pieces, ragged
from lodestone.registry import query
from lodestone.session import cut_lineage, table

CHUNK = 1 << 15
BLOCK = 64
CACHE_UNITS = 250_000
PIECE_BYTES = 2 << 20
NONE = -(1 << 60)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_UNIT = re.compile(r" +[^ ]*|[^ ]+")
_CUT = re.compile(r"(?<=[^ ]) ")
_models: dict[str, "Pieces"] = {}


class Steps:
    """A table of distinct numbers and their values: hashed places, the next free one where a place is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        rest, shift = np.arange(len(keys)), 0
        while len(rest):
            place = (self._place(keys[rest]) + shift) & ((1 << self.bits) - 1)
            free = self.keys[place] < 0
            _, first = np.unique(place, return_index=True)  # of several keys for one place, the first takes it
            takes = np.zeros(len(rest), bool)
            takes[first] = True
            takes &= free
            self.keys[place[takes]], self.values[place[takes]] = keys[rest[takes]], values[rest[takes]]
            rest, shift = rest[~takes], shift + 1
        self.probes = shift

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, real: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for keys that are not there or not ``real``."""
        place = self._place(keys)
        out = np.where((self.keys[place] == keys) & real, self.values[place], -1)
        for shift in range(1, self.probes):
            rest = np.flatnonzero((out < 0) & real & (self.keys[place] >= 0))
            if not len(rest):
                break
            place[rest] = (self._place(keys[rest]) + shift) & ((1 << self.bits) - 1)
            hit = self.keys[place[rest]] == keys[rest]
            out[rest[hit]] = self.values[place[rest[hit]]]
        return out


class Pieces:
    """A vocabulary with scores, and best paths over it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, tuple[int, int]] = {}
        self.spell: list[bytes] = [b""] * size
        self.byte = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.spell[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                rank = min(-model.get_score(i), size)
                text = piece.replace("▁", " ")
                self.ids[text] = (i, -round(1e6 * float(np.log(rank + 2))))
                self.spell[i] = text.encode()
        self.longest = max(map(len, self.ids))
        self.byte_score = -round(2e6 * float(np.log(size)))
        self.cache: dict[str, tuple[int, bytes]] = {}
        # The same vocabulary as a trie, for many units at once: its steps (state, character) stand in one hashed table.
        states: dict[tuple[int, int], int] = {}
        # A character of one byte without a piece is one step as well: its byte piece.
        lone = {chr(b): (self.byte[b], self.byte_score) for b in range(128) if chr(b) not in self.ids}
        self.symbol = {c: i for i, c in enumerate(sorted({*"".join(self.ids), *lone}))}
        self.end, self.worth = [-1], [0]
        for text, (number, worth) in {**self.ids, **lone}.items():
            state = 0
            for c in text:
                step = (state, self.symbol[c])
                if step not in states:
                    states[step] = len(self.end)
                    self.end.append(-1)
                    self.worth.append(0)
                state = states[step]
            self.end[state], self.worth[state] = number, worth
        self.end, self.worth = np.array(self.end, np.int32), np.array(self.worth, np.int64)
        self.steps = Steps(np.array([s * len(self.symbol) + c for s, c in states], np.int64), np.fromiter(states.values(), np.int32, len(states)))
        self.points = np.array([ord(c) for c in self.symbol])

    def _step(self, text: str, j: int, length: int) -> tuple[tuple[int, ...], int] | None:
        """Ids and score of the piece text[j-length:j], bytes for a single character without one."""
        part = text[j - length : j]
        known = self.ids.get(part)
        if known is not None:
            return (known[0],), known[1]
        if length == 1:
            raw = part.encode()
            return tuple(self.byte[b] for b in raw), self.byte_score * len(raw)
        return None

    def forward(self, text: str, seeds: dict[int, int]) -> tuple[list[int], list[int]]:
        """Best sums at every cut and the length of the last piece there (0: a seed), from given sums at some cuts."""
        best, back = [NONE] * (len(text) + 1), [0] * (len(text) + 1)
        for j, value in seeds.items():
            best[j] = value
        ids, longest = self.ids, self.longest
        for j in range(1, len(text) + 1):
            top, length = best[j], 0  # a seed stands for a piece from before the text, longer than any within
            for n in range(min(longest, j), 0, -1):
                before = best[j - n]
                if before == NONE:
                    continue
                known = ids.get(text[j - n : j])
                if known is not None:
                    value = before + known[1]
                elif n == 1:
                    value = before + self.byte_score * len(text[j - 1].encode())
                else:
                    continue
                if value > top:
                    top, length = value, n
            best[j], back[j] = top, length
        return best, back

    def trace(self, text: str, back: list[int], j: int) -> tuple[int, list[int]]:
        """Walk back from cut j to a seed: that cut and the ids on the way."""
        out: list[tuple[int, ...]] = []
        while back[j]:
            out.append(self._step(text, j, back[j])[0])
            j -= back[j]
        return j, [i for ids in reversed(out) for i in ids]

    def unit(self, text: str) -> tuple[int, bytes]:
        """Best sum and ids of a text that starts and ends at sure cuts."""
        ids, longest, best, back = self.ids, self.longest, [0], [0]
        for j in range(1, len(text) + 1):
            top, at = NONE, j - 1
            for i in range(max(0, j - longest), j):  # the longer piece first, so it wins ties
                known = ids.get(text[i:j])
                if known is not None and best[i] + known[1] > top:
                    top, at = best[i] + known[1], i
            if top == NONE or text[j - 1] not in ids:
                value = best[j - 1] + self.byte_score * len(text[j - 1].encode())
                if text[j - 1] not in ids and value > top:
                    top, at = value, j - 1
            best.append(top)
            back.append(at)
        out, j = [], len(text)
        while j:
            out.append(self._step(text, j, j - back[j])[0])
            j = back[j]
        return best[-1], np.array([i for step in reversed(out) for i in step], "<i4").tobytes()

    def _symbols(self, joined: str) -> np.ndarray:
        """Number of each character among those of the vocabulary, -1 for others."""
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, chars), len(self.points) - 1)
        return np.where(self.points[at] == chars, at, -1)

    def many(self, units: list[str]) -> list[tuple[int, bytes]]:
        """``unit`` of many texts: those of one length take their steps together."""
        out: list[tuple[int, bytes] | None] = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            if len(u) <= 40:
                by_length.setdefault(len(u), []).append(i)
        for n, places in by_length.items():
            for a in range(0, len(places), 20_000):
                self._together(units, n, places[a : a + 20_000], out)
        return [self.unit(u) if found is None else found for u, found in zip(units, out)]

    def _together(self, units: list[str], n: int, places: list[int], out: list) -> None:
        m, width = len(places), len(self.symbol)
        chars = self._symbols("".join([units[i] for i in places])).reshape(m, n).T.copy()
        best, back, piece = np.full((n + 1, m), NONE, np.int64), np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        best[0] = 0
        for i in range(n):  # pieces that start earlier come first, so the longer one wins ties
            alive = np.flatnonzero(best[i] > NONE)
            state = np.zeros(len(alive), np.int64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                state = self.steps.find(state * width + chars[j - 1, alive], chars[j - 1, alive] >= 0)
                on = np.flatnonzero(state >= 0)
                if not len(on):
                    break
                alive, state = alive[on], state[on].astype(np.int64)
                whole = np.flatnonzero(self.end[state] >= 0)
                if len(whole):
                    at, own = alive[whole], state[whole]
                    value = best[i][at] + self.worth[own]
                    more = value > best[j][at]
                    at, own = at[more], own[more]
                    best[j][at], back[j][at], piece[j][at] = value[more], j - i, self.end[own]
        # Units with a character that has no piece are left to the plain way.
        sure = np.flatnonzero((best[1:] > NONE).all(axis=0))
        at, steps = np.full(len(sure), n), []
        while (at > 0).any():
            steps.append(np.where(at > 0, piece[at, sure], -1))
            at = at - back[at, sure]
        if not len(sure):
            return
        ids = np.array(steps[::-1], np.int32).T
        ends = np.cumsum((ids >= 0).sum(axis=1)) * 4
        raw = ids[ids >= 0].astype("<i4").tobytes()
        for k, score, a, b in zip(sure.tolist(), best[n, sure].tolist(), [0, *ends.tolist()], ends.tolist()):
            out[places[k]] = (score, raw[a:b])

    def known(self, units: list[str]) -> list[tuple[int, bytes]]:
        cache = self.cache
        new = list(dict.fromkeys(u for u in units if u not in cache))
        # Steps of arrays pay off for many units only; both ways give the same.
        fresh = dict(zip(new, self.many(new) if len(new) >= 2000 else map(self.unit, new)))
        out = [fresh[u] if u in fresh else cache[u] for u in units]
        if len(cache) + len(fresh) > CACHE_UNITS:
            self.cache = cache = {}
        cache.update((u, found) for u, found in fresh.items() if len(u) <= 64)
        return out

    def learn(self, texts: list[str]) -> None:
        """Encode the units of several texts together, ahead of their use."""
        self.known(list(dict.fromkeys(u for t in texts for u in _UNIT.findall(t))))

    def units(self, text: str) -> tuple[int, bytes]:
        """Best sum and ids of a text that starts at a sure cut, by its words."""
        found = self.known(_UNIT.findall(text))
        return sum(s for s, _ in found), b"".join(i for _, i in found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, where each text's ids begin, and its best sum."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        empty = (pc.binary_length(texts).to_numpy(zero_copy_only=False)) == 0
        plain = np.flatnonzero(~odd & ~empty)
        raw: list[bytes] = [b""] * len(texts)
        score = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(odd & ~empty).tolist():
            score[i], raw[i] = self.units(" " + texts[i].as_py())
        if len(plain):
            # A line feed has no piece, so it is a unit's start as a blank is; the unit then has no blank of its own.
            parts = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
            first = np.asarray(parts.offsets) - parts.offsets[0].as_py()
            coded = parts.flatten().dictionary_encode()
            units = [u if u[:1] == "\n" else " " + u for u in coded.dictionary.to_pylist()]
            found = self.known(units)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            opens = first[:-1]
            # The blank in front of the text stands alone when the text starts with a line feed.
            lone = np.array([u[:1] == "\n" for u in units])[code[opens]]
            sums = np.array([s for s, _ in found], np.int64)[code]
            length = np.array([len(i) for _, i in found], np.int64) // 4
            every = np.frombuffer(b"".join(i for _, i in found), "<i4")
            ids = every[ragged((np.cumsum(length) - length)[code], length[code])].tobytes()
            ends = np.concatenate([[0], np.cumsum(length[code])])[first] * 4
            totals = np.concatenate([[0], np.cumsum(sums)])
            blank = self.units(" ")
            for k, i in enumerate(plain.tolist()):
                own = ids[ends[k] : ends[k + 1]]
                score[i] = totals[first[k + 1]] - totals[first[k]] + (blank[0] if lone[k] else 0)
                raw[i] = blank[1] + own if lone[k] else own
        begin = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
        return np.frombuffer(b"".join(raw), "<i4"), begin, score

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        length = np.array([len(s) for s in self.spell], np.int64)
        every = np.frombuffer(b"".join(self.spell), np.uint8)
        raw = every[ragged((np.cumsum(length) - length)[ids], length[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(length[ids])])[begin]
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    # Chunks: ``text`` reaches longest - 1 characters over the chunk's end at ``size`` (less at the document's end).

    def _ends(self, text: str, size: int) -> tuple[int, int] | None:
        """The first sure cut behind all entry cuts and the last one in the chunk, if there are such."""
        reach = self.longest - 1
        found = _CUT.search(text, max(reach, 1), size)
        if not found:
            return None
        last = found.start()
        at = text.rfind(" ", last, size)
        while at > last and text[at - 1] == " ":
            at -= 1
        return found.start(), max(last, at)

    def _exits(self, text: str, size: int, best: list[int], reach: int) -> list[int]:
        """Best sums at exit cuts: the last piece starts within the chunk (or at its end, for exit 0)."""
        return [best[size + f] if size + f <= len(text) else NONE for f in range(reach)]

    def _last_steps(self, text: str, size: int, best: list[int]) -> tuple[list[int], list[int]]:
        """Sums and last piece lengths of exits whose last piece starts before the end of the chunk."""
        sums, back = [], []
        for f in range(self.longest):
            j, top, length = size + f, NONE, 0
            if f == 0:
                sums.append(best[size])
                back.append(0)
                continue
            if j <= len(text):
                for n in range(min(self.longest, j), f, -1):
                    step = self._step(text, j, n)
                    if step is not None and best[j - n] != NONE and best[j - n] + step[1] > top:
                        top, length = best[j - n] + step[1], n
            sums.append(top)
            back.append(length)
        return sums, back

    def transfer(self, text: str, size: int) -> np.ndarray:
        """The matrix [entry cut, exit cut] of best sums."""
        width = self.longest
        ends = self._ends(text, size)
        out = np.full((width, width), NONE, np.int64)
        if ends is None:
            for e in range(min(width, size + 1)):
                best, _ = self.forward(text[:size], {e: 0})
                out[e] = self._last_steps(text, size, best)[0]
            for e in range(size + 1, width):
                out[e, e - size] = 0  # the piece from before reaches over this whole chunk
            return out
        first, last = ends
        middle = self.units(text[first:last])[0]
        best, _ = self.forward(text[last:size], {0: 0})
        tail = np.array(self._last_steps(text[last:], size - last, best)[0], np.int64)
        for e in range(width):
            head = self.forward(text[e:first], {0: 0})[0][-1]
            out[e] = np.where(tail == NONE, NONE, head + middle + tail)
        return out

    def paths(self, text: str, size: int, entry: list[int]) -> tuple[bytes, list[tuple[int, bytes]]]:
        """The ids all paths begin with, and for every exit cut its entry cut (-1: none) and further ids, given the best
        sums at the entry cuts."""
        ends = self._ends(text, size)
        seeds = {e: int(v) for e, v in enumerate(entry) if v > NONE // 2}
        out: list[tuple[int, bytes]] = []
        raw = lambda ids: np.array(ids, "<i4").tobytes()
        if ends is None:
            inside = {e: v for e, v in seeds.items() if e <= size}
            best, back = self.forward(text[:size], inside)
            sums, steps = self._last_steps(text, size, best)
            for f in range(self.longest):
                over = seeds.get(size + f, NONE) if f else NONE
                if over != NONE and over >= sums[f]:
                    out.append((size + f, b""))
                elif sums[f] == NONE:
                    out.append((-1, b""))
                else:
                    e, ids = self.trace(text, back, size + f - steps[f])
                    out.append((e, raw(ids + (list(self._step(text, size + f, steps[f])[0]) if steps[f] else []))))
            return b"", out
        first, last = ends
        best, back = self.forward(text[:first], seeds)
        e, ids = self.trace(text, back, first)
        head = raw(ids) + self.units(text[first:last])[1]
        best, back = self.forward(text[last:size], {0: 0})
        sums, steps = self._last_steps(text[last:], size - last, best)
        for f in range(self.longest):
            if sums[f] == NONE:
                out.append((-1, b""))
                continue
            _, ids = self.trace(text[last:], back, size - last + f - steps[f])
            out.append((e, raw(ids + (list(self._step(text[last:], size - last + f, steps[f])[0]) if steps[f] else []))))
        return head, out


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    out = (a[:, :, None] + b[None]).max(axis=1)
    return np.where(out < NONE // 2, NONE, out)


def _id_lists(ids: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))


def encode_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, text, pieces (array of ids), score (best sum in millionths)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text string, pieces array<int>, score bigint"
    return _encoded(docs, path, id_col, text_col, chunk, block, lambda batches: batches, schema).withColumnRenamed("id", id_col)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, chunk: int, block: int, finish: Callable, schema: str) -> DataFrame:
    """Encoded documents as ``finish`` makes them of batches of id, text, pieces and score, in the task that encodes."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.length("text") >= chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            ids, begin, score = model(path).encode(column(batch, "text").cast(pa.large_string()).fill_null(""))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), column(batch, "text"), _id_lists(ids, begin), pa.array(score)], names=["id", "text", "pieces", "score"])
        # The units of one task help the next one little, and a worker outlives its tasks.
        model(path).cache = {}
        give_back()

    out = source.filter(~F.coalesce(long, F.lit(False))).mapInArrow(lambda batches: finish(whole(batches)), schema)
    keyed = source.filter(long).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", F.lit(1), "id")})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model(path).longest - 1
        for batch in pieces(batches, "text"):
            for k1, k2, text in zip(*[column(batch, n).to_pylist() for n in ("k1", "k2", "text")]):
                text = " " + text
                starts = range(0, len(text), chunk)
                rows = [(k1, k2, k, min(chunk, len(text) - a), text[a : a + chunk + reach]) for k, a in enumerate(starts)]
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "k", "size", "part"), r)) for r in rows[i : i + 64]], schema=chunk_type)

    chunk_type = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("k", pa.int64()), ("size", pa.int64()), ("part", pa.string())])
    # The steps between scans are heavy for their bytes, so partitions are not merged by size.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Chunks are dealt out anew, so that one document's work is spread; a repeated row has its chunks once.
    chunks = cut_lineage(keyed.select("k1", "k2", "text").mapInArrow(cut, "k1 bigint, k2 bigint, k bigint, size bigint, part string")
                         .repartition(parts, "k1", "k2", "k").dropDuplicates(["k1", "k2", "k"]))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 32):
                batch = whole_batch.slice(i, 32)
                model(path).learn(column(batch, "part").to_pylist())
                cells = [model(path).transfer(t, n).reshape(-1).tolist() for t, n in zip(column(batch, "part").to_pylist(), column(batch, "size").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[column(batch, n) for n in ("k1", "k2", "k")], pa.array(cells, pa.list_(pa.int64()))], names=["k1", "k2", "k", "m"])

    stepped = cut_lineage(chunks.mapInArrow(matrices, "k1 bigint, k2 bigint, k bigint, m array<bigint>").withColumn("b", F.floor(F.col("k") / block)))

    def square(cells) -> np.ndarray:
        flat = np.asarray(cells, np.int64)
        return flat.reshape(int(len(flat) ** 0.5), -1)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        found = None
        for m in pdf.sort_values("k")["m"]:
            found = square(m) if found is None else times(found, square(m))
        return pdf.iloc[:1][["k1", "k2", "b"]].assign(m=[found.reshape(-1).tolist()])

    def entries(key: str):
        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key)
            vector, out = None, []
            for m, start in zip(pdf["m"], pdf["entry"] if "entry" in pdf else [None] * len(pdf)):
                m = square(m)
                if vector is None:
                    vector = np.where(np.arange(len(m)) == 0, 0, NONE) if start is None else np.asarray(start, np.int64)
                out.append(vector.tolist())
                vector = times(vector[None], m)[0]
            return pdf[["k1", "k2", key]].assign(entry=out)

        return scan

    blocks = stepped.repartition(parts, "k1", "k2", "b").groupBy("k1", "k2", "b").applyInPandas(product, "k1 bigint, k2 bigint, b bigint, m array<bigint>")
    opening = blocks.repartition(parts, "k1", "k2").groupBy("k1", "k2").applyInPandas(entries("b"), "k1 bigint, k2 bigint, b bigint, entry array<bigint>")
    seeded = stepped.join(opening, ["k1", "k2", "b"]).repartition(parts, "k1", "k2", "b").groupBy("k1", "k2", "b").applyInPandas(entries("k"), "k1 bigint, k2 bigint, k bigint, entry array<bigint>")

    path_type = pa.list_(pa.struct([("e", pa.int32()), ("ids", pa.binary())]))

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 32):
                batch = whole_batch.slice(i, 32)
                model(path).learn(column(batch, "part").to_pylist())
                parts = zip(*[column(batch, n).to_pylist() for n in ("part", "size", "entry")])
                found = [model(path).paths(t, n, entry) for t, n, entry in parts]
                ways = [[{"e": e, "ids": ids} for e, ids in own] for _, own in found]
                yield pa.RecordBatch.from_arrays(
                    [*[column(batch, n) for n in ("k1", "k2", "k")], pa.array([h for h, _ in found], pa.binary()), pa.array(ways, path_type)],
                    names=["k1", "k2", "k", "head", "paths"])

    traced = chunks.join(seeded, ["k1", "k2", "k"]).select("k1", "k2", "k", "part", "size", "entry").mapInArrow(
        traces, "k1 bigint, k2 bigint, k bigint, head binary, paths array<struct<e:int,ids:binary>>")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ascending=False)
        exit_cut, out = 0, []
        for head, paths in zip(pdf["head"], pdf["paths"]):
            exit_cut, ids = paths[exit_cut]["e"], paths[exit_cut]["ids"]
            out.append(head + ids)
        whole_ids = np.frombuffer(b"".join(reversed(out)), "<i4")
        return pdf.iloc[:1][["k1", "k2"]].assign(pieces=[whole_ids])

    picked = traced.repartition(parts, "k1", "k2").groupBy("k1", "k2").applyInPandas(pick, "k1 bigint, k2 bigint, pieces array<int>")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            m = model(path)
            worth = np.zeros(len(m.spell), np.int64)
            for i, s in m.ids.values():
                worth[i] = s
            worth[m.byte] = m.byte_score
            found = column(batch, "pieces")
            n = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(worth[found.flatten().to_numpy()])])
            edge = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in ("id", "text", "pieces")], pa.array(total[edge[1:]] - total[edge[:-1]])], names=["id", "text", "pieces", "score"])

    giants = keyed.join(picked, ["k1", "k2"]).select("id", "text", "pieces").mapInArrow(lambda batches: finish(sums(batches)), schema)
    return out.unionByName(giants)


def decode_pieces(encoded: DataFrame, path: str, pieces_col: str = "pieces") -> DataFrame:
    """Add ``decoded``, the text that the piece ids spell (null ids: null), to every row."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids = column(part, pieces_col)
                n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                found = model(path).decode(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)]))
                texts = pa.array(found, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pc.if_else(pc.is_null(ids), None, texts)], names=[*part.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(decode, f"{schema}, decoded string")


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, score, pieces_crc32 (little-endian 32-bit ids), round_trip (decoding gives the text back)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(i, 1000)
                ids = column(batch, "pieces").flatten().to_numpy().astype("<i4")
                n = pc.list_value_length(column(batch, "pieces")).to_numpy(zero_copy_only=False)
                begin = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                texts = column(batch, "text").cast(pa.large_binary()).fill_null(b"")
                same = pc.equal(texts, pa.array(model(path).decode(ids, begin), pa.large_binary()))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "id"), pa.array(n, pa.int64()), column(batch, "score"), pa.array(crc, pa.int64()), same],
                    names=["doc_id", "n_pieces", "score", "pieces_crc32", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces bigint, score bigint, pieces_crc32 bigint, round_trip boolean"
    return _encoded(docs, path, "doc_id", "text", CHUNK, BLOCK, digest, schema)


@query("op8_sentence_pieces")
def op8(spark, sf_dir):
    import public_tokenizers

    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
