"""Token ids of whole texts in files of shuffled byte planes.

File format (all integers little-endian):

* blocks, one after the other: a block holds ``BLOCK_IDS`` ids (the last one fewer) as unsigned 32-bit integers,
  transposed into four byte planes; each plane is a zstandard frame of its own;
* the chunk index, an Arrow stream in a zstandard frame: ``offset`` and ``n_ids`` of each block, sizes of its planes;
* the document index, likewise: ``id`` and ``n_tokens`` of each document in file order;
* a tail of two 64-bit sizes (chunk index, document index) and the mark ``LTPLANE1``.

Documents are range-partitioned by id, so files follow each other in ascending id order and one task writes one file.
A repeated task writes a file of another name; only files named in the manifest (a written table) are read.

Encoding looks up units, a blank or line feed with the word behind it, in a bounded cache of each worker. A byte-level
BPE of this kind never joins across the front of such a unit, so a text's ids are those of its units. Texts with longer
runs of white space, other white space, or marks of special tokens are encoded whole.

Defined cases: a null or empty text has only the end id; a null id sorts first; rows of one id follow each other in
text order and each keeps its own entry; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.words import column, pieces, ragged
from lodestone.registry import query
from lodestone.session import cut_lineage, scratch_path, table

BLOCK_IDS = 1 << 16
END_ID = 2
MARK = b"LTPLANE1"
CACHE_UNITS = 1_000_000
PIECE_BYTES = 8 << 20
LEVEL = 3

#: Runs of white space that a split at blanks would cut, and white space or marks that only the whole text settles.
_RUNS = ("  ", "\n ", " \n", "\n\n")
_WHOLE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids (as little-endian bytes) of texts, by units kept in a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units; a unit that starts with a line feed keeps it, a blank stands before all others."""
        new = [u for u in units if u not in self.cache]
        if len(self.cache) + len(new) > CACHE_UNITS:
            self.cache, new = {}, units
        self.cache.update(zip(new, self._whole([u if u[:1] == "\n" else " " + u for u in new])))
        return [self.cache[u] for u in units]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a piece: distinct units are looked up once, then put in place by number."""
        whole = pc.match_substring_regex(texts, _WHOLE)
        for run in _RUNS:
            whole = pc.or_(whole, pc.match_substring(texts, run))
        out: list[bytes] = [b""] * len(texts)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, ids in zip(odd.tolist(), self._whole(texts.take(pa.array(odd)).to_pylist()) if len(odd) else []):
            out[i] = ids
        plain = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        if not len(plain):
            return out
        parts = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
        first = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        opening = self._whole(flat.take(pa.array(first)).to_pylist())
        entries = self._known(coded.dictionary.to_pylist()) + opening
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code[first] = len(entries) - len(opening) + np.arange(len(first))
        length = np.array([len(e) for e in entries], np.int64) // 4
        every = np.frombuffer(b"".join(entries), "<u4")
        ids = every[ragged((np.cumsum(length) - length)[code], length[code])].tobytes()
        ends = np.cumsum(length[code])[np.append(first[1:], len(code)) - 1] * 4
        for i, a, b in zip(plain.tolist(), [0, *ends.tolist()], ends.tolist()):
            out[i] = ids[a:b]
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, named by URI or as a plain path."""
    return fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:", "", path))


def _framed(arrow: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, arrow.schema) as writer:
        writer.write_table(arrow)
    return zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue())


def _unframed(frame: bytes) -> pa.Table:
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(frame)) as raw:
        return pa.ipc.open_stream(raw.read()).read_all()


class PlaneWriter:
    """Appends documents to one file, block by block."""

    def __init__(self, sink, id_type: pa.DataType):
        self.sink, self.id_type = sink, id_type
        self.pending = bytearray()
        self.blocks: list[tuple[int, int, list[int]]] = []
        self.ids: list = []
        self.counts: list[int] = []
        self.at = 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress

    def _block(self, raw: bytes) -> None:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T
        frames = [self.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
        self.blocks.append((self.at, len(raw) // 4, [len(f) for f in frames]))
        for frame in frames:
            self.sink.write(frame)
            self.at += len(frame)

    def add(self, key, ids: bytes) -> None:
        self.ids.append(key)
        self.counts.append(len(ids) // 4)
        self.pending += ids
        size, at = BLOCK_IDS * 4, 0
        while len(self.pending) - at >= size:
            self._block(bytes(self.pending[at : at + size]))
            at += size
        del self.pending[:at]

    def close(self) -> None:
        if self.pending:
            self._block(bytes(self.pending))
        chunk = _framed(pa.table({
            "offset": pa.array([b[0] for b in self.blocks], pa.int64()), "n_ids": pa.array([b[1] for b in self.blocks], pa.int64()),
            "planes": pa.array([b[2] for b in self.blocks], pa.list_(pa.int64()))}))
        docs = _framed(pa.table({"id": pa.array(self.ids, self.id_type), "n_tokens": pa.array(self.counts, pa.int64())}))
        for part in (chunk, docs, np.array([len(chunk), len(docs)], "<i8").tobytes(), MARK):
            self.sink.write(part)


class PlaneReader:
    """Reads a file of shuffled planes: its indexes at once, its blocks one at a time or from any id on."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 24)
        tail = source.read(24)
        if tail[16:] != MARK:
            raise ValueError("not a file of token planes")
        n_chunk, n_docs = np.frombuffer(tail[:16], "<i8").tolist()
        source.seek(size - 24 - n_chunk - n_docs)
        self.chunks, self.docs = _unframed(source.read(n_chunk)), _unframed(source.read(n_docs))
        self.expand = zstandard.ZstdDecompressor().decompress

    def block(self, i: int) -> np.ndarray:
        row = self.chunks.slice(i, 1).to_pylist()[0]
        self.source.seek(row["offset"])
        out = np.empty((row["n_ids"], 4), np.uint8)
        for plane, n in enumerate(row["planes"]):
            out[:, plane] = np.frombuffer(self.expand(self.source.read(n)), np.uint8)
        return out.reshape(-1).view("<u4")

    def blocks(self) -> Iterator[np.ndarray]:
        for i in range(self.chunks.num_rows):
            yield self.block(i)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1 of the file; only the blocks that hold them are read."""
        first, last = start // BLOCK_IDS, -(-stop // BLOCK_IDS)
        parts = [self.block(i) for i in range(first, last)]
        whole = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return whole[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
) -> DataFrame:
    """Write one file per range of ids; returns the manifest (part, path, n_ids, n_docs), one row per file."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        encode, writer, sink = encoder(tokenizer).encode, None, None
        for batch in pieces(batches, "text", PIECE_BYTES):
            if writer is None:
                sink = store.open_output_stream(f"{base}/{name}")
                writer = PlaneWriter(sink, column(batch, "id").type)
            texts = column(batch, "text").cast(pa.large_string()).fill_null("")
            for key, ids in zip(column(batch, "id").to_pylist(), encode(texts)):
                writer.add(key, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": [part], "path": [f"{folder.rstrip('/')}/{name}"], "n_ids": [sum(writer.counts)], "n_docs": [len(writer.counts)]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    ranged = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    return cut_lineage(ranged.mapInArrow(write, "part int, path string, n_ids bigint, n_docs bigint"))


def read_tokens(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per document from the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has one row per file and is placed in order on the driver; ids stay in the tasks, a block at a time.
    """
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((row.path, start))
        start += row.n_ids
    if not files:
        return spark.createDataFrame([], f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(column(batch, "path").to_pylist(), column(batch, "base").to_pylist()):
                store, name = filesystem(path)
                with store.open_input_file(name) as source:
                    reader = PlaneReader(source)
                    counts = reader.docs["n_tokens"].to_numpy()
                    stops = np.cumsum(counts)
                    crc, doc, at = np.zeros(len(counts), np.int64), 0, 0
                    for ids in reader.blocks():
                        raw = memoryview(ids.tobytes())
                        high = at + len(ids)
                        while doc < len(counts):
                            low = max(at, int(stops[doc] - counts[doc]))
                            stop = min(high, int(stops[doc]))
                            crc[doc] = zlib.crc32(raw[(low - at) * 4 : (stop - at) * 4], int(crc[doc]))
                            if stops[doc] > high:
                                break
                            doc += 1
                        at = high
                    out = pa.table({"id": reader.docs["id"], "start": base + stops - counts, "n_tokens": counts, "ids_crc32": crc})
                    yield from out.to_batches(max_chunksize=10_000)

    listed = spark.createDataFrame(files, "path string, base bigint").repartition(len(files), "base")
    return listed.mapInArrow(read, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


@query("op2_token_planes")
def op2(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, scratch_path(spark, "planes"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, manifest, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")
