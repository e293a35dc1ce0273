"""Vector expressions and the offline hashing encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import retrieval_tokens

HASH_DIMS = 64
ENCODED_ROWS = 1024


def valid_vector(vector: Column, dims: int) -> Column:
    """Right length, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Double accumulation, clamped to [-1, 1]."""
    ratio = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))


def text_rotation(base: Column, up: Column, right: Column) -> Column:
    """Angle of a direction in a view plane: atan2(base·up, base·right) over x, y, z structs."""

    def product(a: Column, b: Column) -> Column:
        return sum((a[axis] * b[axis] for axis in ("y", "z")), a["x"] * b["x"])

    return F.atan2(product(base, up), product(base, right))


def token_slot(token: Column, dims: int = HASH_DIMS) -> Column:
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dims).cast("int")


def _slot(token: str, dims: int) -> int:
    """``token_slot`` of a string."""
    return int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % dims


def hashing_slots(df: DataFrame, key: str, text: Column, dims: int = HASH_DIMS) -> DataFrame:
    """Default encoder, sparse: token counts by hash slot, and one constant slot so that none is zero."""
    tokens = df.select(key, F.explode(retrieval_tokens(text)).alias("_t"))
    counted = tokens.groupBy(key, token_slot(F.col("_t"), dims - 1).alias("slot")).agg(F.count("_t").alias("n"))
    constant = df.select(key, F.lit(dims - 1).alias("slot"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(constant)


def hashing_vectors(df: DataFrame, key: str, text: Column, dims: int = HASH_DIMS) -> DataFrame:
    """The hashing encoder as dense float arrays, one per key; a key that repeats fails.

    Slots are counted where a text lies, each distinct token of a batch being hashed once; only vectors travel.
    """
    rows = df.select(key, retrieval_tokens(text).alias("_t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED_ROWS):
                part = batch.slice(at, ENCODED_ROWS)
                coded = part.column(1).flatten().dictionary_encode()
                slots = np.array([_slot(t, dims - 1) for t in coded.dictionary.to_pylist()], np.int64)
                sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                places = np.repeat(np.arange(len(sizes)) * dims, sizes) + slots[coded.indices.to_numpy(zero_copy_only=False)]
                counts = np.bincount(places, minlength=len(sizes) * dims).astype("float32")
                counts[dims - 1 :: dims] = 1
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype="int32") * dims), pa.array(counts))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[key, "embedding"])

    encoded = rows.mapInArrow(encode, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>")
    single = F.when(F.col("_n") == 1, F.col("embedding")).otherwise(F.raise_error(F.lit("a key of the hashing encoder repeats")))
    return encoded.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("embedding").alias("embedding")).select(key, single.alias("embedding"))
