"""Media files: content hash, kind by magic bytes, support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def media_inventory(files: DataFrame, content: str = "content") -> DataFrame:
    """Add content_hash, mime (png, jpeg, webp; null otherwise) and supported."""
    head = F.hex(F.substring(content, 1, 12))
    webp = F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")) & (F.octet_length(content) > 12)
    mime = (
        F.when(F.startswith(head, F.lit("89504E47")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(webp, "image/webp")
    )
    return files.withColumns({"content_hash": F.sha2(content, 256), "mime": mime, "supported": mime.isNotNull()})
