"""A training-corpus pipeline over documents: each stage's rows are written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontaminate import drop_contaminated
from lodestone.llm.near_duplicates import drop_near_duplicates
from lodestone.llm.quality import crc_remainder, keep_quality, train
from lodestone.llm.sentence_pieces import piece_digest
from lodestone.llm.substrings import strip_repeats
from lodestone.session import cut_lineage

#: No SQL can say the trained classifier's decisions; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_remainder("doc_id", 5) != 0)
    return keep_quality(docs, train(docs, labels, "doc_id", "text", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand in more than one place."""
    return strip_repeats(docs, length_col="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document: count, best sum, checksum of the ids, and whether decoding gives the text back."""
    import public_tokenizers

    return piece_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that all filtering stages keep.

    Defined cases, stage by stage: a null text is an empty one; texts without words are kept by near duplicates (each row),
    have no repeated passages, no contamination and no pieces; rows that are repeated whole are one document to near
    duplicates, which keep one of them; null ids take part like others and never lead a group; further columns travel
    unchanged up to the last stage, whatever their names; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
