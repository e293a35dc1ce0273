"""The shared folder of a session, and documents that a stream sends again."""

import pytest

from lodestone import session
from lodestone.streaming.indexing import index_batch, stream_index


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_a_changed_document_replaces_its_chunks(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "doc_id long, text string"
    for batch, rows in enumerate([[(1, "old words here"), (2, "stays")], [(1, "new words")], [(3, "third"), (1, "newest"), (4, "")]]):
        folder = str(tmp_path / "in" / str(batch))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        docs = spark.readStream.schema(schema).parquet(folder)
        index_batch(spark.createDataFrame(rows, schema), batch, path)
        assert docs.isStreaming
    last = spark.read.parquet(f"{path}/docs").groupBy("doc_id").max("batch").count()
    assert last == 4
    folder = str(tmp_path / "late")
    spark.createDataFrame([(2, "changed")], schema).coalesce(1).write.parquet(folder)
    other = str(tmp_path / "other")
    out = stream_index(spark.readStream.schema(schema).parquet(folder), other)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(2, "changed")}
    kept = spark.read.parquet(f"{path}/chunks").join(
        spark.read.parquet(f"{path}/docs").groupBy("doc_id").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch"), ["doc_id", "batch"], "left_semi")
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, "newest"), (2, "stays"), (3, "third")}
