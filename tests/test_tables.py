import os

import pytest

from lineora.functions import tables
from lineora.operators.dissect import Dissector
from lineora.sources.files import Corpus, read_manifest
from lineora.streaming import incremental


def test_scope_removes_its_tables(spark):
    kept = tables.cut(spark.range(3).toDF("x"), "kept")
    with tables.scope(spark):
        gone = tables.cut(spark.range(3).toDF("x"), "gone")
        path = gone.inputFiles()[0].removeprefix("file://")
        assert gone.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_batches_count_once_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("INSERT INTO t SELECT a FROM s")
    store = str(tmp_path / "store")
    incremental.keep_graph(incremental.sql_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in" / "b.sql").write_text("INSERT INTO u SELECT a FROM t")
    incremental.keep_graph(incremental.sql_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    assert incremental.stored_graph(spark, store).edges.count() == 2
    os.remove(f"{store}/batch-000000001/{incremental.MARK}")
    assert [r["target_node"] for r in incremental.stored_graph(spark, store).edges.collect()] == ["t.a"]


def test_corpus_in_a_store(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.sql").write_text("INSERT INTO t SELECT a FROM s")
    (tmp_path / "m.csv").write_text("file_path,dialect\nq/1.sql,\n")
    assert Corpus(spark).add_directory(f"file://{tmp_path}/q").lineage().count() == 1
    assert read_manifest(f"file://{tmp_path}/m.csv") == [(f"file://{tmp_path}/q/1.sql", None)]
    assert Corpus(spark).add_manifest(f"file://{tmp_path}/m.csv").lineage().count() == 1


def test_component_lookups(spark):
    d = Dissector(spark, "WITH A AS (SELECT 1 AS x) SELECT x FROM a")
    assert [r["component_type"] for r in d.named("a")] == ["CTE"] and len(d.of_type("main_query")) == 1 and len(d.executable()) == 2
