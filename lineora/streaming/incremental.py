"""A lineage graph kept up to date from a stream of SQL files.

Files of SQL are read as a stream; each batch's statements are parsed on the driver and its graph is merged into the
stored one, in which earlier batches come first. A batch is written to a folder of its own, and counts once a marker file
stands there; a batch that is run again takes its marker away first and replaces its own rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineora.operators.graph import Graph, merge, read_tables, write_tables
from lineora.sources.files import Corpus

#: Stands in the folder of a batch that is whole.
MARK = "_DONE"


def sql_stream(spark: SparkSession, folder: str, glob: str = "*.sql", max_files: int = 100) -> DataFrame:
    """(file_path, sql) of the files that arrive in a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("sql"))


def keep_graph(stream: DataFrame, store: str, checkpoint: str, dialect: str = "spark") -> StreamingQuery:
    """Start the query that adds each batch's graph below store; once() semantics with availableNow."""

    def add(batch: DataFrame, number: int) -> None:
        corpus = Corpus(batch.sparkSession, dialect)
        for r in batch.orderBy("file_path").collect():  # at most max_files files: statements are parsed on the driver
            corpus.add_text(r["file_path"], r["sql"])
        folder = f"{store}/batch-{number:09d}"
        path, fs = _folder(batch.sparkSession, folder)
        mark = path(f"{folder}/{MARK}")
        fs.delete(mark, False)
        write_tables(corpus.graph(), folder)
        fs.create(mark, True).close()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(name).getFileSystem(spark._jsc.hadoopConfiguration())


def stored_graph(spark: SparkSession, store: str) -> Graph:
    """The graph of all batches that were written whole."""
    path, fs = _folder(spark, store)
    found = [x.getPath().toString() for x in fs.listStatus(path(store)) if x.getPath().getName().startswith("batch-")]
    return merge(read_tables(spark, n) for n in sorted(found) if fs.exists(path(f"{n}/{MARK}")))
