"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineora-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the application's own folder, which is removed when the application ends."""
    root = f"{shared_dir(spark)}/lineora/{spark.sparkContext.applicationId}"
    if root not in _own:
        _own.add(root)
        atexit.register(_removed_at_exit, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _removed_at_exit(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        remove(spark, root)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end. What was not written or collected by then can't be read."""
    _scopes.append(made := [])
    try:
        yield
    finally:
        _scopes.pop()
        for path in made:
            remove(spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
