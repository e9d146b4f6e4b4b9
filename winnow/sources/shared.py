"""Intermediate tables in the folder that the driver and all executors share.

The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset, only a local master may use a folder of this process.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-winnow-")
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/winnow/{label}-{uuid.uuid4().hex}"


def saved(rows: DataFrame, label: str) -> DataFrame:
    """Writes the rows once and reads them back, so that everything built on them sees the same rows and no lost executor brings back the work before."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes the files of a table made by saved() that nothing reads any more."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/winnow/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def for_a_while(rows: DataFrame, label: str) -> Iterator[DataFrame]:
    """A saved table that is deleted at the end, also after an error."""
    table = saved(rows, label)
    try:
        yield table
    finally:
        forget(table)
