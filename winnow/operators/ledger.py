"""The ledger of removed paths: as any table, and as a kept, bucketed table that grows.

A kept ledger holds each path once, in buckets by path and sorted inside them, so that inventories meet it without shuffling it, however large it has become.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 200


def add(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """A path is in the ledger once; of rows with one path the largest recorded size counts."""
    both = ledger.select("full_path", "size_bytes").unionByName(new.select("full_path", "size_bytes"))
    return both.groupBy("full_path").agg(F.max("size_bytes").alias("size_bytes"))


def recovered(ledger: DataFrame) -> DataFrame:
    """One row: removed paths and their recorded bytes."""
    return ledger.agg(F.count("*").alias("removed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("recovered_bytes"))


def kept(spark: SparkSession, table: str) -> DataFrame:
    """The kept ledger of that name, (full_path, size_bytes)."""
    return spark.table(table)


def keep(new: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds rows to the kept ledger of that name, which is made if there is none: paths that it holds already stay as they are. Returns the ledger.

    buckets: as many as the shuffle partitions of the jobs that will meet it, or more, so that they take over its buckets. A row that is added twice, also after a failure, is held once.
    """
    spark = new.sparkSession
    rows = new.where("full_path IS NOT NULL").groupBy("full_path").agg(F.max("size_bytes").alias("size_bytes"))
    if spark.catalog.tableExists(table):
        rows = rows.join(spark.table(table).select("full_path"), "full_path", "left_anti")
    # the rows come in buckets already, so each bucket gets one file
    rows.repartition(buckets, "full_path").write.format("parquet").bucketBy(buckets, "full_path").sortBy("full_path").mode("append").saveAsTable(table)
    return kept(spark, table)
