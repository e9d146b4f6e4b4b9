"""Sinks: the listing of an inventory, and plan and ledger tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.scalars import kind_label


def listing(inventory: DataFrame) -> DataFrame:
    """(path, name, size, type) of every entry, directories included."""
    return inventory.select(F.col("parent").alias("path"), "name", F.col("size_label").alias("size"), kind_label(F.col("is_dir")).alias("type"))


def write_listing(inventory: DataFrame, path: str) -> None:
    """Text files with semicolons and no header."""
    listing(inventory).write.option("sep", ";").option("header", "false").csv(path)


def ledger_rows(removals: DataFrame, reason: str | None = None) -> DataFrame:
    """(full_path, size_bytes, reason, recorded_at) of removals; reason defaults to a column of that name, then to null."""
    given = F.lit(reason) if reason is not None else F.col("reason") if "reason" in removals.columns else F.lit(None)
    return removals.select("full_path", "size_bytes", given.cast("string").alias("reason"), F.current_timestamp().alias("recorded_at"))


def write_ledger_batch(removals: DataFrame, path: str, batch: str, reason: str | None = None) -> None:
    """Writes removals as the batch of that id of the ledger at path. Writing a batch again replaces it, so a job that is run twice leaves one copy, and other batches stay as they are.

    An id consists of letters, digits, dots, dashes and underscores.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"no name for a batch: {batch!r}")
    rows = ledger_rows(removals, reason)
    if rows.isEmpty():
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        return
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(full_path, size_bytes, reason, recorded_at, batch) of all batches."""
    return spark.read.schema("full_path string, size_bytes long, reason string, recorded_at timestamp, batch string").parquet(path)
