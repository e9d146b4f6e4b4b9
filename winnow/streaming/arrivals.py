"""Duplicate groups and ledgers over arriving inventory rows, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from winnow.operators.groups import QUICK
from winnow.sources.listing import write_ledger_batch


def quick_groups_stream(inventory: DataFrame) -> DataFrame:
    """Quick groups so far, for update or complete mode. The state is a count for each (name, size)."""
    files = inventory.where(~F.col("is_dir") & F.col("name").isNotNull())
    return files.groupBy(*QUICK).agg(F.count("*").alias("copies"), F.min("full_path").alias("first_path")).where("copies > 1")


def write_ledger(removals: DataFrame, path: str, checkpoint: str, name: str = "stream", reason: str | None = None) -> StreamingQuery:
    """Writes arriving removals (full_path, size_bytes) to the ledger at path, a batch of the ledger for each batch of the stream.

    A batch that is run again after a failure has the same id and replaces what it left; name tells the batches of different streams apart.
    """

    def write(rows: DataFrame, batch: int) -> None:
        write_ledger_batch(rows, path, f"{name}-{batch}", reason)

    return removals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
