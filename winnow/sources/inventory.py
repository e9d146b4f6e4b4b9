"""Inventories: one row for each entry of a file tree, or for each row of a table.

Columns: parent, name, full_path, ext, is_dir, is_hidden, size_bytes, size_label, and content where there is one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from winnow.functions import scalars
from winnow.operators.groups import canonical_names
from winnow.sources import shared


@dataclass
class SubTrees(InputPartition):
    paths: list[str]
    deep: bool


class FileInventoryReader(DataSourceReader):
    def __init__(self, root: str, fan_out: int):
        self.root, self.fan_out = root, fan_out

    def partitions(self) -> list[InputPartition]:
        """The root itself, and its sub-trees dealt to at most ``fan_out`` partitions. Nothing below the root is listed here; scan_tree() also splits deeper."""
        if not os.path.isdir(self.root):
            raise ValueError(f"no directory: {self.root}")
        below = sorted(e.path for e in _entries(self.root) if e.is_dir(follow_symlinks=False))
        return [SubTrees([self.root], False), *(SubTrees(below[i :: self.fan_out], True) for i in range(min(self.fan_out, len(below))))]

    def read(self, partition: SubTrees) -> Iterator[tuple]:
        todo = list(partition.paths)
        while todo:
            for row, path in _listed(todo.pop()):
                yield row
                if path is not None and partition.deep:
                    todo.append(path)


def _listed(path: str) -> Iterator[tuple[tuple, str | None]]:
    """((parent, name, is_dir, size_bytes), the entry's path if it is a directory) of the entries of a directory; an entry without attributes is left out."""
    for entry in _entries(path):
        try:
            is_dir = entry.is_dir(follow_symlinks=False)
            size = entry.stat(follow_symlinks=False).st_size
        except OSError:
            continue
        yield (os.path.dirname(entry.path), entry.name, is_dir, size), entry.path if is_dir else None


def _entries(path: str) -> Iterator[os.DirEntry]:
    """The entries of a directory, one at a time; an unreadable one has none."""
    try:
        with os.scandir(path) as found:
            yield from found
    except OSError:
        return


class FileInventory(DataSource):
    """spark.read.format("file_inventory").load(root): hidden entries and directories included, links not followed.

    The root must be mounted on every executor. Option fan_out: how many partitions the sub-trees of the root are dealt to.
    """

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return "parent string, name string, is_dir boolean, size_bytes bigint"

    def reader(self, schema) -> DataSourceReader:
        return FileInventoryReader(self.options["path"], int(self.options.get("fan_out", "64")))


def with_columns(raw: DataFrame) -> DataFrame:
    """Completes (parent, name, is_dir, size_bytes [, content]) to an inventory."""
    size = F.coalesce(F.col("size_bytes").cast("long"), F.lit(0).cast("long"))
    out = raw.withColumn("is_dir", F.coalesce("is_dir", F.lit(False))).withColumn("size_bytes", size)
    out = out.withColumn("full_path", scalars.join_path(F.col("parent"), F.col("name"))).withColumn("ext", scalars.extension(F.col("name")))
    return out.withColumn("is_hidden", scalars.is_hidden(F.col("name"))).withColumn("size_label", scalars.file_size_label(F.col("size_bytes")))


RAW = "parent string, name string, is_dir boolean, size_bytes bigint"


def _expanded(budget: int):
    """Lists the directories of a task and what lies below them, until ``budget`` entries are listed; directories that are then still to be listed come back as rows with todo."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        names = ["parent", "name", "is_dir", "size_bytes", "todo"]
        seen = 0

        def full() -> Iterator[pd.DataFrame]:
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=names)
                rows.clear()

        for part in parts:
            todo = list(part["path"])
            while todo and seen < budget:
                for row, path in _listed(todo.pop()):
                    seen += 1
                    rows.append((*row, None))
                    yield from full()
                    if path is not None:
                        todo.append(path)
            for path in todo:
                rows.append((None, None, None, None, path))
                yield from full()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


LISTED = RAW + ", todo string"


def tree_listing(spark: SparkSession, root: str, tasks: int | None = None, budget: int = 100_000) -> list[str]:
    """Lists what lies below root: the paths of tables (parent, name, is_dir, size_bytes, todo) in the shared folder, one for each round.

    The frontier, the directories still to be listed, is a table. Each round deals it evenly to ``tasks`` tasks (by default four for each core), each of which goes down from its directories for
    ``budget`` entries and puts back what it has not reached, as rows with todo. So a sub-tree that dominates is dealt anew every round, and the driver lists nothing.
    """
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    rounds: list[str] = []
    frontier = spark.createDataFrame([(root,)], "path string")
    while True:
        rounds.append(shared.new_path(spark, "listing"))
        frontier.repartition(tasks).mapInPandas(_expanded(budget), LISTED).write.parquet(rounds[-1])
        frontier = spark.read.schema(LISTED).parquet(rounds[-1]).where("todo IS NOT NULL").select(F.col("todo").alias("path"))
        if frontier.isEmpty():
            return rounds


def scan_tree(spark: SparkSession, root: str, tasks: int | None = None, canonical: bool = True, budget: int = 100_000) -> DataFrame:
    """The inventory of a directory tree, listed once, when this is called. Hidden entries and directories are included, links not followed; the root must be mounted on every executor.

    canonical: names that are canonically equal in Unicode get one spelling; full_path keeps its own.
    """
    if not os.path.isdir(root):
        raise ValueError(f"no directory: {root}")
    listed = spark.read.schema(LISTED).parquet(*tree_listing(spark, root, tasks, budget))
    found = with_columns(listed.where("todo IS NULL").drop("todo"))
    return canonical_names(found) if canonical else found


def from_table(table: DataFrame, *, parent: Column, name: Column, size: Column, content: Column | None = None, is_dir: Column | None = None) -> DataFrame:
    """Any table with a name and a size as an inventory."""
    parts = [parent.alias("parent"), name.alias("name"), (F.lit(False) if is_dir is None else is_dir).alias("is_dir"), size.cast("long").alias("size_bytes")]
    if content is not None:
        parts.append(content.alias("content"))
    return with_columns(table.select(*parts))


def _kept(skip_hidden: bool, media_only: bool) -> Column:
    kept = F.lit(True)
    if skip_hidden:
        kept = kept & ~F.col("is_hidden")
    if media_only:
        kept = kept & (F.col("is_dir") | F.col("ext").isin(*scalars.MEDIA_EXTENSIONS))
    return kept


def scan_filters(inventory: DataFrame, *, skip_hidden: bool = False, media_only: bool = False) -> DataFrame:
    """skip_hidden looks at an entry's own name only; media_only keeps directories."""
    return inventory.where(_kept(skip_hidden, media_only))


def scan_summary(inventory: DataFrame, *, skip_hidden: bool = False, media_only: bool = False) -> DataFrame:
    """One row: total entries, entries left by the filters (directories included), their ratio."""
    out = inventory.agg(F.count("*").alias("total"), F.count_if(_kept(skip_hidden, media_only)).alias("processed"))
    return out.withColumn("ratio", F.col("processed") / F.greatest(F.lit(1), F.col("total")))


def scan_summaries(inventory: DataFrame, filters: dict[str, dict[str, bool]]) -> DataFrame:
    """A row for each named choice of filters: filter, total, processed, ratio, all counted in one pass over the inventory."""
    counts = inventory.agg(F.count("*").alias("total"), *[F.count_if(_kept(**{"skip_hidden": False, "media_only": False} | how)).alias(f"n_{i}") for i, how in enumerate(filters.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("filter"), F.col(f"n_{i}").alias("processed")) for i, name in enumerate(filters)])
    out = counts.select("total", F.explode(rows).alias("row")).select("row.filter", "total", "row.processed")
    return out.withColumn("ratio", F.col("processed") / F.greatest(F.lit(1), F.col("total")))


def observed(inventory: DataFrame, *, skip_hidden: bool = False, media_only: bool = False) -> tuple[DataFrame, Observation]:
    """(the entries left by the filters, the counts of scan_summary()). The counts are taken while the entries pass to whatever is asked of them first, and can be read from then on: summary(observation)."""
    observation = Observation()
    counted = inventory.observe(observation, F.count(F.lit(1)).alias("total"), F.count_if(_kept(skip_hidden, media_only)).alias("processed"))
    return scan_filters(counted, skip_hidden=skip_hidden, media_only=media_only), observation


def summary(observation: Observation) -> dict[str, float]:
    """total, processed and their ratio; waits for the first action on what was observed."""
    counts = observation.get
    return {**counts, "ratio": counts["processed"] / max(1, counts["total"])}
