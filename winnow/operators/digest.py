"""Digests and byte comparison of files, by path, on the executors. Tables use sha2 and = on their content column instead.

Files are read in chunks of ``CHUNK`` bytes, so memory stays the same for any file. A large file is compared by ranges of ``RANGE`` bytes, rows of their own that are dealt over all tasks. Most files
that differ do so early: first ranges are judged before any other is read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.sources import shared

CHUNK = 64 * 1024
RANGE = 64 << 20


def _chunks(f, length: int | None) -> Iterator[bytes]:
    """The next ``length`` bytes of a file, or all that follow."""
    left = length
    while left is None or left > 0:
        data = f.read(CHUNK if left is None else min(CHUNK, left))
        if not data:
            return
        left = None if left is None else left - len(data)
        yield data


def same_bytes(one: str, two: str, offset: int = 0, length: int | None = None) -> bool:
    """Both readable, equal in size and in all bytes (of the range)."""
    try:
        if os.stat(one).st_size != os.stat(two).st_size:
            return False
        with open(one, "rb") as a, open(two, "rb") as b:
            a.seek(offset)
            b.seek(offset)
            left = length
            while left is None or left > 0:
                x, y = (f.read(CHUNK if left is None else min(CHUNK, left)) for f in (a, b))
                if x != y:
                    return False
                if not x:
                    return True
                left = None if left is None else left - len(x)
            return True
    except OSError:
        return False


def range_digest(path: str, offset: int, length: int | None) -> tuple[int | None, str | None, int]:
    """(size of the file, SHA-256 of a range, bytes read); nulls where the file cannot be read."""
    read, digest = 0, hashlib.sha256()
    try:
        if not os.path.isfile(path):
            return None, None, 0
        with open(path, "rb") as f:
            f.seek(offset)
            for data in _chunks(f, length):
                digest.update(data)
                read += len(data)
            return os.fstat(f.fileno()).st_size, digest.hexdigest(), read
    except OSError:
        return None, None, read


def with_file_digest(inventory: DataFrame, path_col: str = "full_path", range_bytes: int = RANGE) -> DataFrame:
    """Adds sha256, null for files that cannot be read.

    Where sizes are known, a file beyond ``range_bytes`` is digested in ranges that are dealt over all tasks; its sha256 is then that of its size and its ranges' digests. Files of one size have the same kind of
    digest, so equal ones still mean equal bytes. Such a file that no longer has the size it was listed with has none.
    """
    base = inventory.drop("sha256")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(sha256=[range_digest(p, 0, None)[1] for p in part[path_col]])

    def whole(files: DataFrame) -> DataFrame:
        return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())]))

    if "size_bytes" not in base.columns:
        return whole(base)
    large = base.where(F.col("size_bytes") > range_bytes)
    step = F.lit(range_bytes).cast("long")
    ranges = large.select(F.col(path_col).alias("path"), F.col("size_bytes").alias("listed")).distinct()
    ranges = ranges.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("listed") - 1, step)).alias("offset"), step.alias("length"))
    keys = _keyed(ranges).select(F.col("path").alias(path_col), F.col("actual").alias("digest_size"), F.col("key").alias("digest_key"))
    met = large.join(keys, path_col, "left")
    digest = F.when(F.col("digest_size") == F.col("size_bytes"), F.sha2(F.concat_ws(",", F.col("digest_size").cast("string"), "digest_key"), 256))
    return whole(base.where(F.coalesce(F.col("size_bytes"), F.lit(0)) <= range_bytes)).unionByName(met.select(*[F.col(f"`{c}`") for c in base.columns], F.when(F.col("digest_key").isNotNull(), digest).alias("sha256")))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Range rows over all tasks, those of one file apart."""
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "path", "offset")


def _pair_sizes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the size that both files have, null where they differ in it or have none."""

    def size(path: str | None) -> int | None:
        try:
            return os.stat(path).st_size if path is not None else None
        except OSError:
            return None

    for part in parts:
        both = [(size(a), size(b)) for a, b in zip(part["path"], part["reference"], strict=True)]
        yield part.assign(size=pd.array([a if a == b else None for a, b in both], "Int64"))


def _judged(ranges: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["path", "reference", "offset"]].assign(same=[same_bytes(*row) for row in zip(part["path"], part["reference"], part["offset"], part["length"], strict=True)])

    return _dealt(ranges).mapInPandas(run, "path string, reference string, offset long, same boolean")


def pair_ranges(sized: DataFrame, first: bool, range_bytes: int = RANGE) -> DataFrame:
    """(path, reference, offset, length) of the first range of each sized pair, or of its further ranges."""
    length = F.lit(range_bytes).cast("long").alias("length")
    if first:
        return sized.where("size IS NOT NULL").select("path", "reference", F.lit(0).cast("long").alias("offset"), length)
    return sized.where(F.col("size") > range_bytes).select("path", "reference", F.explode(F.sequence(F.lit(range_bytes).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("offset"), length)


def with_file_verdict(pairs: DataFrame, path_col: str = "full_path", reference_col: str = "reference_path", range_bytes: int = RANGE) -> DataFrame:
    """Adds identical: are the two files the same, byte for byte? False where one cannot be read."""
    spark = pairs.sparkSession
    named = pairs.select(F.col(path_col).alias("path"), F.col(reference_col).alias("reference")).distinct()
    with shared.for_a_while(named.mapInPandas(_pair_sizes, "path string, reference string, size long"), "sizes") as sized:
        with shared.for_a_while(_judged(pair_ranges(sized, True, range_bytes)), "first_ranges") as begun:
            alike = sized.join(begun.where("same").select("path", "reference"), ["path", "reference"])
            further = _judged(pair_ranges(alike, False, range_bytes))
            every = begun.unionByName(further).groupBy("path", "reference").agg(F.bool_and("same").alias("same"))
            verdicts = shared.saved(every.where("same").select(F.col("path").alias(path_col), F.col("reference").alias(reference_col), F.lit(True).alias("same")), "verdicts")
    out = pairs.join(verdicts, [path_col, reference_col], "left")
    return out.select(*[F.col(f"`{c}`") for c in pairs.columns if c != "identical"], F.coalesce("same", F.lit(False)).alias("identical"))


def _keyed(ranges: DataFrame) -> DataFrame:
    """(path, actual, key, bytes_read): of each path the size found and a digest of the digests of its ranges, null if one cannot be read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [range_digest(*row) for row in zip(part["path"], part["offset"], part["length"], strict=True)]
            yield part[["path", "offset"]].assign(actual=pd.array([f[0] for f in found], "Int64"), digest=[f[1] for f in found], bytes_read=[f[2] for f in found])

    read = _dealt(ranges).mapInPandas(run, "path string, offset long, actual long, digest string, bytes_read long")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("offset", "digest"))), lambda x: x["digest"])
    key = F.when(F.count("digest") == F.count("*"), F.sha2(F.concat_ws(",", in_order), 256))
    return read.groupBy("path").agg(F.max("actual").alias("actual"), key.alias("key"), F.sum("bytes_read").alias("bytes_read"))


def with_reference_verdict(rows: DataFrame, meet, first: int = CHUNK, range_bytes: int = RANGE) -> DataFrame:
    """rows (full_path, reference_path, ..) with identical (is the file its reference, byte for byte?) and bytes_read, as a saved table. The references are among the rows, once each.

    Groups are refined in rounds: by size and first chunk, then, of the files still like their reference, by the rest in ranges. A file is read once in all, a reference too, however many files
    it is compared with. A reference is identical if it can be read. meet(rows, keys) gives rows the struct ``group`` of the keys row of their group; keys holds the rows of references.
    """
    zero = F.lit(0).cast("long")
    refers = F.col("full_path") == F.col("reference_path")

    def rounds(live: DataFrame, ranges: DataFrame) -> DataFrame:
        keyed = live.join(_keyed(ranges).withColumnRenamed("path", "full_path"), "full_path", "left")
        return keyed

    def like(keyed: DataFrame) -> DataFrame:
        heads = keyed.where(refers).drop("full_path", "reference_path", "bytes_read")
        same = F.coalesce((F.col("key") == F.col("group.key")) & (F.col("actual") == F.col("group.actual")), F.lit(False))
        return meet(keyed, heads).withColumn("like", same).drop("group")

    names = rows.columns
    opening = rows.select(F.col("full_path").alias("path"), zero.alias("offset"), F.lit(first).cast("long").alias("length"))
    with shared.for_a_while(rounds(rows, opening), "round_1") as one, shared.for_a_while(like(one), "like_1") as judged:
        # files beyond the first chunk go on, with the references that have company
        going = judged.where(F.col("like") & (F.col("actual") > first))
        company = going.where(~refers).select("reference_path").distinct()
        going = going.join(company, "reference_path", "left_semi").select(*names, "actual")
        offsets = F.explode(F.sequence(F.lit(first).cast("long"), F.col("actual") - 1, F.lit(range_bytes).cast("long"))).alias("offset")
        ranges = going.select(F.col("full_path").alias("path"), offsets, F.lit(range_bytes).cast("long").alias("length"))
        with shared.for_a_while(rounds(going.drop("actual"), ranges), "round_2") as two:
            rest = like(two).select("full_path", F.col("like").alias("like_too"), F.col("bytes_read").alias("more"))
            out = judged.join(rest, "full_path", "left")
            identical = F.col("like") & F.coalesce("like_too", F.lit(True))
            read = F.coalesce("bytes_read", zero) + F.coalesce("more", zero)
            return shared.saved(out.select(*names, identical.alias("identical"), read.alias("bytes_read")), "verdicts")
