"""Duplicate groups.

Quick groups share name and size; deep groups share the SHA-256 of their content as well. Groups come as one row each, without their
members, so a very frequent name costs a partial aggregation and no large row; ``members_of`` gives the members. An entry without a name is in no
group.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.scalars import content_digest
from winnow.operators.digest import with_file_digest
from winnow.sources import shared

FILTER_BITS = 1 << 26  # 8 MB in words of 64 bits, at most a million rows to broadcast
QUICK = ("name", "size_bytes")
DEEP = ("name", "size_bytes", "sha256")


@F.pandas_udf(T.StringType())
def _decomposed(name: pd.Series) -> pd.Series:
    return name.map(lambda n: None if n is None else n if n.isascii() else unicodedata.normalize("NFD", n))


def canonical_names(inventory: DataFrame) -> DataFrame:
    """Gives names that are canonically equal in Unicode one spelling, the decomposed one (NFD), as column name; paths stay as they are.

    That spelling is the key to group and join by: it follows from the name alone, so no names meet each other, and a very frequent one costs nothing.
    """
    return inventory.withColumn("name", _decomposed("name"))


def quick_groups(inventory: DataFrame) -> DataFrame:
    """(name, size_bytes, copies, first_path) of the files that share both, two or more."""
    files = inventory.where(~F.col("is_dir") & F.col("name").isNotNull())
    return files.groupBy(*QUICK).agg(F.count("*").alias("copies"), F.min("full_path").alias("first_path")).where("copies > 1")


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of (name, size_bytes) keys as a table (word, set): a key sets up to three bits of one 64-bit word, and words without any are left out. At most bits / 64 rows, whatever the number of keys; a
    filter that fills up lets more other keys pass, and still all of its own."""
    return keys.select(_word(bits).alias("word"), _mask().alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("set"))


def maybe_in(rows: DataFrame, table: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose (name, size_bytes) may be in the filter, none that is in it left out; nothing is shuffled, as the filter goes to every task."""
    words = table.select(F.col("word").alias("filter_word"), F.col("set").alias("filter_set"))
    out = rows.join(F.broadcast(words), _word(bits) == F.col("filter_word")).where(F.col("filter_set").bitwiseAND(_mask()) == _mask())
    return out.select(*[F.col(f"`{c}`") for c in rows.columns])


def _word(bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), "name", "size_bytes"), F.lit(bits // 64))


def _mask() -> Column:
    h = F.xxhash64(F.lit(1), "name", "size_bytes")
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def with_digest(inventory: DataFrame) -> DataFrame:
    """The files of quick groups with their sha256, without their content, as a saved table; unreadable content stays null.

    Only candidates are digested, and only once, whatever reads the table. Rows with a content column pass a Bloom filter of the colliding keys in place, so contents are never shuffled; the few
    others that pass by chance are left out afterwards, by their digest rows. The paths of files meet the exact keys first, before any file is opened.
    """
    files = inventory.where(~F.col("is_dir"))
    total = files.count()
    with shared.for_a_while(quick_groups(inventory).select(*QUICK, F.col("copies").alias("n")), "quick") as keys:
        if "content" not in inventory.columns:
            return shared.saved(with_file_digest(_of(files, keys, total)), "digested")
        rest = [F.col(f"`{c}`") for c in inventory.columns if c not in ("content", "sha256")]
        digested = maybe_in(files, key_filter(keys)).select(*rest, content_digest(F.col("content")).alias("sha256"))
        return shared.saved(_of(digested, keys, total), "digested")


def _of(rows: DataFrame, groups: DataFrame, total: int, keys: tuple[str, ...] = QUICK) -> DataFrame:
    return met(rows, groups, total, keys).where("group IS NOT NULL").select(*[F.col(f"`{c}`") for c in rows.columns])


def met(rows: DataFrame, groups: DataFrame, total: int, keys: tuple[str, ...] = QUICK) -> DataFrame:
    """rows with the struct ``group`` of the one row of groups (the keys, n, ..) that has their key, else null.

    Groups with more than a 2,000th of all ``total`` members, so fewer than 2,000 of them, are broadcast; their rows are not dealt by group.
    """
    what = F.struct(*[c for c in groups.columns if c not in keys])
    rest = list(keys[1:])
    large = groups.where(F.col("n") * 2000 > total).select(*keys, what.alias("large"))
    other = groups.where(F.col("n") * 2000 <= total).select(F.col(keys[0]).alias("spread"), *rest, what.alias("other"))
    out = rows.join(F.broadcast(large), list(keys), "left")
    out = out.withColumn("spread", F.when(F.col("large").isNotNull(), F.col("full_path")).otherwise(F.col(keys[0])))
    return out.join(other, ["spread", *rest], "left").withColumn("group", F.coalesce("large", "other")).drop("spread", "large", "other")


def deep_groups(inventory: DataFrame) -> DataFrame:
    """(name, size_bytes, sha256, copies, first_path); files without a digest are in no group."""
    if "content" not in inventory.columns:
        return digest_groups(with_digest(inventory))
    # files that pass the filter by chance share their key with no other, so they are in no group
    readable = inventory.where(~F.col("is_dir") & F.col("content").isNotNull())
    candidates = maybe_in(readable, key_filter(quick_groups(inventory)))
    return digest_groups(candidates.select("full_path", *QUICK, content_digest(F.col("content")).alias("sha256")))


def digest_groups(digested: DataFrame) -> DataFrame:
    """The deep groups of files with their sha256."""
    # null digests are not counted; a condition on the digest would be moved in front of the filter, and digest every row
    grouped = digested.groupBy(*DEEP).agg(F.count("sha256").alias("copies"), F.min("full_path").alias("first_path"))
    return grouped.where("copies > 1")


def members_of(inventory: DataFrame, groups: DataFrame) -> DataFrame:
    """The files of the groups; deep groups take the digested inventory."""
    keys = tuple(k for k in DEEP if k in groups.columns)
    files = inventory.where(~F.col("is_dir"))
    return _of(files, groups.select(*keys, F.col("copies").alias("n")), files.count(), keys)


def with_files(groups: DataFrame, members: DataFrame, most: int = 10_000) -> DataFrame:
    """groups with page, pages and files: the sorted paths of their members. A group of up to ``most`` members has one row; the members of a larger one are dealt to pages of about ``most`` by a hash of their
    paths, a row for each page, so no row grows with its group and none of its members is left out."""
    keys = tuple(k for k in DEEP if k in groups.columns)
    paged = groups.select(*keys, F.col("copies").alias("n"), F.ceil(F.col("copies") / most).alias("pages"))
    rows = met(members.select("full_path", *keys), paged, members.count(), keys).where("group IS NOT NULL")
    page = F.pmod(F.xxhash64("full_path"), F.col("group.pages")).alias("page")
    lists = rows.groupBy(*keys, page).agg(F.sort_array(F.collect_list("full_path")).alias("files"), F.max("group.pages").alias("pages"))
    return groups.join(lists, list(keys))


def totals(groups: DataFrame) -> DataFrame:
    """One row: number of groups, of members, and the bytes beyond one copy of each."""
    saving = F.sum(F.col("size_bytes") * (F.col("copies") - 1))
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("members"), F.coalesce(saving, F.lit(0)).alias("potential_savings"))


def active(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Members that are not in the removed set (full_path)."""
    return members.join(removed.select("full_path").distinct(), "full_path", "left_anti")


def with_remaining(groups: DataFrame, members: DataFrame, removed: DataFrame) -> DataFrame:
    """groups with remaining (members not removed) and locked (one or none left)."""
    keys = [k for k in DEEP if k in groups.columns]
    left = active(members, removed).groupBy(*keys).agg(F.count("*").alias("remaining"))
    out = groups.join(left, keys, "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    return out.withColumn("locked", F.col("remaining") <= 1)


def any_removable(groups_with_remaining: DataFrame) -> DataFrame:
    """One row: is there a group with more than one copy left?"""
    return groups_with_remaining.agg(F.coalesce(F.bool_or(F.col("remaining") > 1), F.lit(False)).alias("removable"))


def ranked(groups: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """groups with rank, by name, size (of one file) or copies (those remaining, where known); ties by name, size, digest, first path.

    A global rank needs one order of all groups. They are dealt to ranges and sorted inside them once, and written with their places; ranks follow from the places and the sizes of the ranges
    before, read from these same rows. So no task sees all groups, and no second dealing can draw other borders. shared.forget() deletes the table behind the result.
    """
    column = {"name": "name", "size": "size_bytes", "copies": "remaining" if "remaining" in groups.columns else "copies"}[by]
    lead = F.col(column).desc() if descending else F.col(column).asc()
    order = [lead, *[F.col(c).asc() for c in (*DEEP, "first_path") if c in groups.columns and c != column]]
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # the id is the number of the partition, in the order of ranges, and from its 33rd bit down the place inside it
    dealt = groups.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rank_id", F.monotonically_increasing_id())
    table = shared.saved(dealt, "ranges")
    part = F.shiftright("rank_id", 33)
    sizes = table.groupBy(part.alias("rank_part")).agg(F.count("*").alias("size"))
    before = sizes.select("rank_part", F.coalesce(F.sum("size").over(Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = table.withColumn("rank_part", part).join(F.broadcast(before), "rank_part")  # one row for each range
    return out.withColumn("rank", F.col("before") + F.col("rank_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("rank_part", "rank_id", "before")
