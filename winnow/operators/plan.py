"""Cleanup plans: tables that say which files to keep, remove or skip. Nothing is deleted.

Every plan leaves at least one copy in every group. The reference of a group is its first remaining member by full_path.

Groups are quick ones (name, size_bytes) unless ``deep`` is set: then members that share their sha256 as well are a group, each set of equal files keeps a copy of its own, and members need the column
sha256 (files without a digest are in no group). Give the members of the groups in question, groups.members_of().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.scalars import content_digest
from winnow.operators.digest import with_file_verdict, with_reference_verdict
from winnow.operators.groups import QUICK, active, digest_groups, met


def _by_digest(members: DataFrame) -> DataFrame:
    """Members whose deep groups are quick groups: the digest is part of the name."""
    return members.where("sha256 IS NOT NULL").withColumn("name", F.concat("name", F.lit("\n"), "sha256"))


def _as_before(plan: DataFrame) -> DataFrame:
    return plan.withColumn("name", F.expr("left(name, length(name) - 65)"))


def batch_plan(members: DataFrame, removed: DataFrame | None = None, deep: bool = False) -> DataFrame:
    """(full_path, name, size_bytes, reference_path, action) for groups with two or more members left.

    The first member is kept; every other one is compared with that one only, and removed if equal, else skipped. Contents in a column are compared by their
    SHA-256 (or by a column sha256), so that no content is shuffled; files in rounds, each read once. Members without a name are in no group.
    """
    if deep:
        return _as_before(batch_plan(_by_digest(members), removed))
    left = members.where("name IS NOT NULL")
    left = left if removed is None else active(left, removed)
    total = left.count()
    if not {"content", "sha256"} & set(members.columns):
        judged = with_reference_verdict(_with_reference(left, total), lambda rows, heads: met(rows, heads, total))
        action = F.when(F.col("full_path") == F.col("reference_path"), "keep").when(F.col("identical"), "remove").otherwise("skip")
        return judged.select("full_path", "name", "size_bytes", "reference_path", action.alias("action"))
    sha256 = F.col("sha256") if "sha256" in members.columns else content_digest(F.col("content"))
    left = left.select("full_path", *QUICK, sha256.alias("sha256"))
    groups = left.groupBy(*QUICK).agg(F.count("*").alias("n"), F.min(F.struct("full_path", "sha256")).alias("first")).where("n > 1")
    rows = met(left, groups, total).where("group IS NOT NULL")
    first = F.col("group.first")
    same = F.coalesce(F.col("sha256") == first["sha256"], F.lit(False))
    action = F.when(F.col("full_path") == first["full_path"], "keep").when(same, "remove").otherwise("skip")
    return rows.select("full_path", "name", "size_bytes", first["full_path"].alias("reference_path"), action.alias("action"))


def batch_outcome(plan: DataFrame) -> DataFrame:
    """One row: removed, skipped, recovered_bytes and the outcome code nothing, only_skipped or removed."""
    gone = F.col("action") == "remove"
    out = plan.agg(F.count_if(gone).alias("removed"), F.count_if(F.col("action") == "skip").alias("skipped"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("recovered_bytes"))
    return out.withColumn("outcome", F.when(F.col("removed") > 0, "removed").when(F.col("skipped") > 0, "only_skipped").otherwise("nothing"))


def savings(members: DataFrame) -> DataFrame:
    """(name, size_bytes, copies, potential_savings, verified_savings, deep_savings) of each quick group of digested members.

    potential_savings takes all members for copies; verified_savings is what batch_plan() frees, which compares with the reference only; deep_savings is what repeated runs on deep groups would free.
    """
    freed = F.count_if(F.col("action") == "remove")
    size = F.col("size_bytes")
    quick = batch_plan(members).groupBy(*QUICK).agg(F.count("*").alias("copies"), freed.alias("freed"))
    deep = digest_groups(members).groupBy(*QUICK).agg(F.sum(size * (F.col("copies") - 1)).alias("deep_savings"))
    out = quick.join(deep, list(QUICK), "left")
    return out.select(*QUICK, "copies", (size * (F.col("copies") - 1)).alias("potential_savings"), (size * F.col("freed")).alias("verified_savings"), F.coalesce("deep_savings", F.lit(0)).alias("deep_savings"))


def removals(plan: DataFrame) -> DataFrame:
    """The ledger rows of a batch or request plan."""
    flag = "action = 'remove'" if "action" in plan.columns else "outcome = 'removed'"
    return plan.where(flag).select("full_path", "size_bytes")


def survivors(inventory: DataFrame, gone: DataFrame) -> DataFrame:
    """The inventory without the removed paths."""
    return inventory.join(gone.select("full_path").distinct(), "full_path", "left_anti")


def lost_groups(members: DataFrame, gone: DataFrame, deep: bool = False) -> DataFrame:
    """Groups of which nothing is left; a sound plan has none."""
    if deep:
        return _as_before(lost_groups(_by_digest(members), gone))
    left = active(members, gone).select(*QUICK).distinct()
    return members.select(*QUICK).distinct().join(left, list(QUICK), "left_anti")


def request_plan(members: DataFrame, requests: DataFrame, removed: DataFrame | None = None, deep: bool = False) -> DataFrame:
    """Outcome of single removals, at most one request in a group: (full_path, name, size_bytes, reference_path, outcome).

    The reference is the first other member that is left. Members are compared by their sha256; without that column they are files, and each pair is compared byte by byte. requests: (full_path).
    """
    if deep:
        return _as_before(request_plan(_by_digest(members), requests, removed))
    by_digest = "sha256" in members.columns
    marked = members.select("full_path", *QUICK, F.col("sha256") if by_digest else F.lit(None).cast("string").alias("sha256")).where("name IS NOT NULL")
    gone = (removed if removed is not None else members.limit(0)).select("full_path").distinct().withColumn("gone", F.lit(True))
    marked = marked.join(gone, "full_path", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    asked = requests.select("full_path").distinct().join(marked, "full_path", "left")
    # the first two members that are left: one of them is the first other one
    place = F.row_number().over(Window.partitionBy(*QUICK).orderBy("full_path"))
    heads = marked.where("NOT gone").withColumn("place", place).where("place <= 2").groupBy(*QUICK)
    heads = heads.agg(*[F.max(F.when(F.col("place") == i, F.struct("full_path", "sha256"))).alias(f"head{i}") for i in (1, 2)])
    ref = F.when(F.col("head1.full_path") == F.col("full_path"), F.col("head2")).otherwise(F.col("head1"))
    rows = asked.join(heads, list(QUICK), "left").withColumn("ref", ref)
    same = F.coalesce(F.col("sha256") == F.col("ref.sha256"), F.lit(False))
    if not by_digest:
        pairs = rows.where("NOT gone AND ref IS NOT NULL").select("full_path", F.col("ref.full_path").alias("reference_path"))
        rows = rows.join(with_file_verdict(pairs).select("full_path", "identical"), "full_path", "left")
        same = F.coalesce("identical", F.lit(False))
    outcome = (
        F.when(F.col("name").isNull(), "not_found")
        .when(F.col("gone"), "already_removed")
        .when(F.col("ref").isNull(), "refused_last_copy")
        .when(~same, "refused_differs")
        .otherwise("removed")
    )
    return rows.select("full_path", "name", "size_bytes", F.col("ref.full_path").alias("reference_path"), outcome.alias("outcome"))


def _with_reference(left: DataFrame, total: int) -> DataFrame:
    """(full_path, name, size_bytes, n, reference_path) of the members of groups of two or more that are left; the reference is a group's first path."""
    groups = left.groupBy(*QUICK).agg(F.count("*").alias("n"), F.min("full_path").alias("reference_path")).where("n > 1")
    rows = met(left.select("full_path", *QUICK), groups, total).where("group IS NOT NULL")
    return rows.select("full_path", *QUICK, "group.n", "group.reference_path")


def _verified(members: DataFrame, requests: DataFrame, removed: DataFrame | None) -> DataFrame:
    """The files of the groups asked for, with a sha256 that is the same for all that equal the group's first file left, byte for byte, and null for the others.

    Only those files can ever go, so no other comparison decides a request.
    """
    files = members.where("name IS NOT NULL AND size_bytes IS NOT NULL").select("full_path", *QUICK)
    asked = requests.select("full_path").distinct().withColumn("asked", F.lit(True))
    groups = files.join(asked, "full_path", "left").groupBy(*QUICK).agg(F.count("*").alias("n"), F.count("asked").alias("asked")).where("asked > 0")
    files = met(files, groups, files.count()).where("group IS NOT NULL").drop("group")
    left = files if removed is None else active(files, removed)
    total = left.count()
    judged = with_reference_verdict(_with_reference(left, total), lambda rows, heads: met(rows, heads, total))
    same = judged.where("identical").select("full_path", F.lit("same").alias("sha256"))
    return files.join(same, "full_path", "left")


def request_plan_ordered(members: DataFrame, requests: DataFrame, removed: DataFrame | None = None, deep: bool = False) -> DataFrame:
    """Outcome of any number of requests (full_path, seq), decided in the order of seq: (seq, full_path, name, size_bytes, outcome).

    The reference of a request is the first other member that is left when its turn comes. No group is gathered: only members
    equal to the first one left ever go, so a group's reference digest stays the same. The leading copies are those before the first member of
    another digest. While two of them are left, each of them finds an equal reference, as every later copy always does. So all copies go when they are
    first asked for, except the leading one that is asked for last if all leading ones are. Requests of equal seq follow the order of their paths.
    Members without sha256 are files; those of the groups asked for are verified first, byte for byte.
    """
    if deep:
        return _as_before(request_plan_ordered(_by_digest(members), requests, removed))
    members = members if "sha256" in members.columns else _verified(members, requests, removed)
    total = members.count()
    marked = members.select("full_path", *QUICK, "sha256").where("name IS NOT NULL AND size_bytes IS NOT NULL")
    marked = marked.groupBy("full_path", *QUICK).agg(F.min("sha256").alias("sha256"))
    gone = (removed if removed is not None else members.limit(0)).select("full_path").distinct().withColumn("gone", F.lit(True))
    marked = marked.join(gone, "full_path", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    asked = requests.where("seq IS NOT NULL").groupBy("full_path", "seq").agg(F.count("*").alias("times"))
    marked = marked.join(asked.groupBy("full_path").agg(F.min("seq").alias("first_seq")), "full_path", "left")

    # the first paths of each digest; the two smallest of a group are its reference and its first differing member
    left = marked.where("NOT gone")
    firsts = left.groupBy(*QUICK, "sha256").agg(F.min("full_path").alias("path"), F.count("*").alias("n"))
    order = Window.partitionBy(*QUICK).orderBy("path")
    heads = firsts.withColumn("place", F.row_number().over(order)).where("place <= 2").groupBy(*QUICK)
    heads = heads.agg(F.max(F.when(F.col("place") == 1, F.struct("sha256"))).alias("head"), F.max(F.when(F.col("place") == 2, F.col("path"))).alias("differing"))
    heads = heads.join(firsts.groupBy(*QUICK).agg(F.sum("n").alias("n")), list(QUICK))
    leading = F.coalesce((F.col("sha256") == F.col("group.head.sha256")) & (F.col("group.differing").isNull() | (F.col("full_path") < F.col("group.differing"))), F.lit(False))
    counted = met(left, heads, total).withColumn("leading", leading).groupBy(*QUICK)
    last = F.max(F.when(F.col("leading"), F.struct("first_seq", "full_path")))
    counted = counted.agg(F.max("group.n").alias("n"), F.max("group.head").alias("head"), F.max("group.differing").alias("differing"), last.alias("last"), F.count_if(F.col("leading") & F.col("first_seq").isNull()).alias("unasked"))

    rows = met(marked.where("first_seq IS NOT NULL").join(asked, "full_path"), counted, total)
    group = F.col("group")
    stays = (group["unasked"] == 0) & (group["last"]["full_path"] == F.col("full_path"))
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    outcome = (
        F.when(F.col("gone"), "already_removed")
        .when(group["n"] == 1, "refused_last_copy")
        .when(~F.coalesce(F.col("sha256") == group["head"]["sha256"], F.lit(False)), "refused_differs")
        .when(stays & group["differing"].isNull(), "refused_last_copy")
        .when(stays, "refused_differs")
        .when((F.col("seq") == F.col("first_seq")) & (F.col("again") == 1), "removed")
        .otherwise("already_removed")
    )
    decided = rows.select("seq", "full_path", *QUICK, outcome.alias("outcome"))
    unknown = requests.select("full_path", "seq").join(marked.select("full_path").distinct(), "full_path", "left_anti")
    return decided.unionByName(unknown.select("seq", "full_path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("size_bytes"), F.lit("not_found").alias("outcome")))
