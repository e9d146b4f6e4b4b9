import os

import pytest
from pyspark.sql import functions as F

from winnow.functions import scalars
from winnow.operators import digest, ledger, plan
from winnow.operators import groups as g
from winnow.sources import inventory as inv
from winnow.sources.listing import read_ledger, write_ledger_batch, write_listing


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "a/x.JPG": b"1234", "b/x.JPG": b"1234", "c/x.JPG": b"9999", "a/.DS_Store": b"h", "b/.DS_Store": b"h", "a/_under.txt": b"u",
        ".hid/in.txt": b"zz", "_d/in.txt": b"zz", "a/noext": b"", "b/noext": b"", "a/é.txt": b"e", "b/é.txt": b"e", "a/sp ace.txt": b"s",
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    os.symlink(root / "a/x.JPG", root / "c/link.JPG")
    return str(root)


@pytest.fixture(scope="module")
def scanned(spark, tree):
    return inv.scan_tree(spark, tree, tasks=3).cache()


def test_scan_lists_every_entry_once(spark, tree, scanned):
    rows = scanned.collect()
    assert len(rows) == 19 and sum(r.is_dir for r in rows) == 5
    assert len({r.full_path for r in rows}) == 19
    link = next(r for r in rows if r.name == "link.JPG")
    assert link.size_bytes == len(os.path.join(tree, "a/x.JPG"))
    one, deep = (inv.scan_tree(spark, tree, tasks=n, budget=b).count() for n, b in ((1, 1), (100, 10**6)))
    assert one == deep == 19


def test_missing_root_is_an_error(spark):
    with pytest.raises(ValueError):
        inv.scan_tree(spark, "/no/such/root")


def test_groups_of_the_tree(scanned):
    quick = {r.name: r.copies for r in g.quick_groups(scanned).collect()}
    assert quick == {".DS_Store": 2, "é.txt": 2, "in.txt": 2, "noext": 2, "x.JPG": 3}
    assert g.totals(g.quick_groups(scanned)).first().potential_savings == 12
    deep = {r.name: r.copies for r in g.deep_groups(scanned).collect()}
    assert deep == quick | {"x.JPG": 2}
    assert g.totals(g.deep_groups(scanned)).first().potential_savings == 8
    assert ".DS_Store" not in {r.name for r in g.quick_groups(inv.scan_filters(scanned, skip_hidden=True)).collect()}
    assert {r.name for r in g.quick_groups(inv.scan_filters(scanned, media_only=True)).collect()} == {"x.JPG"}


def test_batch_plan_of_files_keeps_a_copy(scanned):
    members = g.members_of(scanned, g.quick_groups(scanned))
    table = plan.batch_plan(members).cache()
    assert {(r.name, r.action): r["count"] for r in table.groupBy("name", "action").count().collect()}[("x.JPG", "skip")] == 1
    gone = plan.removals(table)
    assert plan.lost_groups(members, gone).isEmpty()
    left = plan.survivors(scanned, gone)
    assert left.count() + gone.count() == scanned.count()
    again = plan.batch_plan(g.members_of(left, g.quick_groups(left)))
    assert again.where("action = 'remove'").isEmpty()


def test_unreadable_files_have_no_digest(spark, tree):
    rows = spark.createDataFrame([(tree + "/a/x.JPG",), (tree + "/none",)], "full_path string")
    found = {r.full_path.rsplit("/", 1)[1]: r.sha256 for r in digest.with_file_digest(rows).collect()}
    assert found["none"] is None and len(found["x.JPG"]) == 64
    assert not digest.same_bytes(tree + "/none", tree + "/none")


def test_listing_and_ledger(spark, scanned, tmp_path):
    write_listing(scanned, str(tmp_path / "list"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "list")).collect()]
    assert len(lines) == 19 and all(x.count(";") == 3 for x in lines) and sum(x.endswith(";Folder") for x in lines) == 5
    rows = spark.createDataFrame([("/a", 5), ("/b", 7)], "full_path string, size_bytes long")
    write_ledger_batch(rows, str(tmp_path / "ledger"), "first")
    write_ledger_batch(rows.limit(1), str(tmp_path / "ledger"), "second")
    held = ledger.add(read_ledger(spark, str(tmp_path / "ledger")), rows)
    assert ledger.recovered(held).first() == (2, 12)


@pytest.mark.parametrize(
    ("size", "file_label", "total_label"),
    [
        (0, "0.00 KB", "0.00 KB"), (1, "0.00 KB", "0.00 KB"), (128, "0.12 KB", "0.12 KB"), (384, "0.38 KB", "0.38 KB"), (640, "0.62 KB", "0.62 KB"),
        (1023, "1.00 KB", "1.00 KB"), (1024, "1.00 KB", "1.00 KB"), (1048575, "1024.00 KB", "1024.00 KB"), (1048576, "1.00 MB", "1.00 MB"), (2**30, "1024.00 MB", "1.00 GB"), (2**40, "1048576.00 MB", "1.00 TB"),
    ],
)
def test_labels(spark, size, file_label, total_label):
    row = spark.range(1).select(scalars.file_size_label(F.lit(size)).alias("f"), scalars.total_size_label(F.lit(size)).alias("t")).first()
    assert (row.f, row.t) == (file_label, total_label)


def test_path_parts(spark):
    names = [".jpg", "a.", "a", ".a.tiff", "a..TIFF", "x.JPG"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(scalars.extension(F.col("name")).alias("e")).collect()
    assert [r.e for r in rows] == ["", "", "", "tiff", "tiff", "jpg"]
    row = spark.range(1).select(scalars.path_parent(F.lit("/a")).alias("p"), scalars.join_path(F.lit("/"), F.lit("a")).alias("j"), scalars.path_name(F.lit("/a/b")).alias("n")).first()
    assert row == ("/", "/a", "b")
