"""What must hold at any size: ranks beyond a sample, plans without shuffled contents, files read once, even listings, repeatable ledgers."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from winnow.operators import digest, ledger, plan
from winnow.operators import groups as g
from winnow.plans import registry
from winnow.sources import inventory as inv
from winnow.sources.listing import read_ledger, write_ledger_batch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def conf(spark):
    """Settings for one test."""
    before = {}

    def put(**settings):
        for k, v in settings.items():
            name = k.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, v)

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def many_groups(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("groups") / "g")
    h = F.xxhash64("id")
    rows = spark.range(400_000).select(F.concat(F.lit("n"), F.pmod(h, F.lit(90_000))).alias("name"), F.pmod(F.shiftright(h, 20), F.lit(500)).alias("size_bytes"), F.pmod(F.shiftright(h, 40), F.lit(7)).alias("copies"), F.concat(F.lit("/"), F.col("id")).alias("first_path"), F.pmod(h, F.lit(5)).alias("remaining"))
    rows.write.parquet(path)
    return path


@pytest.mark.parametrize("parts", [8, 64])
@pytest.mark.parametrize(("by", "column"), [("name", "name"), ("size", "size_bytes"), ("copies", "remaining")])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_beyond_a_sample(spark, conf, many_groups, parts, by, column, descending):
    conf(spark__sql__shuffle__partitions=str(parts))
    groups = spark.read.parquet(many_groups)
    found = g.ranked(groups.repartition(parts * 3), by, descending).select("first_path", "rank").toArrow()
    ties = ", ".join(c for c in ("name", "size_bytes", "first_path") if c != column)
    expected = f"SELECT first_path, row_number() OVER (ORDER BY {column} {'DESC' if descending else ''}, {ties}) AS rank FROM '{many_groups}/*.parquet'"
    wrong = duckdb.sql(f"SELECT count(*) FROM found JOIN ({expected}) e USING (first_path) WHERE e.rank <> found.rank").fetchall()[0][0]
    assert found.num_rows == 400_000 and wrong == 0


def test_ranks_are_dealt_once(spark, many_groups):
    out = g.ranked(spark.read.parquet(many_groups), "size")
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


CONTENT_QUERIES = ["deep_groups", "group_files", "deep_batch_plan", "deep_request_plan_ordered", "deep_totals", "batch_plan", "batch_outcome", "survivors", "lost_groups", "request_plan", "request_plan_ordered", "recovered_total", "savings"]


def exchanged(df):
    """The columns that go through each shuffle of a plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


@pytest.fixture
def written_plans(spark, monkeypatch):
    """The plans of tables that are saved meanwhile."""
    from winnow.sources import shared

    seen, save = [], shared.saved
    monkeypatch.setattr(shared, "saved", lambda rows, label: (seen.append(rows), save(rows, label))[1])
    return seen


@pytest.mark.parametrize("name", CONTENT_QUERIES)
def test_no_content_is_shuffled(spark, conf, written_plans, name):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    out = registry.QUERIES[name](spark, SF)
    plans = [*written_plans, out]
    assert any(exchanged(p) for p in plans)
    for p in plans:
        assert not [c for c in exchanged(p) if re.search(r"\b(text|content)#", c)]
        # nothing asks for a digest before the filter of candidates
        nodes = p._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Filter \([^\n]*sha2\(", nodes)
        if "sha2(" in nodes:
            lines = nodes.split("\n")
            first = next(i for i, line in enumerate(lines) if "sha2(" in line)
            assert any("BroadcastHashJoin" in line for line in lines[first:])  # below: the filter's join
    digests = sum("sha2(" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    assert digests == 1  # all that reads digests reads the same ones


def test_the_filter_lets_every_key_pass(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id") % 3000).alias("name"), (F.col("id") % 7).alias("size_bytes"), F.col("id").alias("full_path"))
    keys = rows.where("size_bytes = 3").select("name", "size_bytes").distinct()
    for bits in (64, 1 << 12, 1 << 26):
        passed = g.maybe_in(rows, g.key_filter(keys, bits), bits)
        assert passed.columns == rows.columns
        assert passed.join(keys, ["name", "size_bytes"], "left_semi").count() == rows.join(keys, ["name", "size_bytes"], "left_semi").count()
    assert passed.count() < 1.01 * rows.where("size_bytes = 3").count() and g.key_filter(keys, 64).count() == 1
    assert g.maybe_in(rows, g.key_filter(keys.limit(0))).isEmpty()


def test_digests_only_of_candidates(spark):
    items = spark.createDataFrame([("/1", "n", 2, "aa", 0), ("/2", "n", 2, "aa", 0), ("/3", "n", 2, None, 0), ("/4", "m", 2, "aa", 0), (None, None, 2, "aa", 0), ("/5", "m", None, "aa", 1)], "full_path string, name string, size_bytes long, content string, extra int").withColumn("is_dir", F.lit(False))
    found = g.with_digest(items)
    assert found.columns == ["full_path", "name", "size_bytes", "extra", "is_dir", "sha256"]
    assert {(r.full_path, r.sha256 is None) for r in found.collect()} == {("/1", False), ("/2", False), ("/3", True)}
    assert [(r.name, r.copies, r.first_path) for r in g.deep_groups(items).collect()] == [("n", 2, "/1")]


def test_a_hot_name_is_dealt_by_path(spark):
    hot = spark.range(30_000).select(F.concat(F.lit("/h"), F.col("id")).alias("full_path"), F.lit("same").alias("name"), F.lit(5).cast("long").alias("size_bytes"), F.lit("aaaaa").alias("content"))
    rest = spark.range(30_000).select(F.concat(F.lit("/r"), F.col("id")).alias("full_path"), F.concat(F.lit("n"), F.col("id") % 15_000).alias("name"), F.lit(5).cast("long").alias("size_bytes"), F.lit("aaaaa").alias("content"))
    members = g.with_digest(hot.unionByName(rest).withColumn("is_dir", F.lit(False)))
    assert members.count() == 60_000
    by_file = members.groupBy(F.input_file_name()).agg(F.count_if(F.col("name") == "same").alias("n")).collect()
    assert max(r.n for r in by_file) < 15_000  # not all in one task
    counts = {r.action: r["count"] for r in plan.batch_plan(members).groupBy("action").count().collect()}
    assert counts == {"keep": 15_001, "remove": 44_999}


def test_files_of_groups_in_pages(spark):
    rows = [(f"/a{i:03}", "big") for i in range(500)] + [("/x", "n"), ("/y", "n"), ("/z", "alone")]
    items = spark.createDataFrame(rows, "full_path string, name string").selectExpr("*", "1L as size_bytes", "false as is_dir")
    groups = g.quick_groups(items)
    found = g.with_files(groups, g.members_of(items, groups), 50).collect()
    big = [r for r in found if r.name == "big"]
    assert len(big) == 10 and {r.pages for r in big} == {10} and max(len(r.files) for r in big) < 100
    assert sorted(p for r in big for p in r.files) == [p for p, n in rows if n == "big"] and all(list(r.files) == sorted(r.files) for r in big)
    assert [(r.page, r.pages, list(r.files), r.copies) for r in found if r.name == "n"] == [(0, 1, ["/x", "/y"], 2)] and len(found) == 11


# files


def test_large_files_are_digested_in_ranges(spark, disk, tmp_path):
    (tmp_path / "grown").write_bytes(bytes(9000))
    files = scanned(spark, disk).where("NOT is_dir").select("full_path", "size_bytes").withColumn("sha256", F.lit("old"))
    files = files.unionByName(spark.createDataFrame([(f"{tmp_path}/grown", 8999, ""), (f"{disk}/none", 10**6, "")], "full_path string, size_bytes long, sha256 string"))
    whole, parts = ({(os.path.relpath(r.full_path, disk) if "grown" not in r.full_path else "grown", r.size_bytes): r.sha256 for r in digest.with_file_digest(files, range_bytes=n).collect()} for n in (10**9, 7000))
    assert set(whole) == set(parts) and len(whole) == 15
    big = [(f"{x}/big", 300_000) for x in "abcde"]
    for found in (whole, parts):
        assert found[big[0]] == found[big[1]] == found[big[4]] and len({found[b] for b in big}) == 3 and found["none", 10**6] is None
    assert parts["grown", 8999] is None and whole["grown", 8999] is not None  # it has grown since it was listed
    assert all(parts[k] == whole[k] for k in whole if k[1] <= 7000 or k[1] == 10**6) and all(parts[b] != whole[b] for b in big)


@pytest.fixture(scope="module")
def disk(tmp_path_factory):
    root = tmp_path_factory.mktemp("disk")
    rng = random.Random(5)
    big = rng.randbytes(300_000)
    late = big[:-1] + bytes([big[-1] ^ 1])
    early = bytes([big[0] ^ 1]) + big[1:]
    files = {"a/big": big, "b/big": big, "c/big": late, "d/big": early, "e/big": big, "a/one": b"x", "a/pair": b"12", "b/pair": b"34", "a/none": b"", "b/none": b"", "a/gone": b"gg", "b/gone": b"gg", "c/gone": b"gg"}
    for name, data in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return root


def scanned(spark, disk):
    return inv.scan_tree(spark, str(disk), tasks=4)


def test_requests_on_files(spark, disk):
    members = scanned(spark, disk)
    os.rename(disk / "b/gone", disk / "b/away")  # in the inventory, but not readable any more
    try:
        asked = spark.createDataFrame([(f"{disk}/{p}",) for p in ("b/big", "b/pair", "a/one", "b/none", "b/gone", "x/none")], "full_path string")
        found = {r.full_path[len(str(disk)) + 1 :]: r.outcome for r in plan.request_plan(members.where("NOT is_dir"), asked).collect()}
        assert found == {"b/big": "removed", "b/pair": "refused_differs", "a/one": "refused_last_copy", "b/none": "removed", "b/gone": "refused_differs", "x/none": "not_found"}
        # with the first copy gone the second is the reference, which cannot be read
        gone = spark.createDataFrame([(f"{disk}/a/gone",)], "full_path string")
        found = plan.request_plan(members.where("NOT is_dir"), spark.createDataFrame([(f"{disk}/c/gone",), (f"{disk}/a/gone",)], "full_path string"), gone).collect()
        assert {(r.full_path[-6:], r.outcome) for r in found} == {("c/gone", "refused_differs"), ("a/gone", "already_removed")}
    finally:
        os.rename(disk / "b/away", disk / "b/gone")


def test_ordered_requests_on_files(spark, disk):
    members = scanned(spark, disk).where("NOT is_dir")
    order = ["c/big", "a/big", "e/big", "b/big", "a/big", "d/big", "a/pair", "b/pair", "b/gone", "c/gone", "a/gone", "x", "a/one"]
    asked = spark.createDataFrame([(f"{disk}/{p}", i) for i, p in enumerate(order)], "full_path string, seq long")
    found = [r.outcome for r in plan.request_plan_ordered(members, asked).orderBy("seq").collect()]
    assert found == ["refused_differs", "removed", "removed", "refused_differs", "already_removed", "refused_differs", "refused_differs", "refused_differs", "removed", "removed", "refused_last_copy", "not_found", "refused_last_copy"]
    same = plan.request_plan_ordered(g.with_digest(members), asked).orderBy("seq").collect()
    assert [r.outcome for r in same][:-1] == found[:-1]  # the digested are those of groups, to which the last belongs to none


def test_a_large_file_is_compared_by_many_tasks(spark, disk, conf):
    conf(spark__sql__shuffle__partitions="8", spark__sql__adaptive__coalescePartitions__enabled="false")
    pairs = [("a/big", "b/big"), ("a/big", "c/big"), ("a/big", "d/big"), ("a/none", "b/none"), ("a/pair", "b/pair"), ("a/big", "a/one"), ("a/big", "nowhere"), ("nowhere", "nowhere"), ("a/big", None)]
    rows = spark.createDataFrame([(f"{disk}/{a}", b and f"{disk}/{b}", i) for i, (a, b) in enumerate(pairs)], "full_path string, reference_path string, identical int")
    out = digest.with_file_verdict(rows, range_bytes=10_000)
    assert out.columns == ["full_path", "reference_path", "identical"] and out.count() == len(pairs)
    for r in out.collect():
        assert r.identical == (r.reference_path is not None and digest.same_bytes(r.full_path, r.reference_path))
    assert sum(r.identical for r in out.collect()) == 2
    sized = spark.createDataFrame([(f"{disk}/a/big", f"{disk}/b/big", 300_000)], "path string, reference string, size long")
    further = digest._dealt(digest.pair_ranges(sized, False, 10_000)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.offset for r in further) == [*range(10_000, 300_000, 10_000)] and len({r.task for r in further}) > 4
    assert all(digest.same_bytes(f"{disk}/a/big", f"{disk}/c/big", o, 10_000) == (o < 290_000) for o in range(0, 300_000, 10_000))


def test_every_file_is_read_once(spark, tmp_path):
    rng = random.Random(6)
    whole = rng.randbytes(200_000)
    sizes = 0
    for i in range(40):
        data = whole if i % 4 else whole[:100_000] + bytes([whole[100_000] ^ 1]) + whole[100_001:] if i % 8 else bytes(200_000)
        (tmp_path / f"{i:02}").mkdir()
        (tmp_path / f"{i:02}" / "f").write_bytes(data)
        sizes += len(data)
    rows = spark.createDataFrame([(f"{tmp_path}/{i:02}/f", "f", 200_000, 40, f"{tmp_path}/01/f") for i in range(40)], "full_path string, name string, size_bytes long, n long, reference_path string")
    out = digest.with_reference_verdict(rows, lambda r, heads: g.met(r, heads, 40), range_bytes=30_000)
    found = {int(r.full_path[-4:-2]): r for r in out.collect()}
    assert {i for i, r in found.items() if r.identical} == {i for i in range(40) if i % 4}
    assert sum(r.bytes_read for r in found.values()) <= sizes
    assert {found[i].bytes_read for i in range(0, 40, 8)} == {digest.CHUNK}  # unlike from the start: read no further
    table = plan.batch_plan(scanned(spark, tmp_path).where("NOT is_dir"))
    assert {(r.full_path[-4:-2], r.action) for r in table.collect()} == {(f"{i:02}", "keep" if i == 0 else "remove" if i % 8 == 0 else "skip") for i in range(40)}


def test_listing_is_even(spark, tmp_path):
    path = tmp_path
    for i in range(120):  # one deep branch
        path = path / "d"
        path.mkdir()
        (path / f"f{i}").touch()
    for i in range(10_000):
        (tmp_path / "wide" / f"{i:05}").mkdir(parents=True)
        if i % 10 == 0:
            (tmp_path / "wide" / f"{i:05}" / "x").touch()
    rounds = [spark.read.schema(inv.LISTED).parquet(p) for p in inv.tree_listing(spark, str(tmp_path), tasks=8, budget=500)]
    entries = [r.where("todo IS NULL").groupBy(F.input_file_name()).count().collect() for r in rounds]
    assert sum(r["count"] for e in entries for r in e) == 120 * 2 + 1 + 10_000 + 1000
    assert len(rounds) < 12 and all(len(e) <= 8 for e in entries)
    waiting = [[r["count"] for r in x.where("todo IS NOT NULL").groupBy(F.input_file_name()).count().collect()] for x in rounds]
    assert max(max(w) for w in waiting if w) >= 9000  # a folder of sub-folders comes back in one piece ..
    after = [r["count"] for r in entries[1]]
    assert len(after) == 8 and max(after) <= 600  # .. and is dealt to all tasks, each within its budget
    one = inv.scan_tree(spark, str(tmp_path), tasks=2, budget=10**9)
    assert one.count() == 11_241 and one.select("full_path").distinct().count() == 11_241
    reader = inv.FileInventoryReader(str(tmp_path), 3)
    assert [len(p.paths) for p in reader.partitions()] == [1, 1, 1]
    spark.dataSource.register(inv.FileInventory)
    assert spark.read.format("file_inventory").option("fan_out", 3).load(str(tmp_path)).count() == 11_241


def test_counts_come_with_the_groups(spark, disk):
    listed = scanned(spark, disk)
    kept, counts = inv.observed(listed, skip_hidden=True, media_only=True)
    g.quick_groups(kept).collect()
    assert inv.summary(counts) == inv.scan_summary(listed, skip_hidden=True, media_only=True).first().asDict()
    assert inv.summary(counts)["total"] == 18 and inv.summary(counts)["processed"] == 5


def test_canonical_names_need_no_join(spark):
    names = ["caf\u00e9", "cafe\u0301", "plain", None, "\u00c5", "\u212b", "a\u200db", "ab"]
    rows = spark.createDataFrame([(f"/{i}", n, 1) for i, n in enumerate(names)], "full_path string, name string, size_bytes long").withColumn("is_dir", F.lit(False))
    out = g.canonical_names(rows)
    nodes = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in nodes and "Exchange" not in nodes and out.columns == rows.columns
    found = [r.name for r in out.orderBy("full_path").collect()]
    two = ["cafe\u0301", "A\u030a"]
    assert found == [two[0], two[0], "plain", None, two[1], two[1], "a\u200db", "ab"]
    assert {(r.name, r.copies) for r in g.quick_groups(out).collect()} == {(two[0], 2), (two[1], 2)}


# ledgers


def test_a_batch_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("/a", 5), ("/b", 7)], "full_path string, size_bytes long")
    write_ledger_batch(rows, path, "one", "duplicate")
    write_ledger_batch(rows.limit(1), path, "two")
    write_ledger_batch(rows, path, "one", "duplicate")
    held = read_ledger(spark, path)
    assert sorted((r.full_path, r.batch, r.reason) for r in held.collect()) == [("/a", "one", "duplicate"), ("/a", "two", None), ("/b", "one", "duplicate")]
    assert held.where("recorded_at IS NULL").isEmpty() and ledger.recovered(ledger.add(held, rows)).first() == (2, 12)
    with pytest.raises(ValueError):
        write_ledger_batch(rows, path, "a/b")
    write_ledger_batch(rows.limit(0), path, "two")
    assert {r.batch for r in read_ledger(spark, path).collect()} == {"one"}


def test_a_stream_started_again_leaves_one_copy(spark, tmp_path):
    from winnow.streaming.arrivals import write_ledger

    rows = spark.createDataFrame([("/a", 5), ("/b", 7)], "full_path string, size_bytes long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for lost in ("c1", "c2"):  # the second run has lost what it had seen, and gives its first batch the same id
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        write_ledger(stream, str(tmp_path / "out"), str(tmp_path / lost), "removals", "request").awaitTermination()
    rows.selectExpr("concat(full_path, 'x') as full_path", "size_bytes").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write_ledger(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2"), "removals", "request").awaitTermination()
    held = read_ledger(spark, str(tmp_path / "out")).collect()
    assert sorted((r.full_path, r.batch) for r in held) == [("/a", "removals-0"), ("/ax", "removals-1"), ("/b", "removals-0"), ("/bx", "removals-1")]


def test_a_kept_ledger_is_met_in_place(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    spark.sql("DROP TABLE IF EXISTS kept_ledger")
    new = spark.createDataFrame([(f"/{i}", i) for i in range(1000)], "full_path string, size_bytes long")
    try:
        ledger.keep(new.where("size_bytes < 600"), "kept_ledger", 8)
        ledger.keep(new, "kept_ledger", 8)
        held = ledger.keep(new.unionByName(new), "kept_ledger", 8)
        assert ledger.recovered(held).first() == (1000, sum(range(1000)))
        members = spark.range(3000).select(F.concat(F.lit("/"), F.col("id")).alias("full_path"), F.lit("n").alias("name"), F.lit(1).alias("size_bytes"))
        left = g.active(members, ledger.kept(spark, "kept_ledger"))
        assert left.count() == 2000
        nodes = left._jdf.queryExecution().executedPlan().toString()
        below = nodes.split("kept_ledger")[0].split("SortMergeJoin")[1]
        assert nodes.count("Exchange") == 1 and "Exchange" not in below.split("\n:")[-1].split("+- ", 1)[0]
        scan = next(line for line in nodes.split("\n") if "kept_ledger" in line)
        assert "Bucketed: true" in scan
    finally:
        spark.sql("DROP TABLE IF EXISTS kept_ledger")
