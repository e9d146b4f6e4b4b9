import os
import random

import duckdb
import pytest

from winnow.operators import groups as g
from winnow.operators import plan
from winnow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def lines(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    expected = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert lines([tuple(r) for r in df.collect()], df.columns) == lines(expected.fetchall(), expected.columns)


def table(spark, rows):
    return spark.createDataFrame([(f"/{i:03}", n, len(c or ""), c) for i, (n, c) in enumerate(rows)], "full_path string, name string, size_bytes long, content string").selectExpr("*", "false as is_dir")


def test_batch_compares_with_the_reference_only(spark):
    items = table(spark, [("n", "aa"), ("n", "bb"), ("n", "aa"), ("n", "bb"), ("m", None), ("m", None), ("k", "x")])
    found = {r.full_path: r.action for r in plan.batch_plan(g.members_of(items, g.quick_groups(items))).collect()}
    assert found == {"/000": "keep", "/001": "skip", "/002": "remove", "/003": "skip", "/004": "keep", "/005": "skip"}
    assert {(r.name, r.copies) for r in g.deep_groups(items).collect()} == {("n", 2)}


def test_ordered_requests_leave_a_copy(spark):
    items = table(spark, [("n", "aa"), ("n", "aa"), ("m", "x"), ("m", "y"), ("k", "x")])
    members = g.with_digest(items)
    asked = spark.createDataFrame([("/001", 1), ("/000", 2), ("/001", 3), ("/003", 4), ("/004", 5), ("/none", 6)], "full_path string, seq long")
    found = {r.seq: r.outcome for r in plan.request_plan_ordered(members, asked).collect()}
    assert found == {1: "removed", 2: "refused_last_copy", 3: "already_removed", 4: "refused_differs", 5: "not_found", 6: "not_found"}


def fold(members, gone, asked):
    """The requests (path, seq) one after the other. members: path -> (group, digest)."""
    left = {p: v for p, v in sorted(members.items()) if p not in gone}
    out = []
    for seq, path in sorted((s, p) for p, s in asked):
        if path not in members:
            out.append((seq, path, "not_found"))
            continue
        if path not in left:
            out.append((seq, path, "already_removed"))
            continue
        other = next((p for p, v in left.items() if p != path and v[0] == left[path][0]), None)
        same = other is not None and left[path][1] is not None and left[other][1] == left[path][1]
        out.append((seq, path, "refused_last_copy" if other is None else "removed" if same else "refused_differs"))
        if same:
            del left[path]
    return out


def test_ordered_requests_equal_a_fold(spark):
    rng = random.Random(7)
    members = {f"/{i:04}": (f"g{rng.randrange(120)}", rng.choice(["a", "a", "a", "b", None])) for i in range(400)}
    members |= {f"/x{i:04}": ("large", "a" if i % 3 else "b") for i in range(300)}
    gone = set(rng.sample(sorted(members), 60))
    asked = [(rng.choice([*members, "/none"]), rng.randrange(2000)) for _ in range(900)] + [(p, 5000 + i) for i, p in enumerate(members) if rng.random() < 0.7]
    rows = spark.createDataFrame([(p, g, 1, d) for p, (g, d) in members.items()], "full_path string, name string, size_bytes long, sha256 string")
    out = plan.request_plan_ordered(rows, spark.createDataFrame(asked, "full_path string, seq long"), spark.createDataFrame([(p,) for p in gone], "full_path string"))
    assert sorted((r.seq, r.full_path, r.outcome) for r in out.collect()) == sorted(fold(members, gone, asked))
    planned = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in planned  # no group is gathered in a task


def test_every_group_survives_ordered_requests(spark):
    out = registry.QUERIES["request_plan_ordered"](spark, "/root/testdata/sf0.01")
    counts = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert counts == {"removed": 70, "refused_differs": 99, "refused_last_copy": 56}


def test_golden_numbers(spark):
    sf = "/root/testdata/sf0.01"
    assert registry.QUERIES["quick_totals"](spark, sf).first() == (103, 225, 234_199)
    assert registry.QUERIES["deep_totals"](spark, sf).first() == (62, 135, 163_961)
    assert registry.QUERIES["batch_outcome"](spark, sf).first()[:3] == (70, 52, 162_320)


def test_empty_tables(spark):
    none = table(spark, [("n", "a")]).limit(0)
    groups = g.quick_groups(none)
    assert groups.isEmpty() and g.deep_groups(none).isEmpty() and g.ranked(groups).isEmpty()
    assert g.totals(groups).first() == (0, 0, 0)
    assert plan.batch_outcome(plan.batch_plan(none)).first().outcome == "nothing"


def test_streamed_groups(spark, tmp_path):
    from winnow.streaming.arrivals import quick_groups_stream, write_ledger

    items = table(spark, [("n", "aa"), ("n", "aa"), ("k", "x")])
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = quick_groups_stream(stream).writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.name, r.copies) for r in spark.sql("select * from found").collect()] == [("n", 2)]
    write_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3


def test_entries_without_a_name_are_in_no_group(spark):
    items = table(spark, [(None, "aa"), (None, "aa"), ("n", "aa"), ("n", "aa")])
    groups = g.quick_groups(items)
    assert [(r.name, r.copies) for r in groups.collect()] == [("n", 2)]
    members = g.members_of(items, groups)
    assert {r.full_path for r in members.collect()} == {"/002", "/003"}
    assert {r.full_path: r.action for r in plan.batch_plan(items.drop("is_dir")).collect()} == {"/002": "keep", "/003": "remove"}
    assert {r.name: r.remaining for r in g.with_remaining(groups, members, items.limit(0).select("full_path")).collect()} == {"n": 2}
    asked = spark.createDataFrame([("/000",), ("/003",)], "full_path string")
    digested = items.selectExpr("full_path", "name", "size_bytes", "sha2(content, 256) as sha256")
    assert {r.full_path: r.outcome for r in plan.request_plan(digested, asked).collect()} == {"/000": "not_found", "/003": "removed"}
    assert plan.batch_plan(items.limit(0)).isEmpty()
