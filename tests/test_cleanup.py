"""Whole cleanups: what every plan must keep true, on random inventories and on files."""

import random
from collections import Counter, defaultdict

import pytest

from winnow.operators import groups as g
from winnow.operators import plan
from winnow.plans.cleanup import Cleanup
from winnow.sources import inventory as inv
from winnow.sources.listing import write_listing


def random_table(spark, seed):
    rng = random.Random(seed)
    rows = [(f"/{i:04}", rng.choice(["a.jpg", ".b", "c.txt", "d", None]), rng.choice(["", "xx", "yy", "zzz", "www", None])) for i in range(rng.choice([3, 60, 250]))]
    rows = [(p, n, len(c or "") if rng.random() < 0.95 else None, c, False) for p, n, c in rows]
    return spark.createDataFrame(rows, "parent string, name string, size_bytes long, content string, is_dir boolean").transform(inv.with_columns)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("deep", [False, True])
def test_what_plans_keep_true(spark, seed, deep):
    table = random_table(spark, seed)
    rows = {r.full_path: r for r in table.where("full_path IS NOT NULL").collect()}
    c = Cleanup(table, deep=deep)
    key = (lambda r: (r.name, r.size_bytes, r.content)) if deep else (lambda r: (r.name, r.size_bytes))
    sizes = Counter(key(r) for r in rows.values() if r.name is not None and (not deep or r.content is not None))
    assert {(r.name, r.size_bytes): r.copies for r in c.groups.collect()} == {k[:2]: n for k, n in sizes.items() if n > 1} or deep
    assert c.groups.count() == sum(n > 1 for n in sizes.values())
    potential = c.totals().first().potential_savings
    assert potential == sum(k[1] * (n - 1) for k, n in sizes.items())

    made = c.remove_all().collect()
    gone = {r.full_path for r in made if r.action == "remove"}
    left = {r.full_path for r in c.survivors().where("full_path IS NOT NULL").collect()}
    assert left | gone == set(rows) and not left & gone  # everything is on one side
    assert c.recovered().first().recovered_bytes == sum(rows[p].size_bytes for p in gone) <= potential
    alive = defaultdict(set)
    for p in left:
        alive[key(rows[p])].add(rows[p].content)
    assert all(rows[p].content in alive[key(rows[p])] for p in gone)  # each has an equal that stays
    assert plan.lost_groups(c.members, c.removed, deep).isEmpty()
    again = c.remove_all()
    assert again.where("action = 'remove'").isEmpty()
    assert not c.any_removable() if deep else True
    if deep:
        assert c.recovered().first().recovered_bytes == potential  # equal files: all but one of each go
        quick = {(r.name, r.size_bytes) for r in g.quick_groups(table).collect()}
        assert {(r.name, r.size_bytes) for r in c.groups.collect()} <= quick
    c.forget()


def tree(tmp_path):
    files = {"a/x": b"12", "b/x": b"12", "c/x": b"34", "d/x": b"34", ".h/y.jpg": b"p", "e/y.jpg": b"p", "e/.z.jpg": b"q", "f/.z.jpg": b"q", "f/only": b"o"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def asked(spark, root, *names):
    return spark.createDataFrame([(f"{root}/{n}", i) for i, n in enumerate(names)], "full_path string, seq long")


@pytest.mark.parametrize("deep", [False, True])
def test_cleanup_of_files(spark, tmp_path, deep):
    root = tree(tmp_path)
    listed = inv.scan_tree(spark, root, tasks=3)
    c = Cleanup(listed, deep=deep)
    assert c.summary == {"total": 16, "processed": 16, "ratio": 1.0}
    assert c.totals().first() == ((4, 8, 6) if deep else (3, 8, 8))
    first = {(r.rank, r.name, r.remaining) for r in c.ranked("size", True).collect()}
    assert (1, "x", 2 if deep else 4) in first
    out = [r.outcome for r in c.remove(asked(spark, root, "a/x", "b/x", "c/x", "f/only", "e/y.jpg")).orderBy("seq").collect()]
    assert out == ["removed", "refused_last_copy" if deep else "refused_differs", "removed" if deep else "refused_differs", "not_found", "removed"]
    made = {r.full_path[len(root) + 1 :]: r.action for r in c.remove_all().collect()}
    # two differing files and their copies: a quick batch compares with the first one only
    assert made == ({"e/.z.jpg": "keep", "f/.z.jpg": "remove"} if deep else {"b/x": "keep", "c/x": "skip", "d/x": "skip", "e/.z.jpg": "keep", "f/.z.jpg": "remove"})
    assert c.recovered().first() == ((4, 6) if deep else (3, 4))
    assert c.any_removable() == (not deep)
    assert {r.remaining for r in c.remaining().where("name = 'y.jpg'").collect()} == {1}
    pages = {(r.name, tuple(p[len(root) + 1 :] for p in r.files)) for r in c.files().collect()}
    assert ("y.jpg", (".h/y.jpg",)) in pages and sum(len(f) for _, f in pages) == (4 if deep else 5)
    assert c.survivors().count() == 16 - (4 if deep else 3)
    # a later cleanup that is given the ledger goes on from it
    later = Cleanup(listed, deep=deep, removed=c.removed)
    assert later.recovered().first() == c.recovered().first() and later.remove_all().where("action = 'remove'").isEmpty()
    c.forget()


def test_filters_of_a_cleanup(spark, tmp_path):
    root = tree(tmp_path)
    listed = inv.scan_tree(spark, root)
    c = Cleanup(listed, skip_hidden=True, media_only=True)
    assert c.summary["total"] == 16 and c.summary["processed"] == 8 and {r.name for r in c.groups.collect()} == {"y.jpg"}
    write_listing(listed, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 16
