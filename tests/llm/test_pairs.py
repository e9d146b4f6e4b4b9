"""The n-gram join, cap filters and top-k search against brute force, with nulls, ties, repeats and empty tables."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from winnow.llm import cap_dedup, kd_search, ngram_join, store
from winnow.llm.graph import components

SF = "/root/testdata/sf0.001"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def expected_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(sets, links)


def variants(seed, n=120):
    """Texts with many near and exact copies, short ones, nulls and white space only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(size)] for size in (1, 3, 4, 8, 9, 12, 30, 60, 200)]
    out = [None, "", " \t\n", "a b c", "A  b\nC", "é É x y z"]
    while len(out) < n:
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "\n"]).join(w))
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "percent", "how"), [(4, 85, {}), (5, 80, {"frequent": 2, "crowd": 3, "block_tokens": 50}), (2, 80, {"frequent": 1, "crowd": 2, "block_tokens": 200}), (3, 60, {"frequent": 1}), (1, 34, {"frequent": 2})])
def test_components_equal_brute_force(spark, k, percent, how):
    rows = variants(k)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, k=k, percent=percent, count_bits=16, **how).collect()}
    sizes, comps = expected_components(rows, k, percent)
    assert found == {i: (sizes[i], comps[i]) for i, _ in rows}


def test_registered_join_equals_brute_force(spark):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op1_ngram_join(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes, comps = expected_components(rows, 4, 85)
    assert found == {i: (sizes[i], comps[i]) for i, _ in rows}


def test_representatives_keep_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "u"), (2, "a b c d e f", "v"), (3, None, "w"), (None, "", "x"), (None, "a b c d e f", "y")], "doc_id long, text string, root string")
    out = ngram_join.near_duplicate_representatives(docs, count_bits=16)
    assert out.columns == docs.columns
    assert sorted(r.root for r in out.collect()) == ["u", "w", "x", "y"]
    assert ngram_join.near_duplicate_representatives(docs.limit(0), count_bits=16).isEmpty()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 50), (50, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: v for k, v in roots({x for e in links for x in e}, links).items() if k != 7 or v != 7}


def vectors(spark, rows, of="float"):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding array<{of}>, key int")


def test_caps_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(i, (b + rng.normal(0, 0.13, 16)).tolist()) for i, b in enumerate(np.repeat(base, 5, axis=0))]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, []), (904, [0.0] * 16), (905, [float("nan")] * 16), (906, [None, *[1.0] * 15]), (907, [3.0, 4.0]), (908, [6.0, 8.0])]
    df = cap_dedup.cap_near_duplicates(vectors(spark, rows))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for (i, x), (j, y) in itertools.combinations(good, 2) if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
    comps = roots([i for i, _ in rows], links)
    counts = {i: sum(i in e for e in links) for i, _ in rows}
    assert sum(v[0] for v in found.values()) >= 0.98 * sum(counts.values())  # recall
    assert all(found[i][0] <= counts[i] for i in counts)
    assert {i: v[1] for i, v in found.items()} == comps
    assert all(kept == (i == c) for i, (_, c, kept) in found.items())
    assert cap_dedup.cap_near_duplicates(vectors(spark, rows).limit(0)).isEmpty()


def test_crowded_filters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cap_dedup, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(8) + rng.normal(0, 0.05, 8)).tolist()) for i in range(60)]
    found = cap_dedup.cap_near_duplicates(vectors(spark, rows), bucket=60).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(59, 0)}


@pytest.mark.parametrize("shard_rows", [64, 10_000])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(7)
    rows = [(i, np.round(rng.standard_normal(6), 1).tolist()) for i in range(300)]  # rounded: many ties
    rows += [(400, None), (500, [float("inf")] * 6), (None, [1.0] * 6), (600, [1.0, 2.0])]
    df = kd_search.top_k(vectors(spark, rows), "vec_id % 50 = 0", k=10, shard_rows=shard_rows, query_rows=3)
    ints = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and np.isfinite(v).all()}
    expected = set()
    for q in (i for i in ints if i % 50 == 0):
        near = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:10]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
    assert {tuple(r) for r in df.collect()} == expected
    assert kd_search.top_k(vectors(spark, rows).limit(0)).isEmpty()


def test_top_k_is_exact_for_huge_components_and_repeated_ids(spark):
    rows = [(1, [5e6]), (2, [1.0]), (3, [-3.5]), (3, [2.0]), (4, [1e200]), (5, [3e15]), (6, [3e15 + 1]), (7, [1.7e308])]
    wide = [(10 + i, np.full(64, 2.0e6 + i).tolist()) for i in range(3)]
    df = kd_search.top_k(vectors(spark, [(i, v) for i, v in rows + wide], "double"), "vec_id in (2, 3, 6, 10)", k=3, shard_rows=2)

    def ints(v):
        return [int(1024 * Fraction(x) // 1) for x in v]

    every = [(i, ints(v)) for i, v in rows + wide]
    expected = set()
    for q in (2, 3, 6, 10):
        near = sorted((-min(max(sum(a * b for a, b in zip(x, y, strict=True)), -(10**38) + 1), 10**38 - 1), i) for n, x in every if n == q for i, y in every if i != q and len(x) == len(y))[:3]
        expected |= {(q, n + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, i) in enumerate(near)}
    assert {tuple(r) for r in df.collect()} == expected


def test_top_k_reads_its_own_columns_only(spark):
    df = vectors(spark, [(0, [1.0]), (1, [2.0])]).selectExpr("*", "1 AS score", "2 AS rank", "3 AS shard", "4 AS id", "5 AS vec")
    assert [tuple(r) for r in kd_search.top_k(df).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]


@pytest.mark.parametrize("seed", range(3))
def test_linked_sets_share_an_entry(seed):
    """For any similarity, any sizes and any classes of tokens."""
    rng = np.random.default_rng(seed)
    linked = 0
    for _ in range(5000):
        percent, n = int(rng.integers(30, 100)), int(rng.integers(1, 60))
        pool = rng.choice(1 << 40, size=n + 40, replace=False).astype(np.uint64)
        gone, more = int(rng.integers(0, (100 - percent) * n // 100 + 2)), int(rng.integers(0, 40))
        if gone >= n or not gone + more or 100 * (n - gone) < percent * (n + more):
            continue
        linked += 1
        classes = dict(zip(pool.tolist(), rng.choice(3, size=len(pool), p=rng.dirichlet([0.5] * 3)).tolist(), strict=True))
        one, two = np.sort(pool[:n]), np.sort(np.concatenate((pool[gone:n], pool[n : n + more])))
        entries = [set(ngram_join._entries(s, np.array([classes[t] for t in s.tolist()], np.int8), np.ones(len(s), bool), percent).tolist()) for s in (one, two)]
        assert entries[0] & entries[1]
    assert linked > 500


def test_shared_entries_of_sorted_batches():
    rng = np.random.default_rng(4)
    for _ in range(100):
        rows = sorted({(int(rng.integers(0, 6)), int(k % 3 + 1), int(k)) for k in rng.integers(0, 12, size=rng.integers(0, 60))})
        again = sorted(rows + rows[::3])
        table = pa.table({"sig": pa.array([r[0] for r in again], pa.int64()), "key": pa.array([r[2] for r in again], pa.int64()), "n": pa.array([r[1] for r in again], pa.int32())})
        found = [t for b in ngram_join._shared_entries(iter(table.to_batches(max_chunksize=int(rng.integers(1, 9))))) for t in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        members = {s: [r for r in rows if r[0] == s] for s in {r[0] for r in rows}}
        assert found == [(s, r[2], r[1], m[0][2], m[0][1]) for s, m in sorted(members.items()) if len(m) > 1 for r in m]


@pytest.mark.parametrize(("vectors_", "least"), [(2_000, 0.99), (50_000, 0.99)])
def test_pairs_at_the_threshold_share_a_filter(vectors_, least):
    """The default parameters of the registered query."""
    code = cap_dedup.ProductCode(64, vectors_, 0.9, 48, 18, 6, 11)
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9005 * x + np.sqrt(1 - 0.9005**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    one, two = (set(zip(*(a.tolist() for a in code.decode(v)), strict=True)) for v in (x, y))
    assert len({row for row, _ in one & two}) >= least * 2000


def test_caps_in_thousands_of_dimensions_and_one(spark):
    rng = np.random.default_rng(8)
    wide = rng.standard_normal((40, 5000))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((wide, wide[:5] + rng.normal(0, 0.1, (5, 5000)))))]
    rows += [(100, [2.0]), (101, [3.0]), (102, [-1.0])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_dedup.cap_near_duplicates(vectors(spark, rows, "double"), bucket=4).collect()}
    assert all(found[i] == (1, i, True) and found[40 + i] == (1, i, False) for i in range(5))
    assert all(found[i] == (0, i, True) for i in range(5, 40))
    assert found[100] == (1, 100, True) and found[101] == (1, 100, False) and found[102] == (0, 102, True)
    assert cap_dedup.cap_near_duplicates(vectors(spark, rows).limit(0)).isEmpty()


def test_hot_and_null_keys_of_joins(spark):
    rows = spark.range(200_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id ELSE null END AS k")
    table = spark.createDataFrame([(7, "hot"), (10, "ten"), (8, "none")], "k long, v string")
    assert store.hot_keys(rows, "k") == [7]
    found = {r.v: r["count"] for r in store.lookup(rows, table, "k").groupBy("v").count().collect()}
    assert found == {"hot": 66_668, "ten": 1, None: 133_331}
    assert {r.v: r["count"] for r in store.matching(rows, table, ["k"]).groupBy("met.v").count().collect()} == {"hot": 66_668, "ten": 1}
    pairs = rows.selectExpr("k", "id % 2 AS odd")
    assert store.matching(pairs, table.selectExpr("k", "0L AS odd"), ["k", "odd"]).count() == rows.where("k in (7, 8, 10) and id % 2 = 0").count()
    assert store.matching(pairs, table.limit(0).selectExpr("k", "0L AS odd"), ["k", "odd"]).isEmpty()
    assert store.is_small(table) and not store.is_small(table, 100)


def test_clusters_need_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        store.shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert store.shared_dir(Session) == "hdfs://shared"


def test_bucket_gaps_take_a_byte_a_token_however_many_buckets_there_are():
    rng = np.random.default_rng(5)
    for bits in (20, 24, 28):
        places = np.sort(rng.integers(0, 1 << bits, 1_500_000, dtype=np.uint32))
        coded = ngram_join._coded(np.diff(places, prepend=np.uint32(0)))
        assert (ngram_join._decoded(coded) == places).all() and len(coded) < 1.4 * len(places)
    for places in ([], [0], [0, 0, 254, 255, 255, 510], [255], [3 * 255, 3 * 255, 4 * 255 - 1]):
        assert ngram_join._decoded(ngram_join._coded(np.diff(np.array(places, np.uint32), prepend=np.uint32(0)))).tolist() == places


def test_arrow_batches_stay_small(spark):
    store.narrow_batches(spark)
    docs = spark.range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    assert max(r.size for r in docs.mapInArrow(sizes, "size long").collect()) < 5 << 20
    assert ngram_join.jaccard_components(docs.limit(10), k=4, percent=85).where("component_id <> 0").isEmpty()
