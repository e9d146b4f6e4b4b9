"""Token alignment, whitening and language identification against brute force and held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import language_id, store, token_align, whitening

SF = "/root/testdata/sf0.001"


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((at, at + len(data), i))
        at += len(data)
    return out


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, by every pair of overlapping tokens of the libraries' own encodings."""
    t, rows = token_align.loaded(*token_align.default_paths()), []
    for x in texts:
        whole = (" " + (x or "")).encode()
        a = [(i, t.a_bytes[i]) for i in t.a_own.encode(" " + x, add_special_tokens=False).ids] if x else []
        b = [(i, t.b_bytes[i]) for i in t.b_own.encode(x)] if x else []
        if not x or b"".join(d for _, d in a) != whole or b"".join(d for _, d in b) != whole:
            rows.append(None)
            continue
        a, b = spans(a), spans(b)
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [tuple([i for _, e, i in side if lo < e <= hi] for side in (a, b)) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        links = [(i, j) for s, e, i in a for u, v, j in b if s < v and u < e]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest()))
    counts, most = Counter(p for r in rows if r for p in r[3]), defaultdict(int)
    for (_, j), c in counts.items():
        most[j] = max(most[j], c)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[p] == most[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) for r in rows]


def aligned(spark, docs, frequent=token_align.FREQUENT):
    linked = store.saved(token_align.links(docs), "links")
    counts = token_align.pair_counts(linked, token_align.loaded(*token_align.default_paths()).size_b)
    return token_align.scored(linked, counts, frequent)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    expected = brute_alignment(texts)
    for frequent in (token_align.FREQUENT, 1000, 1):  # most pairs, some or none known to every task
        assert [tuple(r)[1:] for r in aligned(spark, docs, frequent).select("doc_id", *COLUMNS).orderBy("doc_id").collect()] == expected


def test_alignment_of_odd_texts(spark):
    rng = random.Random(3)
    words = ["a", " ", "  ", "\n", "\t", "the", "é", "日本", " ", "　", "<|endoftext|>", "<s>", "<0x41>", "🙂", "don't", "12", "\x00", "\u0085", ".", "-", "Straße", " ", "▁"]
    texts = [None, "", " ", "   ", "x", " x", "x ", "▁", "a ▁b", "<unk>", "\n\n", "a  b", "  b", *("".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(120)), *(" ".join(rng.choice(words[:-1]) for _ in range(30)) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = [tuple(r)[1:] for r in aligned(spark, docs).select("doc_id", *COLUMNS).orderBy("doc_id").collect()]
    assert found == brute_alignment(texts)
    assert found[0] == found[1] == found[7] == (0, 0, 0, 0, 0, 0, "") and sum(f[0] > 0 for f in found) > 100


def test_alignment_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b b c", 5), (1, "b b c", 6), (None, "b b c", 7), (2, None, 8)], "doc_id long, text string, keys int")
    found = aligned(spark, docs)
    assert found.columns == ["doc_id", *[c for c in COLUMNS if c not in ("n_best", "count_sum", "groups_sha256")], "groups_sha256", "n_best", "count_sum"]
    assert sorted((r.doc_id or -1, r.n_links, r.count_sum) for r in found.collect()) == [(-1, 3, 15), (1, 3, 15), (1, 3, 15), (2, 0, 0)]
    assert aligned(spark, docs.limit(0)).isEmpty()
    groups = token_align.align(docs.withColumn("groups", F.lit(1))).orderBy("keys").collect()
    assert [len(r.groups) for r in groups] == [3, 3, 3, 0] and groups[0].groups[0] == groups[0].groups[1] and groups[0]["keys"] == 5
    # long texts, in segments: as in one piece
    long = " ".join(f"w{i % 977}é{i}" for i in range(40_000)) + "  x" * 500
    t = token_align.loaded(*token_align.default_paths())
    whole = token_align.block_found(t, [long.encode()])[0]
    monkeypatch.setattr(token_align, "BLOCK", 10_000)
    assert len(list(token_align.segments(t, long.encode()))) > 20
    parts = token_align.long_found(t, long.encode())
    assert (parts.n_a, parts.n_b, parts.n_groups, parts.n_links, parts.sha256) == (whole.n_a, whole.n_b, whole.n_groups, whole.n_links, whole.sha256)
    assert (parts.keys == whole.keys).all() and (parts.times == whole.times).all()
    assert token_align.long_found(t, (long + " ▁").encode()) is None
    # what is remembered is emptied at any time without a change
    monkeypatch.setattr(token_align, "REMEMBERED", 0)
    again = token_align.block_found(t, [b"b b c", long.encode()])
    assert again[1].sha256 == whole.sha256 and again[0].n_links == 3


def test_rows_with_equal_hashes_are_told_apart():
    flat = np.array([1, 2, 1, 3, 1, 2, 9])
    pick, kind = token_align.distinct(np.array([7, 7, 7, 8], np.uint64), flat, np.array([0, 2, 4, 6]), np.array([2, 2, 2, 1]))
    assert kind[0] == kind[2] and kind[1] not in (kind[0], kind[3]) and [flat[[0, 2, 4, 6][pick[k]]] for k in kind] == [1, 1, 1, 9]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")


def check_whitening(found, vectors, components=8):
    """found rows against numpy on vectors {id: list}."""
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[k] for v in x.values()) for k in range(d)]
    centred = np.array([[(n * v[k] - s[k]) / n for k in range(d)] for v in x.values()])
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1], columns[:, ::-1]
    by = {(r.vec_id, r.component): r for r in found}
    assert len(by) == len(found) == n * min(components, d)
    for k in range(min(components, d)):
        own = np.array([by[i, k + 1].whitened for i in x])
        want = centred @ columns[:, k] / math.sqrt(values[k])
        assert min(abs(own - want).max(), abs(own + want).max()) < 1e-7
    for (i, k), r in by.items():
        assert r.deviation == sum((n * c - t) ** 2 for c, t in zip(x[i], s, strict=True)) and r.n == n
        assert math.isclose(r.explained, values[k - 1] / np.trace(cov), rel_tol=1e-9) and r.identity_error < 1e-4


def test_whitening_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(whitening.op12_whitening(spark, SF).collect(), {r.vec_id: list(r.embedding) for r in rows})


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    good = {i: (rng.normal(size=5) * [1, 2, 3, 4, 5] + [0, 1e3, -50, 0.5, 1e5]).tolist() for i in range(60)}
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0, 3.0, 4.0], 1), (103, [float("nan")] * 5, 1), (104, [float("inf")] + [0.0] * 4, 1), (105, [1e300] * 5, 1), (106, [1.0, 2.0], 1)]
    table = vectors_of(spark, [(i, v, 1) for i, v in good.items()] + bad).repartition(4)
    check_whitening(whitening.whitened(table).collect(), good)
    assert whitening.whitened(table, components=2).agg(F.max("component")).first()[0] == 2
    # repeated rows and null ids count, each for itself
    twice = whitening.whitened(vectors_of(spark, [(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (None, [0.0, 3.0], 1)])).collect()
    assert len(twice) == 6 and {r.n for r in twice} == {3} and sum(r.vec_id is None for r in twice) == 2
    # no variance in a dimension, or none at all
    flat = whitening.whitened(vectors_of(spark, [(i, [float(i), 1.0], 1) for i in range(4)])).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat} == {(1, False, 1.0), (2, True, 0.0)} and all(r.identity_error < 1e-9 for r in flat)
    one = whitening.whitened(vectors_of(spark, [(1, [2.0, 3.0], 1)])).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in one} == {(None, 0.0, 0, None)}
    none = whitening.whitened(table.where("vec_id > 99 and vec_id < 106"))
    assert none.isEmpty() and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert none.dtypes == whitening.whitened(table).dtypes


def test_sums_of_squares_are_exact(spark):
    # centred values beyond 32 bits: squares and their sums beyond 64
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1e13, 1e13), rng.uniform(-1e14, 1e14), rng.uniform(-1, 1)], 1) for i in range(40)]
    f = whitening.fit(vectors_of(spark, rows))
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows]
    assert f.sums == [sum(v[k] for v in x) for k in range(3)] and f.n == 40
    trace = sum(sum((40 * v[k] - f.sums[k]) ** 2 for v in x) for k in range(3)) / 40**3
    assert math.isclose(f.trace, trace, rel_tol=1e-15)
    found = whitening.whitened(vectors_of(spark, rows)).collect()
    assert {r.deviation for r in found} == {None} and max(r.identity_error for r in found) < 1e-4
    z = np.array([[3, -5, 2], [2**40, 7, -(2**41)]])
    assert whitening.pair_squares(z) == [sum((r[i] + (r[j] if i != j else 0)) ** 2 for r in z.tolist()) for i in range(3) for j in range(i, 3)]


def test_languages_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    found = language_id.op13_language_id(spark, sf)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    rows = found.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.rejected == (r.score < 0.5) and r.lang_pred in {"en", "de", "fr", "es"} for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    sure = [r for r in held if not r.rejected]
    assert len(sure) / len(held) > 0.98 and sum(r.lang == r.lang_pred for r in sure) / len(sure) > 0.99


@pytest.fixture(scope="module")
def two_languages(spark):
    ones, others = ["der", "und", "nicht", "schon", "auch", "haus"], ["the", "and", "with", "house", "then", "there"]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(of) for _ in range(40)), lang, 3) for i in range(60) for of, lang in ((ones, "de"), (others, "en"))]
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, lang string, score int")
    return docs, language_id.train(docs, F.lit(True))


def test_language_edges(spark, two_languages):
    docs, model = two_languages
    assert sorted(lang for lang, _ in model) == ["de", "en"]
    texts = [None, "", "12 34 !!", "DER UND!! NICHT schon", "the house, and then there" * 20_000, "q", "thén with the house"]
    rows = spark.createDataFrame([(i, t, "zz", 9) for i, t in enumerate(texts)], "doc_id long, text string, rejected string, extra int")
    found = {r.doc_id: r for r in language_id.identify(rows, model).collect()}
    assert [found[i].lang_pred for i in range(7)] == ["und", "und", "und", "de", "en", "und", "en"]
    assert found[5].rejected and found[5].score < 0.5 and not found[0].rejected and found[4].score > 0.9 and found[4].extra == 9
    assert {r.lang_pred for r in language_id.identify(rows.where("doc_id = 5"), model, reject=False).collect()} <= {"de", "en"}
    assert language_id.identify(rows.limit(0), model).isEmpty()
    # nothing to learn from; null labels, texts without letters; one language only
    nothing = docs.limit(3).withColumn("lang", F.lit(None).cast("string")).unionByName(docs.limit(1).withColumn("text", F.lit("1 2")))
    assert language_id.train(nothing, F.lit(True)) == []
    assert {(r.lang_pred, r.score) for r in language_id.identify(rows, []).collect()} == {("und", 0.0)}
    single = language_id.identify(rows, [m for m in model if m[0] == "de"]).where("doc_id in (3, 5)").collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in single} == {("de", 1.0, False)}


def test_one_copied_text_gives_one_window(spark, two_languages):
    docs, _ = two_languages
    copies = spark.range(1000).select((F.col("id") + 1000).alias("doc_id"), F.lit("etwas ganz anderes " * 40).alias("text"), F.lit("de").alias("lang"), F.lit(0).alias("score"))
    text = dict(language_id.train(docs.unionByName(copies).repartition(7), F.lit(True)))["de"]
    assert text.count("etwas") <= language_id.WINDOW // len("etwas ganz anderes ") + 1 and "haus" in text
    again = language_id.train(docs.unionByName(copies).repartition(2), F.lit(True))
    assert dict(again)["de"] == text
    assert len(language_id.train(docs, F.lit(True), languages=1)) == 1
