"""Text operators against SQL, brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import io
import math
import os
import random
import zipfile
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnow.llm import lattice_lm, line_dedup, mixing, nbest_pieces, ngram_join, registry, suffix_dedup, toxicity, warc_zip
from winnow.llm.lattice import default_model, pieces

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df, expected = registry.QUERIES[name](spark, SF), c.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, expected.select(*columns).fetchall()))


def edge_docs(spark):
    rows = [(1, "a b c d", "en", "src0"), (2, None, None, None), (3, "", "de", "src1"), (None, "x y z", "en", "src0"), (1, "a b c d", "en", "src0"), (4, "é " * 3000, "fr", "weird")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, row int")


def test_mixing_edges(spark):
    docs = edge_docs(spark)
    out = mixing.mix(docs, mixing.WEIGHTS, levels=mixing.document_levels(), budget_percent=100, max_epochs=1)
    assert out.columns == [*docs.columns, "mix_epoch", "mix_taken"]
    assert out.agg(F.sum("mix_taken")).first()[0] <= 3011
    assert mixing.mix(docs.limit(0), mixing.WEIGHTS, levels=mixing.document_levels()).isEmpty()
    everything = mixing.mix(docs, mixing.WEIGHTS, levels=mixing.document_levels(), budget_percent=200, max_epochs=2)
    assert everything.agg(F.sum("mix_taken")).first()[0] == 2 * 3011


def test_shortages_stay_among_siblings(spark):
    rows = [(i, "w " * n, lang, src) for i, (n, lang, src) in enumerate([(10, "a", "s1"), (1000, "a", "s2"), (1000, "b", "s3")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, [{}, {}], levels=[F.col("lang"), F.col("source")], budget_percent=50, max_epochs=1)
    taken = {r.source: r.t for r in out.groupBy("source").agg(F.sum("mix_taken").alias("t")).collect()}
    assert taken == {"s1": 10, "s2": 492, "s3": 502}


def test_weight_zero_counts_in_no_capacity(spark):
    rows = [("x", "a", 600), ("x", "b", 50), ("y", "c", 550), ("y", "d", 200)]
    docs = spark.createDataFrame([(i, "w " * n, dom, src) for i, (dom, src, n) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, [{}, {"a": 0}], levels=[F.col("lang"), F.col("source")], budget_percent=50, max_epochs=1)
    taken = {r.source: r.t for r in out.groupBy("source").agg(F.sum("mix_taken").alias("t")).collect()}
    assert taken == {"b": 50, "c": 450, "d": 200}  # 700 tokens: x has 50 to give, so y gets 650


def test_clashing_columns_pass_through(spark):
    extra = ["mix_tokens", "mix_l0", "mix_c0", "mix_place", "line_row", "line_gone", "own_0", "row", "gone", "id", "tokens", "masked", "leaf", "template", "kind"]
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "src0", 7, 8, *range(len(extra))) for i in range(12)], "doc_id long, text string, lang string, source string, n_lines int, mix_epoch int, " + ", ".join(f"{c} int" for c in extra))
    mixed = mixing.mix(docs, mixing.WEIGHTS, levels=mixing.document_levels(), budget_percent=100, max_epochs=1)
    assert mixed.columns == [c for c in docs.columns if c != "mix_epoch"] + ["mix_epoch", "mix_taken"]
    cut = line_dedup.drop_recurring_lines(docs, min_docs=10)
    assert cut.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    for out in (mixed, cut):
        assert [tuple(r) for r in out.select(*extra).distinct().collect()] == [tuple(range(len(extra)))]
    assert mixed.count() == 12 and cut.agg(F.sum("n_dropped")).first()[0] == 11


def test_very_long_lines_and_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(i, f"{chr(97 + i)} own\n{long}" if i < 3 else long[: -i - 10], "en") for i in range(5)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(docs, min_docs=3).collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}
    comp = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, k=4, percent=85).collect()}
    assert comp == {0: (199_999, 0), 1: (199_999, 0), 2: (199_999, 0), 3: (comp[3][0], 0), 4: (comp[4][0], 0)}
    scored = lattice_lm.score_documents(docs, F.col("doc_id") != 4).collect()
    assert all(r.n_tokens > 199_000 and r.score < 0 and math.isfinite(r.score) for r in scored)


def test_line_dedup_edges(spark):
    line = "All rights reserved by number {} here"
    rows = [(i, f"{chr(97 + i)} own text of a document\n" + line.format(i)) for i in range(12)] + [(50, None), (51, ""), (None, line.format(99)), (0, f"a own text of a document\n{line.format(0)}")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, pos int")
    out = line_dedup.drop_recurring_lines(docs, min_docs=10)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    found = {(r.doc_id, r.n_dropped) for r in out.collect()}
    assert found == {(0, 0), *((i, 1) for i in range(1, 12)), (50, 0), (51, 0), (None, 1)}
    assert {r.text for r in out.where("doc_id = 50 or doc_id = 51").collect()} == {None, ""}
    assert line_dedup.drop_recurring_lines(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("strict", [False, True])
def test_texts_are_shuffled_once_at_every_size(spark, strict):
    docs = spark.createDataFrame([(i, f"own text of document {i}\nthe same line in all of them") for i in range(12)], "doc_id long, text string")
    out = line_dedup.drop_recurring_lines(docs, strict=strict)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan
    assert sorted(r.text.count("\n") for r in out.collect()) == [0] * 11 + [1]


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "pieces"])
def test_stages_that_send_texts_to_python_use_small_batches(spark, name):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    spark.conf.unset(key)
    try:
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        assert int(spark.conf.get(key)) <= 4 << 20
        assert 0 < out.count() <= 20
        spark.conf.set(key, "1m")
        dict(corpus_pipeline.STAGES)["pieces"](spark, docs, SF)
        assert spark.conf.get(key) == "1m"  # a limit that is set stays
    finally:
        spark.conf.unset(key)


def test_clean_lines_stay_in_the_pipeline(spark):
    import corpus_pipeline

    homes = [f"I would like {a} {b} {c}" for a, b, c in zip("abcdefghijkl", "mnopqrstuvwx", "lkjihgfedcba", strict=True)]  # same three leading tokens only
    seen = [f"Posted by user {w} on our public board" for w in "abcdefghijkl"]  # a template, and one copy of the first
    rows = [(i, f"{homes[i]}\n{i} {i + 7} {i + 90}\n{seen[i]}\nPage {i} of the book") for i in range(12)] + [(12, seen[0])]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    for i in range(12):
        assert found[i][:3] == [homes[i], f"{i} {i + 7} {i + 90}", seen[i]]
        assert (f"Page {i} of the book" in found[i]) == (i == 0)
    assert found[12] == [""]


def test_long_and_short_repeats_go_in_the_pipeline(spark):
    import corpus_pipeline

    long, middle = " ".join(f"w{chr(97 + i % 26)}" for i in range(60)), " ".join(f"m{chr(97 + i)}" for i in range(12))
    texts = [f"own {chr(97 + i % 26)}{chr(97 + i // 26)} text\n\nAnd ornd." + (f"\n{long}" if i < 2 else "") + (f"\n{middle}" if i < 4 else "") + ("\nfew" if i < 20 else "") for i in range(40)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    for i, lines in found.items():
        assert lines[0] == texts[i].split("\n")[0] and lines[1] == ""
        assert ("And ornd." in lines, long in lines) == (i == 0, i == 0)
        assert (middle in lines, "few" in lines) == (i < 4, i < 20)


def covered(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, bytes(b for b, m in zip(t, mark, strict=True) if not m)))
    return out


@pytest.mark.parametrize(("crowd", "segment"), [(20_000, suffix_dedup.SEGMENT), (1, suffix_dedup.SEGMENT), (3, 1000)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd, segment):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (60, 99, 100, 101, 180, 400)]
    texts = [noise(rng.randrange(150)) + rng.choice(shared) + noise(rng.randrange(150)) + rng.choice(shared) for _ in range(60)]
    texts += ["x" * 99, "x" * 100, "x" * 101, "ab" * 300, None, "", noise(5000) + shared[4] + noise(3000), texts[0], texts[0], "\0" * 250]
    entries = suffix_dedup._entries
    monkeypatch.setattr(suffix_dedup, "_entries", lambda length: entries(length, segment))
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length=100, crowd=crowd, batches=3).collect()}
    assert found == dict(enumerate(covered([(t or "").encode() for t in texts], 100)))


def test_every_shared_passage_is_marked(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (20, 51, 60, 300)]
    texts = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(200))]
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join([*w[:at], *(passages[i % 6] if i % 6 < 4 else []), *w[at:]]))
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (91, "")], "row long, text string")
    found = {r.row: r.n_passages for r in suffix_dedup.shared_passages(docs).collect()}

    def grams(t, k):
        w = (t or "").split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    for k, inside in ((51, False), (26, True)):  # who shares 51 words is marked; who is marked shares 26
        seen = Counter(g for t in texts for g in grams(t, k))
        shares = {i for i, t in enumerate(texts) if any(seen[g] > 1 for g in grams(t, k))}
        assert set(found) <= shares if inside else shares <= set(found)
    assert suffix_dedup.shared_passages(docs.limit(0)).isEmpty()


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in scored) / len(scored)
    caught = sum(r.predicted and r.toxic for r in scored) / sum(r.toxic for r in scored)
    precise = sum(r.predicted and r.toxic for r in scored) / max(1, sum(r.predicted for r in scored))
    assert right > 0.97 and caught > 0.9 and precise > 0.9
    assert all(0 <= r.score <= 1 for r in scored)


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.with_score(docs, model, name="row").collect()
    assert len(out) == 6 and all(0 <= r.row <= 1 for r in out)
    assert {r.toxic_score for r in toxicity.with_score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.with_score(docs.limit(0), model).isEmpty()


def test_training_equals_a_plain_loop_however_rows_are_stored(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["vile", "nice", "tree", "stone", "river", "cloud"]) for _ in range(12)) for _ in range(300)]
    rows = [(i, t, int("vile" in t and i % 7 > 0)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    how = {"bits": 12, "rounds": 2, "l1": 1.0}
    one = toxicity.train(docs.repartition(1), labels, shard_rows=100, **how)
    two = toxicity.train(docs.repartition(23, "text"), labels.repartition(7), shard_rows=100, **how)
    assert one.at.tolist() == two.at.tolist() and one.w.tolist() == two.w.tolist() and 0 < len(one.at) < 1 << 12

    # one shard: plain FTRL-proximal over the rows in the order of their places
    found = toxicity.train(docs, labels, shard_rows=1000, **how)
    place = {r.doc_id: r.place for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1 << 40)).alias("place")).collect()}
    weight = {y: len(rows) / 2 / sum(r[2] == y for r in rows) for y in (0, 1)}
    z, n = Counter(), Counter()
    alpha, beta, l1, l2 = 1.0, 1.0, how["l1"], 0.1

    def w(i):
        penalty = l1 if i else 0.0
        return 0.0 if abs(z[i]) <= penalty else -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(how["rounds"]):
        for i, t, y in sorted(rows, key=lambda r: place[r[0]]):
            x = [0, *sorted(set(toxicity.features(toxicity.words_of([t.encode()]), 12)[1].tolist()))]
            old = {j: w(j) for j in x}
            g = (1 / (1 + math.exp(-sum(old.values()))) - y) * weight[y]
            for j in x:
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * old[j]
                n[j] += g * g
    plain = {j: w(j) for j in z if w(j)}
    assert set(found.at.tolist()) == set(plain)
    assert found.w.tolist() == pytest.approx([plain[j] for j in found.at.tolist()], rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("frequent", [100_000, 1])
def test_lattice_scores_equal_brute_force(spark, frequent):
    """Every segmentation is listed; frequent=1 sends all words through the packed blocks."""
    p = pieces(default_model())
    texts = [("the cat", "en"), ("The the cats", "en"), ("das haus", "de"), ("", "de"), (None, "de"), ("日 the", None), ("das cat ende", "en"), ("neu", "de")]
    train, prior, share = range(6), 0.1, 0.02
    n_pieces = len(p.id)
    ranks = sorted(range(n_pieces), key=lambda j: -p.score[j])
    w = [0.0] * n_pieces
    for rank, j in enumerate(ranks):
        w[j] = 1 / (rank + 2.0)
    names = [p.text[i] for i in p.id]
    w = w + [min(w)] * 256 + [max(w)]
    first = [t.startswith("▁") for t in names] + [False] * 257

    def normal(w):
        a, b = sum(x for x, f in zip(w, first, strict=True) if f), sum(x for x, f in zip(w, first, strict=True) if not f)
        return [x / (a if f else b) for x, f in zip(w, first, strict=True)]

    def paths(word, q):
        """(probability, indices) of every segmentation."""
        at = {t: j for j, t in enumerate(names)}
        out = []

        def grow(rest, prob, used):
            if not rest:
                out.append((prob, used))
            for k in range(1, min(len(rest), 20) + 1):
                if rest[:k] in at:
                    grow(rest[k:], prob * q[at[rest[:k]]], [*used, at[rest[:k]]])
            if rest and rest[0] not in at:
                b = [n_pieces + x for x in rest[0].encode()]
                grow(rest[1:], prob * math.prod(q[x] for x in b), [*used, *b])

        grow("▁" + word, 1.0, [])
        return out

    words = {i: (t or "").lower().split() for i, (t, _) in enumerate(texts)}
    counts = Counter(x for i in train for x in words[i])
    by = {k: Counter(x for i in train if texts[i][1] == k for x in words[i]) for k in (None, "de", "en")}
    docs_of = Counter(texts[i][1] for i in train)
    q = start = normal(w)
    uses = [0.0] * len(w)
    for word in counts:
        found = paths(word, q)
        total = sum(x for x, _ in found)
        for x, used in found:
            for j in used:
                uses[j] += x / total
    uses[-1] = len(counts)
    q = normal([u + prior * sum(uses) * x / sum(start) for u, x in zip(uses, start, strict=True)])
    tokens, d = sum(counts.values()), 0.75

    def general(word):
        spelt = sum(x for x, _ in paths(word, q)) * q[-1] * d * len(counts) / tokens
        return spelt + (max(counts[word] - d, 0) / tokens)

    def score(i):
        total, ends = 0.0, len(train)
        rest = max(1.0, 0.1 * ends)
        classes = [(docs_of[k], sum(c.values()), len(c), c, docs_of[k]) for k, c in by.items() if docs_of[k] >= share * ends] + [(rest, tokens, None, None, ends)]
        mass = sum(x[0] for x in classes[:-1]) + rest + 0.01 * len(classes)
        for weight, own, distinct, c, finals in classes:
            end = (finals + 0.1) / (own + finals + 0.2)
            x = (weight + 0.01) / mass * end
            for word in words[i]:
                x *= (1 - end) * (general(word) if c is None or not own else d * distinct / own * general(word) + max(c[word] - d, 0) / own)
            total += x
        return math.log10(total)

    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.score for r in lattice_lm.score_documents(docs, F.col("doc_id") < 6, frequent=frequent).collect()}
    assert found == pytest.approx({i: score(i) for i in range(len(texts))}, rel=1e-5)


def test_lattice_scores(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(["the cat the dog", "The CAT sat", "", None, "日本 zzqx ▁ the", "the cat the dog", "a b"])], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in lattice_lm.score_documents(docs.union(docs.where("doc_id = 0")), F.col("doc_id") < 4).collect()}
    train = Counter(w for t in ["the cat the dog", "the cat sat", "", "", "the cat the dog"] for w in [*t.split(), None])
    n, v = sum(train.values()), len(train)
    for i, t in [(0, "the cat the dog"), (1, "the cat sat"), (2, ""), (3, ""), (4, "日本 zzqx ▁ the"), (6, "a b")]:
        tokens = [*t.split(), None]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i >= 4, len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert out[0].score == pytest.approx(out[5].score)
    assert lattice_lm.score_documents(docs.limit(0), F.col("doc_id") < 4).isEmpty()


def test_rare_words_meet_texts_in_bounded_groups(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(40, "doc_id")
    on = F.col("doc_id") % 4 != 0
    whole = sorted(map(tuple, lattice_lm.score_documents(docs, on, frequent=10).collect()))
    scores = lattice_lm._rare_scores

    def bounded(share):
        def run(counts, packed):
            assert packed.num_rows < 20  # of 40 blocks
            return scores(share)(counts, packed)

        return run

    monkeypatch.setattr(lattice_lm, "_rare_scores", bounded)
    cut = sorted(map(tuple, lattice_lm.score_documents(docs, on, frequent=10, tokens_per_slice=500).collect()))
    assert [r[:5] for r in whole] == [r[:5] for r in cut] and len(cut) == 200
    assert all(a[5:] == pytest.approx(b[5:], rel=1e-9) for a, b in zip(whole, cut, strict=True))


def test_spelling_sums_over_segmentations():
    m = lattice_lm.LatticeModel.initial(default_model())
    p = pieces(default_model())
    log = {p.text[i]: w for i, w in zip(p.id, m.piece, strict=True)}

    def brute(text):
        total = [1.0] + [0.0] * len(text)
        for e in range(1, len(text) + 1):
            total[e] = sum(total[s] * math.exp(log[text[s:e]]) for s in range(e) if text[s:e] in log)
        return math.log(total[-1]) + m.end

    for word in ("hello", "a", "internationalization"):
        assert m.log_prob([word.encode()])[0] == pytest.approx(brute("▁" + word))


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_round_trip(spark, zip64):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "http://c", None), (4, "u", ""), (5, "v", "é" * 5000), (None, "w", "same"), (9, "z", "alone\r\n\r\nx"), (2, "again", "same")]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, sha string")
    packages = warc_zip.write_packages(pages, zip64=zip64)
    found = warc_zip.read_packages(packages, read_bytes=200).collect()
    assert len(found) == len(rows)
    keeper = {"same": 2, "": 4}
    expected = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i is None or keeper.get(h or "", i) == i else "revisit") for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type) for r in found) == expected
    assert {(r.page_id, r.refers_to) for r in found if r.record_type == "revisit"} == {(1, 2), (3, 4)}
    assert {bytes(r.payload).decode() for r in found if r.payload is not None} == {"same", "", "é" * 5000, "alone\r\n\r\nx"}
    with zipfile.ZipFile(packages.first().path.removeprefix("file://")) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc_zip.ARCHIVE, warc_zip.INDEX, warc_zip.PACKAGE}
    assert warc_zip.read_packages(warc_zip.write_packages(pages.limit(0))).isEmpty()


def test_directory_behind_a_comment_that_looks_like_its_end():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", b"abc")
        z.comment = b"x" + b"PK\5\6" + b"\0" * 30
    found = warc_zip.directory(pa.BufferReader(buffer.getvalue()))
    assert {k: n for k, (_, n) in found.items()} == {"a.txt": 3}


def test_small_payloads_are_not_shared(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "u", "abc"), (4, "v", "abc")], "page_id long, url string, html string")
    found = {r.page_id: r.record_type for r in warc_zip.read_packages(warc_zip.write_packages(pages, min_bytes=3)).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_directory_of_a_foreign_zip():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"one", zipfile.ZIP_STORED)
        z.writestr("b", b"two" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 a note"
    with pytest.raises(ValueError):
        warc_zip.directory(pa.PythonFile(io.BytesIO(b"no zip at all"), mode="r"))
    raw2 = io.BytesIO()
    with zipfile.ZipFile(raw2, "w") as z:
        z.writestr("a", b"one", zipfile.ZIP_STORED)
        z.writestr("b", b"two" * 100, zipfile.ZIP_DEFLATED)
    found = warc_zip.directory(pa.PythonFile(io.BytesIO(raw2.getvalue()), mode="r"))
    at, size = found["a"]
    assert set(found) == {"a"} and raw2.getvalue()[at : at + size] == b"one"


def test_n_best_equals_brute_force():
    p = pieces(default_model())
    score = {p.text[i]: float(w) for i, w in zip(p.id, p.score, strict=True)}

    def brute(text, n):
        best = []

        def walk(rest, total):
            if not rest:
                best.append(total)
                return
            for e in range(1, min(p.longest, len(rest)) + 1):
                if rest[:e] in score:
                    walk(rest[e:], total + score[rest[:e]])
            if rest[0] not in score:
                walk(rest[1:], total + p.unknown)

        walk("▁" + text.replace(" ", "▁"), 0.0)
        return sorted(best, reverse=True)[:n]

    for text in ("hello", "ab cd", "the end", "a  b", "over é x", "to\nbe", "x"):
        block = nbest_pieces.Block(p, [text.encode(), text.encode()])
        block.search(5)
        assert [s for s, _ in block.n_best(0, 5)] == brute(text, 5)


def test_encoding_round_trip(spark):
    texts = [None, "", " ", "a  b\n\tc ▁x 日本語 \U0001f600é", " lead", "trail ", "x" * 3000, "▁▁", "\0\x7f"]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, pieces array<int>")
    out = nbest_pieces.decode(nbest_pieces.encode(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == texts
    assert [r.n_pieces == len(r.pieces or []) for r in out] == [True] * len(texts)
    assert all(r.scores is None or list(r.scores) == sorted(r.scores, reverse=True) for r in out)
    assert nbest_pieces.encode(docs.limit(0)).isEmpty()


def test_all_segmentations_are_returned(spark):
    p = pieces(default_model())
    weight = {int(i): float(w) for i, w in zip(p.id, p.score, strict=True)}
    texts = ["hello world", "the end of it", "a  b", "", "over and over", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = nbest_pieces.decode(nbest_pieces.segmentations(nbest_pieces.encode(docs, n=4))).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and (len(own) == 4 or t in ("", None, "x", "a  b"))
        assert len({tuple(r.pieces) for r in own}) == len(own) and all(r.decoded == t for r in own)
        assert all(sum(weight[k] for k in r.pieces) == pytest.approx(r.score) for r in own)
    found = nbest_pieces.op10_nbest_pieces(spark, SF)
    assert found.where("n_best_sha256 IS NULL").isEmpty() and found.where("n_best_sha256 <> pieces_sha256").count() == 200


def test_registered_round_trip(spark):
    found = nbest_pieces.op10_nbest_pieces(spark, SF).collect()
    assert len(found) == 200 and all(r.round_trip for r in found)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert 0 < len(rows) < docs.count()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.isEmpty()


def test_pipeline_stages_with_edge_cases(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns whose names clash with those used inside."""
    import corpus_pipeline

    extra = ["toxic_score", "mix_epoch", "mix_tokens", "line_gone", "n_lines", "row", "key", "id", "hash", "root", "extra_5"]
    texts = ["a b c d e f g h", "a b c d e f g h", None, "", " ", "long " * 30_000, "own words of one more text", "own words of one more text"]
    rows = [(i if i != 3 else None, t, None if i == 4 else "en", None if i == 5 else "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows_kept = kept.collect()
        assert all(tuple(r)[5:] == tuple(range(len(extra))) for r in rows_kept), name
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in rows_kept) == sorted(str(r[0]) for r in rows if r[0] not in (1, 7))
        elif name != "mixing":
            assert len(rows_kept) == len(rows), name
    out = {(r.doc_id, r.n_pieces) for r in corpus_pipeline.encode_pieces(spark, docs, SF).collect()}
    assert (2, 0) in out and (None, 0) in out and any(i == 5 and n > 20_000 for i, n in out)


def test_pipeline_equals_brute_force(spark):
    """Each stage on all that the one before kept; the registered query ends with the rows of the last."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    tox, lines, near, mixed, _ = [stage for _, stage in corpus_pipeline.STAGES]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    clean = {r.doc_id for r, x in zip(rows, model.scores([(r.text or "").encode() for r in rows]).tolist(), strict=True) if x < 0.5}
    kept = tox(spark, docs, SF).cache()
    assert {r.doc_id for r in kept.collect()} == clean

    cut = lines(spark, kept, SF).cache()
    texts = {r.doc_id: r.text for r in cut.collect()}
    before = {r.doc_id: (r.text or "").split("\n") for r in kept.collect()}
    long = Counter(line for own in before.values() for line in {" ".join(x.split()) for x in own} if len(line.split()) >= 50)
    left = Counter(line for t in texts.values() for line in {" ".join(x.split()) for x in (t or "").split("\n")} if line in long)
    assert set(texts) == set(before) and all(left[line] == 1 for line in long)  # long lines stand in one document each, and none is lost

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                one, two = sorted((root[a], root[b]))
                root = {i: one if r == two else r for i, r in root.items()}
    single = near(spark, cut, SF).cache()
    assert {r.doc_id for r in single.collect()} == {i for i, r in root.items() if i == r}

    sql = mixing.ORACLE_SQL.replace("* 60 // 100", "* 80 // 100").replace("* 2 AS cap", "AS cap")
    c = duckdb.connect()
    c.register("documents", single.toArrow())
    expected = {r[0] for r in c.execute(f"SELECT doc_id FROM ({sql})").fetchall()}
    assert {r.doc_id for r in mixed(spark, single, SF).collect()} == expected

    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == expected
    decoded = {r.doc_id: r.decoded for r in nbest_pieces.decode(out).collect()}
    assert decoded == {i: texts[i] for i in expected}


def test_folds():
    assert zlib.crc32(b"1") % 5 == 3  # the fold is that of the text of the id


def test_scores_do_not_depend_on_which_words_are_rare(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + rng.randrange(26))}{rng.randrange(40)}" for _ in range(30)), "en") for i in range(60)], "doc_id long, text string, lang string")
    on = F.col("doc_id") % 3 != 0
    rare, often = ({r.doc_id: r.score for r in lattice_lm.score_documents(docs, on, frequent=n).collect()} for n in (1, 10**9))
    assert rare == pytest.approx(often, rel=1e-12)
