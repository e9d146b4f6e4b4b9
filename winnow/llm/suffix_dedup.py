"""Removal of long repeated byte strings with a logarithmic family of sampled suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another one.

Suffix arrays. Only suffixes at anchors are kept: in each window of ``length`` bytes the gram with the smallest hash (the leftmost
of equals). Equal windows have their anchor at the same place, so every repeated window is found from an anchor, at a
small part of the positions. An anchor has two entries, each a pointer (row, position) to a core of ``length`` / 2 bytes with a hash of
it as the key: the core that starts at the anchor, and the one that ends there. A repeated window shares one of them with its
twin and reaches x bytes before the core and ``length`` / 2 - x bytes behind it. ``around`` is a hash of all bytes
that such windows can have. An array is sorted by key, so suffixes that begin with the same core stand together, as those with equal prefixes do in any suffix order.

Index family. Texts come in batches. A new batch gets its sorted array, a table in buckets of the key, and is merge-scanned against itself and the arrays of all
levels, bucket by bucket: entries whose core stands on both sides are matches of at least ``length`` / 2 bytes and go to the candidates. Then the batch becomes a level, and levels of
equal size merge, so there are logarithmically many.

Matches. Entries with equal surroundings repeat as a whole. Of each key with different surroundings
one entry for each kind fetches its bytes around the core; the kinds are sorted by the bytes behind the core (a suffix array) and by those
before it, read backwards, with the lengths of common prefixes of neighbours. For each x, entries repeat when they share both
the class of the bytes behind and the class of the x bytes before. A key with more than ``crowd`` kinds (a phrase in very many
contexts) is not gathered: each of its windows becomes a hash, and the hashes are counted by a plain aggregation.

Null texts are empty. Texts shorter than ``length`` lose nothing. Very long texts go through in overlapping segments. Repeated rows repeat each other; rows that repeat id and
text are texts of their own. A null id is an id like others. An empty table gives an empty result. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import store
from winnow.llm.vectors import runs
from winnow.llm.words import BLOCK_BYTES, Words, blocks, byte_codes, mix, prefix_hash, span_hash

GRAM = 32
_PLACE = np.uint64((1 << 24) - 1)
SEGMENT = 2 << 20
BUCKET_ROWS = 500_000


def _pieces(text: bytes, length: int, size: int) -> Iterator[tuple[int, bytes, int, int]]:
    """Overlapping segments (offset, bytes, from, to) of a very long text. Anchors between from and to are the segment's own
    and have all their windows in it."""
    step = size - 4 * length
    last = max(0, -(-(len(text) - size) // step))
    for i in range(last + 1):
        a = i * step
        yield a, text[a : a + size], 2 * length if i else 0, size - 2 * length if i < last else size


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the joined texts, prefix hashes, text borders) of the anchors of texts of at most SEGMENT bytes."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    border = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    prefix = prefix_hash(byte_codes(buf))
    windows = length - GRAM + 1
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), prefix, border
    at = np.arange(len(buf) - GRAM + 1)
    least = (span_hash(prefix, at, at + GRAM) & ~_PLACE) | at.astype(np.uint64)
    done = 1
    while done < windows:
        step = min(done, windows - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    doc = np.searchsorted(border, np.arange(n), side="right") - 1
    fits = np.arange(n) + length <= border[doc + 1]
    doc, place = doc[fits], (least[:n][fits] & _PLACE).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], place[new], prefix, border


def _entries(length: int, segment: int = SEGMENT):
    """(row, text) -> (key, around, row, pos): two entries for each anchor, one of each kind of key."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in blocks(batch, "text"):
                rows, parts, own = [], [], []
                for i, t in enumerate(texts):
                    if len(t) >= length:
                        for s, piece, lo, hi in _pieces(t, length, segment):
                            rows.append(a + i)
                            parts.append(piece)
                            own.append((s, lo, hi))
                if not parts:
                    continue
                for lo, hi in _spans(parts, BLOCK_BYTES):
                    doc, p, prefix, border = anchors(parts[lo:hi], length)
                    move = np.array(own[lo:hi])[doc]
                    mine = (p - border[doc] >= move[:, 1]) & (p - border[doc] < move[:, 2])
                    doc, p, move = doc[mine], p[mine], move[mine]
                    start, end = border[doc], border[doc + 1]
                    ids = batch.column("row").to_numpy()[np.array(rows[lo:hi])][doc]
                    gram = span_hash(prefix, p, p + GRAM)
                    for side, core, use in ((0, p, p + half <= end), (1, p - half, p - half > start)):
                        first, last = start[use], end[use]
                        at, least, most = core[use], *_reach(side, length)
                        left, right = np.maximum(at - most, first), np.minimum(at + length - least, last)
                        around = mix(span_hash(prefix, left, right) + (at - left).astype(np.uint64) * np.uint64(1000003))
                        key = mix(span_hash(prefix, at, at + half) * np.uint64(3) + gram[use]) & ~np.uint64(1) | np.uint64(side)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids[use]), pa.array(at - first + move[use, 0])], ["key", "around", "row", "pos"])

    return run


def _reach(side: int, length: int) -> tuple[int, int]:
    """The least and most bytes before the core of a window whose anchor is where the core starts (side 0) or ends (side 1)."""
    half = length // 2
    return (0, length - half) if side == 0 else (1, length - GRAM - half)


def _spans(parts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(parts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    yield at, len(parts)


class SuffixFamily:
    """The sorted arrays of the levels, as (batches in it, table), and the matched entries of each scan."""

    KIND = "key long, around long, row long, pos long"

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: list[tuple[int, str]] = []
        self.matched: list[DataFrame] = []
        self._all: list[str] = []

    def _array(self, entries: DataFrame) -> str:
        """Entries as a table of ``buckets`` buckets, sorted by key: what meets it by key needs no shuffle of it."""
        name = f"winnow_suffixes_{uuid.uuid4().hex}"
        path = store.new_path(self.spark, "level")
        entries.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self._all.append(name)
        return name

    def _drop(self, name: str) -> None:
        store.forget(self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")
        self._all.remove(name)

    def add(self, entries: DataFrame) -> None:
        """entries (key, around, row, pos) of a new batch: scans it against itself and all levels, then keeps it as a level."""
        self._merge()
        new = self._array(entries)
        batch = self.spark.table(new)
        twice = batch.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        found = batch.join(twice, "key", "left_semi")
        for _, name in self.levels:
            level = self.spark.table(name)
            found = found.unionByName(batch.join(level.select("key"), "key", "left_semi")).unionByName(level.join(batch.select("key"), "key", "left_semi"))
        self.matched.append(store.saved(found, "matched"))
        self.levels.append((1, new))

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (a, one), (b, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((a + b, self._array(self.spark.table(one).unionByName(self.spark.table(two)))))
            self._drop(one)
            self._drop(two)

    def candidates(self) -> DataFrame:
        """The distinct entries whose core stands in two places or more."""
        return store.saved(reduce(DataFrame.unionByName, self.matched).repartition("key", "row").dropDuplicates(["key", "row", "pos"]), "candidates")

    def close(self) -> None:
        for name in list(self._all):
            self._drop(name)
        for found in self.matched:
            store.forget(found)


def _surroundings(length: int):
    """(text, wanted) -> (key, kinds, around, times, left, right): the bytes before and behind each wanted core."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch, "text"):
                out = []
                for text, wanted in zip(texts, batch.column("wanted").slice(a, b - a).to_pylist(), strict=True):
                    for w in wanted:
                        p, (least, most) = w["pos"], _reach(w["key"] & 1, length)
                        out.append((w["key"], w["kinds"], w["around"], w["times"], text[max(0, p - most) : p], text[p + half : p + length - least]))
                        if len(out) == 5000:
                            yield _packed(out)
                            out = []
                if out:
                    yield _packed(out)

    return run


def _packed(out: list[tuple]) -> pa.RecordBatch:
    kinds = [("key", pa.int64()), ("kinds", pa.int64()), ("around", pa.int64()), ("times", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, (_, k) in enumerate(kinds)], [k for k, _ in kinds])


def _sorted_classes(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted order of the strings within their groups, and the common prefix with the one before (-1: another group)."""
    table = np.zeros((len(strings), 4 + width), np.uint8)
    table[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    for i, s in enumerate(strings):
        table[i, 4 : 4 + len(s)] = np.frombuffer(s, np.uint8)
    order = np.argsort(table.view(f"S{4 + width}")[:, 0], kind="stable")
    table = table[order]
    same = table[1:] == table[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1) - 4)
    return order, np.concatenate(([-1], np.where(same[:, :4].all(axis=1), np.maximum(common, 0), -1)))


def repeats(group: np.ndarray, times: np.ndarray, least: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """For each entry and each number of bytes before the core: does that window repeat? Groups are entries of one key.

    A window has ``length`` bytes besides the core, ``least`` of them before it or more.
    """
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    places = np.arange(length + 1)[None, :]
    valid = (places <= n_left[:, None]) & (length - places <= n_right[:, None]) & (places >= least[:, None])
    found = valid & (times > 1)[:, None]
    on_order, on_common = _sorted_classes(right, group, length)
    back_order, back_common = _sorted_classes([x[::-1] for x in left], group, length)
    n = len(group)
    on, back = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(length + 1):
        use = np.flatnonzero(valid[:, x])
        if len(use) < 2:
            continue
        on[on_order] = np.cumsum(on_common < length - x)
        back[back_order] = np.cumsum(back_common < x)
        both = on[use] * (n + 1) + back[use]
        order = np.argsort(both, kind="stable")
        both = both[order]
        twin = both[1:] == both[:-1]
        found[use[order[1:][twin]], x] = True
        found[use[order[:-1][twin]], x] = True
    return found


def _ranges(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first, last) of the runs of True in each line."""
    padded = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    change = np.diff(padded, axis=1)
    entry, first = np.nonzero(change == 1)
    return entry, first, np.nonzero(change == -1)[1] - 1


def _matches(length: int):
    """Runs of one key, (key, around, times, left, right) -> (key, around, from, to): repeated bytes, relative to the core."""

    def out(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables)
        group = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
        least = table.column("key").to_numpy() & 1
        found = repeats(group, table.column("times").to_numpy(), least, table.column("left").to_pylist(), table.column("right").to_pylist(), length - length // 2)
        entry, first, last = _ranges(found)
        key, around = table.column("key").to_numpy()[entry], table.column("around").to_numpy()[entry]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(around), pa.array(-last), pa.array(length - first)], ["key", "around", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for table in runs(batches, ["key"]):
            held.append(table)
            size += table.num_rows
            if size >= 10_000:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return run


def _windows(length: int):
    """(key, around, times, left, right) -> (key, around, place, times, window): a hash of each window around the core."""
    beside = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                left, right, keys = (part.column(c).to_pylist() for c in ("left", "right", "key"))
                prefix = prefix_hash(byte_codes(np.frombuffer(b"".join(x + y for x, y in zip(left, right, strict=True)), np.uint8)))
                end = np.cumsum([len(x) + len(y) for x, y in zip(left, right, strict=True)])
                p = end - np.array([len(y) for y in right])
                places = [np.arange(max(k & 1, beside - len(y)), min(len(x), beside) + 1) for k, x, y in zip(keys, left, right, strict=True)]
                entry, place = np.repeat(np.arange(len(places)), [len(o) for o in places]), np.concatenate(places)
                h = span_hash(prefix, p[entry] - place, p[entry] - place + beside)
                take = pa.array(entry)
                yield pa.RecordBatch.from_arrays([part.column("key").take(take), part.column("around").take(take), pa.array(place), part.column("times").take(take), pa.array(h.view(np.int64))], ["key", "around", "place", "times", "window"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> what is left of each text."""
    for batch in batches:
        for a, b, texts in blocks(batch, "text"):
            out = []
            for text, spans in zip(texts, batch.column("spans").slice(a, b - a).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in sorted((x["from"], min(x["to"], len(text))) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                kept = b"".join(text[i:j] for i, j in zip([0, *[m[1] for m in merged]], [*[m[0] for m in merged], len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), merged, kept))
            kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("id", "row")], *[pa.array([o[i] for o in out], k) for i, (_, k) in enumerate(kinds)]], ["id", "row", *[k for k, _ in kinds]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 400, batches: int = 4, crowd: int = 100_000) -> DataFrame:
    """(id_col, row, n_bytes, n_removed, removed, kept) for every row; removed: the maximal runs [first byte, byte after], kept: the bytes left; row: a hash of the id and the text.

    batches: the texts come to the index in so many parts.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), text.alias("text"))
    long = rows.where(F.octet_length("text") >= length)
    entries = store.saved(long.select("row", "text").mapInArrow(_entries(length), SuffixFamily.KIND), "entries")
    family = SuffixFamily(spark, min(50_000, entries.count() // BUCKET_ROWS + 1))
    for i in range(batches):
        family.add(entries.where(F.pmod("row", F.lit(batches)) == i))
    copies = long.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")
    cand = family.candidates()
    store.forget(entries)
    family.close()

    if not copies.isEmpty():  # rows that repeat id and text
        cand = store.saved(cand.join(copies, "row", "left").select("key", "around", "row", "pos", F.coalesce("copies", F.lit(1)).cast("long").alias("copies")), "candidates")
    else:
        cand = cand.withColumn("copies", F.lit(1).cast("long"))
    kinds = cand.groupBy("key", "around").agg(F.sum("copies").alias("times"), F.min(F.struct("row", "pos")).alias("one"))
    kinds = store.saved(kinds.select("key", "around", "times", "one.row", "one.pos"), "kinds")
    number = store.saved(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("times").alias("most")), "numbers")
    fetch = kinds.join(number.where("kinds > 1").select("key", "kinds"), "key")
    wanted = fetch.groupBy("row").agg(F.collect_list(F.struct("key", "kinds", "around", "times", "pos")).alias("wanted"))
    one_text = long.select("row", "text").join(wanted, "row").dropDuplicates(["row"])
    bytes_ = one_text.select("text", "wanted").mapInArrow(_surroundings(length), "key long, kinds long, around long, times long, left binary, right binary")
    crowded = not number.where(F.col("kinds") > crowd).isEmpty()
    if crowded:  # read twice
        bytes_ = store.saved(bytes_, "surroundings")
    few = bytes_.where(F.col("kinds") <= crowd).repartition("key").sortWithinPartitions("key")
    spans = few.mapInArrow(_matches(length), "key long, around long, from long, to long")
    if crowded:
        many = bytes_.where(F.col("kinds") > crowd).drop("kinds").mapInArrow(_windows(length), "key long, around long, place long, times long, window long")
        twice = many.groupBy("key", "place", "window").agg(F.sum("times").alias("times")).where("times > 1").select("key", "place", "window")
        hits = many.join(twice, ["key", "place", "window"], "left_semi")
        places = hits.groupBy("key", "around").agg(F.sort_array(F.collect_set("place")).alias("p"))
        first, last = "filter(p, x -> NOT array_contains(p, x - 1))", "filter(p, x -> NOT array_contains(p, x + 1))"
        wide = places.select("key", "around", F.explode(F.expr(f"transform(arrays_zip({last}, {first}), z -> named_struct('b', z['0'], 'a', z['1']))")).alias("r"))
        spans = spans.unionByName(wide.select("key", "around", (-F.col("r.b")).alias("from"), (F.lit(length) - F.col("r.a")).alias("to")))
    # one kind, several times: every window around the core repeats
    alone = number.where("kinds = 1 and most > 1").select("key")
    spans = store.saved(spans.groupBy("key", "around").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "matches")
    found = store.matching(cand, spans, ["key", "around"]).select("row", "pos", F.explode("met.spans").alias("s"))
    found = found.select("row", (F.col("pos") + F.col("s.from")).alias("from"), (F.col("pos") + F.col("s.to")).alias("to"))
    before, behind = (F.when(F.col("key").bitwiseAND(1) == 0, _reach(0, length)[i]).otherwise(_reach(1, length)[i]) for i in (1, 0))
    wide = store.matching(cand, alone, ["key"])
    wide = wide.select("row", F.greatest(F.col("pos") - before, F.lit(0)).alias("from"), (F.col("pos") + length - behind).alias("to"))
    spans = store.saved(found.unionByName(wide).groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "spans")
    joined = rows.join(spans, "row", "left").select("id", "row", "text", "spans")
    id_type = rows.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(_cut, f"id {id_type}, row long, n_bytes long, n_removed long, removed array<array<long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def _sampled_grams(gram: int):
    """(row, text) -> (gram, row): of each window of ``gram`` strings of ``gram`` words the one with the smallest hash, each once in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch, "text"):
                words = Words(texts)
                n = len(words.hash) - gram + 1
                if n < gram:
                    continue
                at = np.arange(n)
                hashes = span_hash(prefix_hash(mix(words.hash)), at, at + gram)
                least, done = hashes, 1
                while done < gram:
                    step = min(done, gram - done)
                    least = np.minimum(least[:-step], least[step:])
                    done += step
                doc = words.doc[: len(least)]
                inside = doc == words.doc[2 * gram - 2 :]
                doc, least = doc[inside], least[inside]
                new = np.ones(len(doc), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                row = batch.column("row").to_numpy()[a:b][doc[new]]
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(row)], ["gram", "row"])

    return run


def shared_passages(texts: DataFrame, words: int = 51) -> DataFrame:
    """texts (row, text) -> (row, n_passages): sampled strings of (words + 1) / 2 words that stand in other texts, too.

    The sample holds one string at least of every passage of ``words`` words or more, so each text that shares such a passage with another one is in the result, also where
    the passage has fewer bytes than remove_repeats asks for. Texts without shared strings are not in it.
    """
    grams = store.saved(texts.mapInArrow(_sampled_grams((words + 1) // 2), "gram long, row long"), "grams")
    shared = grams.groupBy("gram").agg(F.min("row").alias("one"), F.max("row").alias("two")).where("one <> two").select("gram")
    return store.matching(grams, shared, ["gram"]).groupBy("row").agg(F.count_distinct("gram").alias("n_passages"))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    out = out.select("doc_id", "row", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    passages = store.saved(shared_passages(docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")), "passages")
    return out.join(passages, "row", "left").drop("row").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))
