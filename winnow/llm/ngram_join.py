"""N-gram Jaccard self-join with token-combination prefixes.

A text is the set of its distinct k-word shingles ("tokens"). Two texts link when
100 * |A n B| >= percent * |A u B|. The join is exact up to collisions of 64-bit hashes.

1. Equal sets collapse to one: a set is known by a 64-bit digest and its size.
2. Token classes. All tokens of all texts are counted in hash buckets, about as many as there are tokens but 2**28 at most, so the
   bit maps of classes that go to every task have a bounded size. Tokens of a bucket over ``frequent`` are frequent (class 1), over ``frequent``**2 very frequent
   (class 2), the others rare (class 0); a bucket of one makes its token unique. Thresholds are raised by what buckets hold on average. A collision only moves a token to
   another class; classes are a function of the token, so the join stays exact.
3. Prefixes. Tokens are ordered by class, then by hash. A set indexes single rare tokens; if those are not enough it extends the prefix into its
   frequent tokens and indexes combinations of two neighbours in that order, then combinations of three very frequent neighbours. Let A and B link, t = percent/100,
   n = |A|, a tokens of A be missing from B and b of B from A; then a + t b <= (1-t) n. In a prefix whose entries combine up to c tokens, a missing token
   breaks c entries at most, an extra token of B c - 1, and c a + (c-1) b <= c (1-t) n as long as t >= (c-1)/c. So floor(c (1-t) n) + 1 entries cannot all be broken,
   and the set whose prefix ends first shares an entry with the other. The index is linear in the text. c is limited by ``percent``, so that sets of n0 tokens or more
   always have entries enough; smaller sets, and those that may link with a smaller one, index floor((1-t) n) + 1 single tokens instead or besides.
   Sets so small that no other set can link are not indexed.
4. Candidates. The entries are sorted once, by entry and size. Within an entry every set is first compared with the smallest one (a star, not
   all pairs). Linked sets are merged into components; then all pairs of sets that still are in different components and whose sizes allow a link. No pair is dropped, except
   those whose ends are already known to be connected.
5. Candidate pairs whose sketches (tokens counted by 64 hash classes, a lower bound of the difference) rule a link out go;
   the others are verified on the whole texts.

Null and empty texts, or those without words, have an empty set and link with nothing. Very long texts are sets like others. Repeated rows are equal sets. Of rows that
repeat an id with other texts, each has its own set. A null id is no id: it never names a component unless all ids are null. An empty table gives an empty result. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import store
from winnow.llm.graph import components
from winnow.llm.words import Words, blocks, mix, shingles


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    doc, x = shingles(Words(texts), k)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield x[a:b]


def _digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


SKETCH = 64


def _sketch(tokens: np.ndarray) -> bytes:
    """Tokens counted by hash class, up to 255. The counts of two sets differ by no more, in sum, than the sets do."""
    return np.minimum(np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _sizes(k: int):
    """(id, hash, text) -> (id, hash, n, key, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch, "text"):
                found = [(len(s), _digest(s) if len(s) else 0, _sketch(s)) for s in _sets(texts, k)]
                kinds = (pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("id", "hash")], *[pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]], ["id", "hash", "n", "key", "sketch"])

    return run


def _coded(gaps: np.ndarray) -> bytes:
    """Gaps as bytes, each 255 standing for 255 more: about one byte a token however many buckets there are."""
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more.astype(np.int64) + 1) - 1] = gaps % 255
    return out.tobytes()


def _decoded(coded: bytes) -> np.ndarray:
    """The sums of the gaps so far, so the places of the buckets."""
    x = np.frombuffer(coded, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x < 255]


def _bucket_counts(k: int, bits: int, parts: int):
    """Each task's token buckets, sorted and stored as gaps, dealt by bucket range: (part, gaps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            all_ = np.sort(np.concatenate(held))
            per = (1 << bits) // parts
            cut = np.searchsorted(all_, np.arange(parts + 1, dtype=np.uint32) * np.uint32(per))
            cut[-1] = len(all_)
            rows = [(p, _coded(np.diff(all_[cut[p] : cut[p + 1]], prepend=np.uint32(p * per)))) for p in range(parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "gaps"])

        for batch in batches:
            for _, _, texts in blocks(batch, "text"):
                for s in _sets(texts, k):
                    if len(s) and (d := _digest(s)) not in seen:
                        seen.add(d)
                        held.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                        size += len(s)
                if size > 1_500_000:
                    yield from out()
                    held.clear()
                    size = 0
                    if len(seen) > 300_000:
                        seen.clear()
        if held:
            yield from out()

    return run


FOLD = 8  # buckets that share a bit in the maps of frequent tokens


def _bucket_maps(bits: int, parts: int, over: list[float]):
    """One range of buckets -> (part, bit map of buckets over one, bit maps of buckets over each limit)."""

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = (1 << bits) // parts
        counts = np.zeros(per, np.uint32)
        for batch in rows:
            for gaps in batch.column("gaps").to_pylist():
                np.add(counts, np.bincount(_decoded(gaps), minlength=per).astype(np.uint32), out=counts)
        most = counts.reshape(-1, FOLD).max(axis=1)
        maps = [np.packbits(counts > 1), *[np.packbits(most > limit) for limit in over]]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([[m.tobytes() for m in maps]], pa.list_(pa.binary()))], ["part", "maps"])

    return run


class TokenClasses:
    """Bit maps of hash buckets: does a token occur twice, and how frequent is it?"""

    def __init__(self, bits: int, maps: list[np.ndarray]):
        self.bits, self.maps = bits, maps

    @staticmethod
    def of(texts: DataFrame, k: int, tokens: int, frequent: int, most_bits: int) -> TokenClasses:
        bits, parts = min(max(20, tokens.bit_length()), most_bits), 64
        load = tokens / (1 << bits)
        over = [load + 4 * math.sqrt(load) + frequent**c for c in (1, 2)]
        gaps = texts.mapInArrow(_bucket_counts(k, bits, parts), "part int, gaps binary")
        maps = gaps.groupBy("part").applyInArrow(_bucket_maps(bits, parts, over), "part int, maps array<binary>")
        sizes = [(1 << bits) // parts // 8 // fold for fold in (1, FOLD, FOLD)]
        out = [np.zeros(parts * size, np.uint8) for size in sizes]
        for row in maps.toLocalIterator():  # of bounded size
            for held, own, size in zip(out, row.maps, sizes, strict=True):
                held[row.part * size : (row.part + 1) * size] = np.frombuffer(own, np.uint8)
        return TokenClasses(bits, out)

    def _bit(self, at: int, bucket: np.ndarray) -> np.ndarray:
        return (self.maps[at][bucket >> 3] >> (np.uint8(7) - (bucket & 7).astype(np.uint8)) & 1).astype(bool)

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, occurs twice) of each token."""
        bucket = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
        return self._bit(1, bucket // FOLD).astype(np.int8) + self._bit(2, bucket // FOLD), self._bit(0, bucket)


def combination(percent: int) -> tuple[int, int]:
    """(the most tokens of a combination, n0: sets of so many tokens have entries enough)."""
    most = max(c for c in (1, 2, 3) if c == 1 or 4 * c * (100 - percent) <= 300)
    return most, math.ceil(400 / (100 - most * (100 - percent))) if most > 1 else 0


def _entries(s: np.ndarray, cls: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of one set. s: sorted tokens; cls, many: their classes, and whether others may hold them."""
    n, gap = len(s), 100 - percent
    most, least = combination(percent)
    if 100 * n < percent * (n + 1):  # no set of another size can link, nor another set of this size
        return s[:0]
    cls = np.minimum(cls, most - 1)
    own = [s[cls == c] for c in range(most)]
    out = []
    if most == 1 or percent * n < 100 * least:  # this set, or one that it may link with, is small
        order = np.argsort(cls, kind="stable")[: gap * n // 100 + 1]
        first = s[order][many[order]]
        out.append(mix(first ^ np.uint64(0xA3A3)))
    if most > 1 and n >= least:
        need = gap * n // 100 + 1
        single, held = own[0][:need], many[cls == 0][:need]
        out.append(mix(single[held] ^ np.uint64(0x5151)))
        count = len(own[0])
        for c in range(1, most):
            need = (c + 1) * gap * n // 100 + 1
            if count >= c * gap * n // 100 + 1 or not len(own[c]):
                if count >= c * gap * n // 100 + 1:
                    break
                continue
            tokens = own[c][: need - count + c]
            x = mix(tokens[: len(tokens) - c] + np.uint64(c))
            for j in range(1, c + 1):
                x = mix(x * np.uint64(3) + tokens[j : len(tokens) - c + j])
            out.append(x)
            count += max(len(own[c]) - c, 0)
    return np.concatenate(out) if out else s[:0]


def _index(k: int, percent: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, texts in blocks(batch, "text"):
                sig, key, size = [], [], []
                doc, x = shingles(Words(texts), k)
                cls, many = classes.value.look_up(x)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    if b > a and (d := _digest(x[a:b])) not in seen:
                        seen.add(d)
                        e = _entries(x[a:b], cls[a:b], many[a:b], percent)
                        sig.append(e)
                        key.append(np.full(len(e), d, np.int64))
                        size.append(np.full(len(e), b - a, np.int32))
                if len(seen) > 300_000:
                    seen.clear()
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(key)), pa.array(np.concatenate(size))], ["sig", "key", "n"])

    return run


def _shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, key, n) sorted -> the distinct entries that two sets or more share, with the first of them: (sig, key, n, key2, n2)."""
    names = ("sig", "key", "n")
    last = [np.zeros(0, np.int64) for _ in names]  # the last distinct row so far
    first = last  # the first row of its entry
    for batch in batches:
        sig, key, n = (np.concatenate((a, batch.column(c).to_numpy().astype(np.int64))) for a, c in zip(last, names, strict=True))
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, n = sig[fresh], key[fresh], n[fresh]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        open_ = bool(len(first[0]) and first[1][0] != key[0])  # the row carried over is not the first of its entry
        head = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
        key2, n2 = key[head], n[head]
        if len(first[0]):
            key2[head == 0], n2[head == 0] = first[1][0], first[2][0]
        # rows go out when they have a partner: the row after or before them
        use = ~new
        use[:-1] |= ~new[1:]
        if len(last[0]):  # the row carried over has been given out if it was not the first; or if its entry goes on
            use[0] = not open_ and len(new) > 1 and not new[1]
        out = [a[use] for a in (sig, key, n, key2, n2)]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(out[3]), pa.array(out[4].astype(np.int32))], ["sig", "key", "n", "key2", "n2"])
        last = [sig[-1:], key[-1:], n[-1:]]
        first = [sig[-1:], key2[-1:], n2[-1:]]


def _verify(k: int, percent: int):
    """(a, part, role, key, text), sorted: in each part of a, its own text (role 0) and then its partners' -> the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(0, np.uint64)
        for batch in batches:
            first, role, key = (batch.column(c).to_numpy() for c in ("a", "role", "key"))
            keep = []
            for i, j, texts in blocks(batch, "text"):
                for at, two in zip(range(i, j), _sets(texts, k), strict=True):
                    if role[at] == 0:
                        one = two
                        continue
                    n, m = len(one), len(two)
                    where = np.searchsorted(one, two)
                    where[where == n] = n - 1
                    both = int((one[where] == two).sum())
                    if 100 * both >= percent * (n + m - both):
                        keep.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(first[keep], pa.int64()), pa.array(key[keep], pa.int64())], ["a", "b"])

    return run


def _local_components(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the tokens that two sets or more hold."""
    sizes = [len(s) for s in sets]
    tokens, where, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    rank = np.cumsum(held > 1) - 1
    use = held[where] > 1
    row, col = row[use], rank[where[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _block_links(k: int, percent: int):
    """The sets of two blocks of a family -> links that join their components: (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        key = np.array(table.column("key").to_pylist(), np.int64)
        c = np.array(table.column("c").to_pylist(), np.int64)
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).to_batches():
            for _, _, texts in blocks(batch, "text"):
                sets += list(_sets(texts, k))
        n = np.array([len(s) for s in sets])
        both = overlaps(sets)
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (c[:, None] != c[None, :])
        root = _local_components(linked)
        use = root != np.arange(len(root))
        return pa.table({"a": key[root[use]], "b": key[use]})

    return run


def _family_links(crowded: DataFrame, texts: DataFrame, k: int, percent: int, block_tokens: int) -> DataFrame:
    """crowded (key, n, c, centre) -> links between sets of one family that lie in different components."""
    step = math.log(100 / percent) * (1 + 1e-9)  # sets that link differ by one size class at most
    sets = crowded.select(F.col("centre").alias("family"), "key", "c", "n", F.floor(F.log("n") / step).alias("class"))
    size = sets.groupBy("family", "class", "c").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
    # a component as large as a block gets blocks of its own; the others share theirs
    size = size.select("family", "class", "c", F.when(F.col("tokens") >= block_tokens, F.col("c")).alias("own"), "tokens", "sets")
    pool = size.groupBy("family", "class", "own").agg(F.ceil(F.greatest(F.sum("tokens") / block_tokens, F.sum("sets") / 700)).alias("blocks"))
    pool = pool.select(F.col("family").alias("f"), F.col("class").alias("k"), F.col("own").alias("o"), "blocks")
    deal = size.drop("tokens", "sets").join(pool, F.expr("family = f and class = k and own <=> o")).select("family", "class", "c", "own", "blocks")
    name = F.concat_ws("/", "class", F.coalesce("own", F.lit(0)), F.pmod(F.xxhash64("key"), "blocks"))
    dealt = store.saved(sets.join(deal, ["family", "class", "c"]).select("family", "class", "key", "c", "own", name.alias("block")), "dealt")
    block = dealt.groupBy("family", "class", "block", "own").agg(F.min("c").alias("c1"), F.max("c").alias("c2"))
    other = block.select("family", *[F.col(x).alias(f"{x}_") for x in ("class", "block", "own", "c1", "c2")])
    apart = "least(c1, c1_) <> greatest(c2, c2_)"  # all in one component: nothing to find
    duels = block.join(other, "family").where(f"block <= block_ and abs(class - class_) <= 1 and {apart}")
    sides = duels.select("family", "block", F.concat_ws(" ", "block", "block_").alias("duel")).union(duels.where("block <> block_").select("family", "block_", F.concat_ws(" ", "block", "block_")))
    rows = dealt.join(sides, ["family", "block"]).join(texts, "key").select("family", "duel", "key", "c", "text")
    out = store.saved(rows.groupBy("family", "duel").applyInArrow(_block_links(k, percent), "a long, b long"), "links")
    store.forget(dealt)
    return out


def _plausible(percent: int):
    """Drops pairs whose sketches alone show that they cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).astype(np.int64).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
                n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                fits = np.abs(one - two).sum(axis=1) * (100 + percent) <= (n + m) * (100 - percent)
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    return run


def _candidates(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of set keys that can link."""
    for side in ("a", "b"):
        pairs = (pairs.distinct() if side == "a" else pairs).join(nodes.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return store.saved(pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_plausible(percent), "a long, b long"), "pairs")


def _texts_of(keys: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, text) of the named sets. Few ids go to the texts, many meet them in a shuffle."""
    wanted = store.saved(keys.distinct().join(nodes.select("key", F.col("id").alias("id1"), F.col("hash").alias("hash1")), "key"), "wanted")
    found = texts.join(store.small(wanted), F.expr("hash = hash1 and id <=> id1"))
    out = store.saved(found.select("key", "text").dropDuplicates(["key"]), "texts")
    store.forget(wanted)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of set keys, a being the one that more pairs share, those that link, as a saved table.

    Each text goes straight to the pairs that need it; a set that very many pairs share meets them in 64 parts.
    """
    hot = store.hot_keys(pairs, "a")
    part = F.when(F.col("a").isin(hot), F.pmod(F.xxhash64("b"), F.lit(64))) if hot else F.lit(None).cast("long")
    dealt = pairs.select("a", F.coalesce(part, F.lit(0)).cast("int").alias("part"), "b")
    roles = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("key")).union(dealt.select("a", "part", F.lit(0), "a").distinct())
    wanted = store.saved(roles.join(nodes.select("key", F.col("id").alias("id1"), F.col("hash").alias("hash1")), "key"), "wanted")
    found = texts.join(store.small(wanted), F.expr("hash = hash1 and id <=> id1")).select("a", "part", "role", "key", "text")
    found = found.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    out = store.saved(found.mapInArrow(_verify(k, percent), "a long, b long"), "links")
    store.forget(wanted)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, percent: int = 80, frequent: int = 24, count_bits: int = 28, crowd: int = 40, block_tokens: int = 100_000) -> DataFrame:
    """(id_col, n_shingles, set_key, component_id) for every row. component_id is the smallest id reachable by links.

    k: words of a shingle. percent: least Jaccard similarity, from 1 to 100. frequent: a token in more sets than this belongs to
    the frequent class. count_bits: buckets of the token counts, as a power of two, at most. crowd: entries with more sets are compared by families.
    block_tokens: tokens of a block of a family.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent goes from 1 to 100")
    spark = docs.sparkSession
    store.narrow_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.col(f"`{text_col}`").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    base = store.saved(texts.mapInArrow(_sizes(k), f"id {id_type}, hash long, n long, key long, sketch binary"), "sets")
    nodes = base.where("n > 0").groupBy("key").agg(F.min(F.struct("id", "hash")).alias("one"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = store.saved(nodes.select("key", "one.id", "one.hash", "least", "n", "sketch"), "nodes")
    tokens = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    classes = spark.sparkContext.broadcast(TokenClasses.of(texts.select("text"), k, tokens, frequent, count_bits))
    index = texts.select("text").mapInArrow(_index(k, percent, classes), "sig long, key long, n int")
    index = index.repartition("sig").sortWithinPartitions("sig", "n", "key")
    index = store.saved(index.mapInArrow(_shared_entries, "sig long, key long, n int, key2 long, n2 int"), "index")
    classes.destroy()

    size_ok = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    pairs = _candidates(index.where(f"key <> key2 and {size_ok}").select(F.col("key2").alias("a"), F.col("key").alias("b")), nodes, percent)
    links = _verified(pairs, nodes, texts, k, percent)
    store.forget(pairs)
    comp = components(links)

    # entries whose sets lie in several components
    rows = index.select("sig", "key", "n").join(comp.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", "n", F.coalesce("component", "key").alias("c"))
    rows = store.saved(rows, "rows")
    store.forget(index)
    open_ = rows.groupBy("sig").agg(F.count("*").alias("members"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("key").alias("centre")).where("c1 <> c2").drop("c1", "c2")
    left = store.saved(rows.join(open_, "sig"), "open")
    store.forget(rows)
    few = left.where(f"members <= {crowd}").select("sig", "key", "n", "c")
    other = few.select("sig", F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("c").alias("cc"))
    pairs = _candidates(few.join(other, "sig").where(f"c < cc and {size_ok}").select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")), nodes, percent)
    found = [_verified(pairs, nodes, texts, k, percent)]
    store.forget(pairs)
    crowded = store.saved(left.where(f"members > {crowd}").select("key", "n", "c", "centre").distinct(), "crowded")
    store.forget(left)
    if not crowded.isEmpty():
        kept = _texts_of(crowded.select("key"), nodes, texts)
        found.append(_family_links(crowded, kept, k, percent, block_tokens))
        store.forget(kept)
    store.forget(crowded)
    more = links
    for f in found:
        more = more.unionByName(f)
    if any(not f.isEmpty() for f in found):
        old, comp = comp, components(more)
        store.forget(old)
    for f in (links, *found):
        store.forget(f)

    # components are named by their smallest id, not by a key
    named = store.saved(nodes.select("key", F.col("least").alias("id")).join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("component", "key").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("id").alias("least_id"))
    names = store.saved(store.lookup(named, least, "root").select(F.col("key").alias("set_key"), "least_id"), "names")
    for f in (nodes, comp, named):
        store.forget(f)
    out = base.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("set_key"))
    return store.lookup(out, names, "set_key").select(F.col("id").alias(id_col), "n_shingles", "set_key", F.coalesce("least_id", "id").alias("component_id"))


def near_duplicate_representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay when one document of each group (the smallest doc_id) is kept, with all their columns.

    Rows with a null doc_id stay. Of rows that repeat a doc_id, all stay or none.
    """
    found = jaccard_components(docs, **how)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")


_REACH = """reach AS (SELECT a AS id, b AS other FROM links UNION SELECT b, a FROM links UNION SELECT r.id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.other IN (l.a, l.b)),
least_ AS (SELECT id, min(other) AS other FROM reach GROUP BY id)"""
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS (SELECT doc_id, CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 4 THEN [array_to_string(v, ' ')]
        ELSE list_distinct(list_transform(range(1, len(v) - 2), lambda i: v[i] || ' ' || v[i + 1] || ' ' || v[i + 2] || ' ' || v[i + 3])) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS t FROM s),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.g) + len(y.g) - c)),
{_REACH}
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM s LEFT JOIN least_ ON id = doc_id
"""
