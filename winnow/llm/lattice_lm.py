"""LM scoring by subword lattice likelihood.

A text is a sequence of words and its end. Each word is drawn as a lattice: one edge spans the whole word, with the discounted
share of the word in the training part; the others are the pieces of an existing vocabulary (and bytes, for
characters that no piece is), reached with the mass that the discount frees. The word's probability is the sum over all paths,
by a forward recursion in log space. A word starts with U+2581, so its first piece is drawn from the pieces that start with it, and
the others from the rest together with "the word ends".

Texts come from a few classes (by default the languages with ``class_share`` of the training texts or more each, hence at most 1 / class_share). A class has word shares of its own and falls back to the
shares of all. The probability of a text is the sum over the classes, and over "no class", of their shares times the product of its
words' probabilities; the class of the text to be scored is never looked at. All these are distributions, so the probabilities of
all texts sum to one at most.

Piece probabilities are the vocabulary's scores (they are ranks, so p ~ 1 / (rank + 2)) as a prior, updated on the distinct
words of the training texts by expectation maximisation: expected uses of each piece over all segmentations, and ``prior`` times as many pseudo-uses dealt by the vocabulary's
probabilities. The counts of words are gathered from the whole training part with one shuffle, by word. The edge of a whole word is the vocabulary's extension to the words of the
corpus; without it (``whole_words`` off) the vocabulary alone carries the score.

The baseline is a smoothed word unigram model. Its counts of frequent words (more than one in ``frequent`` tokens, hence at most
``frequent`` words) go to every task; the others meet the texts by hash range and slice of the texts, as packed blocks. The counts of a range
are repeated for each slice, so a group holds a bounded number of words and of tokens, whatever the vocabulary and the number of texts.

Null and empty texts consist of the end alone; very long texts are scored as a whole. Rows with a null id are never trained on. Rows that repeat id and text get one score each, the same.
Without training rows (or with an empty table, whose result is empty) the vocabulary alone is left. Other columns, whatever their names, take no part. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm import store
from winnow.llm.lattice import BLANK, LITERAL, Pieces, char_codes, default_model, edges, groups, pieces
from winnow.llm.words import Words, blocks, prefix_hash

COUNT_BLOCK = 1 << 20
PACKED = ("words", "spelt", "rows", "each", "docs", "times")


def _word_points(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each with the blank marker in front: (points, start, length)."""
    text = "\n".join(w.decode("utf-8", "replace") for w in words)  # words hold no line feeds
    points = np.frombuffer(("\n" + text).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    start = np.flatnonzero(points == 0x0A)
    points[points == BLANK] = LITERAL
    points[start] = BLANK
    return points, start, np.diff(np.append(start, len(points)))


class LatticeModel:
    """Log probabilities: of the pieces (in the order of Pieces), of the bytes, of the end of a word."""

    def __init__(self, path: str, piece: np.ndarray, byte: np.ndarray, end: float):
        self.path, self.piece, self.byte, self.end = path, piece, byte, end

    @staticmethod
    def initial(path: str) -> LatticeModel:
        p = pieces(path)
        w = 1 / (np.argsort(np.argsort(-p.score, kind="stable"), kind="stable") + 2.0)
        return LatticeModel._normal(path, np.concatenate((w, np.full(256, w.min()), [w.max()])))

    @staticmethod
    def _normal(path: str, w: np.ndarray) -> LatticeModel:
        """Weights of the pieces, the bytes and the end as probabilities: one distribution for first pieces, one for what follows."""
        p = pieces(path)
        first = np.zeros(len(w), bool)
        first[: len(p.id)] = [p.text[i].startswith("▁") for i in p.id]
        w = np.log(np.where(first, w / w[first].sum(), w / w[~first].sum()))
        n = len(p.id)
        return LatticeModel(path, w[:n], w[n : n + 256], float(w[-1]))

    def _lattice(self, words: list[bytes]):
        p = pieces(self.path)
        points, start, length = _word_points(words)
        prefix = prefix_hash(char_codes(points))
        for rows in groups(length, 300_000):
            found = edges(p, prefix, points, start[rows], length[rows])
            weights = []
            for e in found:
                w = self.piece[e.piece]
                for i in np.flatnonzero(e.piece < 0):
                    w[i] = self.byte[list(self._lone(points[start[rows[e.row[i]]] + e.s]))].sum()
                weights.append(w)
            wide = int(length[rows].max()) + 1
            ahead = np.full((len(rows), wide), -np.inf)
            ahead[:, 0] = 0
            for e, w in zip(found, weights, strict=True):
                np.logaddexp(ahead[e.row, e.e], ahead[e.row, e.s] + w, out=(new := np.empty(len(w))))
                ahead[e.row, e.e] = new  # an end has one edge from each start, so no row repeats
            yield p, points, start, rows, length[rows], found, weights, ahead
            del found, weights, ahead  # before those of the next group are made

    @staticmethod
    def _lone(point: int) -> bytes:
        return ("▁" if point == LITERAL else chr(int(point))).encode("utf-8", "surrogatepass")

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability that the pieces spell each word."""
        out = np.zeros(len(words))
        for _, _, _, rows, length, _, _, ahead in self._lattice(words) if words else ():
            out[rows] = ahead[np.arange(len(rows)), length] + self.end
            del ahead, _
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece and byte in the words."""
        p = pieces(self.path)
        out = np.zeros(len(p.score) + 256)
        for _, points, start, rows, length, found, weights, ahead in self._lattice(words) if words else ():
            every = np.arange(len(rows))
            behind = np.full(ahead.shape, -np.inf)
            behind[every, length] = 0
            total = ahead[every, length]
            for e, w in zip(reversed(found), reversed(weights), strict=True):
                through = w + behind[e.row, e.e]
                share = np.exp(np.minimum(ahead[e.row, e.s] + through - total[e.row], 0))
                known = e.piece >= 0
                out[: len(p.score)] += np.bincount(e.piece[known], weights=share[known], minlength=len(p.score))
                for i in np.flatnonzero(~known):
                    for b in self._lone(points[start[rows[e.row[i]]] + e.s]):
                        out[len(p.score) + b] += share[i]
                order = np.argsort(e.row, kind="stable")
                row, val = e.row[order], through[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                if len(first):
                    behind[row[first], e.s] = np.logaddexp.reduceat(val, first)
        return out

    def updated(self, uses: np.ndarray, words: float, prior: float) -> LatticeModel:
        """Weights by expected uses and pseudo-uses, ``prior`` times as many, dealt as the vocabulary's scores say."""
        w = np.concatenate((uses, [words]))
        before = self.initial(self.path)
        p = np.exp(np.concatenate((before.piece, before.byte, [before.end])))
        return self._normal(self.path, w + prior * w.sum() * p / p.sum())


class WordShare:
    """How a word's edge and its spelling share the probability, in each class and (last) in none."""

    def __init__(self, tokens: int, distinct: int, by_class: list[tuple[int, int]], discount: float = 0.75, whole_words: bool = True):
        self.tokens, self.discount, self.by_class, self.whole_words = tokens, discount, by_class, whole_words
        self.free = discount * distinct / tokens if tokens else 1.0

    def logs(self, spelt: np.ndarray, c: np.ndarray, each: np.ndarray) -> list[np.ndarray]:
        """Base-10 logs of the words' probabilities. c: training counts, 0 if unknown; each: those by class. spelt: natural log of the spelling."""
        if not self.whole_words:
            return [spelt / math.log(10)] * (len(self.by_class) + 1)
        spelling = spelt / math.log(10) + math.log10(self.free)
        whole = np.log10(np.maximum(c - self.discount, 1e-300) / max(self.tokens, 1))
        general = np.where(c > 0, np.logaddexp(spelling * math.log(10), whole * math.log(10)) / math.log(10), spelling)
        out = []
        for k, (tokens, distinct) in enumerate(self.by_class):
            if not tokens:
                out.append(general)
                continue
            back = general + math.log10(self.discount * distinct / tokens)
            own = np.log10(np.maximum(each[:, k] - self.discount, 1e-300) / tokens)
            out.append(np.where(each[:, k] > 0, np.logaddexp(back * math.log(10), own * math.log(10)) / math.log(10), back))
        return [*out, general]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, k) -> (h, word, k, n): the words of each block and class with their counts."""
    for batch in batches:
        for a, b, texts in blocks(batch, "text", COUNT_BLOCK):
            words = Words(texts)
            classes = batch.column("k").to_numpy()[a:b][words.doc]
            for k in np.unique(classes):
                own = np.flatnonzero(classes == k)
                h, pick, n = np.unique(words.hash[own], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([words.text(i) for i in own[pick]], pa.binary()), pa.array(np.full(len(h), k, np.int32)), pa.array(n)], ["h", "word", "k", "n"])


class Spelling:
    """Spelling probabilities of words, remembered within a task up to ``most`` words."""

    def __init__(self, model: LatticeModel, most: int = 1_000_000):
        self.model, self.most = model, most
        self.h, self.spelt = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, h: np.ndarray, word) -> np.ndarray:
        """h: sorted distinct hashes; word(i): the bytes of the i-th."""
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        known = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        out = np.where(known, self.spelt[at], 0.0) if len(self.h) else np.zeros(len(h))
        new = np.flatnonzero(~known)
        out[new] = self.model.log_prob([word(i) for i in new]).astype("<f4")  # as they are packed for rare words, so that it makes no difference which words are rare
        if len(self.h) + len(new) > self.most:
            self.h, self.spelt = h, out
        elif len(new):
            both = np.concatenate((self.h, h[new]))
            order = np.argsort(both)
            self.h, self.spelt = both[order], np.concatenate((self.spelt, out[new]))[order]
        return out


def _expected(model):
    """(word) -> (piece, uses) summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = model.value, None
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                found = m.expected(batch.column("word").to_pylist())
                total = found if total is None else total + found
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])

    return run


def _frequent_scores(model, share: WordShare, frequent):
    """(row, id, held_out, text) -> number of words, and what the frequent words give: known, base, score of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts, each = frequent.value
        spelling = Spelling(model.value)
        for batch in batches:
            for a, b, texts in blocks(batch, "text", COUNT_BLOCK):
                words = Words(texts)
                at = np.searchsorted(often, words.hash)
                at[at == len(often)] = 0
                use = np.flatnonzero(often[at] == words.hash) if len(often) else np.zeros(0, np.int64)
                h, pick, which = np.unique(words.hash[use], return_index=True, return_inverse=True)
                row = at[use][pick]
                spelt = spelling.of(h, lambda i, use=use, pick=pick, words=words: words.text(use[pick[i]]))
                values = [np.ones(len(h)), np.log10(counts[row] + 0.1), *share.logs(spelt, counts[row], each[row])]
                sums = [np.bincount(words.doc[use], weights=v[which], minlength=len(texts)).astype(float) for v in values]  # of nothing, bincount is of integers
                part = batch.slice(a, b - a)
                out = [part.column(c) for c in ("row", "id", "held_out")]
                names = ["row", "id", "held_out", "words", "known", "base", *[f"s{k}" for k in range(len(sums) - 2)]]
                yield pa.RecordBatch.from_arrays([*out, pa.array(words.count), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names)

    return run


def _rare_blocks(parts: int, model, frequent):
    """(row, text) -> packed words of each block that are not frequent, by hash range: (part, words, spelling, rows, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value[0]
        spelling = Spelling(model.value)
        for batch in batches:
            for a, _, texts in blocks(batch, "text", COUNT_BLOCK):
                words = Words(texts)
                at = np.searchsorted(often, words.hash)
                at[at == len(often)] = 0
                keep = np.flatnonzero(often[at] != words.hash) if len(often) else np.arange(len(words.hash))
                h, pick, which = np.unique(words.hash[keep], return_index=True, return_inverse=True)
                spelt = spelling.of(h, lambda i, keep=keep, pick=pick, words=words: words.text(keep[pick[i]])).astype("<f4")
                pair, times = np.unique(which.astype(np.int64) * len(texts) + words.doc[keep], return_counts=True)
                word, doc = pair // len(texts), pair % len(texts)
                part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                edge = np.searchsorted(word, cut)
                row = batch.column("row").slice(a, len(texts)).to_numpy()
                out = []
                for p in range(parts):
                    i, j = cut[p], cut[p + 1]
                    if j > i:
                        w, d, t = word[edge[p] : edge[p + 1]] - i, doc[edge[p] : edge[p + 1]], times[edge[p] : edge[p + 1]]
                        each = np.bincount(w, minlength=j - i)  # texts of each word; the pairs follow by word
                        docs, where = np.unique(d, return_inverse=True)
                        packed = (h[i:j], spelt[i:j], row[docs], each.astype("<u4"), where.astype("<u4" if len(docs) > 65535 else "<u2"), t.astype("<u4" if t.max() > 255 else "u1"))
                        out.append((p, *[x.tobytes() for x in packed]))
                kinds = [("part", pa.int32()), *[(c, pa.binary()) for c in PACKED]]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, (_, k) in enumerate(kinds)], [c for c, _ in kinds])
                del words, at, keep, h, pick, which, spelt, pair, times, word, doc, part, out  # before those of the next block are made

    return run


def _rare_scores(share: WordShare):
    """One hash range and slice -> (row, rare_known, rare_base, r0, r1 ..): what its words give to each text."""
    classes = len(share.by_class)
    names = ["row", "rare_known", "rare_base", *[f"r{k}" for k in range(classes + 1)]]

    def run(counts: pa.Table, packed: pa.Table) -> pa.Table:
        h = counts.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], counts.column("c").to_numpy()[order].astype(float)
        by = np.stack([counts.column(f"c{k}").to_numpy()[order] for k in range(classes)], axis=1).astype(float)
        rows: list[np.ndarray] = []
        sums: list[list[np.ndarray]] = [[] for _ in names[1:]]
        for r in range(packed.num_rows):
            words, spelt, row, each, docs, times = (packed.column(x)[r].as_py() for x in PACKED)
            words, row, each = np.frombuffer(words, np.uint64), np.frombuffer(row, np.int64), np.frombuffer(each, "<u4")
            spelt = np.frombuffer(spelt, "<f4").astype(float)
            n = int(each.sum())
            docs = np.frombuffer(docs, f"<u{len(docs) // n}").astype(np.int64)
            times = np.frombuffer(times, f"<u{len(times) // n}").astype(float)
            seen, seen_by, known = np.zeros(len(words)), np.zeros((len(words), classes)), np.zeros(len(words), bool)
            if len(h):
                at = np.searchsorted(h, words)
                at[at == len(h)] = 0
                known = h[at] == words
                seen[known], seen_by[known] = c[at[known]], by[at[known]]
            rows.append(row)
            for total, add in zip(sums, (known, np.log10(seen + 0.1), *share.logs(spelt, seen, seen_by)), strict=True):
                total.append(np.bincount(docs, weights=np.repeat(add, each) * times, minlength=len(row)))
        if not rows:
            return pa.table({n: pa.array([], pa.int64() if n in ("row", "rare_known") else pa.float64()) for n in names})
        row, which = np.unique(np.concatenate(rows), return_inverse=True)
        out = [np.bincount(which, weights=np.concatenate(v), minlength=len(row)) for v in sums]
        return pa.table(dict(zip(names, [row, out[0].astype(np.int64), *out[1:]], strict=True)))

    return run


def score_documents(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", *, model: str | None = None, rounds: int = 1, prior: float = 0.1, whole_words: bool = True, frequent: int = 100_000, class_share: float = 0.02, words_per_part: int = 400_000, tokens_per_slice: int = 2_000_000) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; logs are to base 10.

    train_on: condition on the rows to learn from. class_col: what divides the training texts into classes (null: nothing does); its
    values with ``class_share`` of the texts or more become classes. rounds: of expectation maximisation. prior: see above. whole_words: whether words have an edge of their own. A group that meets the rare words' counts
    holds about ``words_per_part`` words and ``tokens_per_slice`` tokens of texts (12 to 32 bytes each).
    """
    spark = docs.sparkSession
    path = model or default_model()
    text = F.col(f"`{text_col}`")
    group = (F.col(f"`{class_col}`") if class_col else F.lit(None)).cast("string")
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(~train_on, F.lit(True)).alias("held_out"), text.alias("text"), group.alias("group"))
    id_type = rows.schema["id"].dataType.simpleString()
    learn = rows.where("NOT held_out")
    ends = learn.count()
    sizes = {r.group: r["count"] for r in learn.groupBy("group").count().where(F.col("count") >= class_share * ends).orderBy("group").collect()}  # 1 / class_share at most
    names = list(sizes) or [None]
    number = F.coalesce(*[F.when(F.col("group").eqNullSafe(g), k) for k, g in enumerate(names)], F.lit(len(names)))  # the last: none of them
    found = learn.select("text", number.alias("k")).mapInArrow(_counts, "h long, word binary, k int, n long")
    by = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(len(names))]
    table = store.saved(found.groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("c"), *by), "words")
    per = [x for k in range(len(names)) for x in (F.coalesce(F.sum(f"c{k}"), F.lit(0)), F.count_if(F.col(f"c{k}") > 0))]
    distinct, tokens, *totals = table.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), *per).first()
    n, v = tokens + ends, distinct + (1 if ends else 0)
    by_class = list(zip(totals[0::2], totals[1::2], strict=True))
    share = WordShare(tokens, distinct, by_class, whole_words=whole_words)

    m = LatticeModel.initial(path)
    for _ in range(rounds if tokens else 0):
        held = spark.sparkContext.broadcast(m)
        uses = table.select("word").mapInArrow(_expected(held), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        total = np.zeros(len(m.piece) + 256)
        for r in uses.collect():  # one row for each piece of the vocabulary
            total[r.piece] = r.uses
        m = m.updated(total, distinct, prior)
    held = spark.sparkContext.broadcast(m)

    every = [f"c{k}" for k in range(len(names))]
    often = sorted(((r.h & (1 << 64) - 1, r.c, [r[x] for x in every]) for r in table.where(F.col("c") * frequent > n).select("h", "c", *every).collect()), key=lambda r: r[0])  # at most ``frequent`` rows
    lists = spark.sparkContext.broadcast((np.array([r[0] for r in often], np.uint64), np.array([r[1] for r in often], float), np.array([r[2] for r in often], float).reshape(len(often), len(names))))
    marks = [f"s{k}" for k in range(len(names) + 1)]
    alone = rows.drop("group").mapInArrow(_frequent_scores(held, share, lists), f"row long, id {id_type}, held_out boolean, words long, known long, base double, " + ", ".join(f"{x} double" for x in marks))

    same = store.saved(alone, "alone")
    parts = max(1, -(-distinct // words_per_part))
    scarce = same.agg(F.coalesce(F.sum(F.col("words") - F.col("known")), F.lit(0))).first()[0]  # tokens that are not frequent words
    slices = max(1, -(-scarce // (parts * tokens_per_slice)))
    packed = rows.select("row", "text").mapInArrow(_rare_blocks(parts, held, lists), "part int, " + ", ".join(f"{x} binary" for x in PACKED))
    packed = packed.withColumn("slice", F.pmod(F.xxhash64("rows"), F.lit(slices)).cast("int"))
    rare = table.where(F.col("c") * frequent <= n).select(F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * parts, 32).cast("int").alias("part"), "h", "c", *every)
    rare = rare.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    adds = ["rare_base", *[f"r{k}" for k in range(len(names) + 1)]]
    gains = rare.groupBy("part", "slice").cogroup(packed.groupBy("part", "slice")).applyInArrow(_rare_scores(share), "row long, rare_known long, " + ", ".join(f"{x} double" for x in adds))
    gains = gains.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("rare_known", *adds)])
    copies = same.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")  # rows that repeat id and text add up in gains
    out = same.join(gains, "row", "left").join(copies, "row", "left")
    times = F.coalesce("copies", F.lit(1))

    def rest(x: str) -> Column:
        return F.coalesce(F.col(x) / times, F.lit(0.0))

    scale = math.log10(n + 0.1 * (v + 1))
    base = F.col("base") + rest("rare_base") + math.log10(ends + 0.1) - (F.col("words") + 1) * scale
    known = F.col("known") + rest("rare_known").cast("long") + (1 if ends else 0)
    parts_ = []
    weights = [sizes.get(g, 0) for g in names]
    for k, (weight, (own, _)) in enumerate(zip([*weights, max(1.0, 0.1 * ends)], [*by_class, (tokens, distinct)], strict=True)):
        end = ((weight if k < len(names) else ends) + 0.1) / (own + (weight if k < len(names) else ends) + 0.2)
        prior = (weight + 0.01) / (sum(weights) + max(1.0, 0.1 * ends) + 0.01 * (len(names) + 1))
        parts_.append(F.col(f"s{k}") + rest(f"r{k}") + math.log10(end) + F.col("words") * math.log10(1 - end) + math.log10(prior))
    best = F.greatest(*parts_) if len(parts_) > 1 else parts_[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), p - best) for p in parts_), F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "held_out", (F.col("words") + 1).alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op8_lattice_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
