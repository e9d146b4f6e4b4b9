"""SentencePiece encoding to the N best segmentations, and decoding.

As in the model's own encoder a blank is put in front and blanks become U+2581. Pieces are chosen so that their probabilities have the largest product. A unigram model has these probabilities; a BPE model has merge
ranks, from which they are made (lattice.log_scores). A BPE model's own encoder merges greedily by rank instead, so its pieces often differ from the best segmentation, though either decodes to the text. Characters that no piece holds become byte pieces. A U+2581 in the text itself becomes
byte pieces as well, so decoding returns every text exactly.

No piece reaches from other characters into a blank, so a text falls into chunks (blanks and what follows them) whose lattices are
independent. A forward Viterbi pass over the lattices of all distinct chunks of a block gives the best score of every position;
a backward pass gives each chunk's distance to its second-best segmentation. The N best segmentations of a text differ from
the best only in the N - 1 chunks with the smallest distances. For these, a backward A* search runs over the chunk's lattice,
with the forward scores as exact heuristics, so that complete segmentations leave the queue in order of their scores. Equal scores go
to the longer last piece, then to the earlier chunk. All N are returned: the best in full, the others as what they change in it.

Null texts give null; empty texts give no pieces. Very long texts are encoded as a whole, and repeated rows alike. An empty table gives an empty result. Columns named like a result
are replaced; others, whatever their names, pass through encode().
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import store
from winnow.llm.lattice import BLANK, LITERAL, Pieces, char_codes, default_model, edges, groups, pieces
from winnow.llm.words import blocks, prefix_hash, span_hash


BLOCK = 3 << 19  # of the query, which returns digests only
ENCODED = 1 << 19  # of encode(), whose ids and texts are in memory beside the block
CHANGES = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("pieces", pa.list_(pa.int32()))])))


def a_star(edge_list: list[tuple[int, int, int, float]], ahead: np.ndarray, n: int) -> list[tuple[float, list[int]]]:
    """The n best paths through one lattice: (score, piece ids).

    edge_list: (start, end, id, score). ahead: the best score from 0 to each position (forward Viterbi).
    """
    into: dict[int, list] = {}
    for s, e, i, w in sorted(edge_list):  # the longer piece first
        into.setdefault(e, []).append((s, i, w))
    end = len(ahead) - 1
    queue, count, out = [(-ahead[end], 0, end, 0.0, ())], 1, []
    visits = [0] * (end + 1)
    while queue and len(out) < n:
        f, _, at, behind, tail = heapq.heappop(queue)
        visits[at] += 1
        if visits[at] > n and at:  # n better tails from here exist already
            continue
        if at == 0:
            ids = []
            while tail:
                ids.append(tail[0])
                tail = tail[1]
            out.append((-f, ids))
            continue
        for s, i, w in into.get(at, ()):
            if np.isfinite(ahead[s]):
                heapq.heappush(queue, (-(ahead[s] + w + behind), count, s, behind + w, (i, tail)))
                count += 1
    return out


class Block:
    """The chunks of a block of texts with their best segmentations."""

    def __init__(self, p: Pieces, texts: list[bytes]):
        self.p = p
        raw = [np.frombuffer(t.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        lengths = np.array([len(r) + (len(r) > 0) for r in raw], np.int64)
        self.doc_start = np.concatenate(([0], np.cumsum(lengths)))
        points = np.empty(int(self.doc_start[-1]), np.uint32)
        for r, a in zip(raw, self.doc_start, strict=False):
            if len(r):
                points[a] = 0x20
                points[a + 1 : a + 1 + len(r)] = r
        points[points == BLANK] = LITERAL
        points[points == 0x20] = BLANK
        self.points = points
        held = np.zeros(0x110000, bool)
        held[p.chars] = True
        known = np.zeros(len(points), bool)
        inside = points < 0x110000
        known[inside] = held[points[inside]]
        first = np.zeros(len(points), bool)
        first[self.doc_start[:-1][lengths > 0]] = True
        if len(points):
            blank = points == BLANK
            first[1:] |= (blank[1:] & ~blank[:-1]) | ~known[1:] | ~known[:-1]
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(points)))
        self.prefix = prefix_hash(char_codes(points))
        h = span_hash(self.prefix, start, start + length)
        _, pick, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.length = start[pick], length[pick]
        self.doc_chunk = np.searchsorted(start, self.doc_start)
        self.lone = ~known[self.start] if len(pick) else np.zeros(0, bool)
        n = len(pick)
        self.score = np.zeros(n)
        self.gap = np.full(n, np.inf)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lone = np.flatnonzero(self.lone)
        if len(lone):
            self.score[lone] = p.unknown
            coded = [self._bytes(points[self.start[i]]) for i in lone]
            parts.append((lone, np.array([len(c) for c in coded]), np.concatenate(coded)))
        rest = np.flatnonzero(~self.lone)
        for g in groups(self.length[rest]):
            parts.append(self._viterbi(rest[g]))
        count = np.zeros(n, np.int64)
        for rows, sizes, _ in parts:
            count[rows] = sizes
        self.id_start = np.concatenate(([0], np.cumsum(count)))
        self.ids = np.empty(int(self.id_start[-1]), np.int32)
        for rows, sizes, ids in parts:
            self.ids[ragged(self.id_start[rows], sizes)] = ids

    def _bytes(self, point: int) -> np.ndarray:
        c = "▁" if point == LITERAL else chr(point)
        return self.p.byte_id[list(c.encode("utf-8", "surrogatepass"))]

    def _viterbi(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, length = self.p, self.length[rows]
        found = edges(p, self.prefix, self.points, self.start[rows], length)
        wide, n = int(length.max()) + 1, len(rows)
        best = np.full((n, wide), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, wide), np.int32)
        piece = np.full((n, wide), -2, np.int64)
        for e in found:
            w = np.where(e.piece < 0, p.unknown, p.score[e.piece])
            cand = best[e.row, e.s] + w
            better = cand > best[e.row, e.e]  # a start and an end have one edge, so rows do not repeat for an end
            r, t = e.row[better], e.e[better]
            best[r, t], back[r, t], piece[r, t] = cand[better], e.s, e.piece[better]
        every = np.arange(n)
        self.score[rows] = best[every, length]
        # from the end: the pieces of the best path
        on_path = np.full((n, wide), -1, np.int32)
        at, live, trail = length.copy(), every, []
        while len(live):
            trail.append((live, piece[live, at[live]], self.start[rows[live]] + back[live, at[live]]))
            on_path[live, at[live]] = back[live, at[live]]
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        row = np.concatenate([t[0] for t in trail])
        step = np.concatenate([np.full(len(t[0]), -i) for i, t in enumerate(trail)])
        ids = np.concatenate([t[1] for t in trail])
        where = np.concatenate([t[2] for t in trail])
        order = np.lexsort((step, row))
        row, ids, where = row[order], ids[order], where[order]
        # distance to the best path that uses an edge off the best path
        after = np.full((n, wide), -np.inf)
        after[every, length] = 0
        second = np.full(n, -np.inf)
        for e in reversed(found):
            w = np.where(e.piece < 0, p.unknown, p.score[e.piece])
            reach = w + after[e.row, e.e]
            order = np.argsort(e.row, kind="stable")
            np.maximum.at(after, (e.row, np.full(len(e.row), e.s)), reach)
            off = on_path[e.row, e.e] != e.s
            np.maximum.at(second, e.row[off], best[e.row[off], e.s] + reach[off])
        self.gap[rows] = self.score[rows] - second
        unknown = ids < 0
        if unknown.any():
            coded = [self._bytes(int(self.points[where[i]])) if unknown[i] else p.id[ids[i] : ids[i] + 1] for i in range(len(ids))]
            sizes = np.bincount(row, weights=[len(c) for c in coded], minlength=n).astype(np.int64)
            return rows, sizes, np.concatenate(coded)
        return rows, np.bincount(row, minlength=n), p.id[ids]

    def search(self, n: int) -> None:
        """Finds the n best segmentations of every chunk in which one of the n best of a text can differ from the best."""
        self.open = [self._near(d, n) for d in range(len(self.doc_chunk) - 1)]
        at = [self.doc_chunk[d] + o for d, o in enumerate(self.open)]
        need = np.unique(self.which[np.concatenate(at)]) if at else np.zeros(0, np.int64)
        self.options: dict[int, list[tuple[float, list[int]]]] = {}
        for g in groups(self.length[need]):
            rows = need[g]
            found = edges(self.p, self.prefix, self.points, self.start[rows], self.length[rows])
            lists: list[list] = [[] for _ in rows]
            for e in found:
                for r, t, i in zip(e.row.tolist(), e.e.tolist(), e.piece.tolist(), strict=True):
                    lists[r].append((e.s, t, i))
            for c, own in zip(rows.tolist(), lists, strict=True):
                self.options[c] = self._n_best_of_chunk(c, own, n)

    def _near(self, d: int, n: int) -> np.ndarray:
        """The chunks of text d, by place, whose second-best segmentation is among the n - 1 nearest to the best."""
        gap = self.gap[self.which[self.doc_chunk[d] : self.doc_chunk[d + 1]]]
        near = np.flatnonzero(np.isfinite(gap))
        if len(near) > n - 1:
            most = np.partition(gap[near], n - 2)[n - 2] if n > 1 else -1
            near = near[gap[near] <= most]
            near = near[np.argsort(gap[near], kind="stable")][: n - 1]
        return near

    def _n_best_of_chunk(self, c: int, found: list[tuple[int, int, int]], n: int) -> list[tuple[float, list[int]]]:
        p = self.p
        ahead = np.full(int(self.length[c]) + 1, -np.inf)
        ahead[0] = 0
        listed = []
        for s, t, i in found:  # by start
            w = p.unknown if i < 0 else float(p.score[i])
            ahead[t] = max(ahead[t], ahead[s] + w)
            listed.append((s, t, i if i < 0 else int(p.id[i]), w))
        out = []
        for score, ids in a_star(listed, ahead, n):
            full, at = [], int(self.start[c])
            for i in ids:
                if i < 0:
                    full += self._bytes(int(self.points[at])).tolist()
                    at += 1
                else:
                    full.append(i)
                    at += len(p.text[i])
            out.append((score, full))
        return out

    def doc_ids(self, d: int) -> np.ndarray:
        c = self.which[self.doc_chunk[d] : self.doc_chunk[d + 1]]
        return self.ids[ragged(self.id_start[c], self.id_start[c + 1] - self.id_start[c])]

    def doc_score(self, d: int) -> float:
        return float(self.score[self.which[self.doc_chunk[d] : self.doc_chunk[d + 1]]].sum())

    def n_best(self, d: int, n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """The n best segmentations of text d, after search(n): (score, {chunk number: its pieces where they differ from the best})."""
        c = self.which[self.doc_chunk[d] : self.doc_chunk[d + 1]]
        states: list[tuple[float, dict[int, list[int]]]] = [(0.0, {})]
        for at in self.open[d].tolist():
            options = self.options[int(c[at])]
            grown = [(loss + options[0][0] - score, k, j, {**diff, at: ids} if j else diff) for k, (loss, diff) in enumerate(states) for j, (score, ids) in enumerate(options)]
            states = [(g[0], g[3]) for g in sorted(grown, key=lambda g: g[:3])[:n]]
        total = self.doc_score(d)
        return [(total - loss, diff) for loss, diff in states]

    def alternatives(self, d: int, best: list[tuple[float, dict[int, list[int]]]]) -> list[list[tuple[int, int, list[int]]]]:
        """The second and further ones of n_best() as changes to the best pieces: (place, number of pieces replaced, new pieces)."""
        c = self.which[self.doc_chunk[d] : self.doc_chunk[d + 1]]
        size = self.id_start[c + 1] - self.id_start[c]
        start = np.cumsum(size) - size
        return [[(int(start[k]), int(size[k]), ids) for k, ids in sorted(diff.items())] for _, diff in best[1:]]


def changed(best: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The pieces of an alternative, from the best ones and its changes."""
    out, end = [], 0
    for start, size, ids in changes:
        out += best[end:start]
        out += ids
        end = start + size
    return out + best[end:]


def replaced(best: np.ndarray, changes: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """As changed(), for an array of little-endian ids."""
    parts, end = [], 0
    for start, size, ids in changes:
        parts += [best[end:start], np.array(ids, "<i4")]
        end = start + size
    return np.concatenate([*parts, best[end:]])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. and so on."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(start - (ends - size), size)


def spelt(p: Pieces, ids: list[int]) -> bytes:
    return b"".join([p.bytes[i] for i in ids])


def decode_ids(p: Pieces, ids: list[int]) -> bytes:
    return spelt(p, ids)[1:]


def encode(docs: DataFrame, text_col: str = "text", *, n: int = 4, model: str | None = None) -> DataFrame:
    """docs with pieces (ids of the best segmentation), scores (of the n best, best first), n_pieces and alternatives; columns of these names are replaced.

    alternatives: for each of the second to nth best its changes to pieces, (start, size, pieces); segmentations() has them in full.
    """
    path = model or default_model()
    store.narrow_batches(docs.sparkSession)
    base = docs.drop("pieces", "scores", "n_pieces", "alternatives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            null = batch.column(text_col).is_null().to_numpy(zero_copy_only=False)
            for a, b, texts in blocks(batch, text_col, ENCODED):
                block = Block(p, texts)
                block.search(n)
                ids = [None if null[a + d] else block.doc_ids(d) for d in range(b - a)]
                best = [None if null[a + d] else block.n_best(d, n) for d in range(b - a)]
                scores = [None if k is None else [s for s, _ in k] for k in best]
                others = [None if k is None else [[dict(zip(("start", "size", "pieces"), c, strict=True)) for c in other] for other in block.alternatives(d, k)] for d, k in enumerate(best)]
                part = batch.slice(a, b - a)
                out = [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64())), pa.array([0 if i is None else len(i) for i in ids], pa.int64()), pa.array(others, CHANGES)]
                yield pa.RecordBatch.from_arrays(out, [*part.schema.names, "pieces", "scores", "n_pieces", "alternatives"])

    schema = T.StructType([*base.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("n_pieces", T.LongType())])
    change = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    schema.add("alternatives", T.ArrayType(T.ArrayType(change)))
    return base.mapInArrow(run, schema)


def segmentations(encoded: DataFrame) -> DataFrame:
    """A row for each of the n best segmentations of each row of encode(): rank (1 is the best), score, and pieces in full."""
    whole = F.expr("concat(array(array()), coalesce(alternatives, array()))")
    each = encoded.where("pieces IS NOT NULL").select("*", F.posexplode(whole).alias("place", "changes"))
    pieces_ = """aggregate(changes, struct(cast(array() as array<int>) as made, 0 as done),
        (a, c) -> struct(concat(a.made, slice(pieces, a.done + 1, c.start - a.done), c.pieces) as made, c.start + c.size as done),
        a -> concat(a.made, slice(pieces, a.done + 1, greatest(size(pieces) - a.done, 0))))"""
    out = each.withColumn("pieces", F.expr(pieces_)).withColumn("n_pieces", F.size("pieces").cast("long"))
    out = out.withColumn("rank", F.col("place") + 1).withColumn("score", F.col("scores")[F.col("place")])
    return out.drop("place", "changes", "alternatives", "scores")


def decode(encoded: DataFrame, pieces_col: str = "pieces", *, name: str = "decoded", model: str | None = None) -> DataFrame:
    """encoded with the text that the pieces stand for; null for null. A column of that name is replaced."""
    path = model or default_model()
    base = encoded.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if v is None else decode_ids(p, v) for v in part.column(pieces_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.StringType())]))


def _round_trip(path: str, n: int):
    """(doc_id, text) -> the digest columns; encodes and decodes each block in turn, so ids do not leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for a, b, texts in blocks(batch, "text", BLOCK):
                block, rows = Block(p, texts), []
                block.search(n)
                for d, text in enumerate(texts):
                    ids = block.doc_ids(d)
                    best = block.n_best(d, n)
                    first = ids.astype("<i4")
                    fits = None if null[a + d] else decode_ids(p, ids.tolist()) == text
                    all_ids = hashlib.sha256(np.int32(len(ids)).tobytes() + first.tobytes())
                    for changes in block.alternatives(d, best):
                        # it decodes to the text if the best does and what it changes stands for the same bytes
                        fits = fits and all(spelt(p, new) == spelt(p, first[start : start + size].tolist()) for start, size, new in changes)
                        other = replaced(first, changes)
                        all_ids.update(np.int32(len(other)).tobytes() + other.tobytes())
                    rows.append((len(ids), best[0][0], len(best), best[-1][0], hashlib.sha256(first.tobytes()).hexdigest(), all_ids.hexdigest(), fits))
                kinds = [("n_pieces", pa.int64()), ("score", pa.float64()), ("n_best", pa.int32()), ("last_score", pa.float64()), ("pieces_sha256", pa.string()), ("n_best_sha256", pa.string()), ("round_trip", pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)]], ["doc_id", *[k for k, _ in kinds]])

    return run


def op10_nbest_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return docs.mapInArrow(_round_trip(default_model(), 4), "doc_id long, n_pieces long, score double, n_best int, last_score double, pieces_sha256 string, n_best_sha256 string, round_trip boolean")
