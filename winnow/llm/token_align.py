"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

A is a byte-level BPE (a tokenizers file), B a SentencePiece BPE with byte fallback; both are existing vocabularies. A reads a blank and the text, B the text (and
adds the blank itself). Each text is tokenised in full by both. Offsets where both have a token's end and both next tokens start with a blank are anchors: the ends are
compared as byte offsets, so an anchor is verified and not guessed from the tokens. Anchors cut a document into windows, short tuples of A ids and of B ids, and as
an alignment depends on these ids alone, it is made once for each pair of id tuples and remembered. Inside a window every offset where both have an end closes a group, and an A token and a B
token are linked where their byte ranges overlap.

Words repeat as windows do: no piece of B reaches from another character into a blank (checked when the file is read) and A splits there too, so a text is tokenised by the chunks between single
blanks, and the windows of a chunk are remembered as well; chunks start at anchors, so no window crosses their ends. What is remembered is emptied at a fixed size and never changes a result. Texts beyond a block are taken in segments of whole chunks, so memory does not grow with a text.

The links of an id pair are counted over the whole corpus by one shuffle of partial sums. Pairs with more than one in ``frequent`` of all links, hence fewer than ``frequent``, go
to every task; the others meet their documents by a join on the pair, and none of them is hot.

Null and empty texts, and texts that one of the tokenizers does not give back byte for byte (a U+2581 in the text, bytes that are no UTF-8), have no tokens: zeros, and '' instead of a hash. Repeated rows
and ids are rows of their own, each counted; null ids stay null. Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import store
from winnow.llm.nbest_pieces import ragged
from winnow.llm.words import blocks, byte_codes, prefix_hash, span_hash

BLOCK = 1 << 20
REMEMBERED, REMEMBERED_BYTES = 120_000, 1 << 24  # chunks and their bytes, and as many windows, for each worker
FREQUENT = 1_000_000
_LONG = 50_000  # bytes of a chunk from which A's own library takes over, whose time grows with the length only


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Rows:
    """Rows of integers, one after the other in an array that grows."""

    def __init__(self, kind: type) -> None:
        self.flat, self.ends, self.count = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def append(self, sizes: np.ndarray, values: np.ndarray) -> None:
        used = int(self.ends[self.count - 1]) if self.count else 0
        for name, need in (("flat", used + len(values)), ("ends", self.count + len(sizes))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate((held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype))))
        self.flat[used : used + len(values)] = values
        self.ends[self.count : self.count + len(sizes)] = used + np.cumsum(sizes)
        self.count += len(sizes)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, values) of the rows."""
        end = self.ends[at]
        start = np.where(at > 0, self.ends[at - 1], 0)
        return end - start, self.flat[ragged(start, end - start)].astype(np.int64)


def gives_back(ids: np.ndarray, many: np.ndarray, flat: tuple[np.ndarray, np.ndarray], text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the tokens of each chunk (``many`` in turn) are the bytes of the chunk (``size`` in turn of text). flat: the bytes of all tokens, and where each ends."""
    length = flat[1][ids + 1] - flat[1][ids]
    ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(many)))]
    fits = np.diff(ends) == size
    made = flat[0][ragged(flat[1][ids], length)][np.repeat(fits, np.diff(ends))]
    differs = made != text[np.repeat(fits, size)]
    if differs.any():
        fits[np.repeat(np.flatnonzero(fits), size[fits])[differs]] = False
    return fits


def distinct(h: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of one row of each kind, the kind of each row). Rows (spans of flat) of a kind are equal; those that only share a hash become kinds of their own."""
    _, pick, kind = np.unique(h, return_index=True, return_inverse=True)
    like = pick[kind]
    odd = size != size[like]
    rows = np.flatnonzero(~odd)
    differs = flat[ragged(start[rows], size[rows])] != flat[ragged(start[like[rows]], size[rows])]
    if differs.any():
        odd[np.repeat(rows, size[rows])[differs]] = True
    if odd.any():
        own = np.flatnonzero(odd)
        kind[own] = len(pick) + np.arange(len(own))
        pick = np.concatenate((pick, own))
    return pick, kind


class Tokenizers:
    """Both tokenizers, what their tokens stand for, and what has been tokenised and aligned so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back, vocab = byte_level(), model["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = [vocab[x + y] for x, y in merges] == [*range(256, 256 + len(merges))]  # then the order of merges is that of the ids
        self.a_fast = None
        if ranked:
            import public_tokenizers

            self.a_fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes)}, special_tokens={})
        self.b_own = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b_own.id_to_piece(i) for i in range(self.b_own.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b_own.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.chunked = ranked and not any("▁" in t.lstrip("▁") for t in names)
        self.size_b = len(self.b_bytes)
        self.a_len, self.b_len = (np.array([len(t) for t in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        self.a_blank, self.b_blank = (np.array([t[:1] == b" " for t in of]) for of in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = ((np.frombuffer(b"".join(of), np.uint8), np.cumsum([0, *map(len, of)])) for of in (self.a_bytes, self.b_bytes))
        decimal = [str(i).encode() for i in range(max(len(self.a_bytes), self.size_b))]
        self.digits, self.digit_end = np.frombuffer(b"".join(decimal), np.uint8), np.cumsum([0, *map(len, decimal)])
        self.forget()

    @functools.cached_property
    def a_own(self):
        """A's own library, which takes more memory and time."""
        import tokenizers

        own = tokenizers.Tokenizer.from_file(self.a_path)
        own.encode_special_tokens = True
        return own

    def forget(self) -> None:
        self.chunk: dict[bytes, int] = {}
        self.held = 0
        self.chunk_windows, self.chunk_fits, self.chunk_sizes = Rows(np.int32), [], []
        self.window: dict[tuple[bytes, bytes], int] = {}
        self.window_links, self.window_groups, self.window_text = Rows(np.int64), [], []

    def remembered(self, chunks: list[bytes]) -> np.ndarray:
        """Where each chunk (a blank and what follows) is kept, with its windows; new ones are tokenised and aligned."""
        new = [c for c in chunks if c not in self.chunk]
        if new:
            texts = [c[1:].decode("utf-8", "replace") for c in new]
            a_rows = [self.a_fast.encode_ordinary(" " + t) if self.a_fast and len(t) < _LONG else self.a_own.encode(" " + t, add_special_tokens=False).ids for t in texts]
            b_rows = self.b_own.encode(texts, num_threads=1)
            (a_size, a), (b_size, b) = ((np.fromiter(map(len, rows), np.int64, len(rows)), np.fromiter(itertools.chain.from_iterable(rows), np.int64)) for rows in (a_rows, b_rows))
            size = np.fromiter(map(len, new), np.int64, len(new))
            text = np.frombuffer(b"".join(new), np.uint8)
            fits = gives_back(a, a_size, self.a_flat, text, size) & gives_back(b, b_size, self.b_flat, text, size)
            self.chunk.update(zip(new, range(len(self.chunk), len(self.chunk) + len(new)), strict=True))
            self.held += len(text)
            self.chunk_fits.extend(fits.tolist())
            self.chunk_sizes.extend(zip(a_size.tolist(), b_size.tolist(), strict=True))
            self.cut(a[np.repeat(fits, a_size)], b[np.repeat(fits, b_size)], np.where(fits, a_size, 0))
        return np.fromiter((self.chunk[c] for c in chunks), np.int64, len(chunks))

    def cut(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray) -> None:
        """Cuts chunks that lie one behind the other into windows at their anchors, and keeps the windows of each."""
        a_at, b_at = np.cumsum(self.a_len[a]) - self.a_len[a], np.cumsum(self.b_len[b]) - self.b_len[b]
        # anchors: the same byte offset before a token that starts with a blank, on both sides; the start of a chunk is one
        anchor = np.intersect1d(a_at[self.a_blank[a]], b_at[self.b_blank[b]], assume_unique=True)
        a_from, b_from = np.searchsorted(a_at, anchor), np.searchsorted(b_at, anchor)
        windows = self.aligned(a, b, a_from, np.diff(np.append(a_from, len(a))), b_from, np.diff(np.append(b_from, len(b))))
        self.chunk_windows.append(np.diff(np.searchsorted(a_from, np.cumsum(a_size)), prepend=0), windows)

    def aligned(self, a: np.ndarray, b: np.ndarray, a_from: np.ndarray, a_many: np.ndarray, b_from: np.ndarray, b_many: np.ndarray) -> np.ndarray:
        """Where the alignments of the windows a[a_from : a_from + a_many], b[b_from : b_from + b_many] are kept. Their keys are the pairs of id tuples, packed."""
        packed = a.astype("<i4").tobytes(), b.astype("<i4").tobytes()
        spans = zip((4 * a_from).tolist(), (4 * (a_from + a_many)).tolist(), (4 * b_from).tolist(), (4 * (b_from + b_many)).tolist(), strict=True)
        keys = [(packed[0][i:j], packed[1][k:m]) for i, j, k, m in spans]
        new = []
        for w, key in enumerate(keys):
            if key not in self.window:
                self.window[key] = len(self.window)
                new.append(w)
        if new:
            w = np.array(new)
            self.align(a[ragged(a_from[w], a_many[w])], b[ragged(b_from[w], b_many[w])], a_many[w])
        return np.fromiter((self.window[key] for key in keys), np.int64, len(keys))

    def align(self, a: np.ndarray, b: np.ndarray, a_many: np.ndarray) -> None:
        """Aligns windows that lie one behind the other in a and b, and keeps their links, groups and text."""
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        last = a_end[np.cumsum(a_many) - 1]  # of each window, in bytes; an end of both sides
        every, shared = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end, assume_unique=True)
        # the bytes before an end and after the end before it belong to one token on either side: a link
        links = a[np.searchsorted(a_end, every)] * self.size_b + b[np.searchsorted(b_end, every)]
        size = np.diff(np.searchsorted(every, last, side="right"), prepend=0)
        self.window_links.append(size, links)
        self.window_groups.extend(np.diff(np.searchsorted(shared, last, side="right"), prepend=0).tolist())
        # the ids in decimal, group by group: a comma inside a side, a bar between the sides, a semicolon behind a group
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        group = np.concatenate((2 * a_group, 2 * b_group + 1))
        mark = np.full(len(group), ord(","), np.uint8)
        mark[: len(a)][np.append(a_group[1:] != a_group[:-1], True)] = ord("|")
        mark[len(a) :][np.append(b_group[1:] != b_group[:-1], True)] = ord(";")
        order = np.argsort(group, kind="stable")
        ids, mark = np.concatenate((a, b))[order], mark[order]
        digits = self.digit_end[ids + 1] - self.digit_end[ids]
        end = np.cumsum(digits + 1)
        text = np.empty(int(end[-1]), np.uint8)
        text[ragged(end - digits - 1, digits)] = self.digits[ragged(self.digit_end[ids], digits)]
        text[end - 1] = mark
        stop = end[np.searchsorted(group[order], 2 * np.searchsorted(shared, last) + 1, side="right") - 1]
        flat, at = text.tobytes(), 0
        for e in stop.tolist():
            self.window_text.append(flat[at : e - 1])
            at = e


@functools.lru_cache(maxsize=2)
def loaded(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def chunk_starts(buf: np.ndarray) -> np.ndarray:
    """Whether a chunk starts at each byte: at single blanks between characters that are surely no white space."""
    first = np.zeros(len(buf), bool)
    if len(buf) < 3:
        return first
    plain = (buf > 0x20) & (buf < 0x7F) | (buf >= 0x80)
    wide = (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))  # what white space beyond ASCII begins with
    ok = (buf == 0x20)[1:-1] & plain[:-2] & plain[2:] & ~wide[2:]
    ok[1:] &= ~wide[:-3]
    ok[2:] &= ~wide[:-4]
    first[1:-1] = ok
    return first


@dataclass
class Found:
    """What is known of a document: counts, the groups as text, and its distinct links (key, how often)."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    text: list[bytes] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def sha256(self) -> str:
        return hashlib.sha256(b";".join(self.text)).hexdigest() if self.n_a else ""


def block_found(t: Tokenizers, texts: list[bytes]) -> list[Found | None]:
    """A row for each text; None for one that is not given back byte for byte."""
    if max(len(t.chunk), len(t.window)) > REMEMBERED or t.held > REMEMBERED_BYTES:
        t.forget()
    out: list[Found | None] = [Found() for _ in texts]
    docs = np.array([d for d, x in enumerate(texts) if x], np.int64)
    if not len(docs):
        return out
    joined = b"".join(b" " + texts[d] for d in docs)
    buf = np.frombuffer(joined, np.uint8)
    doc_start = np.concatenate(([0], np.cumsum([len(texts[d]) + 1 for d in docs])))
    first = chunk_starts(buf) if t.chunked else np.zeros(len(buf), bool)
    first[doc_start[:-1]] = True
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(buf)))
    pick, kind = distinct(span_hash(prefix_hash(byte_codes(buf)), start, start + size), buf, start, size)
    kept = t.remembered([joined[i:j] for i, j in zip(start[pick].tolist(), (start + size)[pick].tolist(), strict=True)])[kind]
    doc = np.searchsorted(doc_start, start, side="right") - 1
    bad = np.unique(doc[~np.fromiter(t.chunk_fits, bool, len(t.chunk_fits))[kept]])
    for d in bad:
        out[docs[d]] = None
    if len(bad):
        stays = ~np.isin(doc, bad)
        kept, doc = kept[stays], doc[stays]
    n = len(docs)
    n_a, n_b = (np.bincount(doc, x, n).astype(np.int64) for x in np.array(t.chunk_sizes, np.int64)[kept].T)
    windows, at = t.chunk_windows.take(kept)
    w_doc = np.repeat(doc, windows)
    many, keys = t.window_links.take(at)
    space = np.int64(len(t.a_bytes) * t.size_b)
    both, times = np.unique(np.repeat(w_doc, many) * space + keys, return_counts=True)
    groups = np.bincount(w_doc, np.fromiter(t.window_groups, np.int64, len(t.window_groups))[at], n).astype(np.int64)
    links = np.bincount(w_doc, many, n).astype(np.int64)
    edge, of = np.searchsorted(both, np.arange(n + 1) * space), np.searchsorted(w_doc, np.arange(n + 1))
    text = [t.window_text[i] for i in at.tolist()]
    for d in range(n):
        if out[docs[d]] is not None:
            part = slice(edge[d], edge[d + 1])
            out[docs[d]] = Found(int(n_a[d]), int(n_b[d]), int(groups[d]), int(links[d]), text[of[d] : of[d + 1]], both[part] - d * space, times[part])
    return out


def segments(t: Tokenizers, text: bytes) -> Iterator[bytes]:
    """A long text in parts of whole chunks, each without its leading blank; each about a block long where the chunks allow it."""
    cut = np.flatnonzero(chunk_starts(np.frombuffer(text, np.uint8))) if t.chunked else np.zeros(0, np.int64)
    at = 0
    while at < len(text):
        k = int(np.searchsorted(cut, at + BLOCK))
        end = int(cut[k]) if k < len(cut) else len(text)
        yield text[at:end]
        at = end + 1


def long_found(t: Tokenizers, text: bytes) -> Found | None:
    out = Found()
    for part in segments(t, text):
        found = block_found(t, [part])[0]
        if found is None:
            return None
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            setattr(out, name, getattr(out, name) + getattr(found, name))
        out.text.append(b";".join(found.text))
        keys, back = np.unique(np.concatenate((out.keys, found.keys)), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, back, np.concatenate((out.times, found.times)))
        out.keys, out.times = keys, times
    return out


def texts_found(t: Tokenizers, texts: list[bytes]) -> list[Found]:
    found = [long_found(t, texts[0])] if len(texts) == 1 and len(texts[0]) > BLOCK else block_found(t, texts)
    return [f or Found() for f in found]


def _longs(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(rows) if rows else np.zeros(0, np.int64))


def _linked(a_path: str, b_path: str, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(a_path, b_path)
        for batch in batches:
            for a, b, texts in blocks(batch, text_col, BLOCK):
                found = texts_found(t, texts)
                counts = [pa.array([getattr(f, c) for f in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                hashed = pa.array([f.sha256 for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), *counts, hashed, _longs([f.keys for f in found]), _longs([f.times for f in found])], [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    return run


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """A row for each document: id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct links as keys (A id * pieces of B + B id) with how often each occurs."""
    paths = default_paths()
    rows = store.columns(docs, id_col, text_col)
    schema = T.StructType([rows.schema[id_col], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(_linked(a or paths[0], b or paths[1], id_col, text_col), schema)


def align(docs: DataFrame, *, text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """docs with groups, an array of (a, b): the ids of either side of each group; empty for texts without tokens. A column of that name is replaced."""
    a_path, b_path = a or default_paths()[0], b or default_paths()[1]
    base = docs.drop("groups")
    side = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(a_path, b_path)
        for batch in batches:
            for x, y, texts in blocks(batch, text_col, BLOCK):
                rows = []
                for f in texts_found(t, texts):
                    whole = b";".join(f.text).decode().split(";") if f.n_a else []
                    rows.append([dict(zip("ab", ([*map(int, ids.split(","))] for ids in g.split("|")), strict=True)) for g in whole])
                part = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.struct([("a", side), ("b", side)])))], [*part.schema.names, "groups"])

    ids = T.ArrayType(T.IntegerType())
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("groups", T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)])))]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, count) over the rows of a task, with a bounded number of keys at hand."""
    keys, times, held = [], [], 0

    def summed() -> pa.RecordBatch:
        kinds, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, back, np.concatenate(times))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(total)], ["key", "count"])

    for batch in batches:
        keys.append(batch.column("keys").flatten().to_numpy())
        times.append(batch.column("times").flatten().to_numpy())
        held += len(keys[-1])
        if held > 4_000_000:
            one = summed()
            if one.num_rows > 2_000_000:
                yield one
                keys, times, held = [], [], 0
            else:
                keys, times, held = [one.column("key").to_numpy()], [one.column("count").to_numpy()], one.num_rows
    if keys:
        yield summed()


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """(key, count, best) of every id pair, as a saved table: its links in all documents, and whether no pair with the same B id has more."""
    counted = store.saved(linked.select("keys", "times").mapInArrow(_sums, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")), "pairs")
    most = counted.groupBy((F.col("key") % size_b).alias("b")).agg(F.max("count").alias("most"))  # a row for each B id at most
    out = store.saved(counted.withColumn("b", F.col("key") % size_b).join(F.broadcast(most), "b").select("key", "count", (F.col("count") == F.col("most")).alias("best")), "counts")
    store.forget(counted)
    return out


def scored(linked: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """linked (a saved table) with n_best and count_sum instead of keys and times; counts: the table of pair_counts()."""
    spark = linked.sparkSession
    total = linked.agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    few = counts.where(F.col("count") * frequent > total).orderBy("key").toArrow()  # fewer than ``frequent`` rows
    model = spark.sparkContext.broadcast([few.column(c).to_numpy() for c in ("key", "count", "best")])
    own = [c for c in linked.columns if c not in ("keys", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, best = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                size = np.diff(part.column("keys").offsets.to_numpy())
                keys, times = (part.column(c).flatten().to_numpy() for c in ("keys", "times"))
                place = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
                hit = key[place] == keys if len(key) else np.zeros(len(keys), bool)
                place = place[hit]
                end = np.cumsum(size)

                def over(values: np.ndarray, hit=hit, end=end, size=size) -> np.ndarray:
                    full = np.zeros(len(hit) + 1, np.int64)
                    full[1:][hit] = values
                    full = np.cumsum(full)
                    return full[end] - full[end - size]

                sums = [over(times[hit] * best[place]), over(times[hit] * count[place])]
                missed = np.concatenate(([0], np.cumsum(~hit)))[np.concatenate(([0], end))].astype(np.int32)
                rest = [pa.ListArray.from_arrays(missed, v[~hit]) for v in (keys, times)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *map(pa.array, sums), *rest], [*own, "n_best", "count_sum", "keys", "times"])

    schema = T.StructType([*[linked.schema[c] for c in own], *[T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")], linked.schema["keys"], linked.schema["times"]])
    met = store.saved(linked.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "met")
    rare = met.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    rest = counts.where(F.col("count") * frequent <= total)
    found = rare.join(rest, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    sums = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    out = store.saved(met.drop("keys", "times").join(found, "row", "left").select(*own, *sums), "aligned")
    store.forget(met)
    model.destroy()
    return out


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = default_paths()
    linked = store.saved(links(docs), "links")
    counts = pair_counts(linked, loaded(a, b).size_b)
    out = scored(linked, counts)
    for table in (linked, counts):
        store.forget(table)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
