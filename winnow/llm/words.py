"""Words, shingles and their 64-bit hashes for a block of texts, in numpy.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D) of the text in UTF-8,
with A-Z lower-cased. A word's hash is a polynomial over random byte codes, finished by a bit mixer; it
depends on the word alone, so it is the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_pow: list[np.ndarray] = []

BLOCK_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        up, down = np.full(size, _MULT), np.full(size, _INV)
        up[0] = down[0] = 1
        _pow[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of code[i] * M**i; ``span_hash`` reads the hash of any span off them."""
    out = np.zeros(len(codes) + 1, np.uint64)
    up, _ = _powers(len(codes) + 1)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def byte_codes(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def blocks(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, texts in UTF-8) with about ``limit`` bytes at a time; null is empty."""
    column = batch.column(name).cast(pa.large_binary())
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, limit + (int(size[at - 1]) if at else 0), side="right")))
        yield at, end, [t or b"" for t in column.slice(at, end - at).to_pylist()]
        at = end


class Words:
    """The words of a block of texts: ``hash`` of each word, ``doc`` (index of its text), ``start``/``end`` in ``buf``."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(t.lower() for t in texts) + b"\n"
        self.buf = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.count = np.diff(np.searchsorted(self.start, offsets))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.prefix = prefix_hash(byte_codes(self.buf))
        self.hash = span_hash(self.prefix, self.start, self.end)

    def stems(self, size: int) -> np.ndarray:
        """The hash of the first ``size`` bytes of each word."""
        return span_hash(self.prefix, self.start, np.minimum(self.start + size, self.end))

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct k-word shingles, sorted by both; a text of fewer words is one shingle as a whole."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    docs, hashes = [], []
    if n >= k:
        x = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            x = mix(x * _MULT + h[j : n - k + 1 + j])
        full = doc[: n - k + 1] == doc[k - 1 :]
        docs.append(doc[: n - k + 1][full])
        hashes.append(x[full])
    first = np.concatenate(([0], np.cumsum(words.count)[:-1])).astype(np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        x = np.full(len(short), 7, np.uint64) + words.count[short].astype(np.uint64)
        for j in range(k - 1):
            has = words.count[short] > j
            x[has] = mix(x[has] * _MULT + h[first[short[has]] + j])
        docs.append(short)
        hashes.append(mix(x))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, x = np.concatenate(docs), np.concatenate(hashes)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, x = doc[order], x[order]
    edges = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1), len(doc)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], x[new]
