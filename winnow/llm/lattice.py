"""Piece lattices of many short strings at once, in numpy.

The vocabulary comes from an existing SentencePiece model; its path is a parameter and nothing is trained.
Strings are arrays of code points with U+2581 for the blank. All distinct strings of a block are handled together: for each start
the spans that are still a prefix of some piece are extended by one character at a time.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from winnow.llm.words import mix, prefix_hash, span_hash

BLANK = 0x2581
LITERAL = 0xFFFFFFFF  # stands for a U+2581 that is part of the text itself
_BITS = 22


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def char_codes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) * np.uint64(2) + np.uint64(1)) | np.uint64(1)


def _is_bpe(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == model.trainer_spec.BPE


def log_scores(score: np.ndarray, bpe: bool) -> np.ndarray:
    """Scores as natural log probabilities, in steps of 2**-24, so that their sums are exact in any order.

    A unigram model's scores are such already. Those of a BPE model only order its merges; the piece of rank r gets the share 1 / (r + 2), as in Zipf's law.
    """
    if bpe:
        rank = len(score) - np.searchsorted(np.sort(score), score, side="right")
        score = -np.log(rank + 2.0)
        score -= np.log(np.exp(score).sum())
    return np.round(score * 2.0**24) / 2.0**24


class Pieces:
    """hash, id, score (see log_scores) and length of the ordinary pieces, sorted by hash; ids of the byte pieces; the characters covered."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(self.size)]
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte_id[int(self.text[i][3:5], 16)] = i
        own = [i for i in range(self.size) if not special[i] and self.text[i]]
        points = [np.array([ord(c) for c in self.text[i]], np.uint32) for i in own]
        flat = np.concatenate(points)
        cut = np.cumsum([0, *map(len, points)])
        prefix = prefix_hash(char_codes(flat))
        h = span_hash(prefix, cut[:-1], cut[1:])
        order = np.argsort(h)
        self.hash = h[order]
        self.id = np.array(own, np.int64)[order]
        self.score = log_scores(np.array([model.get_score(i) for i in own]), _is_bpe(path))[order]
        self.longest = int(np.diff(cut).max())
        self.chars = np.unique(flat)
        self.single = np.zeros(0x110000 + 1, bool)  # characters that are pieces; the last place stands for all others
        self.single[[p[0] for p in points if len(p) == 1]] = True
        # an unknown character costs more than any ordinary piece
        self.unknown = float(self.score[self.score > -1e8].min()) - 10
        starts = np.concatenate([np.full(len(p), a) for p, a in zip(points, cut[:-1], strict=True)])
        self._prefix = np.zeros(1 << _BITS, bool)
        self._prefix[span_hash(prefix, starts, np.arange(1, len(flat) + 1)) >> np.uint64(64 - _BITS)] = True
        # the place of the piece by the leading bits of its hash; where several share these, the last one's, and the others in a table of their own
        top = self.hash >> np.uint64(64 - _BITS)
        self._slot = np.full(1 << _BITS, -1, np.int32)
        self._slot[top] = np.arange(len(top))
        self._crowded = np.flatnonzero(self._slot[top] != np.arange(len(top)))
        #: What a piece decodes to.
        self.bytes = [t.replace("▁", " ").encode() for t in self.text]
        for b, i in enumerate(self.byte_id):
            if i >= 0:
                self.bytes[i] = bytes([b])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        at = self._slot[h >> np.uint64(64 - _BITS)]
        near = np.flatnonzero(at >= 0)
        out = np.full(len(h), -1, np.int64)
        hit = self.hash[at[near]] == h[near]
        out[near[hit]] = at[near[hit]]
        rest = near[~hit]
        if len(rest) and len(self._crowded):
            place = np.minimum(np.searchsorted(self.hash[self._crowded], h[rest]), len(self._crowded) - 1)
            found = self.hash[self._crowded[place]] == h[rest]
            out[rest[found]] = self._crowded[place[found]]
        return out

    def can_grow(self, h: np.ndarray) -> np.ndarray:
        return self._prefix[h >> np.uint64(64 - _BITS)]


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Edges:
    """Lattice edges from position ``s`` to ``e`` of string ``row``; ``piece`` is an index into Pieces, -1 an unknown character."""

    s: int
    row: np.ndarray
    e: np.ndarray
    piece: np.ndarray


def edges(p: Pieces, prefix: np.ndarray, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[Edges]:
    """The lattices of the strings at start[i] : start[i] + length[i], edge lists by first position."""
    out = []
    everyone = np.arange(len(start))
    for s in range(int(length.max(initial=0))):
        alive = everyone[length > s]
        rows, ends, found = [], [], []
        lone = alive[~p.single[np.minimum(points[start[alive] + s], 0x110000)]]
        if len(lone):
            rows.append(lone)
            ends.append(np.full(len(lone), s + 1))
            found.append(np.full(len(lone), -1))
        for n in range(1, p.longest + 1):
            alive = alive[length[alive] >= s + n]
            if not len(alive):
                break
            at = start[alive] + s
            h = span_hash(prefix, at, at + n)
            grow = p.can_grow(h)
            alive, h = alive[grow], h[grow]
            piece = p.find(h)
            hit = piece >= 0
            rows.append(alive[hit])
            ends.append(np.full(int(hit.sum()), s + n))
            found.append(piece[hit])
        out.append(Edges(s, np.concatenate(rows), np.concatenate(ends), np.concatenate(found)))
    return out


def groups(length: np.ndarray, most_cells: int = 4_000_000):
    """Index arrays of strings of like length, so that a (strings x positions) table stays small."""
    order = np.argsort(length, kind="stable")
    a = 0
    while a < len(order):
        cap = max(int(length[order[a]]) * 2, 8)
        b = int(np.searchsorted(length[order], cap, side="right"))
        b = min(b, a + max(1, most_cells // (cap + 1)))
        yield order[a:b]
        a = b
