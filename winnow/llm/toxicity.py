"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, their first four and five bytes, word pairs and pairs with one word between
them, hashed to 2**bits coordinates; a feature counts once. ASCII punctuation separates words here. Training follows FTRL-proximal: a learning rate for each coordinate and an L1 penalty that
keeps most weights at exactly zero, so the model is a small table that every task can hold.

Training rows are a bounded sample: of each label up to ``train_rows`` / 2 labelled documents, chosen by a hash of the id. Rows are weighted so that both
labels weigh the same, whether or not that bound is reached; 0.5 is the point where either label is as likely if toxic and clean texts were equally
frequent. The rows are dealt by id to a number of shards that follows from their count; in each round every shard runs over its rows, in the order of a hash of the id,
from the shared state, and the changes are averaged. So the model depends on the rows alone, not on how the tables are stored or the cluster is set. A shard returns
the coordinates that it touched, in slices of a fixed range, and the model that goes to all tasks holds the non-zero weights only.

Scoring covers every whole text, however long. Null and empty texts have no features and get the score of the intercept. Without any labelled
row (also with empty tables) every score is 0; an empty table of documents gives an empty result. Null labels and labels other than 0 and 1 are ignored; rows with a null id
are scored but never trained on. Repeated rows are scored, and trained on, once for each time that they occur. Extra columns take no part; a column named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import store
from winnow.llm.words import Words, blocks, mix

SLICES = 16
_PLACES = 1 << 40


_SPLIT = bytes(0x20 if 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E else b for b in range(256))


def words_of(texts: list[bytes]) -> Words:
    return Words([t.translate(_SPLIT) for t in texts])


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, coordinate) of every word, pair and skip-pair, with repeats. Coordinate 0 is the intercept and not among them."""
    h, doc = words.hash, words.doc
    docs, found = [doc, doc, doc], [mix(h + np.uint64(1)), mix(words.stems(4) + np.uint64(4)), mix(words.stems(5) + np.uint64(5))]
    for gap, salt in ((1, 2), (2, 3)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(mix(mix(h[:-gap] + np.uint64(salt)) * np.uint64(5) + h[gap:])[same])
            docs.append(doc[gap:][same])
    x = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate(docs), np.maximum(x, 1)


def _training_rows(bits: int):
    """(place, shard, label, text) -> the same with the sorted coordinates of the text instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch, "text"):
                doc, x = features(words_of(texts), bits)
                order = np.argsort(doc, kind="stable")
                doc, x = doc[order], x[order]
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                sets = [np.unique(x[i:j]).astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                same = [batch.column(c).slice(a, b - a) for c in ("place", "shard", "label")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(sets, pa.binary())], ["place", "shard", "label", "x"])

    return run


def weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ftrl(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, int, float]], alpha: float, beta: float, l1: float, l2: float) -> None:
    """One run of FTRL-proximal over rows (coordinates, label, weight), in place. Coordinate 0, the first of each row, is the intercept."""
    for x, label, weight in rows:
        zx, nx = z[x], n[x]
        penalty = np.full(len(x), l1)
        penalty[0] = 0  # the intercept is not made sparse
        w = weights(zx, nx, alpha, beta, penalty, l2)
        g = (sigmoid(w.sum()) - label) * weight
        z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
        n[x] = nx + g * g


def _shard_pass(state, size: int, passes: int, weight: dict[int, float], how: dict[str, float]):
    """A shard's rows -> (slice, at, z, n): how the touched coordinates of each slice change."""

    def run(table: pa.Table) -> pa.Table:
        before = [a.astype(np.float64) for a in state.value]
        z, n = (a.copy() for a in before)
        place, label, x = (table.column(c).to_pylist() for c in ("place", "label", "x"))
        order = sorted(range(len(place)), key=lambda i: (place[i], label[i], x[i]))
        rows = [(np.concatenate((np.zeros(1, np.int64), np.frombuffer(x[i], "<u4").astype(np.int64))), label[i], weight[label[i]]) for i in order]
        for _ in range(passes):
            ftrl(z, n, rows, **how)
        touched = np.flatnonzero(n != before[1])
        cut = np.searchsorted(touched, np.arange(SLICES + 1) * (size // SLICES))
        own = [touched[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        out = [[t.astype("<u4").tobytes() for t in own], *[[(a[t] - b[t]).astype("<f4").tobytes() for t in own] for a, b in zip((z, n), before, strict=True)]]
        return pa.table({"slice": pa.array(range(SLICES), pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in zip(("at", "z", "n"), out, strict=True)}})

    return run


def _sum_changes(table: pa.Table) -> pa.Table:
    at = np.concatenate([np.frombuffer(v, "<u4") for v in table.column("at").to_pylist()])
    where, which = np.unique(at, return_inverse=True)
    total = {c: np.bincount(which, weights=np.concatenate([np.frombuffer(v, "<f4") for v in table.column(c).to_pylist()]), minlength=len(where)) for c in ("z", "n")}
    return pa.table({"at": pa.array([where.astype("<u4").tobytes()], pa.binary()), **{c: pa.array([v.astype("<f4").tobytes()], pa.binary()) for c, v in total.items()}})


class Model:
    """The coordinates with weights other than zero, in order, and their weights; coordinate 0 is the intercept."""

    def __init__(self, w: np.ndarray, bits: int, trained: int):
        self.bits, self.trained, self.intercept = bits, trained, float(w[0])
        self.at = np.flatnonzero(w)
        self.w = w[self.at].astype(np.float32)
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        if self._dense is None:  # made in the task, not sent
            self._dense = np.zeros(1 << self.bits, np.float32)
            self._dense[self.at] = self.w
        doc, x = features(words_of(texts), self.bits)
        use = np.flatnonzero(self._dense[x])
        pair = np.unique((doc[use] << self.bits) | x[use])  # a feature counts once in a text
        total = np.bincount(pair >> self.bits, weights=self._dense[pair & ((1 << self.bits) - 1)], minlength=len(texts))
        return sigmoid(total + self.intercept)


def train(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 12_000, bits: int = 20, rounds: int = 4, passes: int = 1, shard_rows: int = 1_500, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1) -> Model:
    """Fits on at most about ``train_rows`` of the labelled rows whose id meets ``usable`` (a condition on the id column)."""
    spark = docs.sparkSession
    store.narrow_batches(spark)
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label is not null")
    if usable is not None:
        named = named.withColumnRenamed("id", id_col).where(usable).withColumnRenamed(id_col, "id")
    named = store.saved(named.where("label in (0, 1)"), "labels")
    counts = {r.label: r["count"] for r in named.groupBy("label").count().collect()}
    taken = {k: min(1.0, train_rows / 2 / v) for k, v in counts.items()}
    share = F.coalesce(*[F.when(F.col("label") == k, int(_PLACES * v)) for k, v in taken.items()], F.lit(0))
    picked = F.broadcast(named.where(F.pmod(F.xxhash64("id"), F.lit(_PLACES)) < share))  # bounded by train_rows
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(picked, "id")
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(_PLACES))
    shards = max(1, -(-int(sum(taken[k] * counts[k] for k in taken)) // shard_rows))
    rows = rows.select(place.alias("place"), (place % shards).cast("int").alias("shard"), "label", "text")
    rows = store.saved(rows.mapInArrow(_training_rows(bits), "place long, shard int, label int, x binary"), "training")
    found = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    trained = sum(found.values())
    balance = {k: trained / len(found) / v for k, v in found.items()}
    size = 1 << bits
    z, n_ = np.zeros(size, np.float32), np.zeros(size, np.float32)
    how = {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
    for _ in range(rounds if trained else 0):
        state = spark.sparkContext.broadcast((z, n_))
        changes = rows.groupBy("shard").applyInArrow(_shard_pass(state, size, passes, balance, how), "slice int, at binary, z binary, n binary")
        for r in changes.groupBy("slice").applyInArrow(_sum_changes, "at binary, z binary, n binary").collect():  # at most ``size`` coordinates
            at = np.frombuffer(r.at, "<u4")
            z[at] += np.frombuffer(r.z, "<f4") / shards
            n_[at] += np.frombuffer(r.n, "<f4") / shards
        state.unpersist()
    store.forget(rows)
    store.forget(named)
    penalty = np.full(size, l1)
    penalty[0] = 0
    return Model(weights(z.astype(np.float64), n_.astype(np.float64), alpha, beta, penalty, l2), bits, trained)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """docs with the score as column ``name`` (a column of that name is replaced)."""
    store.narrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [held.value.scores(texts) for _, _, texts in blocks(batch, text_col)]
            score = pa.array(np.concatenate(score) if score else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    schema = T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())])
    return base.mapInArrow(run, schema)


def training_fold(id_col: str = "doc_id") -> Column:
    """True for ids whose crc32 is not divisible by 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, usable=training_fold())
    scored = with_score(docs, model, name="score")
    return scored.select("doc_id", F.coalesce(~training_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
