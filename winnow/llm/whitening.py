"""Embedding whitening by polarisation covariance.

A component c becomes the integer x = floor(1024 * c) + 100000. Only squares are ever summed: those of every centred dimension, and those of the sum of every two centred dimensions. As
Var(i + j) = Var(i) + Var(j) + 2 Cov(i, j), half the differences of these variances are all covariances, which are assembled to the matrix V for eigh.

All sums are exact. A first pass counts the n vectors and sums each dimension, S. Values are centred before they are squared: z = x - floor(S / n) leaves r = S mod n, so n * x - S = n * z - r, and the squares of n * z - r
sum to n * (n * sum z^2 - r^2), in integers of any size (sums travel as two decimals). So V is exact until its entries become doubles. A task sums its rows first and gives one row for each pair of dimensions.
The driver holds d * (d + 1) / 2 sums for d dimensions, whatever the number of vectors, and tasks get the means and the ``components`` first eigenvectors.

Whitened values are x - S / n, projected on an eigenvector, over the root of its eigenvalue. They are written to the shared folder; their own covariances are then summed from centred values, by Spark, for
identity_error.

Vectors that are null or empty or hold null or non-finite components are dropped, as are those with a component whose x is no long, and those whose length is not the most frequent one (of equally frequent ones the
longest counts). Null and repeated ids are rows of their own. An eigenvalue that is zero to double precision (one vector, equal vectors, dependent dimensions) gives null for whitened, explained 0 and no part in identity_error, which is
null if no component is left. A deviation beyond a long is null. An empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import store
from winnow.llm.vectors import usable

SCALE, SHIFT = 1024, 100_000
CELLS = 1 << 17  # of a block of rows
_LIMB = 1 << 62
_DECIMAL = pa.decimal128(38, 0)


def longs(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray | list[np.ndarray]]:
    """(row numbers, x-vectors) of the vectors that take part; with dims those of this length only, as one matrix."""
    rows, vectors = usable(column)
    scaled = [np.floor(SCALE * v) for v in vectors]
    fits = [i for i, v in enumerate(scaled) if np.abs(v).max() < 2.0**62 and (dims is None or len(v) == dims)]
    out = [scaled[i].astype(np.int64) + SHIFT for i in fits]
    if dims is not None:
        return rows[fits], np.stack(out) if out else np.zeros((0, dims), np.int64)
    return rows[fits], out


def limbs(values: list[int]) -> tuple[pa.Array, pa.Array]:
    """Integers as high and low decimals: high * 2**62 + low."""
    return tuple(pa.array([Decimal(v) for v in part], _DECIMAL) for part in zip(*(divmod(v, _LIMB) for v in values), strict=True)) if values else (pa.array([], _DECIMAL), pa.array([], _DECIMAL))


def _added(high: str = "high", low: str = "low") -> list:
    return [F.sum(c).cast("decimal(38,0)").alias(c) for c in (high, low)]


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, place, n, high, low): sums over the vectors of a task by their length."""
    sums: dict[int, list[int]] = {}
    counts: dict[int, int] = defaultdict(int)

    def out() -> pa.RecordBatch:
        dims = [d for d, s in sums.items() for _ in s]
        rows = [dims, [i for s in sums.values() for i in range(len(s))], [counts[d] for d in dims]]
        return pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows), *limbs([v for s in sums.values() for v in s])], ["dims", "place", "n", "high", "low"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            _, vectors = longs(batch.column(0).slice(at, 1024))
            by_length = defaultdict(list)
            for v in vectors:
                by_length[len(v)].append(v)
            for d, own in by_length.items():
                # halves of 31 bits, so that no sum of a block leaves 64 bits
                m = np.stack(own)
                part = [(int(h) << 31) + int(l) for h, l in zip((m >> 31).sum(0), (m & 0x7FFFFFFF).sum(0), strict=True)]
                sums[d] = [x + y for x, y in zip(sums[d], part, strict=True)] if d in sums else part
                counts[d] += len(own)
        if sum(map(len, sums.values())) > 1_000_000:
            yield out()
            sums.clear()
            counts.clear()
    if sums:
        yield out()


@dataclass
class Fit:
    """n vectors with sums S in each dimension; V's largest eigenvalues and their eigenvectors (rows), and V's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def floors(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> list[int]:
        return [s % self.n for s in self.sums]


def pair_squares(z: np.ndarray) -> list[int]:
    """The sums of (z_i + z_j)^2 over the rows for i < j, behind the sums of z_i^2, row by row of the upper triangle: (0, 0), (0, 1), .., (1, 1), .."""
    d = z.shape[1]
    if np.abs(z).max(initial=0) >= 2**20:  # squares beyond 64 bits: integers of any size
        z = z.astype(object)
    out: list[int] = []
    for i in range(d):
        both = z[:, i:] + z[:, i : i + 1]
        both[:, 0] = z[:, i]
        out += [int(v) for v in (both * both).sum(0)]
    return out


def _squares(vector_col: str, dims: int, floors: np.ndarray):
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = [0] * len(pairs), False
        step = max(1, CELLS // dims)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows, x = longs(batch.column(vector_col).slice(at, step), dims)
                if len(rows):
                    seen = True
                    total = [a + b for a, b in zip(total, pair_squares(x - floors), strict=True)]
        if seen:
            yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int32()) for r in zip(*pairs, strict=True)), *limbs(total)], ["i", "j", "high", "low"])

    return run


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8) -> Fit | None:
    """The means and the first components of the table's vectors; None without any vector."""
    rows = store.columns(vectors, vector_col)
    parts = rows.mapInArrow(_lengths, "dims long, place long, n long, high decimal(38,0), low decimal(38,0)")
    by_place = store.saved(parts.groupBy("dims", "place").agg(F.sum("n").alias("n"), *_added()), "dims")
    most = by_place.where("place = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    d, n = most.dims, most.n
    sums = [int(r.high) * _LIMB + int(r.low) for r in by_place.where(F.col("dims") == d).orderBy("place").collect()]  # d rows
    store.forget(by_place)
    floors = np.array([s // n for s in sums], np.int64)
    squares = rows.mapInArrow(_squares(vector_col, d, floors), "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(*_added())
    held = {(r.i, r.j): int(r.high) * _LIMB + int(r.low) for r in squares.collect()}  # d * (d + 1) / 2 rows
    rest = [s % n for s in sums]
    # n^2 times the variance of i, and of i + j; the mean of z_i is rest / n
    single = [n * held[i, i] - rest[i] ** 2 for i in range(d)]
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = single[i] / n**2
        for j in range(i + 1, d):
            both = n * held[i, j] - (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (both - single[i] - single[j]) / (2 * n**2)
    values, columns = np.linalg.eigh(v)
    k = min(components, d)
    return Fit(n, sums, values[::-1][:k].copy(), columns[:, ::-1][:, :k].T.copy(), sum(single) / n**2)


def _projected(f: Fit, vector_col: str, positive: np.ndarray):
    dims, floors, rests = len(f.sums), f.floors, f.rests
    mean = np.array([r / f.n for r in rests])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // dims)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, x = longs(part.column(vector_col), dims)
                z = x - floors
                white = (z - mean) @ f.vectors[positive].T / np.sqrt(f.values[positive])
                most = max(int(np.abs(z).max(initial=0)) * f.n, f.n)
                if most**2 * dims < 2**63:
                    own = ((f.n * z - np.array(rests, np.int64)) ** 2).sum(1).tolist()
                else:
                    own = [int(v) for v in ((f.n * z.astype(object) - np.array(rests, object)) ** 2).sum(1)]
                deviation = pa.array([v if v < 2**63 else None for v in own], pa.int64())
                flat = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1], white.ravel())
                names = [c for c in part.schema.names if c != vector_col]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(rows)) for c in names], deviation, flat], [*names, "deviation", "white"])

    return run


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector that takes part and each component from 1."""
    spark = vectors.sparkSession
    rows = store.columns(vectors, id_col, vector_col)
    schema = T.StructType([rows.schema[id_col], T.StructField("deviation", T.LongType()), T.StructField("white", T.ArrayType(T.DoubleType()))])
    f = fit(rows, vector_col, components)
    if f is None:
        f, positive, table = Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), np.zeros(0, bool), spark.createDataFrame([], schema)
    else:
        positive = f.values > max(f.trace, 0) * len(f.sums) * np.finfo(float).eps
        table = store.saved(rows.mapInArrow(_projected(f, vector_col, positive), schema), "white")
    k = int(positive.sum())
    error = None
    if k:
        # covar_pop centres its values before it multiplies
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        found = table.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]) for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
    explained = F.array(*[F.lit(float(e / f.trace) if p else 0.0) for e, p in zip(f.values, positive, strict=True)]).cast("array<double>")
    place = F.explode(F.sequence(F.lit(0), F.lit(len(f.values) - 1))).alias("place")
    out = table.select(id_col, "deviation", "white", place)
    return out.select(id_col, (F.col("place") + 1).alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", F.get("white", F.col("place")).alias("whitened"), F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
