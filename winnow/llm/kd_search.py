"""Exact top-k inner-product search with a KD-tree in each shard.

Vectors become integers, floor(scale * x), so that scores are exact. The rows are dealt once to shards of about
``shard_rows``; a shard's KD-tree splits at the median of the widest dimension and keeps tight bounding boxes. A query visits
nodes best first: the bound of a box is the largest inner product that any point in it can have, and the search ends when the best
open bound is below the k-th score so far.

Queries go in blocks of about ``query_rows``, hence of a bounded size, to all tasks; the points stay where they are, and a task builds a shard's tree once
for a whole block. Shards are searched in rounds, one shard, 15, 240 and so on: the k-th scores of a round are what the next one starts from, and within
a task each shard starts from what the one before gave.

Scores are summed in doubles where these are exact, in 64-bit integers or unbounded integers where they are not; ranks follow the exact scores (those
beyond 38 digits count as 38 nines), and a score that 64 bits cannot hold is returned as the nearest 64-bit number.

Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part. Vectors of
different lengths are not compared. A query never finds rows of its own id. Rows that repeat an id are candidates each; the results of queries that repeat an id are ranked
together. An empty table, or one without queries, gives an empty result. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm import store
from winnow.llm.vectors import runs, usable

SCORE = pa.decimal128(38, 0)
_MOST = 10**38 - 1


def _packed(v: np.ndarray, scale: float) -> tuple[str, bytes]:
    """floor(scale * v) as (kind, bytes): 32-bit or 64-bit integers, or numbers written out."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * v)
    most = np.abs(x).max()
    if most < 2.0**31:
        return "<i4", x.astype("<i4").tobytes()
    if most < 2.0**62:
        return "<i8", x.astype("<i8").tobytes()
    return "text", " ".join(str(int(y) if np.isfinite(y) else int(scale) * int(z)) for y, z in zip(x.tolist(), v.tolist(), strict=True)).encode()


def _matrix(kinds: list[str], vecs: list[bytes]) -> np.ndarray:
    """The vectors as integers: 64-bit, or Python's if any is too large."""
    rows = [np.frombuffer(v, k).astype(np.int64) if k != "text" else np.array([int(y) for y in v.split()], object) for k, v in zip(kinds, vecs, strict=True)]
    return np.stack(rows)


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vecs = usable(batch.column("vec"))
            ints = [_packed(v, scale) for v in vecs]
            take = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column("id"), take.column("is_query"), pa.array([len(v) for v in vecs], pa.int32()), pa.array([i[0] for i in ints], pa.string()), pa.array([i[1] for i in ints], pa.binary())], ["id", "is_query", "dim", "kind", "vec"])

    return run


class KdTree:
    def __init__(self, points: np.ndarray, leaf: int = 48):
        self.points = points
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._add(np.arange(len(points)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _add(self, rows: np.ndarray, leaf: int) -> int:
        node = len(self.low)
        own = self.points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.rows.append(rows)
        widest = int((high - low).argmax())
        if len(rows) > leaf and high[widest] > low[widest]:
            order = np.argsort(own[:, widest], kind="stable")
            half = len(rows) // 2
            self.rows[node] = None
            self.children[node] = (self._add(rows[order[:half]], leaf), self._add(rows[order[half:]], leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: np.ndarray, k: int, kth) -> tuple[np.ndarray, np.ndarray]:
        """Rows with scores that may be among the k best, given a k-th score known from elsewhere. own: rows left out."""
        open_ = [(-bounds[0], 0)]
        best: list = []
        rows, scores = [], []
        while open_:
            bound, node = heapq.heappop(open_)
            if -bound < kth:
                break
            if self.children[node] is None:
                r = self.rows[node]
                r = r[~own[r]]
                s = self.points[r] @ query
                use = s >= kth
                rows.append(r[use])
                scores.append(s[use])
                for x in s[use].tolist():
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
                if len(best) == k:
                    kth = max(kth, best[0])
            else:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(open_, (-bounds[child], child))
        if not rows:
            return np.zeros(0, np.int64), self.points[:0, 0]
        rows, scores = np.concatenate(rows), np.concatenate(scores)
        use = scores >= kth
        return rows[use], scores[use]


class Queries:
    """A block of queries by length, with the k-th scores known so far (None: not known)."""

    def __init__(self, rows: list, kth: dict[int, int]):
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        for dim in {r.dim for r in rows}:
            own = [r for r in rows if r.dim == dim]
            ids = np.array([r.id for r in own], np.int64)
            self.by_dim[dim] = (ids, _matrix([r.kind for r in own], [bytes(r.vec) for r in own]), [kth.get(r.id) for r in own])


def _search(k: int, held):
    """(dim, shard, id, kind, vec), sorted by shard -> (query_id, vec_id, score): the rows of each shard that can be among the k best of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {dim: list(kth) for dim, (_, _, kth) in held.value.by_dim.items()}
        for table in runs(batches, ["dim", "shard"]):
            dim = table.column("dim")[0].as_py()
            if dim not in known:
                continue
            asked, queries, _ = held.value.by_dim[dim]
            names = table.column("id").to_numpy()
            points = _matrix(table.column("kind").to_pylist(), table.column("vec").to_pylist())
            most = int(np.abs(points).max()) * int(np.abs(queries).max()) * dim
            kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
            tree, queries, kth = KdTree(points.astype(kind)), queries.astype(kind), known[dim]
            lowest = -np.inf if kind is np.float64 else -most - 1
            q_ids, v_ids, found = [], [], []
            for at in range(0, len(asked), 512):
                bounds = tree.bounds(queries[at : at + 512])
                for i, b in enumerate(bounds, at):
                    rows, scores = tree.search(queries[i], b, names == asked[i], k, lowest if kth[i] is None else kth[i])
                    if not len(rows):
                        continue
                    order = sorted(range(len(rows)), key=lambda r, s=scores, v=names[rows]: (-s[r], v[r]))[:k]
                    q_ids.append(np.full(len(order), asked[i]))
                    v_ids.append(names[rows[order]])
                    best = [min(max(int(scores[r]), -_MOST), _MOST) for r in order]
                    found.append(best)
                    if len(best) == k and (kth[i] is None or best[-1] > kth[i]):
                        kth[i] = best[-1]
            if q_ids:
                scores = pa.array([x for f in found for x in f], pa.int64()).cast(SCORE) if kind is not object else pa.array([x for f in found for x in f], SCORE)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_ids)), pa.array(np.concatenate(v_ids)), scores], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: str = "vec_id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, scale: float = 1024, shard_rows: int = 4096, query_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition on the row) picks, its k best rows.

    Ties go to the smaller id; with fewer candidates than k, all come. shard_rows: rows of a tree. query_rows: queries of a block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.expr(queries), F.lit(False)).alias("is_query"), F.col(f"`{vector_col}`").alias("vec")).where("id is not null")
    rows = store.saved(rows.mapInArrow(_integers(scale), "id long, is_query boolean, dim int, kind string, vec binary"), "ints")
    n, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    shards, blocks = max(1, -(-n // shard_rows)), -(-asked // query_rows)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("dim", "shard")
    points = store.saved(dealt, "points")
    store.forget(rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = []
    for b in range(blocks):
        block = points.where("is_query").where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("dim", "id", "kind", "vec").collect()  # about query_rows
        best, low, high, kth = None, 0, 1, {}
        while low < shards:
            held = spark.sparkContext.broadcast(Queries(block, kth))
            found = points.where((F.col("shard") >= low) & (F.col("shard") < high)).select("dim", "shard", "id", "kind", "vec").mapInArrow(_search(k, held), "query_id long, vec_id long, score decimal(38,0)")
            found = found if best is None else found.unionByName(best.drop("rank"))
            better = store.saved(found.withColumn("rank", rank).where(f"rank <= {k}"), "best")
            if best is not None:
                store.forget(best)
            best, low, high = better, high, high * 16
            if low < shards:
                kth = {r.query_id: int(r.score) for r in best.where(f"rank = {k}").select("query_id", "score").collect()}
        out.append(best)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    least, most = (F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1))
    return reduce(DataFrame.unionByName, out).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.least(F.greatest("score", least), most).cast("long").alias("score"))


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
