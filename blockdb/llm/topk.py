"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine.

Components become floor(64 * x). A vector is cut into segments; a segment's mean and standard deviation bound its part of a
squared distance from below: |q - x|^2 >= sum over segments of m * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), which is the same as an upper
bound on q.x, since the norms are known. The rows of a query's k highest bounds give a score that k rows reach; pairs whose bound is below it, or below the
query's k-th score so far, are dropped, first by 4 segments, then by 16; the rest get their exact product. Queries and rows are packed into blocks and meet in a grid: every block of rows meets every block of queries in just one cell, and a
task streams a cell's rows past its queries.

Nulls: vectors null, empty, or holding null or non-finite components take no part, nor do null ids. Shorter vectors count as filled up with zeros.
Every row is a candidate, repeated ones too, but for rows with the query's own id; queries that share an id share its k places. Ties go to the smaller vec_id. Other columns are not read. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockdb.llm import common

SCALE = 64.0
LEVELS = (4, 16)
QUERY_BLOCK, ROW_BLOCK = 8192, 4096
PACKED = "block long, n int, dim int, ids binary, data binary"


def quantise(ids: list, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(64 * x) of the vectors that take part, as float64, which holds products exactly below 2**53."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = np.array([0 if n is None else n for n in vectors.value_lengths().to_pylist()], np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(owner, weights=~np.isfinite(flat), minlength=len(sizes)) > 0
    good = np.flatnonzero((sizes > 0) & ~bad & np.array([i is not None for i in ids], bool)) if len(sizes) else np.zeros(0, np.int64)
    dim = int(sizes[good].max(initial=0))
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out = np.zeros((len(good), dim))
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(sizes[good] == size)
        out[rows, :size] = flat[begin[good[rows]][:, None] + np.arange(size)]
    return np.array([ids[i] for i in good], np.int64), np.floor(SCALE * out)


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            ids, x = quantise(part.column(0).to_pylist(), part.column(1))
            if len(ids):
                kind = "<i4" if np.abs(x).max() < 2**31 else "<f8"
                yield pa.RecordBatch.from_arrays([pa.array([int(ids.min())]), pa.array([len(ids)], pa.int32()), pa.array([x.shape[1] * (1 if kind == "<i4" else -1)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())], ["block", "n", "dim", "ids", "data"])


def _unpack(n: int, dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, "<i4" if dim > 0 else "<f8").reshape(n, abs(dim)).astype(np.float64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Of each row, the scaled means and deviations of its segments; their inner products bound those of the rows from above."""
    parts = [p for p in np.array_split(x, min(segments, x.shape[1]), axis=1) if p.shape[1]]
    return np.concatenate([np.stack([np.sqrt(p.shape[1]) * f(p, axis=1) for p in parts], axis=1) for f in (np.mean, np.std)], axis=1)


class Search:
    """Queries, and the best rows found for them so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.pairs = self.scored = 0  # pairs met, and pairs that no bound has ruled out
        self.least = np.full(len(ids), -np.inf)
        self.q, self.score, self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(self.ids), 512):
            self._add(at, min(len(self.ids), at + 512), ids, x)
        self._trim()

    def _add(self, a: int, b: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Bounds of all pairs, coarse to fine; queries and rows without a pair left are dropped after each level, and the pairs left get exact scores."""
        dim = max(self.x.shape[1], x.shape[1])
        pad = lambda m: m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))
        q, x = pad(self.x[a:b]), pad(x)
        live = ids[None, :] != self.ids[a:b, None]
        qs, rows, least = np.arange(b - a), np.arange(len(ids)), self.least[a:b]
        self.pairs += int(live.sum())
        for segments in LEVELS:
            bound = statistics(q[qs], segments) @ statistics(x[rows], segments).T
            if segments == LEVELS[0] and len(rows) > self.k:
                least = self._floor(bound, live, q, x, least)
            floor = least[qs]
            live &= bound >= np.where(np.isfinite(floor), floor - 1e-6 * (1 + np.abs(floor)), -np.inf)[:, None]
            some = live.any(axis=1), live.any(axis=0)
            live, qs, rows = live[np.ix_(*some)], qs[some[0]], rows[some[1]]
            if not len(qs):
                return
        self.scored += int(live.sum())
        score = q[qs] @ x[rows].T
        i, j = np.nonzero(live & (score >= least[qs][:, None]))
        self.q, self.score, self.found = (np.concatenate(p) for p in ((self.q, a + qs[i]), (self.score, score[i, j]), (self.found, ids[rows[j]])))

    def _floor(self, bound: np.ndarray, live: np.ndarray, q: np.ndarray, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The k-th best exact score among the k rows of the highest bounds is a score that k rows reach."""
        best = np.argpartition(np.where(live, bound, -np.inf), bound.shape[1] - self.k, axis=1)[:, bound.shape[1] - self.k :]
        exact = np.einsum("ijk,ik->ij", x[best], q)
        exact[~np.take_along_axis(live, best, axis=1)] = -np.inf
        return np.maximum(least, exact.min(axis=1))

    def _trim(self) -> None:
        """The k best rows of each query."""
        order = np.lexsort((self.found, -self.score, self.q))
        q = self.q[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.score, self.found = q[keep], self.score[order][keep], self.found[order][keep]
        full = np.bincount(self.q, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.q, np.arange(len(self.ids)), "right") - 1
        self.least[full] = self.score[last[full]]

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q]), pa.array(self.found), pa.array(self.score.astype(np.int64))], ["query_id", "vec_id", "score"])


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    cell, searches = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["g"], r["s"]) != cell:
                yield from (x.result() for x in searches)
                cell, searches = (r["g"], r["s"]), []
            block = _unpack(r["n"], r["dim"], r["ids"], r["data"])
            if r["kind"] == 0:
                searches.append(Search(*block, k))
            else:
                for x in searches:
                    x.add(*block)
    yield from (x.result() for x in searches)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables have vec_id and embedding."""
    spark = vectors.sparkSession
    n = common.partitions(spark)
    asked = queries.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(blocks, "g").drop("g")
    packed = asked.mapInArrow(lambda it: _pack(it, QUERY_BLOCK), PACKED).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(blocks)))
    packed = common.materialize(packed, "topk-queries")
    rows = vectors.select("vec_id", "embedding").mapInArrow(lambda it: _pack(it, ROW_BLOCK), PACKED)
    slices = max(1, n // blocks)
    side = lambda df, kind: df.select("g", "s", F.lit(kind).alias("kind"), "n", "dim", "ids", "data")
    grid = side(packed.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), 0).unionByName(
        side(rows.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), 1)
    )
    cells = grid.repartition(max(n, blocks * slices), "g", "s").sortWithinPartitions("g", "s", "kind")
    best = cells.mapInArrow(lambda it: _cells(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
