"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; with a segment's mean m and deviation s,

    |q - x|^2 >= sum over segments of length * ((mq - mx)^2 + (sq - sx)^2),

so the inner product, (|q|^2 + |x|^2 - |q - x|^2) / 2, is at most the sum of
length * (mq * mx + sq * sx). Bounds are taken coarse to fine; only pairs whose
bound still reaches the query's current k-th score get an exact product.

Queries are a stated set: they are broadcast in blocks of ``BLOCK`` vectors and
every block meets all rows. Each task keeps k rows per query, and a query's
rows from all tasks meet in one group of at most k per task.

Defined cases: vectors that are null or hold null or non-finite components take
no part, neither do vectors of a length other than the query's; equal scores go
to the smaller vec_id; rows with a null vec_id are no queries and no
candidates; rows that repeat a vec_id are candidates each, but never for a query
of the same id; empty vectors meet those of their length with score 0. Scores beyond 64 bits are out of range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlab.sources.files import stage

#: Queries in one broadcast block (4 MB at 64 components).
BLOCK = 8192
#: Segment lengths, coarse to fine.
RESOLUTIONS = (16, 4)
SCALE = 64.0
#: Candidates compared at once.
STRIPE = 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(64 * x) of every component as double."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double"))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False))
                         ).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _stats(x: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that a dot product of two
    rows is the bound (0 for vectors without components)."""
    if not x.shape[1]:
        return np.zeros((len(x), 1))
    parts = [x[:, k:k + length] for k in range(0, x.shape[1], length)]
    cols = [f * np.sqrt(p.shape[1]) for p in parts for f in (p.mean(1), p.std(1))]
    return np.stack(cols, 1)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact below 2^53."""
    most = max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(x).max(initial=0))) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.stats = [_stats(vectors, r) for r in RESOLUTIONS]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        floor = self.score[:, -1].astype(float)
        slack = 1e-9 * np.sqrt((self.q**2).sum(1)) * np.sqrt((x**2).sum(1)).max(initial=0) + 1e-6
        open_q = np.arange(len(self.ids))
        alive = np.ones((len(open_q), len(ids)), bool)
        for stats, length in zip(self.stats, RESOLUTIONS):
            bound = stats[open_q] @ _stats(x, length).T
            alive = alive & (bound + slack[open_q, None] >= floor[open_q, None])
            keep = alive.any(1)
            open_q, alive = open_q[keep], alive[keep]
            if not len(open_q):
                return
        for lo in range(0, len(open_q), 256):
            rows, live = open_q[lo:lo + 256], alive[lo:lo + 256]
            cols = np.flatnonzero(live.any(0))
            score = exact_products(self.q[rows], x[cols])
            out = ~live[:, cols] | (ids[cols][None] == self.ids[rows][:, None])
            score = np.where(out, np.iinfo(np.int64).min, score)
            # the k-th largest of old and new; ties at the edge are settled by vec_id
            both = np.concatenate([self.score[rows], score], 1)
            name = np.concatenate([self.vec[rows], np.broadcast_to(ids[cols], score.shape)], 1)
            edge = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k][:, None]
            r, c = np.nonzero((both >= edge) & (both > np.iinfo(np.int64).min))
            s, v = both[r, c], name[r, c]
            order = np.lexsort((v, -s, r))
            r, s, v = r[order], s[order], v[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, s, v, rank = (a[rank < self.k] for a in (r, s, v, rank))
            self.score[rows[r], rank], self.vec[rows[r], rank] = s, v


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield ids[at], flat.reshape(len(at), n)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """The k candidates of highest inner product for each query: (query_id,
    rank, vec_id, score). Both sides are (vec_id, v) as ``usable`` returns."""
    spark = candidates.sparkSession
    schema = "query_id long, vec_id long, score long"
    n = queries.count()
    parts = [queries] if n <= block else [
        queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(-(-2 * n // block))) == b) for b in range(-(-2 * n // block))]
    found = None
    for part in parts:
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        if rows.num_rows > block:
            raise ValueError("a block of queries holds too many equal ids")
        sent = spark.sparkContext.broadcast([x for b in rows.combine_chunks().to_batches() for x in _by_length(b)])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[Best]] = {}
            for ids, q in sent.value:
                best.setdefault(q.shape[1], []).append(Best(ids, q, k))
            for batch in batches:
                for ids, x in _by_length(batch):
                    for lo in range(0, len(ids), STRIPE):
                        for b in best.get(x.shape[1], ()):
                            b.meet(ids[lo:lo + STRIPE], x[lo:lo + STRIPE])
            for bs in best.values():
                for b in bs:
                    r, c = np.nonzero(b.score > np.iinfo(np.int64).min)
                    yield pa.record_batch({"query_id": pa.array(b.ids[r], pa.int64()),
                                           "vec_id": pa.array(b.vec[r, c], pa.int64()),
                                           "score": pa.array(b.score[r, c], pa.int64())})

        near = stage(candidates.mapInArrow(run, schema), "topk-block")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op9_topk_search(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """Contract: the queries are the rows whose vec_id is divisible by 20."""
    rows = usable(embeddings)
    # repeated query rows ask once
    queries = rows.where(F.col("vec_id") % 20 == 0).dropDuplicates(["vec_id"])
    return top_k(queries, rows, k)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
