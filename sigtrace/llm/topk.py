"""Exact top-k search by inner product with block-at-a-time pruning.

Rows stand in an order that brings similar vectors together, cut into ranges of
``BLOCK`` rows.  Each range keeps the largest and the smallest weight of every term
(dimension); with them a query sums the best that a range can reach.  Per query the
ranges are taken by falling bounds and scored through their forward index, the rows'
weights, until the next bound is below the k-th best score so far.

Queries go to the executors in blocks of ``QUERIES`` rows, together with a k-th score
to beat, from a bounded sample of rows: a true lower bound, so nothing is lost.

Weights are floor(1024 * x) as longs.  Vectors that are null or hold null or non-finite
components, and rows without vec_id, take no part.  Vectors are compared with vectors of
their own length.  Rows with the query's vec_id are the query's own.  Equal scores go to
the smaller vec_id; repeated candidate rows each hold a rank, repeated queries each have
their own ranks.  Scores beyond a long stay at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.operators.staging import stage

from .rows import only

SCALE = 1024
BLOCK, QUERIES = 128, 4096
#: Rows of a task that are held at once; rows of the sample behind the first k-th scores; centres of the order.
HELD, SAMPLE, CENTRES = 32_768, 2048, 64
ROWS_PER_PARTITION = 20_000
#: Largest product sum that doubles hold exactly.
EXACT = float(1 << 53)


def weighted(vectors: DataFrame) -> DataFrame:
    """(vec_id, weights array<long>) of the rows that take part."""
    rows = only(vectors, "vec_id", "embedding")
    x = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    weights = F.transform(x, lambda v: F.floor(v * SCALE).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), weights.alias("weights")
    )


def dense(ids: list[int], weights: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, weights) for each length of vector; longs where sums could leave the exact doubles."""
    lengths = np.fromiter(map(len, weights), np.int64, len(weights))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = np.array([weights[i] for i in at], np.int64).reshape(len(at), n)
        yield at, np.array([ids[i] for i in at], np.int64), rows


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as longs, exact."""
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if top(a) * top(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    limit = (1 << 63) - 1
    sums = a.astype(object) @ b.astype(object).T
    return np.clip(sums, -limit - 1, limit).astype(np.int64) if sums.size else sums.astype(np.int64)


LOWEST = np.iinfo(np.int64).min


class Best:
    """The k best (score, vec_id) of each query; free places hold the lowest score and no id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.scores = np.full((queries, k), LOWEST)
        self.ids = np.full((queries, k), -1, np.int64)
        self.full = np.zeros((queries, k), bool)
        self.floor = floor

    def kth(self) -> np.ndarray:
        """A score that a row has to reach to matter."""
        return np.maximum(self.floor, np.where(self.full[:, -1], self.scores[:, -1], LOWEST))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray) -> None:
        """Offers the rows ``ids`` with a column of scores each to the queries ``rows``."""
        s = np.hstack([self.scores[rows], scores])
        i = np.hstack([self.ids[rows], np.broadcast_to(ids, scores.shape)])
        f = np.hstack([self.full[rows], valid])
        order = np.lexsort((i, -s.astype(np.float64), ~f), axis=1) if np.abs(s[f]).max(initial=0) < EXACT else _object_order(s, i, f)
        order = order[:, : self.k]
        self.scores[rows], self.ids[rows], self.full[rows] = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))


def _object_order(scores: np.ndarray, ids: np.ndarray, full: np.ndarray) -> np.ndarray:
    flipped = ~scores  # falls as the score rises, without overflow
    return np.lexsort((ids, flipped, ~full), axis=1)


def search(best: Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Scores the blocks of ``rows`` that can still matter, block by block for each query."""
    starts = range(0, len(rows), BLOCK)
    tops = np.stack([rows[s : s + BLOCK].max(axis=0) for s in starts])
    lows = np.stack([rows[s : s + BLOCK].min(axis=0) for s in starts])
    bounds = products(np.maximum(queries, 0), tops) + products(np.minimum(queries, 0), lows)
    order = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    for r in range(len(tops)):
        block = order[active, r]
        alive = bounds[active, block] >= best.kth()[active]
        active, block = active[alive], block[alive]
        if not len(active):
            return
        by_block = np.argsort(block, kind="stable")
        numbers, first = np.unique(block[by_block], return_index=True)
        for b, some in zip(numbers, np.split(active[by_block], first[1:])):
            s = b * BLOCK
            scores = products(queries[some], rows[s : s + BLOCK])
            own = query_ids[some][:, None] == ids[None, s : s + BLOCK]
            useful = ~own & (scores >= best.kth()[some][:, None])
            hit = useful.any(axis=1)
            if hit.any():
                best.add(some[hit], ids[s : s + BLOCK], scores[hit], useful[hit])


def ordered(candidates: DataFrame, sample: list) -> DataFrame:
    """The written index: rows range-partitioned by their nearest centre, hot centres split by vec_id."""
    centres = [list(map(int, r["weights"])) for r in sample[:CENTRES]]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            centre = np.zeros(len(ids), np.int64)
            groups = {c.shape[1]: (p, c) for p, _, c in dense(list(range(len(centres))), centres)}
            for at, _, rows in dense(ids, weights):
                if rows.shape[1] in groups:
                    places, own = groups[rows.shape[1]]
                    centre[at] = places[products(rows, own).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre)], names=["vec_id", "weights", "centre"])

    coded = candidates.mapInArrow(nearest, "vec_id long, weights array<long>, centre long")
    parts = max(1, -(-candidates.count() // ROWS_PER_PARTITION))
    return stage(coded.repartitionByRange(parts, "centre", "vec_id").sortWithinPartitions("centre", "vec_id")).drop("centre")


def one_pass(index: DataFrame, block: list, first: int, sample: list, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): what each task found for a block of queries."""
    groups = {}
    for at, ids, rows in dense([r["vec_id"] for r in block], [r["weights"] for r in block]):
        floor = Best(len(ids), k, np.full(len(ids), LOWEST))
        for _, sample_ids, sample_rows in dense([r["vec_id"] for r in sample], [r["weights"] for r in sample]):
            if sample_rows.shape[1] == rows.shape[1]:
                search(floor, ids, rows, sample_ids, sample_rows)
        groups[rows.shape[1]] = (at + first, ids, rows, floor.kth())
    sent = index.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(ids), k, floor) for n, (_, ids, _, floor) in sent.value.items()}
        for ids, weights in _held(batches):
            for _, row_ids, rows in dense(ids, weights):
                if rows.shape[1] in best:
                    _, query_ids, queries, _ = sent.value[rows.shape[1]]
                    search(best[rows.shape[1]], query_ids, queries, row_ids, rows)
        for n, found in best.items():
            at, ids, _, _ = sent.value[n]
            q, p = np.nonzero(found.full)
            columns = [at[q], ids[q], found.ids[q, p], found.scores[q, p]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, weights = [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        weights += batch.column(1).to_pylist()
        while len(ids) >= HELD:
            yield ids[:HELD], weights[:HELD]
            ids, weights = ids[HELD:], weights[HELD:]
    if ids:
        yield ids, weights


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates (vec_id, embedding) of each query row."""
    asked, rows = stage(weighted(queries)), stage(weighted(candidates))
    sample = rows.limit(SAMPLE).collect()
    index = ordered(rows, sample)
    found, held, first = [], [], 0
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == QUERIES:
            found.append(stage(one_pass(index, held, first, sample, k)))
            first, held = first + len(held), []
    found.append(one_pass(index, held, first, sample, k))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
