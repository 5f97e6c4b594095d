"""Hard negatives by Fagin's threshold algorithm.

Every block of candidates has a list for each dimension, sorted by that component.
An anchor reads all lists at once, from the top where its own component is positive
and from the bottom where it is negative; what it meets is scored by random access to
the whole vector, in whole numbers.  The sum of the anchor's products with the values at
the reading depth is the threshold: nothing unread can score more.  Reading stops when
the threshold is strictly below what each of the anchor's windows still needs: its k-th
score, or the lower end of a window that is not full.  Strictly, since equal scores go to
the smaller vec_id, which may still be unread.

Mining goes twice over the written blocks: first for the positives, the best rows of
the anchor's label (one window without ends), then for the negatives, the best rows
of other labels between ``LOW`` and ``HIGH`` percent of each positive's score.  Rows of a block
are alike (nearest of a few centres), so that whole blocks stop at their first depth.
A task gives its k best of each window and the rows are ranked over all tasks.
Anchors go out in blocks of ``ANCHORS`` rows.

Rows without vec_id or label, and rows whose vector is null or holds null or non-finite
components, take no part.  Vectors meet vectors of their own length only.  Rows with
the anchor's vec_id are the anchor's own and neither positives nor negatives.  Repeated
anchors each have their results, repeated candidates each hold a rank.  A positive
with a negative score has no negatives, as its window is empty.  Scores beyond a long
stay at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.operators.staging import stage

from .rows import only

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score in percent of its positive's.
LOW, HIGH = 80, 100
#: Anchors of one pass, candidates of one block, rows of a partition, centres that order the rows.
ANCHORS, BLOCK, ROWS_PER_PARTITION, CENTRES = 4096, 4096, 20_000, 64
#: Rows that a list is read to at its first row's bound, and how much further each time.
FIRST, DEEPER = 16, 4
LONG = (1 << 63) - 1
#: Largest sums of products that floats and doubles hold exactly.
EXACT_SINGLE, EXACT = float(1 << 24), float(1 << 53)


def scaled(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """(vec_id, label, x array<long>, anchor) of the rows that take part."""
    rows = only(vectors, "vec_id", "embedding", "label").withColumn("anchor", is_anchor)
    c = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long"))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return rows.where(there & ~F.coalesce(odd, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        x.alias("x"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"),
    )


def by_length(ids: list[int], labels: list[int], rows: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, labels, matrix of longs) for each length of vector."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, ids[at], labels[at], np.array([rows[i] for i in at], np.int64).reshape(len(at), n)


def held_as(*parts: np.ndarray) -> type:
    """The fastest kind of number in which inner products of these whole numbers are exact."""
    tops = [float(np.abs(p.astype(np.float64)).max(initial=0)) for p in parts]
    size = tops[0] * tops[-1] * max(1, parts[0].shape[1])
    return np.float32 if size < EXACT_SINGLE else np.float64 if size < EXACT else object


def as_long(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-LONG - 1, min(LONG, int(s))) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


@dataclass
class Windows:
    """An anchor's ranges of scores, both ends included, each with the k best rows met so far."""

    low: list[int]
    high: list[int]
    k: int

    def __post_init__(self):
        self.scores = [np.empty(0, np.int64) for _ in self.low]
        self.ids = [np.empty(0, np.int64) for _ in self.low]

    def needed(self) -> int:
        """The least score that some window still needs: its k-th, or its lower end where it is not full."""
        return min(int(s[-1]) if len(s) == self.k else low for s, low in zip(self.scores, self.low))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        useful = scores >= self.needed()
        scores, ids = scores[useful], ids[useful]
        for w, (low, high) in enumerate(zip(self.low, self.high)):
            least = self.scores[w][-1] if len(self.scores[w]) == self.k else low
            inside = (scores >= max(low, least)) & (scores <= high)
            if inside.any():
                s, i = np.concatenate([self.scores[w], scores[inside]]), np.concatenate([self.ids[w], ids[inside]])
                best = np.lexsort((i, ~s))[: self.k]  # ~s falls as the score rises, without overflow
                self.scores[w], self.ids[w] = s[best], i[best]


class Lists:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.order = np.argsort(rows, axis=0, kind="stable")  # by component, lowest first
        self.values = np.take_along_axis(rows, self.order, axis=0)
        self.kept = {np.int64: rows}

    def as_kind(self, kind: type) -> np.ndarray:
        if kind not in self.kept:
            self.kept[kind] = self.rows.astype(kind)
        return self.kept[kind]

    def thresholds(self, anchors: np.ndarray, depths: np.ndarray, kind: type) -> np.ndarray:
        """What rows not read before each depth can reach at most, for each anchor: products with the values there."""
        n, up, down = len(self.rows), np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        return up @ self.values[n - 1 - depths].astype(kind).T + down @ self.values[depths].astype(kind).T

    def search(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, windows: list[Windows], same: bool) -> int:
        """Offers every anchor the rows it can still need, of its own label or of the others; gives the number of scores taken."""
        n, taken = len(self.rows), 0
        ends = [min(n, 1)]
        while ends[-1] < n:
            ends.append(min(n, max(FIRST, DEEPER * ends[-1])))
        starts = [0, *ends[:-1]]
        kind = held_as(anchors, self.rows)
        bounds = self.thresholds(anchors, np.array(starts), kind)
        rows, sought = self.as_kind(kind), anchors.astype(kind)
        for a, best in enumerate(windows):
            if not best.low or bounds[a, 0] < best.needed():
                continue
            top, bottom = np.flatnonzero(anchors[a] > 0), np.flatnonzero(anchors[a] < 0)
            wanted = ((self.labels == labels[a]) == same) & (self.ids != own[a])
            unread = np.ones(n, bool)
            for start, end, bound in zip(starts, ends, bounds[a]):
                if bound < best.needed():
                    break
                if len(top) + len(bottom):
                    met = np.zeros(n, bool)
                    met[self.order[n - end : n - start, top]] = True
                    met[self.order[start:end, bottom]] = True
                    new = np.flatnonzero(met & unread)
                else:  # every score is zero
                    new = np.arange(n)
                unread[new] = False
                taken += len(new)
                if len(offered := new[wanted[new]]):
                    scores = rows[offered] @ sought[a] if len(offered) * 4 < n else (rows @ sought[a])[offered]
                    best.add(as_long(scores), self.ids[offered])
                if not unread.any():
                    break
        return taken


def ordered(candidates: DataFrame) -> DataFrame:
    """The candidates, written in an order in which neighbours are alike; a centre with many rows is cut by vec_id."""
    centres = {}
    for row in candidates.limit(CENTRES).collect():
        centres.setdefault(len(row["x"]), []).append(row["x"])
    centres = {n: np.array(c, np.float64).reshape(len(c), n) for n, c in centres.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, rows = (batch.column(i).to_pylist() for i in range(3))
            centre = np.zeros(len(ids), np.int64)
            for at, _, _, matrix in by_length(ids, labels, rows):
                if (known := centres.get(matrix.shape[1])) is not None:
                    # the nearest centre only orders rows, so rounding does no harm
                    centre[at] = (matrix @ known.T - (known * known).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre)], names=["vec_id", "label", "x", "centre"])

    coded = candidates.mapInArrow(nearest, "vec_id long, label long, x array<long>, centre long")
    parts = max(1, -(-candidates.count() // ROWS_PER_PARTITION))
    return stage(coded.repartitionByRange(parts, "centre", "vec_id").sortWithinPartitions("centre", "vec_id")).drop("centre")


@dataclass
class Anchors:
    """Anchors of one length of vector: numbers, ids, labels, vectors, and windows (low, high, scores of positives' places)."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    low: list[list[int]]
    high: list[list[int]]


def searched(index: DataFrame, anchors: dict[int, Anchors], k: int, same: bool) -> DataFrame:
    """(number, window, vec_id, score): the k best of each window that each task found."""
    sent = index.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: [Windows(lo, hi, k) for lo, hi in zip(a.low, a.high)] for n, a in sent.value.items()}
        for ids, labels, rows in _blocks(batches):
            for _, row_ids, row_labels, matrix in by_length(ids, labels, rows):
                if a := sent.value.get(matrix.shape[1]):
                    Lists(row_ids, row_labels, matrix).search(a.rows, a.ids, a.labels, found[matrix.shape[1]], same)
        for n, a in sent.value.items():
            out = [
                (int(number), w, int(i), int(s))
                for number, best in zip(a.number, found[n])
                for w, (ids, scores) in enumerate(zip(best.ids, best.scores))
                for i, s in zip(ids, scores)
            ]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "window", "vec_id", "score"])

    return index.mapInArrow(run, "number long, window long, vec_id long, score long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    held: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        for i, column in enumerate(held):
            column += batch.column(i).to_pylist()
        while len(held[0]) >= BLOCK:
            yield tuple(c[:BLOCK] for c in held)
            held = tuple(c[BLOCK:] for c in held)
    if held[0]:
        yield held


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(number, window, rank, vec_id, score): the k best of each window over all tasks."""
    rank = F.row_number().over(Window.partitionBy("number", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def bounds(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def one_pass(index: DataFrame, rows: list, first: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of a block of anchors."""
    spark = index.sparkSession
    anchors = {
        x.shape[1]: Anchors(at + first, ids, labels, x, [[-LONG - 1]] * len(at), [[LONG]] * len(at))
        for at, ids, labels, x in by_length([r["vec_id"] for r in rows], [r["label"] for r in rows], [r["x"] for r in rows])
    }
    mine: dict[int, list] = {}
    for row in best_of(searched(index, anchors, positives, same=True), positives).orderBy("number", "rank").collect():
        mine.setdefault(row["number"], []).append((row["vec_id"], row["score"]))
    for a in anchors.values():
        ranges = [[bounds(s, low, high) for _, s in mine.get(n, [])] for n in a.number.tolist()]
        a.low = [[lo for lo, hi in own] for own in ranges]
        # an empty window takes nothing and asks for nothing
        a.high = [[hi for lo, hi in own] for own in ranges]
        for lows, highs in zip(a.low, a.high):
            lows[:] = [lo if lo <= hi else LONG for lo, hi in zip(lows, highs)]
    ids = {n: i for a in anchors.values() for n, i in zip(a.number.tolist(), a.ids.tolist())}
    named = [(n, w, ids[n], p, s) for n, found in mine.items() for w, (p, s) in enumerate(found)]
    names = spark.createDataFrame(named, "number long, window long, anchor_id long, positive_id long, positive_score long")
    best = best_of(searched(index, anchors, negatives, same=False), negatives)
    # at most ANCHORS * positives rows
    return best.join(F.broadcast(names), ["number", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and its positives.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on these.
    """
    rows = stage(scaled(vectors, is_anchor))
    index = ordered(rows.drop("anchor"))
    found, held, first = [], [], 0
    for row in rows.where("anchor").toLocalIterator():
        held.append(row)
        if len(held) == ANCHORS:
            found.append(stage(one_pass(index, held, first, positives, negatives, low, high)))
            first, held = first + len(held), []
    found.append(one_pass(index, held, first, positives, negatives, low, high))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every
