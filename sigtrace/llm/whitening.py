"""Whitening of embeddings from a covariance weighted by multiplicity.

Components c become longs x = floor(64 * c) + 1,000,000.  Equal x vectors are one group;
each distinct vector enters the fit once, with the weight one or its number of rows.
Weight, sum and centred products are added up task by task: the sums S and the total
weight n are whole numbers and exact, the products are a matrix product of
(n * x - S) / n, whose numerator is exact, so values far from zero cost no digits.
Every distinct vector is whitened once and joined back to its rows; the join is
salted where one vector has many rows.

Rows whose vector is null or empty or holds null or non-finite entries are left out.  Rows
with null or repeated vec_ids each have their results.  Vectors are fitted and whitened
with those of their own length.  Entries beyond 2 ** 40 in size stay at that limit.
Directions without variance (relative to the first, below ``FLAT``) cannot be whitened and
have no component: a single distinct vector gives no rows.  A deviation beyond a long
stays at its limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrace.operators.staging import stage

from .rows import only

SCALE, SHIFT, BOUND = 64, 1_000_000, float(1 << 40)
#: Components returned; eigenvalues below this share of the first count as zero.
COMPONENTS, FLAT = 16, 1e-12
#: Rows of a matrix that a task works on at once.
HELD = 16_384
#: Pieces that all rows would make, for vectors with many rows.
PIECES = 1000
LONG = (1 << 63) - 1
WEIGHTS = ("one", "count")


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    rows = only(vectors, "vec_id", "embedding")
    c = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    near = lambda v: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), v * SCALE))
    x = F.transform(c, lambda v: F.floor(near(v)).cast("long") + SHIFT)
    return rows.where((F.size("embedding") > 0) & ~F.coalesce(odd, F.lit(True))).select("vec_id", x.alias("x"))


@dataclass
class Fit:
    """What whitening needs to know of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray


def matrices(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(rows, length, x, weight) of every run of rows of one length in column ``x``; weights stand in ``weight``."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("x"))
        weights = batch.column(batch.schema.get_field_index("weight")).to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:]):
            for s in range(a, b, held):
                e = min(b, s + held)
                yield batch.slice(s, e - s), int(sizes[s]), flat[ends[s] : ends[e]].reshape(e - s, -1), weights[s:e]


def exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted sums of the columns, whatever their size."""
    if float(np.abs(x).max(initial=0)) * float(weight.sum()) < LONG:
        return (weight @ x).tolist()
    return [sum(int(w) * int(v) for w, v in zip(weight, column)) for column in x.T]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they fit, else Python's whole numbers."""
    if (float(np.abs(x).max(initial=0)) + 1) * n * 2 < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(c: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact up to a long's limit."""
    if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * c.shape[1] < LONG:
        return (c * c).sum(axis=1).tolist()
    return [min(LONG, sum(int(v) * int(v) for v in row)) for row in c]


def totals(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Total weight and exact sums by length of vector; a long decimal holds the sums."""

    def run(batches):
        found: dict[int, tuple[int, list[int]]] = {}
        for _, length, x, weight in matrices(batches):
            n, sums = found.get(length, (0, [0] * length))
            found[length] = n + int(weight.sum()), [a + b for a, b in zip(sums, exact_sums(x, weight))]
        for length, (n, sums) in found.items():
            columns = [[length] * (length + 1), list(range(-1, length)), [str(v) for v in (n, *sums)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["length", "at", "value"])

    parts = distinct.select("x", "weight").mapInArrow(run, "length long, at long, value string")
    summed = parts.groupBy("length", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, list[int]] = {}
    for row in summed.orderBy("length", "at").collect():
        out.setdefault(row["length"], []).append(int(row["value"]))
    return {length: (values[0], values[1:]) for length, values in out.items()}


def products(frame: DataFrame, column: str, prepare) -> dict[int, np.ndarray]:
    """Weighted matrix products by length of vector: the sum of prepare(x)^T * weight * prepare(x).

    Tasks give one row of the matrix at a time, which are added up by (length, row).
    """

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for _, length, x, weight in matrices(batches):
            y = prepare(length, x)
            part = (y * weight[:, None]).T @ y
            found[length] = found[length] + part if length in found else part
        for length, matrix in found.items():
            columns = [np.full(length, length), np.arange(length), pa.array(matrix.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["length", "at", "row"])

    parts = frame.select(F.col(column).alias("x"), "weight").mapInArrow(run, "length long, at long, row array<double>")
    # added in pairs of positions, so that no group is gathered in one place
    cells = parts.select("length", "at", F.posexplode("row").alias("to", "value"))
    summed = cells.groupBy("length", "at", "to").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for row in summed.collect():
        out.setdefault(row["length"], np.zeros((row["length"], row["length"])))[row["at"], row["to"]] = row["value"]
    return out


def distinct_vectors(rows: DataFrame, weights: str = "one") -> DataFrame:
    """(x, copies, weight): each distinct vector of ``rows`` once, written."""
    if weights not in WEIGHTS:
        raise ValueError(f"weights are one of {', '.join(WEIGHTS)}")
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    return stage(counted.withColumn("weight", F.lit(1).cast("long") if weights == "one" else F.col("copies")))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fits by length of vector.  The driver gets one matrix of length x length numbers for each."""
    known = totals(distinct)

    def prepare(length, x):
        n, sums = known[length]
        return centred(x, n, sums).astype(np.float64) / n

    out = {}
    for length, matrix in products(distinct, "x", prepare).items():
        n, sums = known[length]
        matrix = (matrix + matrix.T) / (2 * n)
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        some = values > max(FLAT * values[0], 0.0)
        out[length] = Fit(n, sums, values[some], vectors[:, some], values[some] / max(np.trace(matrix), 1e-300))
    return out


def whitened(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """``distinct`` with, added, deviation and whitened array<double>: every distinct vector once."""
    sent = distinct.sparkSession.sparkContext.broadcast(fits)
    schema = "x array<long>, copies long, weight long, deviation long, whitened array<double>"

    def run(batches):
        for rows, length, x, _ in matrices(batches):
            known = sent.value[length]
            c = centred(x, known.n, known.sums)
            y = (c.astype(np.float64) / known.n) @ known.directions / np.sqrt(known.values)
            columns = [*rows.columns, pa.array(deviations(c), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "copies", "weight", "deviation", "whitened"])

    return distinct.select("x", "copies", "weight").mapInArrow(run, schema)


def identity_errors(made: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' own covariance minus the identity, by length of vector."""
    out = {}
    for length, known in fits.items():
        k = len(known.values)
        if not k:
            continue
        own = made.where(F.size("x") == length)
        mean = np.array(own.agg(*(F.sum(F.col("whitened")[i] * F.col("weight")) for i in range(k))).first()) / known.n
        covariance = products(own, "whitened", lambda _, y, mean=mean: y - mean)[k] / known.n
        out[length] = float(np.abs(covariance - np.eye(k)).max())
    return out


def components(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component."""
    rows = stage(whole(vectors).withColumn("place", F.monotonically_increasing_id()))
    distinct = distinct_vectors(rows, weights)
    fits = fit(distinct, components)
    made = stage(whitened(distinct, fits))
    errors = identity_errors(made, fits)
    known = [(length, f.n, [float(e) for e in f.explained], errors[length]) for length, f in sorted(fits.items()) if length in errors]
    facts = vectors.sparkSession.createDataFrame(known, "length int, n long, explained array<double>, identity_error double")
    each = joined_back(rows, made).select("vec_id", "length", "deviation", F.posexplode("whitened").alias("at", "value"))
    # one row for each length of vector, fewer than the matrices that the driver has held
    return each.join(F.broadcast(facts), "length").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )


def joined_back(rows: DataFrame, made: DataFrame) -> DataFrame:
    """vec_id, length, deviation and whitened of every row (vec_id, x, place).

    A vector with more than 1/``PIECES`` of all rows is cut into pieces of that size by place;
    there are fewer than ``PIECES`` such vectors, which bounds the broadcast list of them.
    """
    piece = max(1, -(-(made.agg(F.sum("copies")).first()[0] or 0) // PIECES))
    pieces = F.ceil(F.col("copies") / piece).cast("int")
    hot = F.broadcast(made.where(F.col("copies") > piece).select("x", pieces.alias("pieces")))
    spread = rows.join(hot, "x", "left").withColumn("salt", F.pmod("place", F.coalesce("pieces", F.lit(1))).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > piece, pieces).otherwise(1) - 1))
    once = made.select("x", F.size("x").alias("length"), "deviation", "whitened", salts.alias("salt"))
    return spread.join(once, ["x", "salt"]).select("vec_id", "length", "deviation", "whitened")
