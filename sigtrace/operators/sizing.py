"""Size checks that decide between a broadcast and a shuffle, and skew-proof joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


@dataclass(frozen=True)
class Limits:
    """Largest table that is sent whole to every executor."""

    broadcast_rows: int = 2_000_000
    broadcast_bytes: int = 256 * 1024 * 1024
    hot_fraction: int = 1000


DEFAULT_LIMITS = Limits()


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """Whether a table is small, by reading at most ``max_rows + 1`` of its rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast when a count shows at most ``max_rows`` rows.

    Meant for small stored tables, where the check is cheap.
    """
    return F.broadcast(df) if has_at_most(df, max_rows) else df


def spread_if_small(df: DataFrame, max_bytes: int = 512 * 1024 * 1024) -> DataFrame:
    """Give a small input that came in few splits to all cores.

    Inputs above ``max_bytes`` have splits enough and stay where they are.
    """
    if df.isStreaming or plan_bytes(df) > max_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def plan_bytes(df: DataFrame) -> int:
    """Size the optimizer expects of a frame; for file scans that of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Rows of a table that go out in one broadcast where it is sent in several.
CHUNK_ROWS = 1_000_000


def joined_in_chunks(left: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str], rows: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of ``table``, nulls where it has no such keys; ``left`` is never shuffled.

    ``table`` has its keys once and values without nulls.  It goes out in broadcasts of some ``CHUNK_ROWS``
    rows, one after the other, as many as its size asks for; where that is more than one it is written first.
    """
    rows = table.count() if rows is None else rows
    chunks = max(1, -(-rows // CHUNK_ROWS))
    table = stage(table) if chunks > 1 else table
    out = left
    for i in range(chunks):
        part = table if chunks == 1 else table.where(F.pmod(F.xxhash64(*keys), F.lit(chunks)) == i)
        named = part.select(*keys, *(F.col(v).alias(f"__chunk{i}_{v}") for v in values))
        out = out.join(F.broadcast(named), list(keys), "left")
    found = [F.coalesce(*(f"__chunk{i}_{v}" for i in range(chunks))).alias(v) for v in values]
    return out.select(*left.columns, *found)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Sequence[str],
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Inner shuffle join that stays balanced when one ``key`` holds much of ``left``.

    A key with at least 1/``hot_fraction`` of all left rows is cut into pieces of
    that size; its right rows are repeated once per piece.  There can be no more
    than ``hot_fraction`` such keys, which bounds the broadcast list of them.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    pieces = F.ceil(F.col("__n") * limits.hot_fraction / total).cast("int")
    hot = F.broadcast(
        counts.where(F.col("__n") * limits.hot_fraction >= total)
        .select(key, F.greatest(pieces, F.lit(1)).alias("__pieces"))
    )
    spread = F.pmod(F.xxhash64(*spread_by), F.coalesce("__pieces", F.lit(1))).cast("int")
    salted_left = left.join(hot, key, "left").withColumn("__salt", spread).drop("__pieces")
    copies = F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)
    salted_right = right.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__pieces")
    return salted_left.join(salted_right, [key, "__salt"]).drop("__salt")
