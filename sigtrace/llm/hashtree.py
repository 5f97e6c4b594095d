"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends the tree: among the children of a node it takes the one with the best
weighted hash draw, ln(u) / weight with u from a hash of doc_id and child.  A child's
draw depends on nothing but the row and itself, so a change of weight moves rows only
into or out of the children whose weight changed, and nothing below other children.
A shard that is added hangs under the root as a region of its own, so it alone takes
rows; shards 0 to 15 stand in two regions of two racks.

The law is ``key``: doc_id and the tree decide, so equal doc_ids share a shard.  A null
doc_id is a key like any other.  A null text has no bytes (size 1) and a null text_crc32.
Slots number the rows of a shard from 0 without gaps, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigtrace.operators.staging import stage

from .rows import only

#: Rows that one window numbers, in expectation, times the number of shards.
BUCKET_ROWS = 20_000
#: Copies of one row that a task makes rows of at once.
PIECE = 10_000


@dataclass(frozen=True)
class Node:
    """A subtree; its weight is the sum of its shards' weights."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def shards(numbers: range, prefix: str, weights: dict[int, float]) -> tuple[Node, ...]:
    return tuple(Node(f"{prefix}/shard{n}", shard=n, own=weights.get(n, 1.0)) for n in numbers)


def topology(count: int = 16, weights: dict[int, float] | None = None, per_rack: int = 4, racks: int = 2, base: int = 16) -> Node:
    """The tree for ``count`` shards: the first ``base`` in full racks and regions, each later one a region of its own."""
    weights = weights or {}
    regions = []
    for first in range(0, min(count, base), per_rack * racks):
        region = f"region{len(regions)}"
        inside = []
        for start in range(first, min(first + per_rack * racks, count, base), per_rack):
            rack = f"{region}/rack{len(inside)}"
            inside.append(Node(rack, shards(range(start, min(start + per_rack, count, base)), rack, weights)))
        regions.append(Node(region, tuple(inside)))
    for n in range(base, count):
        name = f"region{len(regions)}"
        regions.append(Node(name, (Node(f"{name}/rack0", shards(range(n, n + 1), f"{name}/rack0", weights)),)))
    return Node("root", tuple(regions))


def draw(key: Column, child: Node) -> Column:
    """ln(u) / weight with u strictly between 0 and 1; the largest draw wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.log(u) / F.lit(float(child.weight))


def place(key: Column, node: Node) -> Column:
    """The shard where ``key`` ends: one draw for each child, at each level only below the winner."""
    if node.shard is not None:
        return F.lit(node.shard)
    alive = [c for c in node.children if c.weight > 0]
    if len(alive) == 1:
        return place(key, alive[0])
    best = F.greatest(*(draw(key, c) for c in alive))
    chosen = F.when(draw(key, alive[0]) == best, place(key, alive[0]))
    for child in alive[1:]:
        chosen = chosen.when(draw(key, child) == best, place(key, child))
    return chosen


def assign(documents: DataFrame, tree: Node, grown: Node) -> DataFrame:
    """doc_id, size, text_crc32, shard and grown_shard of every row of ``documents`` (doc_id, text)."""
    rows = only(documents, "doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"),
        place(key, grown).cast("int").alias("grown_shard"),
    )


def numbered(assigned: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``assigned`` with ``slot``: buckets of a shard are numbered side by side and shifted by the rows before them.

    Equal rows are counted before the shuffle and spread out again at the end.
    """
    rows = stage(assigned)
    buckets = max(1, -(-rows.count() // bucket_rows))
    counted = (
        rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
        .groupBy("bucket", *rows.columns)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    totals = counted.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = first.join(offsets, ["shard", "bucket"])
    # copies are dealt out in pieces over all tasks before they become rows
    last = F.floor((F.col("copies") - 1) / PIECE).cast("long")
    pieces = placed.select(
        *rows.columns, (F.col("offset") + F.col("first")).alias("start"), "copies", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")
    ).repartition(*rows.columns, "piece")
    begin, end = F.col("piece") * PIECE, F.least(F.col("copies"), (F.col("piece") + 1) * PIECE)
    return pieces.select(*rows.columns, F.explode(F.sequence(F.col("start") + begin, F.col("start") + end - 1)).alias("slot"))


def shard(documents: DataFrame, count: int = 16) -> DataFrame:
    """Every row of ``documents`` in one of ``count`` shards, and its shard with one more."""
    made = numbered(assign(documents, topology(count), topology(count + 1)))
    return made.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
