"""Operators on hit tables: merge, dedupe, newest-first feed, alerts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import HITS
from .staging import stage

RECENT = 500


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """One row per hit id, the newest; partial aggregation runs before the shuffle."""
    rest = [c for c in hits.columns if c not in ("id", "timestamp")]
    newest = F.max(F.struct("timestamp", *rest)).alias("__newest")
    return hits.groupBy("id").agg(newest).select("id", "__newest.*").select(*hits.columns)


def merge_hits(*feeds: DataFrame) -> DataFrame:
    """Union of hit tables with repeated hits removed."""
    return dedupe_hits(_union(feeds))


def _union(feeds: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*HITS.fieldNames()) for f in feeds])


def recent_hits(*feeds: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` newest distinct hits of stored hit tables, newest first.

    Every task hands on its newest rows only.  Where repeated hits leave fewer than ``n`` of
    them, more rows are taken, four times as many each time; as a rule one reading is enough.
    The rows are written when the plan is made, since their number decides on that.
    """
    every = _union(feeds)
    rest = [c for c in every.columns if c not in ("id", "timestamp")]
    # of rows with one id and time the greatest comes first, so a cut never changes which one stays
    newest = every.orderBy(F.desc("timestamp"), "id", F.desc(F.struct(*rest)))
    wanted = n * max(1, len(feeds))
    while True:
        rows = stage(newest.limit(wanted))
        distinct = dedupe_hits(rows).orderBy(F.desc("timestamp"), "id").limit(n)
        if rows.count() < wanted or distinct.count() == n:
            return distinct
        wanted *= 4


def alerts(hits: DataFrame) -> DataFrame:
    """Alert text, one row per hit."""
    return hits.select(
        F.concat(F.lit("Intelligence Hit: "), "match_type").alias("title"),
        F.concat(F.lit("Matched: "), "matched_text", F.lit("\nSource: "), "source").alias("body"),
    )
