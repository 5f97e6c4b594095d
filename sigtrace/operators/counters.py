"""Counters per monitor and per feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import format_build_date, format_size, percent, pick_description
from .indicators import feed_counts
from .sizing import broadcast_if_small


def monitor_counts(lines: DataFrame, candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Lines, extracted items, hits and time of the last hit per ``monitor_id``, the time as ``last_hit``.

    ``hits`` must carry ``monitor_id`` (``keep=["monitor_id"]`` of the scan).
    """
    one = F.count(F.lit(1))
    by_lines = lines.groupBy("monitor_id").agg(one.alias("lines_processed"))
    by_items = candidates.groupBy("monitor_id").agg(one.alias("items_extracted"))
    by_hits = hits.groupBy("monitor_id").agg(one.alias("hits_found"), F.max("timestamp").alias("last_hit"))
    return (
        by_lines.join(by_items, "monitor_id", "left")
        .join(by_hits, "monitor_id", "left")
        .select(
            "monitor_id",
            "lines_processed",
            F.coalesce("items_extracted", F.lit(0)).alias("items_extracted"),
            F.coalesce("hits_found", F.lit(0)).alias("hits_found"),
            "last_hit",
        )
    )


def shown_counts(counts: DataFrame) -> DataFrame:
    """Counters with the time of day of the last hit as ``last_activity``."""
    return counts.withColumn("last_activity", F.date_format("last_hit", "HH:mm:ss")).drop("last_hit")


def monitor_stats(lines: DataFrame, candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Counters of ``monitor_counts`` for display."""
    return shown_counts(monitor_counts(lines, candidates, hits))


def summed_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """Counters of several batches as one row for each of ``keys``."""
    total = [F.sum(c).alias(c) for c in ("lines_processed", "items_extracted", "hits_found")]
    return counts.groupBy(*keys).agg(*total, F.max("last_hit").alias("last_hit"))


def enabled_lines(lines: DataFrame, monitors: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Lines of enabled monitors; none at all when ``feeds`` is given and empty."""
    enabled = monitors.where("enabled").select("monitor_id").distinct()
    if feeds is not None and feeds.isEmpty():
        enabled = enabled.limit(0)
    return lines.join(broadcast_if_small(enabled), "monitor_id", "left_semi").select(*lines.columns)


def totals(feeds: DataFrame, monitors: DataFrame) -> DataFrame:
    """Number of feeds and of monitors, one row."""
    count_of = F.count(F.lit(1))
    return feeds.agg(count_of.alias("feeds")).withColumn("monitors", monitors.agg(count_of).scalar())


def feed_stats(queries: DataFrame, hits: DataFrame, feeds: DataFrame) -> DataFrame:
    """Lookups and lookups with a match per feed; every query is put to every feed.

    ``hits`` is the lookup of ``queries(query)``, ``feeds`` has ``feed_id``.
    """
    asked = queries.where(F.col("query") != "").groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    matched = (
        hits.select("database_id", F.col("matched_text").alias("query"))
        .distinct()
        .join(asked, "query")
        .groupBy(F.col("database_id").alias("feed_id"))
        .agg(F.sum("n").alias("queries_with_match"))
    )
    total = F.coalesce(asked.agg(F.sum("n")).scalar(), F.lit(0))
    rate = F.when(F.col("total_queries") > 0, F.col("queries_with_match") / F.col("total_queries"))
    return (
        feeds.select("feed_id")
        .distinct()
        .join(matched, "feed_id", "left")
        .withColumn("total_queries", total)
        .withColumn("queries_with_match", F.coalesce("queries_with_match", F.lit(0)))
        .withColumn("match_rate", F.coalesce(rate, F.lit(0.0)))
        .select("feed_id", "total_queries", "queries_with_match", "match_rate", percent(F.col("match_rate")).alias("match_percent"))
    )


def feed_summary(feeds: DataFrame, indicators: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row per feed: size, mode, description, build date, counts and, if given, statistics."""
    counts = feed_counts(indicators)
    described = feeds.select(
        "feed_id",
        "path",
        "size_bytes",
        format_size(F.col("size_bytes")).alias("size_human"),
        "mode",
        pick_description(F.col("description")).alias("description"),
        format_build_date(F.col("build_epoch")).alias("built"),
        "is_auto_updated",
    )
    summary = described.join(counts, "feed_id", "left").fillna(0, ["ip", "literal", "glob", "total"])
    return summary if stats is None else summary.join(stats, "feed_id", "left")
