"""Feed store: publish a feed version, replace the catalog, read the current state.

Each publish writes its indicators to a path of its own below
``<root>/indicators/feed=<name>/version=<v>``, and each state of the catalog is
written once to ``<root>/feeds/snapshot=<n>/write=<id>``.  A publish adds
indicators and then a snapshot; readers take the highest snapshot that has data
files, so they see the old state or the new one and never a mixture.  Every
snapshot holds a marker row, so an empty catalog is a state like any other, and a
write that broke off leaves no data file and is passed over.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from ..schemas import FEEDS, INDICATORS


def _snapshots(root: str) -> str:
    return f"{root}/feeds"


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and folder of the highest snapshot, from the names of its files alone."""
    try:
        files = spark.read.schema(FEEDS).parquet(_snapshots(root)).inputFiles()
    except AnalysisException:
        return None
    found = [(int(m[1]), m[0]) for f in files if (m := re.search(r"snapshot=(\d+)/write=\w+", f))]
    return max(found, default=None)


def current_feeds(spark: SparkSession, root: str) -> DataFrame:
    """The catalog as of now; empty before the first publish."""
    newest = _newest(spark, root)
    if newest is None:
        return spark.createDataFrame([], FEEDS)
    return spark.read.schema(FEEDS).parquet(f"{_snapshots(root)}/{newest[1]}").where(F.col("feed_id").isNotNull())


def current_indicators(spark: SparkSession, root: str) -> DataFrame:
    """Indicators of all feeds in the current catalog (a handful of paths)."""
    paths = [r["path"] for r in current_feeds(spark, root).select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], INDICATORS)
    return spark.read.schema(INDICATORS).parquet(*paths)


def save_feeds(feeds: DataFrame, root: str) -> None:
    """Make ``feeds``, which may be empty, the current catalog."""
    spark = feeds.sparkSession
    newest = _newest(spark, root)
    number = newest[0] + 1 if newest else 0
    marker = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in FEEDS.fields))
    rows = feeds.select(*FEEDS.fieldNames()).where(F.col("feed_id").isNotNull()).union(marker)
    rows.coalesce(1).write.parquet(f"{_snapshots(root)}/snapshot={number}/write={uuid.uuid4().hex}")


def replace_auto_updated(feeds: DataFrame, new: DataFrame) -> DataFrame:
    """``feeds`` without its auto-updated rows and same-named rows, with ``new`` added."""
    gone = feeds.where("is_auto_updated").select("feed_id").unionByName(new.select("feed_id"))
    kept = feeds.join(broadcast_if_small(gone.distinct()), "feed_id", "left_anti")
    return kept.unionByName(new)


def publish_feed(
    indicators: DataFrame,
    feeds: DataFrame,
    name: str,
    version: str,
    root: str,
    sha256: str | None = None,
    auto_updated: bool = True,
    mode: str | None = None,
    description: dict[str, str] | None = None,
    build_epoch: int | None = None,
    size_bytes: int | None = None,
) -> DataFrame:
    """Write a feed version and make it current; returns the new catalog.

    An auto-updated feed takes the place of the earlier auto-updated one.  What
    earlier publishes wrote stays for batches that still read it.
    """
    spark = indicators.sparkSession
    path = f"{root}/indicators/feed={name}/version={version}/publish={uuid.uuid4().hex}"
    indicators.withColumn("feed_id", F.lit(name)).select(*INDICATORS.fieldNames()).write.parquet(path)
    row = {
        "feed_id": name,
        "path": path,
        "size_bytes": size_bytes,
        "mode": mode or _single_mode(indicators),
        "description": description,
        "build_epoch": build_epoch,
        "is_auto_updated": auto_updated,
        "sha256": sha256,
    }
    new = spark.createDataFrame([tuple(row[c] for c in FEEDS.fieldNames())], FEEDS)
    after = replace_auto_updated(feeds, new) if auto_updated else add_feed(feeds, new)
    save_feeds(after, root)
    return current_feeds(spark, root)


def add_feed(feeds: DataFrame, new: DataFrame) -> DataFrame:
    """``feeds`` with ``new`` added, replacing rows of the same id."""
    return feeds.join(broadcast_if_small(new.select("feed_id")), "feed_id", "left_anti").unionByName(new)


def unload_feeds(feeds: DataFrame, ids: DataFrame) -> DataFrame:
    """``feeds`` without those in ``ids(feed_id)``."""
    return feeds.join(broadcast_if_small(ids.select("feed_id").distinct()), "feed_id", "left_anti")


def _single_mode(indicators: DataFrame) -> str | None:
    row = indicators.agg(F.min("mode").alias("m")).first()
    return row["m"]
