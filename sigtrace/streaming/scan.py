"""Continuous matching of a stream of log lines against feeds that may be replaced."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counters import enabled_lines, monitor_counts, shown_counts, summed_counts
from ..operators.extract import extract
from ..operators.hits import alerts
from ..operators.indicators import FeedProfile, profile_indicators
from ..plans.hits import match_candidates
from ..schemas import COUNTS
from ..sources.hits import read_hits
from ..sources.logs import finish_batch
from . import store

log = logging.getLogger(__name__)


@dataclass
class FeedHolder:
    """The indicator table in use; a reload that fails leaves the last good one."""

    load: Callable[[], DataFrame]
    indicators: DataFrame | None = None
    profile: FeedProfile | None = None

    def refresh(self) -> tuple[DataFrame, FeedProfile]:
        try:
            fresh = self.load()
            self.indicators, self.profile = fresh, profile_indicators(fresh)
        except Exception:
            if self.indicators is None:
                raise
            log.exception("feed reload failed, keeping the feeds of the batch before")
        return self.indicators, self.profile


@dataclass
class BatchScan:
    """Body of the micro-batch: extract, match, count, store, alert.

    Everything is written under ``stream=<id>/batch_id=<n>`` in overwrite mode, so a
    batch that is run again replaces what its first run left.  The id is that of the
    query, which Spark keeps in the checkpoint: other queries, and a query with a new
    checkpoint, have folders of their own.  Old batches are folded, see ``store``.

    A batch whose alerts are not written yet is noted under ``pending`` before they are tried; the
    note goes when they are there.  Noted batches are tried again with every batch and
    when the query starts, also after a restart.
    """

    feeds: FeedHolder
    tlds: DataFrame
    out: str
    monitors: DataFrame | None = None
    include_line: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = f"stream={spark.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        place = f"{stream}/batch_id={batch_id}"
        indicators, profile = self.feeds.refresh()
        batch = batch.persist()
        lines = finish_batch(batch)
        if self.monitors is not None:
            lines = enabled_lines(lines, self.monitors)
        found = extract(lines, self.tlds).persist()
        try:
            hits = match_candidates(
                found, indicators, include_line=self.include_line, keep=["monitor_id"], profile=profile
            )
            hits_path = f"{self.out}/hits/{place}"
            hits.write.mode("overwrite").parquet(hits_path)
            stored = spark.read.schema(hits.schema).parquet(hits_path)
            counters = monitor_counts(lines, found, stored).withColumn("run_id", F.lit(self.run_id))
            counters.write.mode("overwrite").parquet(f"{self.out}/counters/{place}")
            store.mark(spark, f"{self.out}/pending/{place}")
            write_pending_alerts(spark, self.out, stream)
            if (batch_id + 1) % store.FOLD == 0:
                self._fold(spark, stream, batch_id)
        finally:
            found.unpersist()
            batch.unpersist()

    def _fold(self, spark: SparkSession, stream: str, batch_id: int) -> None:
        """Fewer folders; what fails here is tried again, since the folders themselves tell what is folded."""
        try:
            waiting = set(store.children(spark, f"{self.out}/pending/{stream}"))
            unwritten = lambda batch: f"batch_id={batch}" in waiting
            store.fold(spark, f"{self.out}/hits/{stream}", batch_id, waiting=unwritten)
            store.fold(spark, f"{self.out}/alerts/{stream}", batch_id, waiting=unwritten)
            store.fold(spark, f"{self.out}/counters/{stream}", batch_id, lambda rows: summed_counts(rows, "run_id", "monitor_id"))
        except Exception:
            log.exception("batches up to %s were not folded", batch_id)


def write_pending_alerts(spark: SparkSession, out: str, stream: str | None = None) -> list[str]:
    """Writes the alerts of all noted batches, of one stream or of all; gives the batches that failed again."""
    streams = [stream] if stream else store.children(spark, f"{out}/pending")
    failed = []
    for place in [f"{s}/{batch}" for s in streams for batch in store.children(spark, f"{out}/pending/{s}")]:
        try:
            alerts(read_hits(spark, f"{out}/hits/{place}")).write.mode("overwrite").parquet(f"{out}/alerts/{place}")
            store.remove(spark, f"{out}/pending/{place}")
        except Exception:
            log.exception("alerts of %s were not written", place)
            failed.append(place)
    return failed


def scan_stream(
    lines: DataFrame,
    load: Callable[[], DataFrame],
    tlds: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    monitors: DataFrame | None = None,
    include_line: bool = False,
) -> StreamingQuery:
    """Start matching ``lines`` against the feeds that ``load()`` returns for each batch.

    Hits, alerts and counters go to Parquet under ``out``.  ``trigger`` holds the
    arguments of ``DataStreamWriter.trigger``; without it batches follow each
    other at once.  The number of lines per batch is in ``lastProgress`` as the
    observed metric ``lines``.  Alerts that an earlier run with this checkpoint could not
    write are tried again first.
    """
    if earlier := _stream_of(lines.sparkSession, checkpoint):
        write_pending_alerts(lines.sparkSession, out, earlier)
    body = BatchScan(FeedHolder(load), tlds, out, monitors, include_line)
    counted = lines.observe("lines", F.count_if(F.length("line") > 0).alias("lines"))
    writer = counted.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _stream_of(spark: SparkSession, checkpoint: str) -> str | None:
    """The folder name of the query that a checkpoint belongs to, None for a new checkpoint."""
    if not store.exists(spark, f"{checkpoint}/metadata"):
        return None
    return f"stream={json.loads(spark.read.text(f'{checkpoint}/metadata').first()[0])['id']}"


def running_counters(spark: SparkSession, out: str, run_id: str | None = None) -> DataFrame:
    """Counters per monitor over all batches so far, or over those of one run."""
    folders = store.live(spark, f"{out}/counters")
    batches = spark.read.schema(COUNTS).parquet(*folders) if folders else spark.createDataFrame([], COUNTS)
    if run_id is not None:
        batches = batches.where(F.col("run_id") == run_id)
    return shown_counts(summed_counts(batches, "monitor_id"))


def stored_hits(spark: SparkSession, out: str) -> DataFrame:
    """All hits stored so far."""
    return read_hits(spark, *store.live(spark, f"{out}/hits"))


def stored_alerts(spark: SparkSession, out: str) -> DataFrame | None:
    """All alerts written so far, none before the first batch."""
    folders = store.live(spark, f"{out}/alerts")
    return spark.read.schema("title string, body string").parquet(*folders) if folders else None


def dedupe_stream(hits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming hits without repeats of an id that arrive within ``delay``.

    Rows later than ``delay`` are not passed on; Spark counts them in the query's
    progress as ``numRowsDroppedByWatermark``.
    """
    return hits.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])
