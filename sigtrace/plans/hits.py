"""End-to-end matching plans: query texts or log lines in, hits out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip_bits, ip_family
from ..operators.extract import CANDIDATE_COLUMNS, extract, lookup_key
from ..operators.indicators import FeedProfile
from ..operators.match import match
from ..operators.sizing import DEFAULT_LIMITS, Limits
from ..schemas import HITS

SEPARATOR = "\u001f"
MANUAL_TYPE, MANUAL_SOURCE = "Manual", "manual"


def _hit_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def _indicator_texts(resolve_patterns: bool) -> Column:
    """What matched: ``text/prefix`` of a network, else pattern texts or ids."""
    if resolve_patterns:
        shown = F.transform("patterns", lambda p: F.coalesce(p["entry"], F.col("matched_text")))
    else:
        shown = F.transform("patterns", lambda p: F.concat(F.lit("pattern_"), p["pattern_id"].cast("string")))
    network = F.concat_ws("/", F.col("matched_text"), F.col("network.prefix_len").cast("string"))
    return F.when(F.col("network").isNotNull(), F.array(network)).otherwise(shown)


def _payloads() -> Column:
    """Metadata of what matched; a network without any gives JSON ``null``."""
    listed = F.filter(F.transform("patterns", lambda p: p["data"]), lambda d: d.isNotNull())
    network = F.array(F.coalesce(F.col("network.data"), F.lit("null")))
    return F.when(F.col("network").isNotNull(), network).otherwise(listed)


def _assemble(matches: DataFrame, resolve_patterns: bool, hit_time: Column, log_line: Column, extra, place) -> DataFrame:
    hits = matches.withColumn("matched_indicators", _indicator_texts(resolve_patterns)).where(
        F.size("matched_indicators") > 0
    )
    identity = [F.col(c) for c in place] + [F.col(c) for c in ("match_type", "matched_text", "feed_id")]
    return hits.select(
        _hit_id(*identity).alias("id"),
        hit_time.alias("timestamp"),
        "matched_text",
        "match_type",
        "source",
        F.col("feed_id").alias("database_id"),
        "matched_indicators",
        _payloads().alias("data"),
        log_line.cast("string").alias("log_line"),
        *extra,
    )


def lookup(
    queries: DataFrame,
    indicators: DataFrame,
    resolve_patterns: bool = True,
    hit_time: Column | None = None,
    profile: FeedProfile | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Look up every distinct non-empty text of ``queries(query)`` in all feeds.

    A text that is an IP address meets only networks; all other text meets only
    literals and globs.  One hit per (text, feed).
    """
    text = F.col("query")
    candidates = (
        queries.where(text != "")
        .select("query")
        .distinct()
        .select(
            text.alias("matched_text"),
            lookup_key(text).alias("lookup_key"),
            ip_family(text).alias("family"),
        )
        .withColumn("ip_bits", ip_bits(F.col("matched_text"), F.col("family")))
    )
    matches = (
        match(candidates, indicators, profile, limits)
        .withColumn("match_type", F.lit(MANUAL_TYPE))
        .withColumn("source", F.lit(MANUAL_SOURCE))
    )
    return _assemble(
        matches, resolve_patterns, F.current_timestamp() if hit_time is None else hit_time, F.lit(None), (), ("source",)
    )


def match_candidates(
    candidates: DataFrame,
    indicators: DataFrame,
    include_line: bool = False,
    resolve_patterns: bool = False,
    hit_time: Column | None = None,
    keep: Sequence[str] = (),
    profile: FeedProfile | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Hits of extracted candidates; ``keep`` adds further line columns at the end.

    The place of a hit, and so its id, includes the monitor: two monitors that
    read one file each get their own hits.
    """
    place = [c for c in ("monitor_id", "source", "path", "file_id", "line_number", "pos") if c in candidates.columns]
    carried = ["event_ts"] if hit_time is not None and "event_ts" in candidates.columns else []
    wanted = dict.fromkeys([*place, *carried, *keep, *CANDIDATE_COLUMNS, *(["line"] if include_line else [])])
    matches = match(candidates.select(*wanted), indicators, profile, limits)
    return _assemble(
        matches,
        resolve_patterns,
        F.current_timestamp() if hit_time is None else hit_time,
        F.col("line") if include_line else F.lit(None),
        keep,
        place,
    )


def scan(
    lines: DataFrame,
    indicators: DataFrame,
    tlds: DataFrame,
    include_line: bool = False,
    types: Iterable[str] | None = None,
    **options,
) -> DataFrame:
    """Extract from log lines and match against every feed: one hit per (item, feed).

    ``options`` are those of :func:`match_candidates`.
    """
    return match_candidates(extract(lines, tlds, types), indicators, include_line, **options)


def empty_hits(spark) -> DataFrame:
    return spark.createDataFrame([], HITS)
