"""Indicator matching over log data on Spark: feeds, extraction, matching, hits, counters."""

from .functions import flatten_payload, format_build_date, format_hit_time, format_size, ip_bits, ip_family, percent, rfc3339
from .operators.counters import enabled_lines, feed_stats, feed_summary, monitor_stats, totals
from .operators.extract import extract
from .operators.hits import alerts, dedupe_hits, merge_hits, recent_hits
from .operators.indicators import add_feeds, compile_indicators, feed_counts, probe_counts, profile_indicators, remove_feeds
from .operators.lines import last_lines, split_lines, tail_lines
from .operators.sizing import Limits
from .operators.staging import stage
from .plans.hits import lookup, match_candidates, scan
from .plans.update import current_feeds, current_indicators, publish_feed, save_feeds, unload_feeds
from .sources.artifacts import file_inventory, read_manifest, updates_available, verify_artifacts
from .sources.catalog import read_catalog, split_existing, write_catalog
from .sources.feeds import indicators_from, load_feed, read_tlds
from .sources.hits import read_hits
from .sources.logs import read_log_lines, read_log_stream, tail_files
from .sources.tail import register_tail
from .streaming.scan import dedupe_stream, running_counters, scan_stream, stored_alerts, stored_hits, write_pending_alerts

__all__ = [name for name in dir() if not name.startswith("_")]
