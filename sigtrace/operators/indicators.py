"""Indicator tables: classify feed entries, index them, count and combine feeds.

Each indicator gets one *probe*: a key that every text it matches is sure to
produce as well.  Matching is then one equi join on ``probe`` for literals,
networks and globs alike.

========= ============================================== =====================
tag       indicator                                      key
========= ============================================== =====================
``E``     literal                                        the text
``N4/n``  IPv4 network (``N6/n``: IPv6)                  first n address bits
``Lk``    glob ``*.X``, X literal with k labels          X
``Pn``    glob that starts with a literal run            its first n characters
``Sn``    glob that ends with a literal run              its last n characters
``Gn``    glob with a literal run inside                 n characters of it
``A``     glob without any literal character             empty
========= ============================================== =====================

Text tags carry ``i`` or ``s`` for the feed's case mode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cidr_address, cidr_prefix_len, glob_literals, glob_to_regex, ip_bits, ip_family, suffix_key
from ..functions import patterns as P
from ..functions.globs import GLOB_MARKS
from ..schemas import INDICATORS
from .extract import lookup_key
from .sizing import DEFAULT_LIMITS, Limits, broadcast_if_small

MAX_LABELS = 16
MAX_ANCHOR = 32
MAX_GRAM = 3
#: Letters of host names from common to rare; what is not listed is rare.
COMMON = ".w-eoaitnsrclmhudpgbkyvf"


def entry_kind(entry: Column) -> Column:
    """``ip`` for addresses and CIDR ranges, ``glob`` with ``*``, ``?`` or ``[``, else ``literal``."""
    return (
        F.when(cidr_prefix_len(entry).isNotNull(), F.lit("ip"))
        .when(entry.rlike(GLOB_MARKS), F.lit("glob"))
        .otherwise(F.lit("literal"))
    )


def fold(text: Column, mode: Column) -> Column:
    """Text in the form compared under a feed's case mode."""
    return F.when(mode == P.CASE_INSENSITIVE, F.lower(text)).otherwise(lookup_key(text))


def _rarest_gram(text: Column) -> Column:
    """The ``MAX_GRAM`` neighbouring characters of a text that are rarest by ``COMMON``, the first of equals."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - MAX_GRAM + 1, F.lit(1)))

    def scored(i: Column) -> Column:
        piece = text.substr(i, F.lit(MAX_GRAM))
        rarity = sum((_rarity(F.substring(piece, k, 1)) for k in range(1, MAX_GRAM + 1)), F.lit(0))
        return F.struct(rarity.alias("rarity"), (-i).alias("first"), piece.alias("text"))

    return F.array_max(F.transform(starts, scored))["text"]


def _rarity(character: Column) -> Column:
    place = F.position(character, F.lit(COMMON))
    return F.when(character == "", 0).when(place == 0, len(COMMON) + 1).otherwise(place)


def _own_length(text: Column) -> Column:
    """Characters of an end beyond a leading ``www.`` and a bare last label, which thousands of names share."""
    rest = F.regexp_replace(F.regexp_replace(text, r"(?i)^www\.", ""), r"\.[^.]*$", "")
    return F.length(rest)


def _glob_anchor(glob: Column, case: Column) -> Column:
    """(tag, key) of the part of a glob that singles out its matches best.

    A literal end counts by what it has beyond ``www.`` and a last label; where that
    is less than a gram, the rarest gram of the run with most characters of its own is
    the key, and only globs without such a run rest on a weak end.
    """
    runs = F.col("__runs")
    head, tail = F.left(F.get(runs, F.lit(0)), F.lit(MAX_ANCHOR)), F.right(F.element_at(runs, -1), F.lit(MAX_ANCHOR))
    inner = F.array_max(F.transform(runs, lambda r: F.struct(_own_length(r).alias("own"), F.length(r).alias("n"), r.alias("text"))))
    gram = _rarest_gram(inner["text"])
    labels = F.size(F.split("suffix_key", r"\."))

    def anchor(letter: str, size: Column | None, key: Column) -> Column:
        parts = [F.lit(letter), case] + ([size.cast("string")] if size is not None else [])
        return F.struct(F.concat(*parts).alias("tag"), key.alias("key"))

    own = F.greatest(_own_length(head), _own_length(tail))
    has_gram = (inner["n"] >= MAX_GRAM) & (inner["own"] > own)
    ends_suffice = ((own >= MAX_GRAM) | ~has_gram) & (F.greatest(F.length(head), F.length(tail)) > 0)
    return (
        F.when(labels <= MAX_LABELS, anchor("L", labels, F.col("suffix_key")))
        .when(inner["n"] == 0, anchor("A", None, F.lit("")))
        .when(ends_suffice & ((_own_length(head) > _own_length(tail)) | (F.length(tail) == 0)), anchor("P", F.length(head), head))
        .when(ends_suffice, anchor("S", F.length(tail), tail))
        .otherwise(anchor("G", F.length(gram), gram))
    )


def compile_indicators(entries: DataFrame) -> DataFrame:
    """``entries(feed_id, mode, pattern_id, entry, data)`` as an indicator table."""
    entry, kind = F.col("entry"), F.col("kind")
    address = cidr_address(entry)
    case = F.when(F.col("mode") == P.CASE_INSENSITIVE, F.lit("i")).otherwise(F.lit("s"))
    is_glob = kind == "glob"
    typed = (
        entries.withColumn("kind", entry_kind(entry))
        .withColumn("match_key", F.when(kind == "ip", entry).otherwise(fold(entry, F.col("mode"))))
        .withColumn("family", F.when(kind == "ip", ip_family(address)))
        .withColumn("prefix_len", F.when(kind == "ip", cidr_prefix_len(entry)))
        .withColumn("net_bits", F.left(ip_bits(address, F.col("family")), F.col("prefix_len")))
        .withColumn("glob_re", F.when(is_glob, glob_to_regex(F.col("match_key"))))
        .withColumn("suffix_key", F.when(is_glob, suffix_key(F.col("match_key"))))
        .withColumn("__runs", F.when(is_glob, glob_literals(F.col("match_key"))))
    )
    network = F.struct(
        F.concat(F.lit("N"), F.col("family"), F.lit("/"), F.col("prefix_len")).alias("tag"),
        F.col("net_bits").alias("key"),
    )
    literal = F.struct(F.concat(F.lit("E"), case).alias("tag"), F.col("match_key").alias("key"))
    probe = (
        F.when(kind == "ip", network)
        .when(kind == "literal", literal)
        .otherwise(_glob_anchor(F.col("match_key"), case))
    )
    return (
        typed.withColumn("__probe", probe)
        .withColumn("probe_tag", F.col("__probe.tag"))
        .withColumn("probe", F.concat("__probe.tag", F.lit(":"), "__probe.key"))
        .select(*INDICATORS.fieldNames())
    )


@dataclass(frozen=True)
class FeedProfile:
    """What planning a match needs to know of an indicator table."""

    rows: int
    size: int
    tags: tuple[str, ...]

    def fits(self, limits: Limits = DEFAULT_LIMITS) -> bool:
        return self.rows <= limits.broadcast_rows and self.size <= limits.broadcast_bytes


def profile_indicators(indicators: DataFrame) -> FeedProfile:
    """Row count, size and the distinct probe tags (a few hundred at most)."""
    texts = ("feed_id", "entry", "match_key", "glob_re", "data", "probe")
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(128))
    row = indicators.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(width), F.lit(0)).alias("size"),
        F.collect_set("probe_tag").alias("tags"),
    ).first()
    return FeedProfile(row["n"], row["size"], tuple(sorted(row["tags"])))


def feed_counts(indicators: DataFrame) -> DataFrame:
    """Indicators of each kind per feed."""

    def of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(kind)

    return indicators.groupBy("feed_id").agg(
        of("ip"), of("literal"), of("glob"), F.count(F.lit(1)).alias("total")
    )


def probe_counts(indicators: DataFrame) -> DataFrame:
    """Globs by the way they are found: how many rest on a weak anchor."""
    return indicators.where("kind = 'glob'").groupBy("feed_id", F.left("probe_tag", F.lit(1)).alias("anchor")).count()


def remove_feeds(indicators: DataFrame, ids: DataFrame) -> DataFrame:
    """Indicators of all feeds but those in ``ids(feed_id)``."""
    return indicators.join(broadcast_if_small(ids.select("feed_id").distinct()), "feed_id", "left_anti")


def add_feeds(indicators: DataFrame, *more: DataFrame) -> DataFrame:
    """One indicator table out of several."""
    for df in more:
        indicators = indicators.unionByName(df)
    return indicators
