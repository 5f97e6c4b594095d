"""Matching candidates against every feed with one equi join.

A candidate produces the probes that the feed's tags call for (see
``indicators``), meets the indicators that share one, and keeps those whose glob
really matches.  When the indicators fit the broadcast limits the candidates are
never shuffled, only the matches are.  Of larger tables, which are large by their
literals as a rule, networks and globs are still broadcast; the literals are joined by
shuffle with the *distinct* texts, and the outcome is joined back to the
occurrences; both joins are salted.  Only where networks and globs alone exceed
the limits does everything go that way.  The candidates are then needed several
times, so they are written to the shared folder instead of extracted again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.globs import is_pieces, pieces_match
from .indicators import FeedProfile, profile_indicators
from .membership import key_filter, may_be_known
from .sizing import DEFAULT_LIMITS, Limits, salted_join
from .staging import stage

FOUND = ("feed_id", "network", "patterns")


def _text_key(letter: str, size: int, text: Column) -> Column:
    if letter == "E":
        return text
    if letter == "A":
        return F.lit("")
    if letter == "P":
        return F.left(text, F.lit(size))
    if letter == "S":
        return F.right(text, F.lit(size))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.when(dots >= size, F.substring_index(text, ".", -size))


def _grams(size: int, text: Column, mark: Column) -> Column:
    """The distinct ``size``-character pieces of a text, each marked."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    pieces = F.transform(starts, lambda i: F.concat(mark, text.substr(i, F.lit(size))))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def probes(tags: tuple[str, ...], text: Column, family: Column, bits: Column) -> Column:
    """Array of all probes of a candidate for an indicator table with ``tags``."""
    by_family = {4: [], 6: []}
    plain, grams = [], []
    for tag in tags:
        mark = F.lit(tag + ":")
        network = re.fullmatch(r"N([46])/(\d+)", tag)
        if network:
            length = int(network[2])
            by_family[int(network[1])].append(F.concat(mark, F.left(bits, F.lit(length))))
            continue
        letter, case, size = re.fullmatch(r"([ELPSGA])([is])(\d*)", tag).groups()
        folded = F.lower(text) if case == "i" else text
        if letter == "G":
            grams.append(_grams(int(size), folded, mark))
        else:
            plain.append(F.concat(mark, _text_key(letter, int(size or 0), folded)))

    def array_of(columns: list[Column]) -> Column:
        return F.array(*columns).cast("array<string>")

    texts = F.concat(array_of(plain), *grams) if grams else array_of(plain)
    return (
        F.when(family == 4, array_of(by_family[4])).when(family == 6, array_of(by_family[6])).otherwise(texts)
    )


def _confirmed(joined: DataFrame) -> DataFrame:
    """Pairs whose glob really matches: by its pieces, or by its expression where it has one-character places."""
    folded = F.col("mode") == P.CASE_INSENSITIVE
    text = F.when(folded, F.lower("lookup_key")).otherwise(F.col("lookup_key"))
    glob = F.when(folded, F.lower("entry")).otherwise(F.col("entry"))
    settled = F.col("glob_re").isNull() | F.startswith("probe_tag", F.lit("L"))
    return joined.where(settled | F.when(is_pieces(glob), pieces_match(text, glob)).otherwise(F.rlike(text, F.col("glob_re"))))


def _grouped(matches: DataFrame, candidate: list[str]) -> DataFrame:
    """One row per (candidate, feed): best network, or all patterns in order."""
    network = F.struct((-F.col("prefix_len")).alias("order"), "pattern_id", "prefix_len", "entry", "data")
    pattern = F.struct("pattern_id", "entry", "data")
    is_ip = F.col("kind") == "ip"
    keys = [c for c in candidate if c != "line"]
    carried = [F.first("line").alias("line")] if "line" in candidate else []
    return matches.groupBy(*keys, "feed_id").agg(
        *carried,
        F.min(F.when(is_ip, network)).alias("network"),
        F.sort_array(F.collect_list(F.when(~is_ip, pattern))).alias("patterns"),
    )


_INDICATOR_SIDE = ("feed_id", "pattern_id", "entry", "kind", "prefix_len", "glob_re", "data", "mode", "probe_tag", "probe")


def _probed(candidates: DataFrame, profile: FeedProfile) -> DataFrame:
    keys = probes(profile.tags, F.col("lookup_key"), F.col("family"), F.col("ip_bits"))
    return candidates.select("*", F.explode(keys).alias("probe"))


def _literal_matches(candidates: DataFrame, literals: DataFrame, tags: tuple[str, ...], limits: Limits) -> DataFrame:
    """Candidates beside the literals they equal; only those that a filter of all literals lets pass are shuffled."""
    texts = candidates.where(F.col("family").isNull())
    keys = probes(tags, F.col("lookup_key"), F.col("family"), F.col("ip_bits"))
    known, words = key_filter(literals, "probe")
    passed = stage(may_be_known(texts.select("*", F.explode(keys).alias("probe")), "probe", known, words))
    place = [c for c in candidates.columns if c not in ("lookup_key", "family", "ip_bits", "line")]
    return salted_join(passed, literals, "probe", place or ["lookup_key"], limits)


def match(
    candidates: DataFrame,
    indicators: DataFrame,
    profile: FeedProfile | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Candidates with the feeds that know them; candidates without match are left out.

    ``candidates`` needs ``lookup_key``, ``family`` and ``ip_bits``; its columns
    together (``line`` aside) must tell one candidate from another.  Adds
    ``feed_id``, ``network`` (the longest matching network, for addresses) and
    ``patterns`` (all matching literals and globs in ``pattern_id`` order).
    """
    profile = profile or profile_indicators(indicators)
    side = indicators.select(*_INDICATOR_SIDE)
    if profile.fits(limits):
        joined = _probed(candidates, profile).join(F.broadcast(side), "probe")
        return _grouped(_confirmed(joined), candidates.columns)

    text = ["lookup_key", "family", "ip_bits"]
    candidates = stage(candidates)
    is_literal = F.startswith("probe_tag", F.lit("E"))
    others = side.where(~is_literal)
    small = profile_indicators(indicators.where(~is_literal))
    if small.fits(limits):
        near = _confirmed(_probed(candidates, small).join(F.broadcast(others), "probe"))
        tags = tuple(t for t in profile.tags if t.startswith("E"))
        far = _literal_matches(candidates, side.where(is_literal), tags, limits)
        columns = [*candidates.columns, *(c for c in _INDICATOR_SIDE if c != "probe")]
        return _grouped(near.select(*columns).unionByName(far.select(*columns)), candidates.columns)
    distinct = candidates.select(*text).distinct()
    joined = salted_join(_probed(distinct, profile), side, "probe", ["lookup_key"], limits)
    known = _grouped(_confirmed(joined), text).select("lookup_key", *FOUND)
    place = [c for c in candidates.columns if c not in (*text, "line")]
    return salted_join(candidates, known, "lookup_key", place or text, limits)
