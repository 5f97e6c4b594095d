"""Candidate extraction: log lines to one row per item that could be an indicator."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip_bits
from ..functions import patterns as P
from .sizing import joined_in_chunks, spread_if_small

CANDIDATE_COLUMNS = ("pos", "match_type", "matched_text", "lookup_key", "family", "ip_bits")

# A line is cut once into runs of the characters that tokens have; the few runs that can hold a token are kept.
# The patterns of all types then read only these, each the runs with the character or length that its tokens have.
TOKEN_GROUPS = {
    "ipv4": (P.IPV4_TOKEN, lambda run: run.rlike(P.IPV4_HINT), (P.IPV4_TYPE,)),
    "ipv6": (P.IPV6_TOKEN, lambda run: F.contains(run, F.lit(":")), (P.IPV6_TYPE,)),
    "domain": (P.DOMAIN_TOKEN, lambda run: run.rlike(P.DOMAIN_HINT), (P.DOMAIN_TYPE,)),
    "email": (P.EMAIL_TOKEN, lambda run: F.contains(run, F.lit("@")), (P.EMAIL_TYPE,)),
    "long": (
        P.LONG_TOKEN,
        lambda run: F.length(run) >= P.LONG_LEAST,
        (P.MD5_TYPE, P.SHA1_TYPE, P.SHA256_TYPE, P.BITCOIN_TYPE, P.ETHEREUM_TYPE),
    ),
}


def _runs(line: Column) -> Column:
    """The runs of a line that can hold tokens, in their order."""
    long = (F.length(line) >= P.LONG_LEAST) & (line.rlike(P.DIGIT_HINT) | line.rlike(P.HEX_HINT))
    cut = F.filter(
        F.regexp_extract_all(line, F.lit(P.RUN), F.lit(0)), lambda run: (F.length(run) >= P.LONG_LEAST) | run.rlike(P.MARK_HINT)
    )
    return F.when(line.rlike(P.MARK_HINT) | long, cut).otherwise(F.array().cast("array<string>"))


def _tokens(runs: Column, pattern: str, possible: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.filter(runs, possible), lambda run: F.regexp_extract_all(run, F.lit(pattern), F.lit(0))))


def _ipv6_pieces(token: Column) -> Column:
    """The parts of a run with colons between groups that are not hexadecimal."""
    groups = F.transform(F.split(token, ":"), lambda g: F.when(g.rlike(P.IPV6_GROUP), g).otherwise(F.lit(" ")))
    cut = F.replace(F.replace(F.array_join(groups, ":"), F.lit(": "), F.lit(" ")), F.lit(" :"), F.lit(" "))
    return F.filter(F.split(cut, " "), lambda p: F.like(p, F.lit("%:%:%")))


def _trimmed(group: Column, token: Column) -> Column:
    """Points, hyphens and a colon that only surround a name or address are no part of it."""
    return (
        F.when(group == "domain", F.trim(token, F.lit(".-")))
        .when(group == "email", F.ltrim(F.rtrim(token, F.lit(".-")), F.lit(".")))
        .when(group == "ipv6", F.regexp_replace(F.rtrim(token, F.lit(".")), "([^:]):$", "$1"))
        .otherwise(token)
    )


def _is_valid(group: Column, text: Column) -> Column:
    """Whether a token has the form of its type, not only the look of it.

    Of domains only those whose last label begins with a digit are turned away
    here; the list of TLDs leaves few for the full test.
    """
    return (
        F.when(group == "ipv4", text.rlike(P.IPV4_ADDRESS))
        .when(group == "ipv6", text.rlike(P.IPV6_ADDRESS))
        .when(group == "domain", F.substring_index(text, ".", -1) >= "A")
        .when(group == "email", text.rlike(P.EMAIL_ADDRESS))
        .otherwise(text.rlike(P.LONG_FORMS))
    )


def _match_type(group: Column, text: Column) -> Column:
    """Type of a valid token; a hash-shaped text counts as a hash first."""
    by_group = F.when(group == "ipv4", F.lit(P.IPV4_TYPE))
    for name, kind in (("ipv6", P.IPV6_TYPE), ("domain", P.DOMAIN_TYPE), ("email", P.EMAIL_TYPE)):
        by_group = by_group.when(group == name, F.lit(kind))
    by_length = F.when(F.length(text) == 32, F.lit(P.MD5_TYPE)).when(F.length(text) == 40, F.lit(P.SHA1_TYPE))
    return (
        by_group.when(text.rlike(P.HEX_HASH), by_length.otherwise(F.lit(P.SHA256_TYPE)))
        .when(F.startswith(text, F.lit("0x")), F.lit(P.ETHEREUM_TYPE))
        .otherwise(F.lit(P.BITCOIN_TYPE))
    )


def lookup_key(text: Column) -> Column:
    """Text to look up: hexadecimal hashes in lower case, all else unchanged."""
    return F.when(text.rlike(P.HEX_HASH), F.lower(text)).otherwise(text)


def extract(lines: DataFrame, tlds: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """All candidates of ``lines``, one row per occurrence.

    Types are independent: the host of an e-mail address is also a domain.  A
    domain counts only when its last label is in ``tlds(tld)``.  ``pos`` orders
    the candidates of a line and is unique in it.
    """
    wanted = set(P.TYPES if types is None else types)
    unknown = wanted - set(P.TYPES)
    if unknown:
        raise ValueError(f"unknown candidate types: {sorted(unknown)}")
    groups = {g: spec for g, spec in TOKEN_GROUPS.items() if wanted & set(spec[2])}

    cut = spread_if_small(lines).select("*", _runs(F.col("line")).alias("__runs")).where(F.size("__runs") > 0)
    tokens_of = {g: _tokens(F.col("__runs"), p, possible) for g, (p, possible, _) in groups.items()}
    if "ipv6" in tokens_of:
        tokens_of["ipv6"] = F.flatten(F.transform(tokens_of["ipv6"], _ipv6_pieces))
    tokenised = cut.select("*", *[tokens.alias(f"__{g}") for g, tokens in tokens_of.items()])
    found, start = [], F.lit(0)
    for g in groups:
        tokens = F.col(f"__{g}")
        found.append(F.struct(F.lit(g).alias("__group"), tokens.alias("__tokens"), start.alias("__start")))
        start = start + F.size(tokens)
    rows = (
        tokenised.select(*lines.columns, F.inline(F.array(*found)))
        .select("*", F.posexplode("__tokens").alias("__i", "__token"))
        .withColumn("matched_text", _trimmed(F.col("__group"), F.col("__token")))
        .where(_is_valid(F.col("__group"), F.col("matched_text")))
        .withColumn("match_type", _match_type(F.col("__group"), F.col("matched_text")))
    )
    if wanted != {t for _, _, served in groups.values() for t in served}:
        rows = rows.where(F.col("match_type").isin(*sorted(wanted)))
    if P.DOMAIN_TYPE in wanted:
        rows = _with_known_tld(rows, tlds)

    text, kind = F.col("matched_text"), F.col("match_type")
    family = F.when(kind == P.IPV4_TYPE, F.lit(4)).when(kind == P.IPV6_TYPE, F.lit(6))
    return rows.select(
        *lines.columns,
        (F.col("__start") + F.col("__i")).alias("pos"),
        "match_type",
        "matched_text",
        F.when(kind.isin(P.MD5_TYPE, P.SHA1_TYPE, P.SHA256_TYPE), F.lower(text)).otherwise(text).alias("lookup_key"),
        family.alias("family"),
        ip_bits(text, family).alias("ip_bits"),
    )


def _with_known_tld(rows: DataFrame, tlds: DataFrame) -> DataFrame:
    known = tlds.select(F.lower("tld").alias("__last"), F.lit(True).alias("__known")).distinct()
    is_domain = F.col("match_type") == P.DOMAIN_TYPE
    labelled = rows.withColumn("__last", F.when(is_domain, F.lower(F.substring_index("matched_text", ".", -1))))
    return (
        joined_in_chunks(labelled, known, ["__last"], ["__known"])
        .where(~is_domain | (F.col("__known") & F.col("matched_text").rlike(P.DOMAIN_NAME)))
        .drop("__last", "__known")
    )
