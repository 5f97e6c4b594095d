"""Scalar rendering functions, all ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

KIB = 1024


def format_size(c: Column) -> Column:
    """Byte count with a 1024-based unit and two decimals (ties to even)."""

    def scaled(unit: int, name: str) -> Column:
        return F.format_string(f"%.2f {name}", F.bround(c.cast("double") / unit, 2))

    return (
        F.when(c >= KIB**3, scaled(KIB**3, "GB"))
        .when(c >= KIB**2, scaled(KIB**2, "MB"))
        .when(c >= KIB, scaled(KIB, "KB"))
        .otherwise(F.concat(c.cast("string"), F.lit(" bytes")))
    )


def format_build_date(epoch: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm UTC``; null stays null.

    Seconds beyond the year 9999 give ``Unknown date``.
    """
    known = F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm 'UTC'")
    in_range = epoch.between(-62135596800, 253402300799)
    return F.when(in_range, known).when(epoch.isNotNull(), F.lit("Unknown date"))


def format_hit_time(c: Column) -> Column:
    """RFC 3339 text as ``MMM dd, HH:mm:ss`` in the session zone.

    Other text: what stands between the first ``T`` and the next ``.``; without
    a ``T`` the text itself.
    """
    parsed = F.when(c.rlike(P.RFC3339), F.try_to_timestamp(F.upper(c)))
    after_t = F.substring_index(F.get(F.split(c, "T"), F.lit(1)), ".", 1)
    return F.coalesce(F.date_format(parsed, "MMM dd, HH:mm:ss"), after_t, c)


def rfc3339(ts: Column) -> Column:
    """Timestamp as RFC 3339 text with the offset of the session zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def percent(rate: Column) -> Column:
    """A rate as a whole percentage, ties to even."""
    return F.concat(F.bround(rate * 100, 0).cast("int").cast("string"), F.lit("%"))


def base_name(path: Column) -> Column:
    """Last segment of a path; the path itself when it has none."""
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.when(name == "", path).otherwise(name)


def source_label(path: Column, capture: bool = False) -> Column:
    """File name; for capture logs ``Zeek:`` and the name without trailing ``.log``s."""
    name = base_name(path)
    if capture:
        return F.concat(F.lit("Zeek:"), F.regexp_replace(name, r"(\.log)+$", ""))
    return F.coalesce(name, F.lit("unknown"))


def artifact_name(name: Column, version: Column) -> Column:
    return F.concat_ws("-", name, version)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
