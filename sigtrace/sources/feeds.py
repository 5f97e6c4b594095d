"""Feed files and tables of well-known names (TLDs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.indicators import compile_indicators, entry_kind
from ..operators.numbering import dense_index, pin_splits


def feed_id_of(path: str) -> Column:
    return F.sha2(F.lit(path), 256)


def pack_metadata(columns: list[str]) -> Column:
    """All metadata columns as one JSON object; null when every one is null."""
    if not columns:
        return F.lit(None).cast("string")
    filled = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    return F.when(filled, F.to_json(F.struct(*columns)))


def load_feed(
    spark: SparkSession,
    path: str,
    feed_id: str | None = None,
    mode: str = P.CASE_SENSITIVE,
    fmt: str = "csv",
) -> DataFrame:
    """Indicator table of a feed file whose first column is ``entry``.

    All further columns are metadata.  ``pattern_id`` counts the entries in file
    order from 0, addresses and other entries apart.
    """
    if mode not in (P.CASE_SENSITIVE, P.CASE_INSENSITIVE):
        raise ValueError(f"unknown feed mode: {mode}")
    pin_splits(spark)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    rows = reader.load(path)
    metadata = [c for c in rows.columns if c != "entry"]
    entries = rows.where(F.length("entry") > 0).select(
        (F.lit(feed_id) if feed_id else feed_id_of(path)).alias("feed_id"),
        F.lit(mode).alias("mode"),
        "entry",
        pack_metadata(metadata).alias("data"),
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__mid"),
    )
    placed = entries.withColumn("__ip", entry_kind(F.col("entry")) == "ip")
    numbered = dense_index(placed, ["feed_id", "__ip"], ["__path", "__start"], ["__mid"], "pattern_id")
    return compile_indicators(numbered.drop("__ip", "__path", "__start", "__mid"))


def indicators_from(entries: DataFrame) -> DataFrame:
    """Indicator table of derived ``entries(feed_id, mode, entry, data)``.

    Entries have no file order here: ``pattern_id`` is the rank of the entry's
    SHA-256 among the feed's addresses or other entries.  The leading hash digits
    split a feed of any size evenly for the ranking.
    """
    hashed = (
        entries.withColumn("__ip", entry_kind(F.col("entry")) == "ip")
        .withColumn("__h", F.sha2("entry", 256))
        .withColumn("__b", F.left("__h", F.lit(3)))
    )
    ranked = dense_index(hashed, ["feed_id", "__ip"], ["__b"], ["__h", "data"], "pattern_id")
    return compile_indicators(ranked)


def read_tlds(spark: SparkSession, path: str) -> DataFrame:
    """Top-level domains of a text file, one per line, ``#`` starts a comment."""
    name = F.lower(F.trim("value"))
    return spark.read.text(path).where((name != "") & ~F.startswith(name, F.lit("#"))).select(name.alias("tld"))
