"""Saved feed catalog: the list of feeds to open."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from ..schemas import CATALOG


#: Feeds in one list of a saved catalog.
ENTRIES = 10_000


def parse_catalog(texts: DataFrame, column: str = "value") -> DataFrame:
    """Catalog rows of JSON texts: ``path``, ``is_auto_updated``, ``sha256``.

    A text is a list of objects (``sha256`` may be missing) or, in the older
    layout, a list of paths.  A list that is neither throughout gives no rows.
    """

    def field(v, name, kind):
        return F.try_variant_get(v, f"$.{name}", kind)

    def is_entry(v):
        return field(v, "path", "string").isNotNull() & field(v, "is_auto_updated", "boolean").isNotNull()

    def is_path(v):
        return F.schema_of_variant(v) == "STRING"

    items = texts.select(
        F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<variant>").alias("items")
    )
    item = F.col("item")
    current = items.where(F.forall("items", is_entry)).select(F.explode("items").alias("item"))
    older = items.where(F.forall("items", is_path)).select(F.explode("items").alias("item"))
    return current.select(
        field(item, "path", "string").alias("path"),
        field(item, "is_auto_updated", "boolean").alias("is_auto_updated"),
        field(item, "sha256", "string").alias("sha256"),
    ).unionByName(
        older.select(
            F.try_variant_get(item, "$", "string").alias("path"),
            F.lit(False).alias("is_auto_updated"),
            F.lit(None).cast("string").alias("sha256"),
        )
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The saved catalog; empty when the file is missing or cannot be parsed."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], CATALOG)
    return parse_catalog(texts)


def write_catalog(feeds: DataFrame, path: str, entries: int = ENTRIES) -> None:
    """Save path, flag and hash of each feed as a JSON list; of more than ``entries`` feeds as several, one a file.

    Every list has some ``entries`` feeds and is written by a task of its own.  ``read_catalog`` reads them all.
    """
    entry = F.struct("path", "is_auto_updated", "sha256")
    text = F.to_json(F.sort_array(F.collect_list(entry))).alias("value")
    lists = -(-feeds.count() // entries)
    if lists > 1:
        rows = feeds.groupBy(F.pmod(F.xxhash64("path"), F.lit(lists)).alias("list")).agg(text).select("value")
    else:
        rows = feeds.agg(text)
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def split_existing(catalog: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows whose file is in ``inventory(path)``, and the others."""
    files = broadcast_if_small(inventory.select("path").distinct())
    return catalog.join(files, "path", "left_semi"), catalog.join(files, "path", "left_anti")
