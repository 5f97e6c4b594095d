"""Update manifests and the landed feed files they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name
from ..schemas import MANIFEST

# -- fixed values: first bytes of a Zstandard frame and of an HTML page ---------
ZSTD_MAGIC = "28B52FFD"
HTML_START = "3C21444F43"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per feed of a manifest: names, version and what its file must be."""
    return explode_manifest(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def explode_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.select("channel", "generated_at", F.explode("databases").alias("d")).select(
        "channel", "generated_at", "d.name", "d.version", "d.format_version", "d.full.*"
    )


def describe_files(files: DataFrame) -> DataFrame:
    """``files(path, content)`` as path, size, SHA-256 and first bytes."""
    return files.select(
        "path",
        F.octet_length("content").cast("bigint").alias("length"),
        F.sha2("content", 256).alias("sha256"),
        F.hex(F.substring("content", 1, 5)).alias("head"),
    )


def file_inventory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Path, size, SHA-256 and first bytes of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return describe_files(files)


def verify_artifacts(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Check each manifest file against what landed: ``status`` and first ``error``.

    Files are paired by name; of several landed files of one name the one whose
    path ends with the longest part of the URL counts, the first path of equals.
    A file whose manifest row has no hash or no size cannot be verified and is
    rejected.  ``status`` is ``ok``, ``rejected`` or ``missing``.
    """
    landed = inventory.select(
        base_name(F.col("path")).alias("__file"), "path", "length", F.col("sha256").alias("found"), "head"
    )
    error = (
        F.when(F.col("sha256").isNull(), F.lit("manifest has no SHA-256"))
        .when(F.col("size").isNull(), F.lit("manifest has no size"))
        .when((F.col("length") > 5) & (F.col("head") == HTML_START), F.lit("file is an HTML page"))
        .when(F.col("found") != F.col("sha256"), F.concat(F.lit("SHA-256 is "), "found", F.lit(", expected "), "sha256"))
        .when(F.col("length") < 4, F.concat(F.lit("file has only "), F.col("length").cast("string"), F.lit(" bytes")))
        .when(F.left("head", F.lit(8)) != ZSTD_MAGIC, F.concat(F.lit("first bytes are "), F.left("head", F.lit(8))))
        .when(F.col("length") != F.col("size"), F.lit("size differs from the manifest"))
    )
    parts = lambda c: F.reverse(F.split(c, "/"))
    same = F.zip_with(parts("url"), parts("path"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.aggregate(
        same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")),
    )["n"]
    rows = manifest.withColumn("__file", base_name(F.col("url"))).join(landed, "__file", "left")
    best = F.min_by(F.struct("path", "length", "found", "head"), F.struct((-shared).alias("n"), "path")).alias("__best")
    return (
        rows.groupBy("name", "version", "url", "sha256", "size")
        .agg(best)
        .select("*", "__best.*")
        .withColumn("error", error)
        .withColumn(
            "status",
            F.when(F.col("path").isNull(), F.lit("missing"))
            .when(F.col("error").isNotNull(), F.lit("rejected"))
            .otherwise(F.lit("ok")),
        )
        .select("name", "version", "path", "status", "error")
    )


def updates_available(manifest: DataFrame, feeds: DataFrame, name: str = "threat-intel") -> DataFrame:
    """Compare the auto-updated feed with manifest row ``name`` by hash.

    One row per manifest row of that name: ``available``, the installed feed and
    hash (null when there is none) and the latest version and hash.  Without an
    installed hash an update is available.
    """
    installed = feeds.where("is_auto_updated").agg(
        F.min(F.struct("feed_id", "sha256")).alias("installed")
    )
    latest = manifest.where(F.col("name") == name)
    return latest.select(
        "name",
        F.col("version").alias("latest_version"),
        F.col("sha256").alias("latest_sha256"),
        installed.scalar().alias("installed"),
    ).select(
        "name",
        F.coalesce(F.col("installed.sha256") != F.col("latest_sha256"), F.lit(True)).alias("available"),
        F.col("installed.feed_id").alias("installed_feed"),
        F.col("installed.sha256").alias("installed_sha256"),
        "latest_version",
        "latest_sha256",
    )
