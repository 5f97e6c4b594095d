"""Row numbers over inputs of any size, without one task per file or feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import joined_in_chunks, plan_bytes

MOVED = "input splits changed between the counting and the numbering pass"


def _rows_before(scope: Sequence[str], block: Sequence[str]) -> Column:
    before = Window.partitionBy(*scope).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("__n").over(before), F.lit(0))


def dense_index(
    df: DataFrame, scope: Sequence[str], block: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """0-based position of each row in its ``scope``, ordered by ``block`` then ``order``.

    Blocks are numbered on their own and shifted by the sizes of the blocks
    before them, so only one row per block meets in the scope-wide window.
    """
    keys = [*scope, *block]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    bases = sizes.select(*keys, _rows_before(scope, block).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    known = F.coalesce("__base", F.raise_error(F.lit(MOVED)).cast("long"))
    return (
        df.withColumn("__i", inside)
        .join(bases, keys, "left")
        .withColumn(name, known + F.col("__i"))
        .drop("__i", "__base")
    )


def number_file_rows(df: DataFrame, name: str) -> DataFrame:
    """1-based row number in file order, added without shuffling the rows.

    ``df`` must read files directly and carry ``path`` and ``_metadata``.  Row ids
    grow inside a task, so a row's number is its distance from the first row of
    its split plus the rows of the splits before it: one small table row per split.
    """
    pin_splits(df.sparkSession)
    start, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    return _number_rows(df, start, length, name, split_bound(df))


def number_batch_rows(batch: DataFrame, name: str) -> DataFrame:
    """The same for a micro-batch of whole files, which carries ``path`` and ``block``.

    ``batch`` must be persisted and come straight from the files.
    """
    splits = batch.select("path", "block").distinct().count()
    return _number_rows(batch, F.col("block.start"), F.col("block.length"), name, splits).drop("block")


def _number_rows(df: DataFrame, start: Column, length: Column, name: str, splits: int) -> DataFrame:
    """Rows with their split's shift, which comes by broadcast: in one, or for millions of splits in several.

    A split is named by two hashes of its file and place, so a million of them are some 50 MB.
    """
    place = ("path", "__start", "__length")
    split = ["__split", "__check"]
    tagged = df.select("*", start.alias("__start"), length.alias("__length"), F.monotonically_increasing_id().alias("__mid"))
    sizes = tagged.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    shift = _rows_before(["path"], ["__start"]) - F.col("__first") + 1
    names = [F.xxhash64(*place).alias("__split"), F.xxhash64(F.lit(1), *place).alias("__check")]
    shifts = sizes.select(*names, shift.alias("__shift"))
    known = F.coalesce("__shift", F.raise_error(F.lit(MOVED)).cast("long"))
    return (
        joined_in_chunks(tagged.select("*", *names), shifts, split, ["__shift"], splits)
        .withColumn(name, F.col("__mid") + known)
        .drop("__start", "__length", "__mid", "__shift", *split)
    )


def pin_splits(spark) -> None:
    """Fix the number files are split for, which else follows the executors present."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def split_bound(df: DataFrame) -> int:
    """Upper bound of the number of splits of a file-reading frame, from sizes and the session's split size.

    100 TB in splits of 128 MiB are 800,000, so the table of splits stays small.
    """
    spark, total = df.sparkSession, plan_bytes(df)
    size = lambda key: int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    cores = int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism)
    split = min(size("spark.sql.files.maxPartitionBytes"), max(size("spark.sql.files.openCostInBytes"), total // cores))
    return len(df.inputFiles()) + total // max(1, split)
