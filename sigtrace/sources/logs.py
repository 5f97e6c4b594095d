"""Log files as line tables, batch and stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name, source_label
from ..operators.numbering import number_batch_rows, number_file_rows


def name_matches(path: Column, pattern: str) -> Column:
    """``*`` takes every file, ``*.ext`` those whose extension is the pattern's last part."""
    if pattern == "*":
        return F.lit(True)
    extension = pattern.removeprefix("*.").split(".")[-1]
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1) == extension).otherwise(F.lit(False))


def _glob_filter(pattern: str) -> str:
    """The same rule for the file listing itself, so other files are never opened."""
    return "*" if pattern == "*" else "?*." + pattern.removeprefix("*.").split(".")[-1]


def _labelled(rows: DataFrame, monitor_id: str, capture: bool, *columns) -> DataFrame:
    return rows.select(
        F.lit(monitor_id).alias("monitor_id"),
        source_label(F.col("path"), capture).alias("source"),
        "path",
        *columns,
        "line",
        F.col("event_ts"),
    )


def read_log_lines(
    spark: SparkSession,
    path: str,
    monitor_id: str,
    recursive: bool = False,
    pattern: str = "*",
    capture: bool = False,
    numbered: bool = True,
    keep_empty: bool = False,
) -> DataFrame:
    """Lines of all files under ``path``, without empty ones unless asked for.

    Lines end at ``\\n`` only.  ``line_number`` counts from 1 with empty lines
    included; numbering reads the input once more (without shuffling it).  With
    ``numbered=False`` it is a row id instead, which tells lines apart but means
    nothing and may differ when the files are split differently.  ``event_ts`` is the file's modification time.
    """
    text = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", _glob_filter(pattern))
        .text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("event_ts"),
            "_metadata",
        )
    )
    rows = number_file_rows(text, "line_number") if numbered else text.withColumn("line_number", F.monotonically_increasing_id())
    labelled = _labelled(rows, monitor_id, capture, "line_number")
    return labelled if keep_empty else labelled.where(F.length("line") > 0)


def tail_files(spark: SparkSession, path: str, n: int, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """The last ``n`` lines of every file under ``path`` joined by newlines: ``path``, ``tail``; none of an empty file.

    Files are listed by Spark and read from their ends by the tasks, in growing blocks until the
    lines are found, so the bytes read do not depend on how long a file is.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", _glob_filter(pattern)).load(path).where("length > 0").select("path", "length")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, place = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", name))
                with fs.open_input_file(place) as stream:
                    tails.append(tail_of(stream, size, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails, pa.string())], names=["path", "tail"])

    return files.mapInArrow(run, "path string, tail string")


def tail_of(stream, size: int, n: int, block: int = 1 << 16) -> str:
    """The last ``n`` lines of the first ``size`` bytes; a ``\\r`` before the ``\\n`` that ends a line is no part of it."""
    blocks, end, breaks = [], size, 0
    while end > 0 and breaks <= n:
        start = max(0, end - block)
        stream.seek(start)
        blocks.append(stream.read(end - start))
        breaks += blocks[-1].count(b"\n")
        end, block = start, min(2 * block, 1 << 24)
    *ended, rest = b"".join(reversed(blocks)).split(b"\n")
    lines = [line.removesuffix(b"\r") for line in ended[-n:]] + ([rest] if rest else [])
    return b"\n".join(lines[-n:]).decode("utf-8", "replace")


def read_log_stream(
    spark: SparkSession,
    directory: str,
    monitor_id: str,
    pattern: str = "*",
    capture: bool = True,
    max_files: int = 1000,
) -> DataFrame:
    """Stream of all lines of closed files that appear in ``directory``.

    For files that still grow use the ``tail`` source.  Rows carry the ``block`` of
    the file they come from; in a micro-batch ``finish_batch`` turns it into line
    numbers and drops empty lines (``scan_stream`` does so by itself).
    """
    block = F.struct(
        F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length")
    )
    text = (
        spark.readStream.option("lineSep", "\n")
        .option("pathGlobFilter", _glob_filter(pattern))
        .option("maxFilesPerTrigger", max_files)
        .text(directory)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("event_ts"),
            block.alias("block"),
        )
    )
    return _labelled(text, monitor_id, capture, "block")


def finish_batch(batch: DataFrame) -> DataFrame:
    """Lines of a persisted micro-batch, numbered per file and without empty ones."""
    numbered = number_batch_rows(batch, "line_number") if "block" in batch.columns else batch
    return numbered.where(F.length("line") > 0)
