"""Tables that a stream writes batch by batch, with a bounded number of folders.

    <table>/stream=<id>/batch_id=<n>      one micro-batch, written in overwrite mode
    <table>/stream=<id>/fold=<level>-<i>  the batches from i * FOLD ** level on, FOLD ** level of them

A folder counts when its writer has left ``_SUCCESS`` in it.  Readers take the folds of
the highest level and what no fold covers, so a fold replaces its parts in the moment it
is complete.  Its parts are removed only when the next fold of that level is complete, so
that readers who listed them before can finish.  A fold of parts that were folded again is
the same rows, so a batch that is run again after a restart does no harm.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.sizing import plan_bytes

#: Parts of one fold, and bytes of a file that a fold writes.
FOLD, FILE_BYTES = 100, 128 * 1024 * 1024

Part = tuple[int, int]  # level and number; batches have level 0


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it is absent."""
    fs, place = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _filesystem(spark, path)
    return fs.exists(place)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, place = _filesystem(spark, path)
    fs.create(place, True).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _filesystem(spark, path)
    fs.delete(place, True)


def _part(name: str) -> Part | None:
    if batch := re.fullmatch(r"batch_id=(\d+)", name):
        return 0, int(batch[1])
    fold = re.fullmatch(r"fold=(\d+)-(\d+)", name)
    return (int(fold[1]), int(fold[2])) if fold else None


def _name(part: Part) -> str:
    return f"batch_id={part[1]}" if part[0] == 0 else f"fold={part[0]}-{part[1]}"


def _within(part: Part, fold: Part) -> bool:
    return part[0] < fold[0] and part[1] // FOLD ** (fold[0] - part[0]) == fold[1]


def parts(spark: SparkSession, folder: str) -> set[Part]:
    """The complete parts in a stream's folder, covered or not."""
    found = filter(None, map(_part, children(spark, folder)))
    return {p for p in found if exists(spark, f"{folder}/{_name(p)}/_SUCCESS")}


def uncovered(found: set[Part]) -> list[Part]:
    """Those parts that no other one holds."""
    return sorted(p for p in found if not any(_within(p, q) for q in found))


def live(spark: SparkSession, table: str) -> list[str]:
    """Folders that together hold every row of a table once."""
    streams = [f"{table}/{name}" for name in children(spark, table) if name.startswith("stream=")]
    return [f"{s}/{_name(p)}" for s in streams for p in uncovered(parts(spark, s))]


def fold(
    spark: SparkSession,
    folder: str,
    last: int,
    combine: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    waiting: Callable[[int], bool] = lambda batch: False,
) -> None:
    """Folds what is complete up to the batch ``last``, level by level, and removes what earlier folds replaced.

    A fold whose batches are not all written, by ``waiting``, is left for a later call.
    """
    found = parts(spark, folder)
    level = 1
    while (last + 1) // FOLD**level:
        own = uncovered(found)
        for number in range((last + 1) // FOLD**level):
            inside = [p for p in own if _within(p, (level, number)) and p[0] == level - 1]
            span = FOLD**level
            if not inside or (level == 1 and any(waiting(b) for b in range(number * span, (number + 1) * span))):
                continue
            if level > 1 and any(_within(p, (level, number)) and p[0] < level - 1 for p in own):
                continue  # a lower level has still to be folded
            rows = combine(spark.read.parquet(*(f"{folder}/{_name(p)}" for p in inside)))
            files = max(1, -(-plan_bytes(rows) // FILE_BYTES))
            rows.coalesce(files).write.mode("overwrite").parquet(f"{folder}/{_name((level, number))}")
            found.add((level, number))
        level += 1
    for part in found - set(uncovered(found)):
        above = next(q for q in sorted(found) if _within(part, q))
        if (above[0], above[1] + 1) in found or any(_within(above, q) for q in found):
            remove(spark, f"{folder}/{_name(part)}")
