"""Operators on log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizing import joined_in_chunks
from .staging import stage


def split_lines(texts: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """One row per line of a text column: ``line_number`` (from 1) and ``line``.

    Only ``\\n`` ends a line; what follows the last one is a line if it is not empty.
    Empty lines are dropped after numbering unless asked for.
    """
    rest = [c for c in texts.columns if c != column]
    pieces = F.split(column, "\n", -1)
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    lines = F.posexplode(whole).alias("__i", "line")
    numbered = texts.select(*rest, lines).select(*rest, (F.col("__i") + 1).cast("bigint").alias("line_number"), "line")
    return numbered if keep_empty else numbered.where(F.length("line") > 0)


def last_lines(text: Column, n: int) -> Column:
    """The last ``n`` lines of a text joined by newlines, cut from its end; null for a text without lines.

    A ``\\r`` before the ``\\n`` that ends a line is no part of it.
    """
    ended = F.endswith(text, F.lit("\n"))
    body = F.when(ended, F.left(text, F.length(text) - 1)).otherwise(text)
    tail = F.replace(F.substring_index(body, "\n", -n), F.lit("\r\n"), F.lit("\n"))
    return F.when(text != "", F.when(ended & F.endswith(tail, F.lit("\r")), F.left(tail, F.length(tail) - 1)).otherwise(tail))


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of numbered lines of each path joined by newlines: ``path``, ``tail``.

    For lines that are rows already; see ``last_lines`` for texts and ``tail_files`` for files, which
    are not read whole.  ``lines`` are numbered without gaps, empty lines included.  The last
    number of each path is found first, so only lines of the result are shuffled, for any
    ``n`` and however long a file is; no sort of a file takes place.
    """
    last = lines.groupBy("path").agg(F.max("line_number").alias("__last"))
    kept = joined_in_chunks(lines, stage(last), ["path"], ["__last"]).where(F.col("line_number") > F.col("__last") - n)
    ordered = F.sort_array(F.collect_list(F.struct("line_number", "line")))
    plain = F.transform(ordered["line"], lambda line: F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line))
    return kept.groupBy("path").agg(F.array_join(plain, "\n").alias("tail"))
