"""Row-wise work in Arrow batches, and columns picked by exact name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name and position.

    Tables may carry extra columns whose names differ in case only; Spark's own
    name lookup would call such a reference ambiguous.
    """
    places = [df.columns.index(name) for name in names]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(name) for i, name in zip(places, names)))


def with_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    compute: Callable[..., list],
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """``df`` with ``fields`` appended, computed batch by batch from the columns ``inputs``.

    ``compute`` gets one Python list for each input and returns one array or list
    for each field.  All rows and columns pass through, so no join brings the
    results back.  The new columns stand last and are found by position, see ``split``.
    ``finish`` is called when a task ends, to drop what its worker keeps in memory.
    """
    places = [df.columns.index(name) for name in inputs]
    width = len(df.columns)
    names = [f"c{i}" for i in range(width + len(fields))]
    added = [T.StructField(names[width + i], f.dataType) for i, f in enumerate(fields)]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema)] + added)
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in pieces(batch, places[0]):
                    made = compute(*(part.column(i).to_pylist() for i in places))
                    arrays = [m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, kinds)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=names)
        finally:
            if finish:
                finish()

    return df.toDF(*names[:width]).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes in the column ``text``, which bounds what a task holds at once."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        held = before[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(before, held + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split(df: DataFrame, names: list[str], wanted: list[str]) -> DataFrame:
    """Gives the result of ``with_columns`` names again: ``names`` are the original
    columns followed by the appended ones, ``wanted`` those to keep (the last of a name)."""
    last = {name: i for i, name in enumerate(names)}
    return df.select(*(F.col(f"c{last[name]}").alias(name) for name in wanted))


def original(df: DataFrame, like: DataFrame) -> DataFrame:
    """The first columns of ``df`` under the names they have in ``like``."""
    return df.select(*df.columns[: len(like.columns)]).toDF(*like.columns)


def chunks(texts: list[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _arrow(kind: T.DataType) -> pa.DataType:
    plain = {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.StringType: pa.string(),
        T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(),
    }
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else plain[type(kind)]
