"""Stored hits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..schemas import HITS


def read_hits(spark: SparkSession, *paths: str) -> DataFrame:
    """Hits saved under ``paths``; an empty table when there are none."""
    try:
        return spark.read.schema(HITS).option("recursiveFileLookup", "true").parquet(*paths)
    except AnalysisException:
        return spark.createDataFrame([], HITS)
