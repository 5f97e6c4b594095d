"""Derived feeds as written tables in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where none is named, a new temporary folder becomes the checkpoint folder of a
    local session.  On a cluster that is an error: executors would write to their
    own disks, and tables read back would be empty.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sigtrace-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: known size, no recomputation, no lineage.

    A derived indicator table is read several times (profile, match, statistics),
    so it is computed here once; a lost executor re-reads the file.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sigtrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
