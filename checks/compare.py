"""Run registered queries beside their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from .oracle import ORACLE
from .queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(str(v) for v in r) for r in frame.itertuples(index=False)))


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str:
    """Empty text when Spark and SQL agree, else what differs."""
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return "" if a else "no rows"
    extra, missing = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    return f"rows {len(a)} / {len(b)}; only Spark {extra}; only SQL {missing}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name) if name in ORACLE else f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001 - a report of all queries is wanted
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem[:1200]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
