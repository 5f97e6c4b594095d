"""Views over the given tables that stand in for logs and feeds (FIXTURES.md A)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.functions import patterns as P
from sigtrace.operators.extract import extract
from sigtrace.operators.lines import split_lines
from sigtrace.operators.staging import shared_folder
from sigtrace.sources.feeds import indicators_from

EPOCH = "2024-01-01 00:00:00"
TLDS = ("com", "net", "org")
NET = ("0.0.0.0/0", "10.0.0.0/8", "10.2.0.0/15", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.17", "192.168.0.0/16")
GLOBS = ("*.example.com", "M.*", "*.example.???", "*[0-9]@mail?.example.com", "blog.*.net")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant(spark: SparkSession, column: str, values) -> DataFrame:
    rows = ", ".join(f"('{v}')" for v in values)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({column})")


def tlds(spark: SparkSession) -> DataFrame:
    return constant(spark, "tld", TLDS)


def lines_documents(spark, sf_dir, keep_empty: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("monitor_id"),
        "source",
        F.col("doc_id").cast("string").alias("path"),
        (F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("event_ts"),
        "text",
    )
    return split_lines(rows, "text", keep_empty)


def log_files(spark, sf_dir) -> str:
    """Every document's text as lines of a log file, one file per source; returns the folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    sources = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("value"))
    one_each = sources.repartition(F.col("source")).sortWithinPartitions("source", "doc_id")
    one_each.select("source", "value").write.partitionBy("source").text(folder)
    return folder


def lines_files(lines: DataFrame) -> DataFrame:
    """Lines read back from ``log_files``, with the source's name in place of the file's."""
    return lines.withColumn("path", F.regexp_extract("path", "source=([^/]*)/", 1))


def lines_pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("monitor_id"),
        F.lit("Zeek:http").alias("source"),
        F.col("page_id").cast("string").alias("path"),
        F.lit(1).cast("bigint").alias("line_number"),
        F.col("url").alias("line"),
        (F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(secs=F.col("page_id"))).alias("event_ts"),
    )


def event_address() -> F.Column:
    user = F.col("user_id")
    return F.concat_ws(".", F.lit("10"), user % 8, F.col("event_id") % 4, user % 256)


def lines_conn(spark, sf_dir) -> DataFrame:
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        F.lit("conn").alias("monitor_id"),
        F.lit("Zeek:conn").alias("source"),
        F.lit("conn.log").alias("path"),
        F.col("event_id").alias("line_number"),
        F.concat_ws(" ", ts, event_address(), "event_type").alias("line"),
        F.col("ts").alias("event_ts"),
    )


def hosts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


def addresses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(event_address().alias("query"))


# -- feeds ---------------------------------------------------------------------


def _entries(df: DataFrame, feed_id: str, mode: str) -> DataFrame:
    """``df(entry)`` with metadata; every third pattern entry has none."""
    size = F.length("entry")
    data = F.to_json(F.struct(F.lit(feed_id).alias("category"), size.alias("rank")))
    is_ip = F.col("entry").rlike(r"^[0-9./]+$")
    return df.select(
        F.lit(feed_id).alias("feed_id"),
        F.lit(mode).alias("mode"),
        "entry",
        F.when(is_ip | (size % 3 != 0), data).alias("data"),
    )


def net(spark, sf_dir) -> DataFrame:
    return _entries(constant(spark, "entry", NET), "net", P.CASE_SENSITIVE)


def globs(spark, sf_dir) -> DataFrame:
    return _entries(constant(spark, "entry", GLOBS), "globs", P.CASE_INSENSITIVE)


def globs_cs(spark, sf_dir) -> DataFrame:
    return _entries(constant(spark, "entry", GLOBS), "globs_cs", P.CASE_SENSITIVE)


def derived_ip(spark, sf_dir) -> DataFrame:
    found = extract(lines_documents(spark, sf_dir), tlds(spark), [P.IPV4_TYPE])
    octets = F.split("matched_text", r"\.")
    exact = F.when(F.get(octets, F.lit(3)).cast("int") % 2 == 0, F.col("matched_text"))
    network = F.when(
        F.get(octets, F.lit(0)).cast("int") % 2 == 0,
        F.concat(F.get(octets, F.lit(0)), F.lit("."), F.get(octets, F.lit(1)), F.lit(".0.0/16")),
    )
    both = found.select(F.explode(F.array(exact, network)).alias("entry"))
    return _entries(both.where("entry is not null").distinct(), "derived_ip", P.CASE_SENSITIVE)


def derived_text(spark, sf_dir) -> DataFrame:
    even = lines_documents(spark, sf_dir).where(F.col("path").cast("long") % 2 == 0)
    found = extract(even, tlds(spark), [P.SHA1_TYPE, P.EMAIL_TYPE]).select(F.upper("matched_text").alias("entry"))
    names = hosts(spark, sf_dir).where("page_id % 3 = 0").select(F.col("host").alias("entry"))
    return _entries(found.unionByName(names).distinct(), "derived_text", P.CASE_INSENSITIVE)


def derived_globs(spark, sf_dir) -> DataFrame:
    """A glob feed that grows with ``pages``: five shapes for each host."""
    host = F.col("host")
    shapes = F.array(
        F.concat(F.lit("*."), F.substring_index(host, ".", -2)),
        F.concat(F.left(host, F.lit(6)), F.lit("*")),
        F.concat(F.lit("?"), F.expr("substring(host, 2)")),
        F.concat(F.lit("*"), F.expr("substring(host, 3, 5)"), F.lit("*")),
        F.concat(F.lit("[a-m]*"), F.right(host, F.lit(9))),
    )
    rows = hosts(spark, sf_dir).where("page_id % 7 = 0").select(F.explode(shapes).alias("entry")).distinct()
    return _entries(rows, "derived_globs", P.CASE_SENSITIVE)


FEEDS = {f.__name__: f for f in (net, derived_ip, derived_text, globs, globs_cs, derived_globs)}


def indicators(spark, sf_dir, *names) -> DataFrame:
    parts = [FEEDS[n](spark, sf_dir) for n in names]
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return indicators_from(entries)
