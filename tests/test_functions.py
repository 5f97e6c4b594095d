import json
import random

import pytest
from pyspark.sql import functions as F

from sigtrace import functions as S
from sigtrace.operators.counters import feed_stats, feed_summary, totals
from sigtrace.operators.hits import alerts, dedupe_hits, recent_hits
from sigtrace.operators.indicators import add_feeds, feed_counts, probe_counts, remove_feeds
from sigtrace.plans.hits import lookup
from sigtrace.schemas import FEEDS, HITS
from sigtrace.sources.logs import name_matches

from .helpers import feed, rows


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "size,text",
    [(0, "0 bytes"), (1023, "1023 bytes"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1408, "1.38 KB"), (1048575, "1024.00 KB"),
     (1048576, "1.00 MB"), (5 * 1024**3 + 1, "5.00 GB"), (3 * 1024**4, "3072.00 GB")],
)
def test_format_size(spark, size, text):
    assert value(spark, S.format_size(F.lit(size))) == text


@pytest.mark.parametrize("epoch,text", [(0, "1970-01-01 00:00 UTC"), (1737556245, "2025-01-22 14:30 UTC"), (10**15, "Unknown date"), (None, None)])
def test_build_date(spark, epoch, text):
    assert value(spark, S.format_build_date(F.lit(epoch).cast("long"))) == text


@pytest.mark.parametrize(
    "given,text",
    [("2025-01-22T14:30:45.123Z", "Jan 22, 14:30:45"), ("2025-01-22T14:30:45+02:00", "Jan 22, 12:30:45"), ("2025-01-22t14:30:45z", "Jan 22, 14:30:45"),
     ("2025-01-22T14:30:45.999999999Z", "Jan 22, 14:30:45"), ("2025-01-22T14:30:45.123", "14:30:45"), ("2025-13-22T14:30:45.1Z", "14:30:45"),
     ("xTyTz.w", "y"), ("now", "now"), ("", "")],
)
def test_hit_time(spark, given, text):
    assert value(spark, S.format_hit_time(F.lit(given))) == text


def test_rfc3339_round_trip(spark):
    assert value(spark, S.rfc3339(F.timestamp_micros(F.lit(1)))) == "1970-01-01T00:00:00.000001+00:00"


@pytest.mark.parametrize("rate,text", [(0.0, "0%"), (1.0, "100%"), (0.125, "12%"), (0.135, "14%"), (0.005, "0%"), (0.666, "67%")])
def test_percent(spark, rate, text):
    assert value(spark, S.percent(F.lit(rate))) == text


@pytest.mark.parametrize(
    "path,base,label,capture",
    [("/var/log/conn.log", "conn.log", "conn.log", "Zeek:conn"), ("a.log.log", "a.log.log", "a.log.log", "Zeek:a"), ("/x/y/", "y", "y", "Zeek:y"),
     (None, None, "unknown", None), ("file:///l/dns.log.gz", "dns.log.gz", "dns.log.gz", "Zeek:dns.log.gz")],
)
def test_labels(spark, path, base, label, capture):
    c = F.lit(path).cast("string")
    assert value(spark, S.base_name(c)) == base
    assert value(spark, S.source_label(c)) == label and value(spark, S.source_label(c, capture=True)) == capture


@pytest.mark.parametrize("path,pattern,taken", [("/a/x.log", "*.log", True), ("/a/x.log.gz", "*.log", False), ("/a/x", "*", True), ("/a/x", "*.log", False), ("/a/.log", "*.log", False), ("/a/x.gz", "*.log.gz", True)])
def test_name_pattern(spark, path, pattern, taken):
    assert value(spark, name_matches(F.lit(path), pattern)) is taken


@pytest.mark.parametrize("json,epoch", [("1700000000", 1700000000), ("70000", 70000), ("-1", None), ('"1700000000"', None), ("1.5", None), ("null", None), ("[1]", None)])
def test_build_epoch(spark, json, epoch):
    assert value(spark, S.build_epoch(F.parse_json(F.lit(json)))) == epoch


def test_description(spark):
    def pick(*pairs):
        flat = [F.lit(x).cast("string") for p in pairs for x in p]
        return value(spark, S.pick_description(F.create_map(*flat) if flat else F.lit(None).cast("map<string,string>")))

    assert pick(("de", "d"), ("en", "e")) == "e" and pick(("de", None), ("fr", "f")) == "f" and pick(("de", None)) is None and pick() is None


def test_flatten_payload(spark):
    payloads = ['{"b": [1, "a", null, {"x": 1}, [true, [1.5, [2]]]], "a": "t", "c": {}, "d": null, "e": 1e3, "f": 1e30, "g": false, "h": []}', "[1, 2]", "oops", '"s"', None]
    df = spark.createDataFrame(list(enumerate(payloads)), "n int, p string")
    got = {(r.n, r.key): r.value_text for r in S.flatten_payload(df, "p").collect()}
    assert got == {
        (0, "a"): "t", (0, "b"): "[1, a, null, [Object], [true, [1.5, [2]]]]", (0, "c"): "[Object]", (0, "d"): "null", (0, "e"): "1000.0",
        (0, "f"): "1e30", (0, "g"): "false", (0, "h"): "[]", (1, None): "[1,2]", (2, None): "oops", (3, None): '"s"', (4, None): None,
    }


def shown(value):
    """The display rule, by recursion."""
    if isinstance(value, list):
        return "[" + ", ".join(map(shown, value)) + "]"
    if isinstance(value, dict):
        return "[Object]"
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def test_flatten_payload_of_any_shape(spark):
    rng = random.Random(6)
    texts = ["", "a", "{", "}}", '"', "\\", "[,]", "é\n\t", "\u0001x", "null", ": {}", "a, b"]

    def value(depth):
        kind = rng.randint(0, 6) if depth else rng.randint(0, 3)
        if kind < 4:
            return [rng.choice(texts), rng.randint(-5, 5), None, rng.random() < 0.5][kind]
        if kind == 4:
            return {rng.choice(texts): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return [value(depth - 1) for _ in range(rng.randint(0, 4))]

    values = [[value(6) for _ in range(3)] for _ in range(200)]
    df = spark.createDataFrame([(i, json.dumps({"k": v})) for i, v in enumerate(values)], "n int, p string")
    got = {r.n: r.value_text for r in S.flatten_payload(df, "p").collect()}
    assert got == {i: shown(v) for i, v in enumerate(values)}


def test_deep_payloads_beside_flat_ones(spark, tmp_path):
    def deep(n, inner):
        return '{"k": ' + "[" * n + inner + "]" * n + "}"

    objects = '{"k": [' + '{"o": ' * 500 + '["}"]' + "}" * 500 + ", 1]}"
    rows = [(0, deep(1, "1, 2")), (1, deep(80, '"]"')), (2, deep(999, "1.50")), (3, deep(1000, "1")), (4, objects), (5, '{"k": "flat"}')]
    rows += [(6, '{"k": [' + ",".join(['"a\\\\b"'] * 20_000) + "]}")]
    df = spark.createDataFrame(rows, "n int, p string")
    want = {0: "[1, 2]", 1: "[" * 80 + "]" + "]" * 80, 2: "[" * 999 + "1.5" + "]" * 999, 3: rows[3][1], 4: "[[Object], 1]", 5: "flat"}
    want[6] = "[" + ", ".join(["a\\b"] * 20_000) + "]"
    assert {r.n: r.value_text for r in S.flatten_payload(df, "p").collect()} == want
    df.write.parquet(f"{tmp_path}/in")
    stream = S.flatten_payload(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "p")
    query = stream.writeStream.format("memory").queryName("flattened").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert {r.n: r.value_text for r in spark.table("flattened").collect()} == want


def _hits(spark, *ids_and_seconds):
    base = spark.createDataFrame(list(ids_and_seconds), "id string, s long")
    return base.select("id", F.timestamp_seconds("s").alias("timestamp"), *[F.lit("x").cast(f.dataType).alias(f.name) if f.dataType.simpleString() == "string" else F.array(F.lit("i")).alias(f.name) for f in HITS.fields[2:]])


def test_recent_hits_cap_order_and_dedupe(spark):
    many = _hits(spark, *[(f"h{i:03d}", i // 2) for i in range(501)])
    newest = [r.id for r in recent_hits(many, many).collect()]
    assert len(newest) == 500 and newest[:3] == ["h500", "h498", "h499"] and "h001" not in newest
    twice = _hits(spark, ("a", 1), ("a", 5), ("b", 3))
    assert rows(dedupe_hits(twice), "id", F.unix_seconds("timestamp")) == [("a", 5), ("b", 3)]
    assert [r.id for r in recent_hits(twice, n=1).collect()] == ["a"]


def test_recent_hits_with_many_repeats(spark):
    """Repeats that fill the first rows taken are read past; of equal ids and times the greatest row stays."""
    hits = _hits(spark, *[("hot", i) for i in range(300)], *[("same", 400)] * 200, *[(f"r{i}", i) for i in range(5)])
    marked = hits.withColumn("source", F.when(F.col("id") == "same", F.monotonically_increasing_id().cast("string")).otherwise(F.col("source")))
    for n in (1, 2, 4, 50):
        got = [tuple(r) for r in recent_hits(marked, marked, n=n).collect()]
        assert got == [tuple(r) for r in dedupe_hits(marked).orderBy(F.desc("timestamp"), "id").limit(n).collect()]
    assert recent_hits(marked.limit(0), n=5).count() == 0


def test_alert_text(spark):
    row = alerts(_hits(spark, ("a", 1))).first()
    assert row.title == "Intelligence Hit: x" and row.body == "Matched: x\nSource: x"


def test_feed_set_counts_and_statistics(spark):
    a, b = feed(spark, ["10.0.0.0/8", "x.com", "*.y.com"], "a"), feed(spark, ["x.com"], "b")
    both = add_feeds(a, b)
    assert rows(feed_counts(both), "feed_id", "ip", "literal", "glob", "total") == [("a", 1, 1, 1, 3), ("b", 0, 1, 0, 1)]
    assert rows(remove_feeds(both, spark.createDataFrame([("a",)], "feed_id string")), "feed_id") == [("b",)]
    assert rows(probe_counts(both), "anchor", "count") == [("L", 1)]

    queries = spark.createDataFrame([("x.com",), ("x.com",), ("10.1.1.1",), ("none",), ("",)], "query string")
    stats = feed_stats(queries, lookup(queries, both), both)
    assert rows(stats, "feed_id", "total_queries", "queries_with_match", "match_rate", "match_percent") == [("a", 4, 3, 0.75, "75%"), ("b", 4, 2, 0.5, "50%")]
    nothing = queries.where("false")
    assert rows(feed_stats(nothing, lookup(nothing, both), both), "feed_id", "total_queries", "match_rate") == [("a", 0, 0.0), ("b", 0, 0.0)]

    feeds = spark.createDataFrame([("a", "/a", 2048, "CaseSensitive", {"de": "D"}, 0, False, None), ("c", "/c", 1, "CaseSensitive", None, None, True, None)], FEEDS)
    got = rows(feed_summary(feeds, both, stats), "feed_id", "size_human", "description", "built", "total", "queries_with_match")
    assert got == [("a", "2.00 KB", "D", "1970-01-01 00:00 UTC", 3, 3), ("c", "1 bytes", None, None, 0, None)]
    assert totals(feeds, feeds.limit(1)).first() == (2, 1)
