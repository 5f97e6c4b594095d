import io
import json

import pytest
from pyspark.sql import functions as F

from sigtrace.functions.patterns import CASE_INSENSITIVE
from sigtrace.operators.lines import last_lines, split_lines, tail_lines
from sigtrace.sources.artifacts import file_inventory, read_manifest, updates_available, verify_artifacts
from sigtrace.sources.catalog import read_catalog, split_existing, write_catalog
from sigtrace.sources.feeds import load_feed, read_tlds
from sigtrace.sources.hits import read_hits
from sigtrace.sources.logs import read_log_lines, tail_files, tail_of

from .helpers import rows

FEED = """entry,threat,note
1.2.3.4,scanner,
10.0.0.0/8,internal,x
evil.com,malware,"a, b"
*.evil.com,malware,
2001:db8::1,c2,y
2001:db8::/32,c2,
login?.bad.org,phish,z
[ab]*.net,phish,
10.0.0.0/33,odd,w
EVIL.org,,
"""


@pytest.fixture()
def feed_file(tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text(FEED)
    return str(path)


def test_load_feed_classifies_and_numbers(spark, feed_file):
    got = rows(load_feed(spark, feed_file, "f", CASE_INSENSITIVE), "entry", "kind", "pattern_id", "match_key", "probe_tag")
    assert got == sorted(
        [
            ("1.2.3.4", "ip", 0, "1.2.3.4", "N4/32"),
            ("10.0.0.0/8", "ip", 1, "10.0.0.0/8", "N4/8"),
            ("2001:db8::1", "ip", 2, "2001:db8::1", "N6/128"),
            ("2001:db8::/32", "ip", 3, "2001:db8::/32", "N6/32"),
            ("evil.com", "literal", 0, "evil.com", "Ei"),
            ("*.evil.com", "glob", 1, "*.evil.com", "Li2"),
            ("login?.bad.org", "glob", 2, "login?.bad.org", "Pi5"),
            ("[ab]*.net", "glob", 3, "[ab]*.net", "Si4"),
            ("10.0.0.0/33", "literal", 4, "10.0.0.0/33", "Ei"),
            ("EVIL.org", "literal", 5, "evil.org", "Ei"),
        ]
    )


def test_load_feed_packs_metadata(spark, feed_file):
    data = dict(rows(load_feed(spark, feed_file), "entry", "data"))
    assert json.loads(data["evil.com"]) == {"threat": "malware", "note": "a, b"}
    assert json.loads(data["1.2.3.4"]) == {"threat": "scanner"} and data["EVIL.org"] is None
    assert load_feed(spark, feed_file).select("feed_id").first()[0] == load_feed(spark, feed_file).select("feed_id").first()[0]
    with pytest.raises(ValueError):
        load_feed(spark, feed_file, mode="Loud")


def test_many_files_number_in_path_order(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part{i}.csv").write_text("entry\n" + "".join(f"x{i}-{j}\n" for j in range(4)))
    got = rows(load_feed(spark, str(tmp_path), "f"), "pattern_id", "entry")
    assert got == [(4 * i + j, f"x{i}-{j}") for i in range(5) for j in range(4)]


def test_tlds(spark, tmp_path):
    (tmp_path / "t").write_text("# list\nCOM\n\nxn--p1ai\n")
    assert rows(read_tlds(spark, str(tmp_path / "t")), "tld") == [("com",), ("xn--p1ai",)]


def test_log_lines_numbers_over_splits(spark, tmp_path):
    (tmp_path / "big.log").write_bytes(b"".join(b"line %d\n" % i if i % 7 else b"\n" for i in range(1, 200_001)))
    (tmp_path / "small.log").write_bytes(b"a\r\n\n\xff\xfe\nlast")
    (tmp_path / "other.txt").write_bytes(b"no\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = read_log_lines(spark, str(tmp_path), "m", pattern="*.log")
        assert lines.rdd.getNumPartitions() > 8
        big = lines.where("source = 'big.log'")
        wrong = big.where(F.col("line") != F.concat(F.lit("line "), F.col("line_number").cast("string")))
        assert big.count() == 200_000 - 200_000 // 7 and wrong.count() == 0
        small = lines.where("source = 'small.log'").orderBy("line_number").collect()
        assert [r.line_number for r in small] == [1, 3, 4] and small[0].line == "a\r" and small[2].line == "last"
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_log_lines_recursive_and_labels(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "dns.log.log").write_text("x\n")
    (tmp_path / "conn.log").write_text("y\n")
    lines = read_log_lines(spark, str(tmp_path), "m", recursive=True, capture=True, numbered=False)
    assert rows(lines, "source", "line") == [("Zeek:conn", "y"), ("Zeek:dns", "x")]
    assert lines.select("line_number").distinct().count() == 2


def test_split_and_tail(spark):
    texts = spark.createDataFrame([("p", "a\r\n\nb\nc"), ("q", ""), ("r", "x\n")], "path string, t string")
    lines = split_lines(texts, "t")
    assert rows(lines, "path", "line_number", "line") == [("p", 1, "a\r"), ("p", 3, "b"), ("p", 4, "c"), ("r", 1, "x")]
    whole = split_lines(texts, "t", keep_empty=True)
    assert rows(tail_lines(whole, 2), "path", "tail") == [("p", "b\nc"), ("r", "x")]
    assert rows(tail_lines(whole, 3), "path", "tail") == [("p", "\nb\nc"), ("r", "x")]
    for n in (3, 5000):  # neither a sort of whole files nor another plan for many lines
        assert "Window" not in tail_lines(whole, n)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text,expected",
    [
        ('[{"path": "/a", "is_auto_updated": true, "sha256": "h"}, {"path": "/b", "is_auto_updated": false}]', [("/a", True, "h"), ("/b", False, None)]),
        ('["/a", "/b"]', [("/a", False, None), ("/b", False, None)]),
        ('["/a", {"path": "/b", "is_auto_updated": false}]', []),
        ('[{"path": "/a"}]', []),
        ("{", []),
        ("[]", []),
    ],
)
def test_catalog_layouts(spark, tmp_path, text, expected):
    (tmp_path / "c.json").write_text(text)
    assert rows(read_catalog(spark, str(tmp_path / "c.json")), "path", "is_auto_updated", "sha256") == expected


def test_catalog_round_trip_and_missing(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert read_catalog(spark, path).count() == 0
    feeds = spark.createDataFrame([("/a", True, "h"), ("/b", False, None)], "path string, is_auto_updated boolean, sha256 string")
    write_catalog(feeds, path)
    assert rows(read_catalog(spark, path), *feeds.columns) == rows(feeds, *feeds.columns)
    kept, gone = split_existing(feeds, spark.createDataFrame([("/b",)], "path string"))
    assert rows(kept, "path") == [("/b",)] and rows(gone, "path") == [("/a",)]


def _manifest(tmp_path, entries):
    body = {"channel": "stable", "generated_at": "2025-01-01", "databases": [
        {"name": n, "version": "v1", "format_version": 1, "full": {"url": f"https://h/{f}", "sha256": h, "size": s, "signature": "-"}}
        for n, f, h, s in entries]}
    (tmp_path / "manifest.json").write_text(json.dumps(body, indent=1))
    return str(tmp_path / "manifest.json")


def test_verify_reports_the_first_failure(spark, tmp_path):
    import hashlib

    landing = tmp_path / "landing"
    landing.mkdir()
    magic = bytes.fromhex("28b52ffd")
    files = {"good": magic + b"x", "html": b"<!DOCTYPE html>", "hash": magic + b"y", "tiny": b"abc", "magic": b"12345", "size": magic}
    for name, content in files.items():
        (landing / name).write_bytes(content)
    digest = {n: hashlib.sha256(c).hexdigest() for n, c in files.items()}
    entries = [(n, n, "0" * 64 if n == "hash" else digest[n], len(c) + (n == "size")) for n, c in files.items()] + [("gone", "gone", "", 1)]
    got = {r.name: (r.status, r.error) for r in verify_artifacts(file_inventory(spark, str(landing)), read_manifest(spark, _manifest(tmp_path, entries))).collect()}
    assert got["good"] == ("ok", None) and got["gone"] == ("missing", None)
    assert {n: s for n, (s, _) in got.items() if n not in ("good", "gone")} == dict.fromkeys(["html", "hash", "tiny", "magic", "size"], "rejected")
    assert "HTML" in got["html"][1] and "SHA-256" in got["hash"][1] and "3 bytes" in got["tiny"][1]
    assert "31323334" in got["magic"][1] and "size" in got["size"][1]


@pytest.mark.parametrize("installed,available", [([("f", True, "h")], False), ([("f", True, "old")], True), ([("f", True, None)], True), ([("f", False, "h")], True), ([], True)])
def test_updates(spark, tmp_path, installed, available):
    manifest = read_manifest(spark, _manifest(tmp_path, [("threat-intel", "t", "h", 1), ("other", "o", "h", 1)]))
    feeds = spark.createDataFrame(installed, "feed_id string, is_auto_updated boolean, sha256 string")
    got = updates_available(manifest, feeds).collect()
    assert [(r.available, r.latest_version) for r in got] == [(available, "v1")]
    assert updates_available(manifest, feeds, "absent").count() == 0


def test_missing_hit_store_is_empty(spark, tmp_path):
    assert read_hits(spark, str(tmp_path / "none")).count() == 0


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def by_hand(data, n):
    *ended, rest = data.split(b"\n")
    lines = [line.removesuffix(b"\r") for line in ended] + ([rest] if rest else [])
    return b"\n".join(lines[-n:]).decode()


TAILS = [b"", b"\n", b"a", b"a\n", b"a\r\nb\r\n", b"a\r\nb\r", b"\n\n\n", b"a\n\nb\n\n", b"\r\n", b"x" * 300 + b"\n" + "é".encode() * 200]


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_last_lines_of_texts_and_files(spark, tmp_path, n):
    for data in TAILS:
        assert tail_of(io.BytesIO(data), len(data), n, block=7) == by_hand(data, n), data
    texts = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(TAILS)] + [(99, None)], "i int, t string")
    got = dict(rows(texts.select("i", last_lines(F.col("t"), n).alias("tail")).where("tail is not null"), "i", "tail"))
    assert got == {i: by_hand(t, n) for i, t in enumerate(TAILS) if t}
    for i, data in enumerate(TAILS):
        (tmp_path / f"{i}.log").write_bytes(data)
    files = {int(r.path.rsplit("/", 1)[1].split(".")[0]): r.tail for r in tail_files(spark, str(tmp_path), n, pattern="*.log").collect()}
    assert files == got


def test_bytes_read_do_not_depend_on_the_length_of_a_file():
    taken = []
    for lines in (10_000, 400_000):
        stream = Counted(b"".join(b"line %06d\n" % i for i in range(lines)))
        assert tail_of(stream, len(stream.getvalue()), 5).endswith(f"line {lines - 1:06}")
        taken.append(stream.taken)
    assert taken[0] == taken[1] == 1 << 16


def test_crlf_in_numbered_lines(spark):
    texts = spark.createDataFrame([("p", "a\r\nb\r\n")], "path string, t string")
    assert rows(tail_lines(split_lines(texts, "t", keep_empty=True), 2), "tail") == [("a\nb",)]


def test_numbering_is_the_same_plan_for_millions_of_splits(spark, tmp_path, monkeypatch):
    """Either side of a broadcast's size the text stays where it is, and the numbers are right."""
    from sigtrace.operators import numbering, sizing

    for name in "abc":
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for splits, rows_a_chunk in ((900_000, 1_000_000), (1_500_000, 1_000_000), (8, 3)):
            monkeypatch.setattr(numbering, "split_bound", lambda df, n=splits: n)
            monkeypatch.setattr(sizing, "CHUNK_ROWS", rows_a_chunk)
            lines = read_log_lines(spark, str(tmp_path), "m")
            assert rows(lines, "line", "line_number") == sorted((f"{n}{i}", i) for n in "abc" for i in range(1, 3001))
            plan = lines._jdf.queryExecution().executedPlan().toString()
            moved = [row for row in plan.splitlines() if "Exchange" in row and "Broadcast" not in row and "value" in row]
            assert "SortMergeJoin" not in plan and not moved
            assert plan.count("BroadcastHashJoin") == -(-splits // rows_a_chunk)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_table_goes_out_in_chunks(spark, monkeypatch):
    from sigtrace.operators import sizing

    left = spark.range(1000).select((F.col("id") % 90).alias("k"), "id")
    table = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows(left.join(table, "k", "left"), "k", "id", "v")
    for n in (1000, 7):
        monkeypatch.setattr(sizing, "CHUNK_ROWS", n)
        got = sizing.joined_in_chunks(left, table, ["k"], ["v"])
        assert got.columns == ["k", "id", "v"] and rows(got.fillna(-1), "k", "id", "v") == rows(left.join(table, "k", "left").fillna(-1), "k", "id", "v")
        assert "hashpartitioning(k" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(want) == 1000
