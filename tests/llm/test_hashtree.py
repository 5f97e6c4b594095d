import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sigtrace.llm import hashtree

from .helpers import documents, odd_columns


def test_every_row_has_a_shard_and_a_gapless_slot(spark, monkeypatch):
    monkeypatch.setattr(hashtree, "BUCKET_ROWS", 50)
    rows = [(i, f"text {i}") for i in range(3000)] + [(7, "again")] * 40 + [(None, None), (None, ""), (8, "é" * 10)]
    got = hashtree.shard(odd_columns(documents(spark, rows))).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, (len(t.encode()) if t is not None else 0) + 1, zlib.crc32(t.encode()) if t is not None else None) for i, t in rows
    )
    for n in range(16):
        slots = sorted(r.slot for r in got if r.shard == n)
        assert slots == list(range(len(slots))) and 120 < len(slots) < 320
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in got)
    assert 100 < sum(r.grown_shard == 16 for r in got) < 260
    places = {}
    assert all(places.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) for r in got)


def test_placement_equals_draws_by_hand(spark):
    tree = hashtree.topology(16, {3: 2.5, 9: 0.5, 12: 0.0})
    ids = [str(i) for i in range(300)]
    names = sorted(n.name for n in walk(tree) if n.name != "root")
    frame = spark.createDataFrame([(i,) for i in ids], "k string")
    hashed = {r["k"]: r for r in frame.select("k", *(F.xxhash64("k", F.lit(n)).alias(n.replace("/", "_")) for n in names)).collect()}

    def place(key, node):
        if node.shard is not None:
            return node.shard

        def draw(child):
            h = hashed[key][child.name.replace("/", "_")] % (1 << 64)
            return math.log(((h >> 11) + 0.5) / (1 << 53)) / child.weight

        return place(key, max((c for c in node.children if c.weight), key=draw))

    got = {r["k"]: r["s"] for r in frame.select("k", hashtree.place(F.col("k"), tree).alias("s")).collect()}
    assert got == {k: place(k, tree) for k in ids} and 12 not in got.values()


def walk(node):
    yield node
    for child in node.children:
        yield from walk(child)


def test_a_changed_weight_moves_rows_only_to_or_from_its_branch(spark):
    frame = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    before, after = hashtree.topology(16), hashtree.topology(16, {5: 3.0})
    moved = frame.select(hashtree.place(F.col("k"), before).alias("a"), hashtree.place(F.col("k"), after).alias("b")).where("a <> b").collect()
    assert moved and all(r.b in range(8) for r in moved)  # region of shard 5
    assert all(r.b == 5 for r in moved if r.a // 4 == 1) and not any(r.a // 4 == 0 and r.b // 4 == 0 for r in moved)


def test_empty_table(spark):
    assert hashtree.shard(documents(spark, [])).count() == 0


def test_a_row_with_many_copies_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(hashtree, "PIECE", 7)
    rows = [(5, "same")] * 500 + [(i, f"t{i}") for i in range(40)]
    got = hashtree.shard(documents(spark, rows)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 540 and sum(r.doc_id == 5 for r in got) == 501
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
