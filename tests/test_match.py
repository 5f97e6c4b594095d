"""Lookups against brute force, on the broadcast and on the shuffle path."""

import fnmatch
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sigtrace.functions.patterns import CASE_INSENSITIVE
from sigtrace.operators.indicators import profile_indicators
from sigtrace.operators.sizing import Limits, salted_join
from sigtrace.operators.staging import stage
from sigtrace.plans.hits import lookup, scan

from .helpers import feed, lines, rows, tlds
from .test_globs import random_globs, random_texts

SHUFFLE = Limits(broadcast_rows=0)
PATHS = pytest.mark.parametrize("limits", [Limits(), SHUFFLE], ids=["broadcast", "shuffle"])


def ask(spark, texts, indicators, **kw):
    queries = spark.createDataFrame([(t,) for t in texts], "query string")
    return lookup(queries, indicators, **kw)


@PATHS
def test_longest_prefix_agrees_with_ipaddress(spark, limits):
    rng = random.Random(3)
    nets = set()
    while len(nets) < 120:
        six = rng.random() < 0.4
        width = 128 if six else 32
        length = rng.choice([0, 1, 4, 8, 12, 16, 24, width])
        base = rng.getrandbits(width) & ~((1 << (width - 5)) - 1) | rng.getrandbits(4)
        cls = ipaddress.IPv6Network if six else ipaddress.IPv4Network
        nets.add(cls((base, length), strict=False))
    addresses = [rng.choice(sorted(nets, key=str)).network_address + rng.getrandbits(3) for _ in range(60)]
    texts = sorted({str(a) for a in addresses})
    got = dict(rows(ask(spark, texts, feed(spark, [str(n) for n in nets]), limits=limits), "matched_text", F.col("matched_indicators")[0]))
    want = {}
    for t in texts:
        fits = [n for n in nets if ipaddress.ip_address(t) in n]
        if fits:
            want[t] = f"{t}/{max(n.prefixlen for n in fits)}"
    assert got == want


@PATHS
def test_globs_agree_with_fnmatch(spark, limits):
    rng = random.Random(11)
    globs = sorted({g for g in random_globs(rng, 250) + ["*.a.b", "*.a", "ab*", "*bc", "*abc*", "*", "??", "[ab]*"] if any(c in g for c in "*?[")})
    texts = sorted({t for t in random_texts(rng, 120) + ["a.a.b", "xabcx", ".a", "a.a"] if t})
    got = {(r.matched_text, g) for r in ask(spark, texts, feed(spark, globs), limits=limits).collect() for g in r.matched_indicators}
    assert got == {(t, g) for t in texts for g in globs if fnmatch.fnmatchcase(t, g)}


@PATHS
def test_case_modes(spark, limits):
    entries = ["Evil.com", "*.BAD.org", "M.*", "D41D8CD98F00B204E9800998ECF8427E"]
    both = feed(spark, entries, "cs").unionByName(feed(spark, entries, "ci", CASE_INSENSITIVE))
    texts = ["evil.COM", "Evil.com", "x.bad.org", "x.BAD.org", "m.x", "d41d8cd98f00b204e9800998ecf8427E"]
    got = set(rows(ask(spark, texts, both, limits=limits), "matched_text", "database_id"))
    assert got == {(t, "ci") for t in texts} | {("Evil.com", "cs"), ("x.BAD.org", "cs"), (texts[-1], "cs")}


def test_addresses_meet_only_networks_and_text_only_patterns(spark):
    indicators = feed(spark, ["10.0.0.0/8", "*", "10.0.0.0/33", "1?.0.0.1"])
    got = dict(rows(ask(spark, ["10.0.0.1", "10.0.0.0/33", ""], indicators), "matched_text", F.array_join("matched_indicators", "|")))
    assert got["10.0.0.1"] == "10.0.0.1/8"
    assert set(got["10.0.0.0/33"].split("|")) == {"*", "10.0.0.0/33"} and "" not in got


def test_payload_rules(spark):
    indicators = feed(spark, [("10.0.0.0/8", None), ("a.com", '{"x":1}'), ("*.com", None)])
    got = dict(rows(ask(spark, ["10.1.1.1", "a.com", "b.com"], indicators), "matched_text", "data"))
    assert got == {"10.1.1.1": ["null"], "a.com": ['{"x":1}'], "b.com": []}


def test_duplicate_rows_are_kept(spark):
    hit = ask(spark, ["a.com"], feed(spark, [("a.com", "1"), ("a.com", "2")]), resolve_patterns=False).first()
    assert hit.matched_indicators == ["pattern_0", "pattern_1"] and sorted(hit.data) == ["1", "2"]


def test_empty_feed_gives_no_hits(spark):
    assert ask(spark, ["a.com"], feed(spark, ["x.com"]).where("false")).count() == 0


@PATHS
def test_scan_paths_agree_and_survive_a_hot_item(spark, limits):
    hot = ["GET evil.com from 10.0.0.1"] * 300
    log = lines(spark, *hot, *[f"u{i}@mail.org 10.0.{i}.7 h{i}.net" for i in range(100)])
    indicators = feed(spark, ["evil.com", "10.0.0.0/8", "10.0.3.0/24", "*@mail.org", "h*"], "f")
    got = scan(log, indicators, tlds(spark), include_line=True, keep=["line_number"], limits=limits)
    kinds = dict(rows(got.groupBy("match_type").count(), "match_type", "count"))
    assert kinds == {"Domain": 300 + 100, "IPv4": 400, "Email": 100}
    assert got.where("log_line is null").count() == 0 and got.select("id").distinct().count() == got.count()


def test_salted_join_equals_a_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = spark.range(60).select(F.when(F.col("id") < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("r"))
    want = rows(left.join(right, "k"), "k", "id", "r")
    assert rows(salted_join(left, right, "k", ["id"], Limits(hot_fraction=20)), "k", "id", "r") == want


def test_profile_is_bounded(spark):
    globs = ["*.x." + "y" * i for i in range(1, 40)] + ["p" * i + "*" for i in range(1, 60)]
    profile = profile_indicators(feed(spark, globs + [f"10.0.0.0/{i}" for i in range(33)]))
    assert profile.rows == len(globs) + 33 and len(profile.tags) < 80


def test_plans_hold_no_cross_product(spark):
    log = lines(spark, "evil.com 10.0.0.1")
    indicators = feed(spark, ["evil.com", "10.0.0.0/8", "*z?a*", "*.x.com"])
    for limits in (Limits(), SHUFFLE):
        plan = scan(log, indicators, tlds(spark), limits=limits)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = scan(log, indicators, tlds(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [probe" in plan and "SortMergeJoin" not in plan
    before_grouping = plan[plan.index("BroadcastHashJoin [probe"):]
    assert "hashpartitioning(source" not in before_grouping and "hashpartitioning(lookup_key" not in before_grouping


def test_brand_globs_do_not_meet_every_name_of_a_domain(spark):
    """Joined pairs for a candidate stay few when thousands of globs share ``.com`` and ``www.``."""
    import random

    from pyspark.sql import functions as F

    from sigtrace.operators.indicators import profile_indicators
    from sigtrace.operators.match import _probed

    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    globs = [f"*{name()}*.com" for _ in range(1000)] + [f"www.*{name()}*" for _ in range(1000)] + [f"*-{name()}-*.net" for _ in range(500)]
    indicators = feed(spark, globs)
    names = spark.createDataFrame([(f"www.{name()}.com",) for _ in range(300)], "lookup_key string").select(
        "lookup_key", F.lit(None).cast("int").alias("family"), F.lit(None).cast("string").alias("ip_bits")
    )
    pairs = _probed(names, profile_indicators(indicators)).join(indicators, "probe").count()
    assert pairs < 10 * 300


def test_only_literals_go_through_the_shuffle(spark):
    """A feed that is too large by its literals: networks and globs stay broadcast, results are the same."""
    entries = [f"n{i}.com" for i in range(200)] + ["10.0.0.0/8", "*.evil.com", "a*", "N7.COM"]
    indicators = feed(spark, entries, mode=CASE_INSENSITIVE)
    text = " ".join([f"n{i}.com" for i in range(0, 300, 3)] + ["10.1.2.3", "x.evil.com", "a.org", "n7.com", "n7.com"])
    df = lines(spark, text)
    columns = ("id", "matched_text", "match_type", "matched_indicators", "data")
    limits = Limits(broadcast_rows=10)
    got = scan(df, indicators, tlds(spark), limits=limits)
    assert rows(got, *columns) == rows(scan(df, indicators, tlds(spark)), *columns)
    assert rows(scan(df, indicators, tlds(spark), limits=SHUFFLE), *columns) == rows(got, *columns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan  # networks and globs


def test_a_feed_without_literals_or_without_others(spark):
    for entries in (["10.0.0.0/8", "*.evil.com"] * 1, [f"n{i}.com" for i in range(30)]):
        df = lines(spark, "10.1.1.1 x.evil.com n3.com n3.com")
        indicators = feed(spark, entries)
        want = rows(scan(df, indicators, tlds(spark)), "id", "matched_text")
        for n in (0, 1, 2, 20):
            assert rows(scan(df, indicators, tlds(spark), limits=Limits(broadcast_rows=n)), "id", "matched_text") == want


def test_candidates_without_a_match_are_not_shuffled(spark, monkeypatch):
    """Of 20,000 texts that no literal equals only the filter's few errors go on, beside all that one does."""
    from sigtrace.operators import match as M

    went_on = []
    monkeypatch.setattr(M, "stage", lambda df: went_on.append(stage(df)) or went_on[-1])
    entries = [f"n{i}.com" for i in range(5000)] + ["10.0.0.0/8"]
    known, others = [f"n{i}.com" for i in range(0, 5000, 50)], [f"o{i}.com" for i in range(20_000)]
    indicators = feed(spark, entries)
    df = lines(spark, *[" ".join(others[i : i + 100]) for i in range(0, 20_000, 100)], " ".join(known * 2))
    columns = ("id", "matched_text", "matched_indicators")
    got = rows(scan(df, indicators, tlds(spark), limits=Limits(broadcast_rows=10)), *columns)
    assert got == rows(scan(df, indicators, tlds(spark)), *columns) and len(got) == 200
    texts, passed = went_on
    assert texts.count() == 20_200 and 200 <= passed.count() < 200 + 0.05 * 20_000


def test_key_filter_keeps_every_key_at_any_size(spark, monkeypatch):
    from sigtrace.operators import membership

    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key"))
    for most in (membership.MOST_WORDS, 64):  # the second is far too small and lets nearly all pass
        monkeypatch.setattr(membership, "LEAST_WORDS", 16)
        monkeypatch.setattr(membership, "MOST_WORDS", most)
        known, words = membership.key_filter(keys, "key")
        assert words <= most and known.count() <= words
        assert membership.may_be_known(keys, "key", known, words).count() == 20_000
        passed = membership.may_be_known(others, "key", known, words)
        assert passed.columns == ["key"] and (most == 64 or passed.count() < 1000)
        assert "Exchange hashpartitioning(key" not in passed._jdf.queryExecution().executedPlan().toString()
    none, words = membership.key_filter(keys.limit(0), "key")
    assert membership.may_be_known(others, "key", none, words).count() == 0
