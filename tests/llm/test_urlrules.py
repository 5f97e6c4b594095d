import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sigtrace.llm import urlrules as U

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1", "http://example.com/en/1?x=1", "http://example.com/en", "http://example.com",
    "http://a.b.net/es/9#f", "http://net/fr/", "http://xnet/fr/", "http://evil.org/x://y.net/fr/", "http://É.com/é\nz?q", "https://a.org/fr/12",
    "http://user@host.net:80/es/1", "http://www.example.com/en/", "http://sub.www.example.com/en/x", "://com/", "http://com?/a", "HTTP://X.ORG",
]


def pages(spark, urls):
    rows = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    return rows.select("*", *(F.lit(1).alias(n) for n in ("URL", "host", "tokens", "verdict", "rule")))


def test_host_path_and_fixed_rules(spark):
    urls = URLS * 3
    got = U.classify(pages(spark, urls)).collect()
    assert len(got) == len(urls)
    for row in got:
        host, path, rule = brute(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule), urls[row.page_id]
        assert row.verdict == (RULES[rule] if rule else row.verdict) and row.verdict in ("allow", "block")


@pytest.fixture(scope="module")
def mined(spark):
    """Casino pages under .com/en are blocked; .org and .info pages are open."""
    urls = [f"http://casino{i % 2}.example.com/en/{i}" for i in range(40)] + [f"http://www.news.example.com/de/{i}" for i in range(40)]
    labelled = U.with_parts(pages(spark, urls)).withColumn("fixed", U.fixed()).withColumn("tokens", U.tokens())
    return U.mine(labelled.select("url", "tokens", "fixed.verdict"))


def test_mined_rules_judge_open_urls(spark, mined):
    rules = mined.collect()
    assert all(r.confidence >= U.MIN_CONFIDENCE and r.support >= U.MIN_SUPPORT for r in rules)
    for r in rules:  # nothing stays that a shorter rule says as surely
        assert not any(set(s.tokens) < set(r.tokens) and s.verdict == r.verdict and s.confidence >= r.confidence for s in rules)
    urls = ["http://casino1.example.org/en/5", "http://www.news.example.org/de/1", "http://other.info/xx/"]
    sets = U.with_parts(pages(spark, urls)).withColumn("tokens", U.tokens()).select("tokens").distinct()
    got = {tuple(r.tokens): r.verdict for r in U.judge(sets, mined).collect()}

    def by_hand(tokens):
        fired = [(r.confidence, r.support, r.verdict) for r in rules if set(r.tokens) <= set(tokens)]
        return max(fired)[2] if fired else None

    for row in sets.collect():
        assert got.get(tuple(row.tokens)) == by_hand(row.tokens)
    assert sorted(got.values()) == ["allow", "block"]


def test_empty_table(spark):
    assert U.classify(pages(spark, []).limit(0)).count() == 0


def brute_rules(urls, least, confidence):
    """All rules over sets of tokens of (tokens, verdict), without those a smaller set says as surely."""
    out = {}
    every = sorted({t for tokens, _ in urls for t in tokens})
    for size in range(1, len(every) + 1):
        for part in combinations(every, size):
            inside = [v for tokens, v in urls if set(part) <= set(tokens)]
            for verdict in ("allow", "block"):
                n = inside.count(verdict)
                if n >= least and n / len(inside) >= confidence:
                    out[part, verdict] = n / len(inside)
    return out


def test_mined_rules_equal_brute_force(spark, monkeypatch):
    """What fires, how surely and with what verdict is that of all rules over all sets of tokens."""
    monkeypatch.setattr(U, "MIN_SUPPORT", 0.1)
    rng = random.Random(4)
    rows = [(f"u{i}", sorted(rng.sample("abcdef", rng.randint(0, 4)) + (["x", "y"] if i % 3 == 0 else [])), rng.choice(["allow", "block", "block"])) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:1] * 30, "url string, tokens array<string>, verdict string")
    got = U.mine(df).collect()
    want = brute_rules([r[1:] for r in rows], 4, U.MIN_CONFIDENCE)
    for tokens in {tuple(r[1]) for r in rows} | {("a", "b"), ("x", "y"), tuple("abcdefxy")}:
        fired = {v: max([c for (part, w), c in want.items() if w == v and set(part) <= set(tokens)], default=0) for v in ("allow", "block")}
        mine = {v: max([r.confidence for r in got if r.verdict == v and set(r.tokens) <= set(tokens)], default=0) for v in ("allow", "block")}
        assert mine == pytest.approx(fired), tokens
    assert any({"x", "y"} <= set(r.tokens) for r in got) or not any({"x", "y"} & set(p) for p, _ in want)


def test_a_url_of_thousands_of_segments(spark):
    long = "http://www.example.com/en/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000))
    urls = [long, "http://x.org/" + long[26:]] + [f"http://www.example.com/en/{i}" for i in range(8)]
    start = time.monotonic()
    got = {r.page_id: r.verdict for r in U.classify(pages(spark, urls)).collect()}
    assert time.monotonic() - start < 60 and set(got.values()) == {"allow"}


def test_nested_paths_of_many_lengths(spark):
    """Twenty-five tokens in a chain: each stands in all URLs of the next."""
    urls = ["http://example.com/en/" + "/".join("abcdefghijklmnopqrstuvwxy"[:n]) for n in range(1, 26)] * 2
    start = time.monotonic()
    assert {r.verdict for r in U.classify(pages(spark, urls + ["http://q.info/a/b/c"])).collect()} == {"block"}
    assert time.monotonic() - start < 120


def test_copies_weigh_as_one(spark, monkeypatch):
    """A URL with most of the rows neither fills the sample nor decides its rules."""
    monkeypatch.setattr(U, "SAMPLE", 60)
    hot = [("hot", ["t"], "allow")] * 900
    rest = [(f"u{i}", ["t", f"v{i % 2}"], "block") for i in range(100)]
    df = spark.createDataFrame(hot + rest, "url string, tokens array<string>, verdict string")
    assert 35 < U.drawn(df).count() < 85
    assert {r.verdict for r in U.mine(df).collect()} == {"block"}


def strongest(rules, tokens):
    """Confidence of the surest rule of each verdict for a set of tokens; ``rules`` are triples of tokens, verdict, confidence."""
    return {v: max([c for part, w, c in rules if w == v and set(part) <= set(tokens)], default=0) for v in ("allow", "block")}


def test_classes_beyond_the_basket_are_mined(spark, monkeypatch):
    """Four classes are more frequent in every URL than r and s, of which only both together tell the verdict."""
    monkeypatch.setattr(U, "BASKET", 4)
    monkeypatch.setattr(U, "MIN_SUPPORT", 0.05)
    rows = []
    for i in range(120):
        without = {i % 6, (i + 1 + i // 6 % 5) % 6}
        extra = [["r", "s"], ["r"], ["s"], []][i // 6 % 4]
        verdict = "block" if len(extra) == 2 or (not extra and i % 2) else "allow"
        rows.append((f"u{i}", [f"f{c}" for c in range(6) if c not in without] + extra, verdict))
    df = spark.createDataFrame(rows, "url string, tokens array<string>, verdict string")
    rules = [(r.tokens, r.verdict, r.confidence) for r in U.mine(df).collect()]
    assert (["r", "s"], "block", 1.0) in rules


@pytest.mark.parametrize("basket", [1, 2, 4])
def test_rules_of_long_urls_equal_brute_force(spark, monkeypatch, basket):
    """However few classes FP-growth gets, the rules are the same: all that no smaller set says as surely."""
    monkeypatch.setattr(U, "MIN_SUPPORT", 0.06)
    monkeypatch.setattr(U, "BASKET", basket)
    rng = random.Random(11)
    rows = []
    for i in range(50):
        tokens = rng.sample("abcdefgh", rng.randint(3, 8)) + (["x", "y"] if i % 5 == 0 else [])
        verdict = "block" if len(set(tokens) & set("adfh")) % 2 or i % 17 == 0 else "allow"
        rows.append((f"u{i}", sorted(tokens), verdict))
    df = spark.createDataFrame(rows + rows[:1] * 30, "url string, tokens array<string>, verdict string")
    every = [(part, v, c) for (part, v), c in brute_rules([r[1:] for r in rows], 3, U.MIN_CONFIDENCE).items()]
    got = [(r.tokens, r.verdict, r.confidence) for r in U.mine(df).collect()]
    assert len({(tuple(p), v) for p, v, _ in got}) == len(got) and max(len(p) for p, _, _ in got) > basket
    for size in range(1, 10):
        for tokens in combinations("abcdefghx", size):
            tokens += ("y",) * ("x" in tokens)  # x and y are one class
            assert strongest(got, tokens) == pytest.approx(strongest(every, tokens)), tokens
    surest = {(p, v): c for p, v, c in every}
    for part, verdict, confidence in got:  # only what no smaller set says as surely
        smaller = [s for n in range(1, len(part)) for s in combinations(part, n)]
        assert not any(surest.get((s, verdict), 0) >= confidence for s in smaller if not {"x", "y"} & set(part))


def test_long_urls_of_both_verdicts_end(spark):
    """Two URLs of other verdicts share sixty segments each with others, all in sets of URLs of their own."""
    names = [f"s{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(60)]
    urls = ["http://example.com/en/" + "/".join(names), "http://www.example.com/en/" + "/".join(names)]
    urls += [f"http://{'www.' * (i % 2)}example.com/en/{name}" for i, name in enumerate(names)]
    urls += ["http://q.info/" + "/".join(names[:2]), "http://q.info/sxx"]
    start = time.monotonic()
    got = {r.page_id: r.verdict for r in U.classify(pages(spark, urls)).collect()}
    assert time.monotonic() - start < 120 and got[0] == "block" and got[1] == "allow" and len(got) == len(urls)


def test_all_urls_are_mined(spark, monkeypatch):
    """The bound of ``drawn`` takes nothing from mining."""
    rows = [(f"u{i}", ["t", f"v{i % 50}"], "block" if i % 50 < 49 else "allow") for i in range(200)]
    df = spark.createDataFrame(rows, "url string, tokens array<string>, verdict string")
    monkeypatch.setattr(U, "SAMPLE", 5)
    support = {tuple(r.tokens): r.support for r in U.mine(df).collect()}
    assert support == {("t",): 0.98, **{(f"v{i}",): 0.02 for i in range(50)}}
