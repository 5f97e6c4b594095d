import random

import pytest
from pyspark.sql import functions as F

from sigtrace.functions.patterns import DOMAIN_NAME
from sigtrace.operators.extract import TOKEN_GROUPS, _ipv6_pieces, _is_valid, _match_type, _trimmed, extract

from .helpers import lines, rows, tlds

MD5, SHA1, SHA256 = "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "E3" * 32
BTC, BC1, ETH = "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "0x" + "aB" * 20


def found(spark, text, *types):
    return [(r.match_type, r.matched_text) for r in extract(lines(spark, text), tlds(spark), types or None).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("from 10.0.0.1 to 10.0.0.255.", ["10.0.0.1", "10.0.0.255"]),
        ("10.0.0.1-10.0.0.5,[1.2.3.4]", ["10.0.0.1", "10.0.0.5", "1.2.3.4"]),
        ("256.1.1.1 1.2.3 1.2.3.4.5 v1.2.3.4 01.2.3.4 1.2.3.4567 12345.1.1.1 1.2.3.4a", []),
        ("é1.2.3.4é", ["1.2.3.4"]),
        (".".join(["1"] * 500), []),
    ],
)
def test_ipv4(spark, text, expected):
    assert [t for _, t in found(spark, text, "IPv4")] == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("[2001:db8::1]:443 fe80::1%eth0 ::ffff:1.2.3.4 1:2:3:4:5:6:7:8.", ["2001:db8::1", "fe80::1", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8"]),
        ("std::cout 12:30:45 a:b:c 1:2:3:4:5:6:7:8:9 12345::1 1::2::3 00:1a:2b:3c:4d:5e", []),
        ("db8::1: up, 2001:db8::", ["db8::1", "2001:db8::"]),
    ],
)
def test_ipv6(spark, text, expected):
    assert [t for _, t in found(spark, text, "IPv6")] == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("see www.Evil.COM, a.b-c.net. and -x.org-", ["www.Evil.COM", "a.b-c.net", "x.org"]),
        ("readme.md a..com evil.com.local .com com", []),
        ("x" * 64 + ".com " + "y" * 63 + ".com " + "z" * 70 + ".com", ["y" * 63 + ".com"]),
        ("https://user@host.example.com:80/p?q=1", ["host.example.com"]),
    ],
)
def test_domain(spark, text, expected):
    assert [t for _, t in found(spark, text, "Domain")] == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("<a.b+c@x.example.com>, d@y.org.", ["a.b+c@x.example.com", "d@y.org"]),
        ("a@b @x.com a@x.c1 a@-.com", []),
        ("l" * 64 + "@x.com " + "l" * 66 + "@x.com", ["l" * 64 + "@x.com"]),
    ],
)
def test_email(spark, text, expected):
    assert [t for _, t in found(spark, text, "Email")] == expected


def test_hashes_and_wallets(spark):
    text = f"{MD5} {SHA1},{SHA256} {BTC} {BC1} {ETH}"
    assert found(spark, text) == [
        ("MD5", MD5), ("SHA1", SHA1), ("SHA256", SHA256), ("Bitcoin", BTC), ("Bitcoin", BC1), ("Ethereum", ETH),
    ]
    near = f"{MD5}0 {SHA1}g {SHA256}_ x{BTC} {BTC[:-1]}0 {ETH}1 {ETH[:-1]} " + "g" * 32
    assert found(spark, near) == []
    key = extract(lines(spark, SHA256), tlds(spark)).first().lookup_key
    assert key == SHA256.lower()


def test_types_overlap_and_repeat(spark):
    text = "a@evil.com a@evil.com"
    assert sorted(found(spark, text)) == [("Domain", "evil.com")] * 2 + [("Email", "a@evil.com")] * 2
    positions = rows(extract(lines(spark, text), tlds(spark)), "pos")
    assert len(set(positions)) == 4


def test_long_lines_finish(spark):
    texts = ["a." * 100_000, "x" * 200_000 + "@evil.com", ":" * 200_000, "1" * 200_000 + ".1.1.1", "-" * 200_000 + ".com", "ab:" * 70_000]
    assert rows(extract(lines(spark, *texts), tlds(spark), ["IPv4", "IPv6", "Email", "MD5"]), "matched_text") == []


def test_unknown_type_is_refused(spark):
    with pytest.raises(ValueError):
        extract(lines(spark, "x"), tlds(spark), ["Phone"])


@pytest.mark.parametrize(
    "text,kind,expected",
    [
        ("src:2001:db8::1 addr:fe80::1, x:::1 2001:db8::2:port", "IPv6", ["2001:db8::1", "fe80::1", "::1", "2001:db8::2"]),
        ("foo_bar.evil.com _dmarc.evil.com evil.com_x", "Domain", ["foo_bar.evil.com", "_dmarc.evil.com"]),
        (".".join(["a"] * 141) + ".com", "Domain", []),
        ("x" * 70 + ".bob@evil.com", "Email", []),
    ],
)
def test_whole_runs(spark, text, kind, expected):
    assert [t for _, t in found(spark, text, kind)] == expected


@pytest.mark.parametrize("unit", ["::1 :.", ":.", "a.", "a@", "1.", "aaaaaaaaaa", "f:", ".-"])
def test_time_grows_with_the_length_of_a_line(spark, unit):
    import time

    def seconds(n):
        start = time.perf_counter()
        extract(lines(spark, "::1 a@b.c " + unit * (n // len(unit))), tlds(spark)).count()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(1_000_000) < 20 * seconds(100_000) + 2


def test_runs_give_what_the_whole_line_gives(spark):
    """Cutting a line into runs first changes no token, no order and no position."""
    rng = random.Random(17)
    parts = [
        "10.0.0.1", "1.2.3", "fe80::1", "a:b", "::", "x.com", "a..com", "no.", "no..", "word:", "d@y.org", "@", MD5, SHA1.upper(), "a" * 32, "F" * 40,
        "g" * 70, BTC, ETH, "é", " ", " ", ", ", "/", "-", "_", "%", "+", "(", "\t", "=", "12:30:45", "2001:db8::", ".", ":", "0x", "abcdefabcdef" * 3,
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = lines(spark, *texts)
    whole = {}
    for group, (pattern, _, _) in TOKEN_GROUPS.items():
        tokens = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        whole[group] = F.flatten(F.transform(tokens, _ipv6_pieces)) if group == "ipv6" else tokens
    expected = []
    for row in df.select("line_number", *(c.alias(g) for g, c in whole.items())).collect():
        pos = 0
        for group in TOKEN_GROUPS:
            for token in row[group]:
                expected.append((row.line_number, pos, group, token))
                pos += 1
    one = spark.createDataFrame(expected, "line_number long, pos int, grp string, token string")
    text = _trimmed(F.col("grp"), F.col("token"))
    valid = one.withColumn("text", text).where(_is_valid(F.col("grp"), F.col("text"))).withColumn("kind", _match_type(F.col("grp"), F.col("text")))
    domains = (F.col("grp") != "domain") | (F.lower(F.substring_index("text", ".", -1)).isin("com", "net", "org") & F.col("text").rlike(DOMAIN_NAME))
    got = rows(extract(df, tlds(spark)), "line_number", "pos", "match_type", "matched_text")
    assert got == rows(valid.where(domains), "line_number", "pos", "kind", "text") and len(got) > 2000
