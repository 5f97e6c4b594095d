import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sigtrace.functions import cidr_address, cidr_prefix_len, ip_bits, ip_family

ODD_TEXTS = [
    "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "", "a", "::", "::1", "1::", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1::2::3", ":::", ":1", "1:", "12345::", "g::1", "::ffff:1.2.3.4",
    "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "1.2.3.4::", "1:2:3:4::5:6:7:8",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::1:2:3:4:5:6:7:8", "fe80::1%eth0", "2001:DB8::A", "é::1", "::ffff:01.2.3.4",
]


def _family(text):
    try:
        if "%" in text:
            return None
        return ipaddress.ip_address(text).version
    except ValueError:
        return None


def _bits(text):
    address = ipaddress.ip_address(text)
    return format(int(address), f"0{address.max_prefixlen}b")


def random_addresses(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            out.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        else:
            mask = rng.choice([0, 0xFFFF << 32, (1 << 64) - 1, (1 << 128) - 1])
            out.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & mask)))
    return out


def test_family_and_bits_agree_with_ipaddress(spark):
    texts = ODD_TEXTS + random_addresses(1, 300)
    rows = (
        spark.createDataFrame([(t,) for t in texts], "t string")
        .select("t", ip_family(F.col("t")).alias("f"), ip_bits(F.col("t")).alias("b"))
        .collect()
    )
    for r in rows:
        assert r.f == _family(r.t), r.t
        assert r.b == (_bits(r.t) if r.f else None), r.t


@pytest.mark.parametrize(
    "entry,expected",
    [("10.0.0.0/8", 8), ("10.0.0.1", 32), ("::1", 128), ("2001:db8::/32", 32), ("10.0.0.0/33", None),
     ("10.0.0.0/", None), ("10.0.0.0/08", None), ("10.0.0.0/8/9", None), ("x/8", None), ("::/0", 0), ("::/129", None)],
)
def test_prefix_length(spark, entry, expected):
    row = spark.createDataFrame([(entry,)], "e string").select(
        cidr_prefix_len(F.col("e")).alias("n"), cidr_address(F.col("e")).alias("a")
    ).first()
    assert row.n == expected
