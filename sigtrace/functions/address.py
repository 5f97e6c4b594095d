"""IP address text as columns: family, bit string, CIDR parts.

An address becomes a string of 32 or 128 binary digits, so that "is in network"
is "the first n digits are equal" and a longest-prefix match is an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _ipv4_bits(address: Column) -> Column:
    def octet(i: int) -> Column:
        return F.substring_index(F.substring_index(address, ".", i), ".", -1).cast("bigint")

    number = octet(1) * 256**3 + octet(2) * 256**2 + octet(3) * 256 + octet(4)
    return F.lpad(F.bin(number), 32, "0")


def _hex_pair(high: Column, low: Column) -> Column:
    return F.lower(F.hex(high.cast("bigint") * 256 + low.cast("bigint")))


def _dotted_tail_as_hex(address: Column) -> Column:
    """``::ffff:1.2.3.4`` -> ``::ffff:102:304``; other text is returned as is."""
    tail = F.regexp_extract(address, P.IPV6_DOTTED_TAIL, 1)
    octets = F.split(tail, r"\.")
    head = address.substr(F.lit(1), F.length(address) - F.length(tail))
    replaced = F.concat(
        head,
        _hex_pair(F.get(octets, F.lit(0)), F.get(octets, F.lit(1))),
        F.lit(":"),
        _hex_pair(F.get(octets, F.lit(2)), F.get(octets, F.lit(3))),
    )
    return F.when(tail != "", replaced).otherwise(address)


def _ipv6_bits(address: Column) -> Column:
    text = F.when(F.contains(address, F.lit(".")), _dotted_tail_as_hex(address)).otherwise(address)
    given = F.size(F.regexp_extract_all(text, F.lit("[0-9A-Fa-f]+"), F.lit(0)))
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - given))
    groups = F.split(F.trim(F.replace(text, F.lit("::"), zeros), F.lit(":")), ":")
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")


def ip_family(c: Column) -> Column:
    """4 or 6 when the text is an IP address, else null."""
    is_ipv6 = F.contains(c, F.lit(":")) & c.rlike(P.IPV6_ADDRESS)
    return F.when(c.rlike(P.IPV4_ADDRESS), F.lit(4)).when(is_ipv6, F.lit(6))


def ip_bits(c: Column, family: Column | None = None) -> Column:
    """Binary digits of an IP address (32 or 128 of them), null for other text."""
    family = ip_family(c) if family is None else family
    return F.when(family == 4, _ipv4_bits(c)).when(family == 6, _ipv6_bits(c))


def cidr_address(entry: Column) -> Column:
    return F.substring_index(entry, "/", 1)


def cidr_prefix_len(entry: Column) -> Column:
    """Prefix length of ``address`` or ``address/n``; null when out of range or not an IP."""
    family = ip_family(cidr_address(entry))
    widest = F.when(family == 4, F.lit(32)).when(family == 6, F.lit(128))
    given = F.when(
        entry.rlike("^[^/]+/(?:0|[1-9][0-9]{0,2})$"),
        F.substring_index(entry, "/", -1).cast("int"),
    ).when(~F.contains(entry, F.lit("/")), widest)
    return F.when(given <= widest, given)
