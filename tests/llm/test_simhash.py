import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sigtrace.llm import simhash
from sigtrace.llm.components import components

from .helpers import documents, full_documents, lower, odd_columns


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abÀéABß \t\n\x0b\x1f ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_texts_and_many_repeats():
    for text in ("word " * 5000, " ".join(map(str, range(3000)))):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_five_shared_positions_hold_a_choice_of_four():
    assert len(simhash.FOURS) == 14
    assert all(any(set(four) <= set(five) for four in simhash.FOURS) for five in combinations(range(8), 5))


def prints(rng):
    out = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            value = base
            for _ in range(rng.randint(0, 6)):
                value ^= 1 << rng.randrange(64)
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("part", [4096, 5])
def test_links_connect_what_is_within_three_bits(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    values = prints(random.Random(part))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash._components_of(rows).collect()}
    roots = brute_components(values)
    least = {root: min(i for i, r in enumerate(roots) if r == root) for root in roots}
    assert [got[v] for v in signed] == [least[r] for r in roots]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base.replace("w200 ", "x ")), (20, "other words entirely here"), (None, base), (None, "lone"), (30, None), (31, ""), (32, " \t"), (20, "other words entirely here")]
    got = simhash.near_duplicates(odd_columns(documents(spark, rows))).collect()
    values = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(values)
    least = {r: min([i for (i, _), q in zip(rows, roots) if q == r and i is not None], default=None) for r in roots}
    expected = [(i, f"{v:016x}", least[r]) for (i, _), v, r in zip(rows, values, roots)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    df = full_documents(spark, [(5, base), (3, base), (3, base), (None, base), (7, "a b c d"), (8, None), (9, ""), (None, "q r s")])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in df.distinct().collect() if (r.doc_id, r.text) in {(3, base), (7, "a b c d"), (8, None), (None, "q r s")}], key=str)
