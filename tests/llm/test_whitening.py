import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtrace.llm import whitening


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *(F.lit(7).alias(n) for n in ("VEC_ID", "x", "n", "length", "copies", "weight", "component")))


def brute(rows, k=16, weights="one"):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by numpy over the written rule."""
    out = {}
    known = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for length in {len(x) for _, x in known}:
        own = [(i, x) for i, x in known if len(x) == length]
        distinct = sorted({x for _, x in own})
        weight = [1 if weights == "one" else sum(y == x for _, y in own) for x in distinct]
        n = sum(weight)
        sums = [sum(w * x[d] for w, x in zip(weight, distinct)) for d in range(length)]
        centred = lambda x: np.array([n * c - s for c, s in zip(x, sums)]) / n
        c = np.array([centred(x) for x in distinct])
        v = (c * np.array(weight)[:, None]).T @ c / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        some = e > 1e-12 * e[0]
        for i, x in own:
            y = centred(x) @ u[:, some] / np.sqrt(e[some])
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            for j, value in enumerate(y, 1):
                out.setdefault((i, j), []).append((n, deviation, abs(value), e[j - 1] / np.trace(v)))
    return out


def check(df, expected, **options):
    got = {}
    rows = whitening.components(df, **options).collect()
    for r in rows:
        assert abs(r.identity_error) < 1e-9
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        for a, b in zip(sorted(values), sorted(got[key]), strict=True):
            assert a[:2] == b[:2] and b[2:] == pytest.approx(a[2:], rel=1e-8, abs=1e-8)
    return rows


def sample(rng, n, dim, scale=1.0):
    stretch = [1 + d for d in range(dim)]
    return [[rng.gauss(0, scale * s) for s in stretch] for _ in range(n)]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_numpy(spark, monkeypatch, weights):
    monkeypatch.setattr(whitening, "HELD", 7)
    monkeypatch.setattr(whitening, "PIECES", 4)  # the common vector is cut into pieces
    rng = random.Random(4)
    rows = [(i, v, 0) for i, v in enumerate(sample(rng, 150, 20))]
    rows += [(200 + i, rows[3][1], 0) for i in range(90)]
    rows += [(300 + i, v, 0) for i, v in enumerate(sample(rng, 12, 3))]
    rows += [(None, rows[5][1], 1), (400, None, 0), (401, [1.0, None], 0), (402, [], 0), (403, [float("nan")] * 20, 0), (404, [float("inf")] * 20, 0), rows[7]]
    rows = [(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v], m) for i, v, m in rows]
    check(vectors(spark, rows).repartition(5), brute(rows, weights=weights), weights=weights)


def test_signs_are_the_same_for_all_rows(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(sample(rng, 60, 4))]
    y = {(r.vec_id, r.component): r.whitened for r in whitening.components(vectors(spark, rows)).collect()}
    w = np.array([[y[i, k] for k in range(1, 5)] for i in range(60)])
    assert np.abs(w.T @ w / 60 - np.eye(4)).max() < 1e-9


def test_few_vectors_and_empty_tables(spark):
    assert whitening.components(vectors(spark, [])).collect() == []
    assert whitening.components(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []  # no variance
    two = [(1, [1.0, 2.0, 0.0], 0), (2, [0.0, 2.0, 0.0], 0), (3, [0.0, 2.0, 0.0], 0)]
    rows = check(vectors(spark, two), brute(two))
    assert sorted((r.vec_id, r.component) for r in rows) == [(1, 1), (2, 1), (3, 1)]


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2**20 * (1 + i % 3)), float(i)], 0) for i in range(9)]
    check(vectors(spark, rows), brute(rows))
    far = [(0, [3.0e38, 1.0], 0), (1, [-3.0e38, 0.0], 0), (2, [0.0, 0.5], 0)]
    limit = 2**40
    x = {0: (limit, 64), 1: (-limit, 0), 2: (0, 32)}
    expected = {i: min(2**63 - 1, (3 * a) ** 2 + (3 * b - 96) ** 2) for i, (a, b) in x.items()}
    assert {r.vec_id: r.deviation for r in whitening.components(vectors(spark, far)).collect()} == expected


def test_weights_have_names(spark):
    with pytest.raises(ValueError):
        whitening.components(vectors(spark, []), weights="rows")
