import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtrace.llm import negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
LONG = 2**63 - 1


def vectors(spark, rows):
    """Extra columns clash with inputs and working names."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *(F.lit(7).alias(n) for n in ("VEC_ID", "Label", "x", "anchor", "score", "rank", "number")))


def brute(rows, every, positives=5, negatives=5, low=80, high=100):
    known = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            known.append((i, label, [math.floor(256 * c) for c in v]))
    out = []
    for i, label, a in known:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, m) for j, m, b in known if j != i and len(a) == len(b)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps)
            out += [(i, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(df, every, **options):
    got = negatives.mine(df, F.col("vec_id") % every == 0, **options)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block,anchors", [(4096, 4096), (16, 3)])
def test_equals_brute_force(spark, monkeypatch, block, anchors):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("ROWS_PER_PARTITION", 120), ("CENTRES", 5), ("FIRST", 2), ("DEEPER", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(5)
    value = lambda: rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, rng.randint(-256, 256) / 256])
    rows = [(i, [value() for _ in range(5)], rng.randint(0, 2)) for i in range(300)]
    rows += [(300 + i, [1.0, 0.5, 0.0, 0.0, -1.0], i % 2) for i in range(60)]  # a very common vector: ties beyond every window
    rows += [(400 + i, [value() for _ in range(2)], i % 2) for i in range(12)]
    rows += [(440, [0.0] * 5, 1), (450, [], 0), (451, [], 0), (452, [], 1)]
    rows += [(None, [1.0] * 5, 0), (460, None, 0), (470, [1.0, None, 0.0, 0.0, 0.0], 0), (480, [float("nan")] * 5, 0)]
    rows += [(490, [float("inf")] * 5, 0), (500, [1.0] * 5, None)]
    rows += [rows[0], rows[17], rows[17], rows[310]]
    assert mined(vectors(spark, rows), 10) == brute(rows, 10)


def test_other_windows_and_counts(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.randint(0, 1)) for i in range(120)]
    rows = [(i, [math.floor(256 * c) / 256 for c in v], m) for i, v, m in rows]
    options = {"positives": 3, "negatives": 7, "low": 50, "high": 95}
    assert mined(vectors(spark, rows), 4, **options) == brute(rows, 4, **options)


def test_few_rows_and_empty_tables(spark):
    assert mined(vectors(spark, []), 2) == []
    alone = [(0, [1.0], 0), (1, [1.0], 1)]  # no positive
    assert mined(vectors(spark, alone), 2) == []
    same = [(0, [1.0], 0), (1, [1.0], 0)]  # no other label
    assert mined(vectors(spark, same), 2) == []
    negative = [(0, [1.0], 0), (1, [-1.0], 0), (3, [-1.0], 1)]  # a positive below zero has an empty window
    assert mined(vectors(spark, negative), 2) == brute(negative, 2) == []


def test_scores_beyond_exact_doubles(spark):
    rows = [(0, [3.0e6, 1.0], 0), (1, [3.0e6, 1.0], 0), (2, [3.0e6, 0.5], 1), (3, [2.9e6, 0.5], 1), (4, [-3.0e6, 1.0], 1)]
    assert mined(vectors(spark, rows), 10) == brute(rows, 10)


def test_reading_stops_at_the_threshold():
    """Blocks of clustered rows: most are never scored, and the best are those of a full scan."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = np.floor(256 * (np.repeat(centres, 50, axis=0) + rng.normal(scale=0.05, size=(2000, 16)))).astype(np.int64)
    windows = [negatives.Windows([-LONG], [LONG], 5)]
    taken = 0
    for s in range(0, 2000, 100):
        lists = negatives.Lists(np.arange(s, s + 100), np.zeros(100, np.int64), rows[s : s + 100])
        taken += lists.search(rows[:1], np.array([0]), np.array([0]), windows, same=True)
    scores = rows @ rows[0]
    scores[0] = -LONG
    assert windows[0].ids[0].tolist() == np.lexsort((np.arange(2000), -scores))[:5].tolist()
    assert taken < 600


def test_a_tie_below_the_threshold_is_still_read():
    """Reading goes on while the threshold equals the k-th score: a smaller vec_id may come."""
    rows = np.full((50, 3), 7)
    lists = negatives.Lists(np.arange(50)[::-1].copy(), np.zeros(50, np.int64), rows)
    windows = [negatives.Windows([-LONG], [LONG], 4)]
    lists.search(np.array([[1, 2, 3]]), np.array([-1]), np.array([0]), windows, same=True)
    assert windows[0].ids[0].tolist() == [0, 1, 2, 3]
