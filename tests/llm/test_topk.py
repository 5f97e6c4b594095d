import math
import random

import pytest

from sigtrace.llm import topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, LABEL int, score string")


def brute(queries, candidates, k):
    def weights(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    out = []
    rows = [(i, w) for i, v, *_ in candidates if i is not None and (w := weights(v)) is not None]
    for i, v, *_ in queries:
        if i is None or (q := weights(v)) is None:
            continue
        scores = [(-sum(a * b for a, b in zip(q, w)), j) for j, w in rows if j != i and len(w) == len(q)]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def exact(rng, n, dim):
    """Components that floats hold exactly, many of them equal."""
    return [[rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, rng.randint(-512, 512) / 512]) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("block,held,queries", [(128, 32_768, 4096), (4, 50, 3)])
def test_equals_brute_force(spark, monkeypatch, block, held, queries):
    for name, value in (("BLOCK", block), ("HELD", held), ("QUERIES", queries), ("ROWS_PER_PARTITION", 200), ("SAMPLE", 40)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    rows = [(i, v, 0, "x") for i, v in enumerate(exact(rng, 400, 6))]
    rows += [(400 + i, [1.0, 0.5, 0.0, 0.0, 0.0, -1.0], 0, "x") for i in range(100)]  # one very common vector
    rows += [(i, v, 0, "x") for i, v in zip(range(600, 620), exact(rng, 20, 3))]
    rows += [(None, [1.0] * 6, 0, "x"), (700, None, 0, "x"), (701, [1.0, None] * 3, 0, "x"), (702, [], 0, "x"), (703, [float("nan")] * 6, 0, "x"), (704, [float("inf")] * 6, 0, "x")]
    rows += [rows[0], rows[450], rows[450]]
    df = vectors(spark, rows)
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows, 10)


def test_few_rows_and_empty_tables(spark):
    empty = vectors(spark, [])
    assert topk.top_k(empty, empty).count() == 0
    two = vectors(spark, [(0, [1.0], 0, "x"), (1, [2.0], 0, "x")])
    assert [tuple(r) for r in topk.top_k(two.where("vec_id = 0"), two).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert topk.top_k(two, empty).count() == topk.top_k(empty, two).count() == 0


def test_weights_beyond_exact_doubles(spark):
    df = vectors(spark, [(0, [3.0e9, 1.0], 0, "x"), (1, [3.0e9, 1.0], 0, "x"), (2, [1.0, 1.0], 0, "x"), (3, [-3.0e9, 1.0], 0, "x")])
    assert [tuple(r)[1:] for r in topk.top_k(df.where("vec_id = 2"), df).collect()] == [
        (1, 0, 3000000000 * 1024 * 1024 + 1024 * 1024), (2, 1, 3000000000 * 1024 * 1024 + 1024 * 1024), (3, 3, -3000000000 * 1024 * 1024 + 1024 * 1024)
    ]
    assert [r.score for r in topk.top_k(df.where("vec_id = 0"), df).collect()][0] == 2**63 - 1
