"""Hard negatives against a full comparison, on clustered, equal, odd and very large vectors."""

import math
import random

import pytest

from jobweave.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q string, cell int, rank int"


def brute(rows, every=100, k=5, n=10):
    held = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        held[i] = min(held.get(i, own), own)
    dot = lambda p, q: sum(a * b for a, b in zip(p, q, strict=False))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scores = sorted((-dot(v, w), i, m) for i, (m, w) in held.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:k]:
            fit = [x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:n]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def vector(rng, centre, wide):
    return [struct32(c + rng.gauss(0, wide)) for c in centre]


def struct32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def clustered(n, seed=3, wide=0.05, dims=8):
    """Vectors around few centres, with a hot label, a hot vector, and all odd rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(12)]
    hot = vector(rng, centres[0], 0)
    rows = []
    for i in range(n):
        v = hot if rng.random() < 0.15 else vector(rng, rng.choice(centres), wide)
        rows.append((i, v, 3 if rng.random() < 0.4 else rng.randint(0, 9), "x", 1, 2))
    odd = [(None, hot), (n + 1, None), (n + 2, [None, 1.0]), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] * dims), (n + 5, []), (n + 6, [0.5]), (n + 7, [0.0] * dims)]
    rows += [(i, v, 3, "x", 1, 2) for i, v in odd] + [(n + 8, hot, None, "x", 1, 2), (200, hot, 4, "x", 1, 2), (200, hot, 4, "x", 1, 2), (n + 200 - n % 100, [0.0] * dims, 3, "x", 1, 2)]
    return rows


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PIVOTS", 24), ("GROUP", 4), ("PART", 150)):
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("broadcast", [negatives.BROADCAST_ROWS, 0])
def test_equals_a_full_comparison(spark, small, monkeypatch, broadcast):
    monkeypatch.setattr(negatives, "BROADCAST_ROWS", broadcast)
    rows = clustered(900)
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA), every=20).collect())) == brute(rows, 20)


def test_bounds_spare_rows(spark, small, monkeypatch):
    """On clustered vectors a row goes to few groups only."""
    seen, sent = [], negatives.sent

    def counted(rows, ranges, keys):
        made = sent(rows, ranges, keys)
        seen.append((made.count(), rows.count() * (ranges.select("group").distinct().count() if len(keys) == 1 else 4)))
        return made

    monkeypatch.setattr(negatives, "sent", counted)
    rows = [r for r in clustered(1200, wide=0.01) if r[1] and len(r[1]) == 8 and any(r[1])]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA), every=20).collect())) == brute(rows, 20)
    assert all(n < 0.6 * most for n, most in seen), seen


def test_scores_beyond_floating_point(spark, small):
    rng = random.Random(8)
    rows = [(i, [struct32(rng.uniform(0.4, 1) * 2.0**20) for _ in range(4)], i % 3, "x", 1, 2) for i in range(0, 300, 5)]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA), every=50).collect())) == brute(rows, 50)


def test_all_equal_and_all_zero(spark, small):
    for v in ([0.5, 0.25], [0.0, 0.0], []):
        rows = [(i, v, i % 4, "x", 1, 2) for i in range(60)]
        assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA), every=10).collect())) == brute(rows, 10)


def test_empty_table(spark):
    made = negatives.mine(spark.createDataFrame([], SCHEMA))
    assert made.count() == 0 and made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
