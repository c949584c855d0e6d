import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quirewise.llm import centroids

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, wide=64, k=16):
    kept = [(i, [math.floor(64 * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == wide and all(v is not None and math.isfinite(v) for v in e)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [x for _, x in by_hash[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min(range(len(now)), key=lambda j: (far(x, now[j]), j)) for _, x in kept]
    for _ in range(3):
        at = assign()
        for j in range(len(now)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if own:
                now[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    d = [far(x, now[a]) for (_, x), a in zip(kept, at, strict=True)]
    inertia = [sum(v for v, a in zip(d, at, strict=True) if a == j) for j in range(len(now))]
    short = lambda v: v if v < 2**63 else None
    return Counter((i, a, short(v), short(inertia[a]), short(sum(d)), hashlib.sha256(",".join(map(str, now[a])).encode()).hexdigest()) for (i, _), a, v in zip(kept, at, d, strict=True))


def vectors(n=150, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(0, scale, 64) + rng.integers(0, 5)).astype(np.float32).tolist()) for i in range(n)]


def check(spark, rows, **options):
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options)
    assert Counter(map(tuple, found.select(*COLUMNS).collect())) == brute([r[:2] for r in rows])


def test_plain_and_odd_rows(spark):
    rows = vectors()
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] + [1.0] * 63), (206, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (7, rows[7][1]), (208, [0.0] * 64), (209, [-0.001] * 64)]
    check(spark, [(*r, 0) for r in rows + odd])


@pytest.mark.parametrize("scale", [1e5, 3e6, 1e9, 1e30])
def test_numbers_beyond_the_bound(spark, scale):
    """Distances that float64 can't hold; large vectors beside small ones."""
    rows = vectors(60) + [(100 + i, x) for i, x in vectors(30, 5, scale)]
    check(spark, [(*r, 0) for r in rows])


def test_few_ties_and_none(spark):
    check(spark, [(i, [1.0] * 64, 0) for i in range(40)])
    check(spark, [(i, [float(i)] * 64, 0) for i in range(5)])
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    clashing = spark.createDataFrame([(1, [1.0] * 64, "a", "b"), (2, [2.0] * 64, "a", "b")], "vec_id long, embedding array<float>, x string, cluster string")
    assert centroids.cluster(clashing).columns == COLUMNS


def test_products_are_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**21), 2**21, (50, 64)).astype(np.float64)
    c = rng.integers(-(2**21), 2**21, (7, 64)).tolist()
    best, far = centroids.nearest(x, c)
    for row, b, d in zip(x, best, far, strict=True):
        each = [sum((int(v) - w) ** 2 for v, w in zip(row, q, strict=True)) for q in c]
        assert (min(each), each.index(min(each))) == (d, b)
