import random
from collections import defaultdict

import numpy as np
import pytest

from quirewise.llm import mixing
from tests.llm.brute import WS
from tests.llm.fixtures import awkward_documents, frame


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = {s: weight[s] for s in names if s not in fixed}
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(rest.values())
        over = [s for s in rest if rest[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: w * level for s, w in rest.items()}
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, got):
    size = lambda t: len(WS.findall(t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    want = targets(dict(sizes))
    largest = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((d, size(t)) for d, t, *_ in rows), key=str)
    for s, x in want.items():
        assert abs(taken[s] - x) <= largest[s] + 1e-6  # a source of few documents may have no better way
    return taken


def test_awkward_mix(spark):
    rows = awkward_documents()
    got = mixing.mix_report(frame(spark, rows)).collect()
    check(rows, got)
    again = mixing.mix_report(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_and_wordless(spark):
    assert mixing.mix_report(frame(spark, [], False)).collect() == []
    got = mixing.mix_report(frame(spark, [(1, None, "en", "a", None), (2, " ", "en", None, 1)], False)).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 60), "en", rng.choice("aaaabbc"), 1) for i in range(3000)]
    check(rows, mixing.mix_report(frame(spark, rows, False)).collect())


def test_flight_keeps_totals_and_expectations():
    size = np.sort(np.random.default_rng(1).integers(1, 400, 40)).astype(float)[::-1].copy()
    size[0] = 3000  # far larger than what the others make up for with their number kept, so words alone are kept for it
    sums = np.zeros(40)
    for k in range(3000):
        pi = np.full(40, 0.375)
        mixing.fly(pi, size, random.Random(k), False)
        assert (pi * size).sum() == pytest.approx(0.375 * size.sum())
        assert ((pi > 0) & (pi < 1)).sum() <= mixing.REST + 4
        sums += pi
        landed = np.full(40, 0.375)
        mixing.fly(landed, size, random.Random(f"land{k}"), True)
        assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - 0.375 * size.sum()) <= np.median(size)
    assert np.allclose(sums / 3000, 0.375, atol=0.04)


def test_flight_keeps_both_totals():
    size = np.sort(np.random.default_rng(2).integers(100, 400, 200)).astype(float)[::-1].copy()
    pi = np.full(200, 0.5)
    mixing.fly(pi, size, random.Random(0), False)
    assert pi.sum() == pytest.approx(100, abs=8) and (pi * size).sum() == pytest.approx(size.sum() / 2)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_sources_come_near_their_targets(spark, sf):
    """No source misses by more than its median document, few by more than a few words."""
    got = mixing.mix_report(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).collect()
    sizes, taken, target = defaultdict(list), defaultdict(int), {}
    for r in got:
        sizes[r.source].append(r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
    misses = {s: abs(taken[s] - target[s]) for s in sizes}
    assert all(misses[s] <= np.median(sizes[s]) for s in sizes)
    assert np.median(list(misses.values())) <= 20


def test_mix_repeats_rows(spark):
    rows = awkward_documents()
    docs = frame(spark, rows)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = sum(len(WS.findall(r.text or "")) for r in out.collect())
    assert abs(words / sum(len(WS.findall(r[1] or "")) for r in rows) - 1.5) < 0.2
    assert out.count() > 0 and mixing.mix(frame(spark, [])).collect() == []
