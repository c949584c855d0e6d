import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quirewise.llm import resampling
from tests.llm.brute import fold
from tests.llm.fixtures import awkward_documents, frame

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall(fold(text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, items, percent=5):
    s, t = Counter(), Counter()
    found = [(d, *grams(x)) for d, x in docs]
    for _, _, g in found:
        s.update(g)
    for _, x in items:
        t.update(grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, w, g in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append((d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    eligible = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = eligible[: percent * len(eligible) // 100]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return Counter({(*r[:4], i): 1 for i, r in enumerate(drawn, 1)}) + Counter({(*r, None): n for r, n in left.items()})


def check(spark, docs, items, percent=5, extra=False, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = resampling.resample(frame(spark, docs, extra), bench, percent=percent, **options)
    assert Counter(map(tuple, found.select(*COLUMNS).collect())) == brute([r[:2] for r in docs], items, percent)


@pytest.mark.parametrize("percent", [0, 5, 37, 100])
def test_awkward_rows(spark, percent):
    check(spark, awkward_documents(), [(1, "spam and eggs"), (2, None), (3, "the An-S xing")], percent, True)


def test_many_intervals_and_repeated_rows(spark):
    docs = awkward_documents(150) + [awkward_documents()[25]] * 40
    for percent, interval in ((5, 3), (40, 7), (50, 10_000)):
        check(spark, docs, [(1, "über xtion the")], percent, interval=interval)


def test_real_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)
    check(spark, docs, items, 30, interval=50)


def test_nothing(spark):
    check(spark, [], [(1, "x")])
    check(spark, awkward_documents(), [])


def test_runs_are_hashed_by_their_words():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aé0z") for _ in range(rng.choice([1, 3, 9, 63, 64, 65, 200]))) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["a,b--c", "", "-"]
    found = Counter()
    for _, at, bucket in resampling.features([t.encode() for t in texts]):
        found.update(zip(at.tolist(), bucket.tolist(), strict=True))
    assert found == Counter((i, b) for i, t in enumerate(texts) for b in grams(t)[1])


@pytest.mark.parametrize("most", [1, 7, 40])
def test_long_texts_come_in_pieces(monkeypatch, most):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 30, "dé"]) for _ in range(n)) + end for n in (0, 1, 2, 3, 50) for end in ("", " ", "  -  ")]
    whole = resampling.pieces
    monkeypatch.setattr(resampling, "pieces", lambda t, longest: whole(t, longest, most))
    found = Counter()
    for _, at, bucket in resampling.features([t.encode() for t in texts]):
        found.update(zip(at.tolist(), bucket.tolist(), strict=True))
    assert found == Counter((i, b) for i, t in enumerate(texts) for b in grams(t)[1])


def test_tournament_merges_runs():
    rng = np.random.default_rng(0)
    runs = [sorted(rng.choice(1000, rng.integers(1, 60), replace=False).tolist()) for _ in range(13)]
    everything = sorted((x, i) for i, run in enumerate(runs) for x in run)
    tree = resampling.Tournament()
    out = []
    for i, run in sorted(enumerate(runs), key=lambda r: (r[1][0], r[0])):
        keys = [(x, i) for x in run]
        out += [r for part in tree.up_to(keys[0]) for r in part]
        tree.enter(keys, keys)
    out += [r for part in tree.up_to() for r in part]
    assert out == everything
