import random
import zlib
from collections import Counter, defaultdict

from quirewise.llm import sharding
from tests.llm.fixtures import awkward_documents, frame


def check(rows, got, shards=24):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return loads


def test_awkward(spark):
    rows = awkward_documents()
    check(rows, sharding.shard_documents(frame(spark, rows)).collect())
    assert sharding.shard_documents(frame(spark, [], False)).collect() == []


def test_even_and_together(spark):
    rows = [(i, f"text {i % 700} " + "x" * (i % 700 % 90), "en", "s", 1) for i in range(2000)] + [(5000 + i, "copied " * 9, "en", "s", 1) for i in range(1500)] + [(9000 + i, f"alone {i} " * (i % 13), "en", "s", 1) for i in range(2500)]
    got = sharding.shard_documents(frame(spark, rows, False)).collect()
    loads = check(rows, got)
    mean = sum(loads.values()) / 24
    assert max(loads.values()) < 1.03 * mean and min(loads.values()) > 0.97 * mean
    homes = defaultdict(set)
    text = {d: t for d, t, *_ in rows}
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    pairs = [len(homes[f"text {i} " + "x" * (i % 90)]) for i in range(700)]
    assert sum(x == 1 for x in pairs) > 500
    assert len(homes["copied " * 9]) < 20
    again = sharding.shard_documents(frame(spark, rows[::-1], False).repartition(7)).collect()
    assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in again}


def test_one_row_repeated(spark):
    rows = [(1, "same text again", "en", "s", 1)] * 900 + [(i, f"other {i}", "en", "s", 1) for i in range(2, 400)]
    loads = check(rows, sharding.shard_documents(frame(spark, rows, False)).collect())
    mean = sum(loads.values()) / 24
    assert max(loads.values()) < 1.03 * mean


def test_cuts_hardly_more_than_packing_whole_groups(spark):
    """Against a plain packing that knows all groups: the largest first, each whole into the least loaded shard."""
    rng = random.Random(11)
    rows, groups = [], defaultdict(list)
    for g in range(500):
        text = f"group {g} " + "y" * rng.randint(0, 400)
        for _ in range(rng.choice([2, 2, 2, 3, 5, 9, 30])):
            groups[text].append(len(rows))
            rows.append((len(rows), text, "en", "s", 1))
    rows += [(len(rows) + i, f"alone {i} " + "z" * rng.randint(0, 400), "en", "s", 1) for i in range(2500)]
    got = {r.doc_id: r.shard for r in sharding.shard_documents(frame(spark, rows, False)).collect()}
    loads, cap = [0] * 24, sum(len(t) + 8 for _, t, *_ in rows) / 24
    whole = 0
    for text, own in sorted(groups.items(), key=lambda x: -len(x[1]) * (len(x[0]) + 8)):
        s = min(range(24), key=loads.__getitem__)
        loads[s] += len(own) * (len(text) + 8)
        whole += loads[s] <= cap
    pairs = lambda ids: sum(n * (n - 1) // 2 for n in Counter(got[i] for i in ids).values())
    kept, every = sum(pairs(own) for own in groups.values()), sum(len(own) * (len(own) - 1) // 2 for own in groups.values())
    together = sum(len({got[i] for i in own}) == 1 for own in groups.values())
    print("pairs kept", kept / every, "groups whole", together, "packed", whole)
    assert kept > 0.9 * every and together > 0.9 * whole


def test_string_ids_and_tied_giants(spark):
    """Documents that are placed one by one, of one size, with ids that are strings, empty or null."""
    rows = [("", "x" * 4000), (None, "x" * 3999 + "y"), ("a", "z" * 4000), (None, "w" * 4000), ("b", "x" * 4000), ("", "q" * 4000)] + [(f"d{i}", "s" * (i % 7)) for i in range(50)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    per = Counter(r.shard for r in out)
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in per.items())
