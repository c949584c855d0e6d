"""Queries over their whole input, against brute force."""

import random
from collections import defaultdict

import quirewise.plans
from quirewise.operators import edits, reconstruct
from quirewise.plans.registry import QUERIES
from quirewise.sources.views import Views

SF = "/root/testdata/sf0.001"
quirewise.plans.load()


def test_mean_confidence_is_over_all_words(spark):
    counted = defaultdict(list)
    for r in Views(spark, SF).spans.select("page_index", "text", "confidence").collect():
        counted[r.page_index] += [r.confidence] if r.text else []
    got = {r.page_index: r["mean"] for r in QUERIES["agg_mean_conf"](spark, SF).collect()}
    assert got == {p: sum(c) / len(c) if c else 0.0 for p, c in counted.items()}


def table_fit(old, new):
    """The whole table, as stated."""
    k, t, inf = len(old), len(new), float("inf")
    cost, back = [[inf] * (t + 1) for _ in range(k + 1)], {}
    cost[0][0] = 0
    for i in range(1, k + 1):
        for j in range(t + 1):
            ways = [(1, 0), *((1, h) for h in range(1, min(8, j) + 1)), *((g, 1) for g in range(2, min(8, i) + 1) if j)]
            priced = [(cost[i - g][j - h] + 2 * edits.distance("".join(old[i - g : i]), "".join(new[j - h : j])) + (h > 1 or g > 1), n) for n, (g, h) in enumerate(ways)]
            cost[i][j], n = min(priced)
            back[i, j] = ways[n]
    if cost[k][t] == inf:
        return None
    out, i, j = [""] * k, k, t
    while i:
        g, h = back[i, j]
        out[i - g] = " ".join(new[j - h : j]) if h else ""
        i, j = i - g, j - h
    return out


def typed(rng, old):
    new = []
    for w in old:
        new += rng.choice([[w]] * 6 + [[], [w + "x"], [w[:1], w[1:] or "q"], [w, "added"], [w[::-1]]])
    return [w for w in new if w]


def test_fit_is_the_cheapest_of_the_whole_table():
    rng = random.Random(5)
    for n in [1, 2, 3, 5, 8, 13] * 12 + [31, 34, 40]:
        old = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(n)]
        new = typed(rng, old)
        if new and (expected := table_fit(old, new)):
            assert edits.fit(old, new) == expected
    old = [f"w{i:02d}" for i in range(40)]
    new = ["these", "words", "are", "put", "before", "all", "others", "now", "and", "some", "more", *old[:15], *old[30:]]
    assert len(old) * len(new) > 900 and edits.fit(old, new) == table_fit(old, new)


def test_long_texts_are_split_at_common_words():
    rng = random.Random(6)
    for n, kinds in ((7, 3), (40, 5), (90, 30)):
        old, new = ([str(rng.randrange(kinds)) for _ in range(m)] for m in (n, n + 3))
        longest = [[0] * (len(new) + 1) for _ in range(n + 1)]
        for i in reversed(range(n)):
            for j in reversed(range(len(new))):
                longest[i][j] = longest[i + 1][j + 1] + 1 if old[i] == new[j] else max(longest[i + 1][j], longest[i][j + 1])
        expected, i, j = [], 0, 0
        while i < n and j < len(new):
            if old[i] == new[j]:
                expected.append((i, j))
                i, j = i + 1, j + 1
            elif longest[i][j + 1] >= longest[i + 1][j]:
                j += 1
            else:
                i += 1
        assert edits.common(old, new) == expected
    old = [f"w{i}" for i in range(300)]
    new = ["lead", *old[:100], "put", "in", *old[100:150], "w150x", *old[152:]]
    out = edits.fit(old, new)
    assert out == ["lead w0", *old[1:99], "w99 put in", *old[100:150], "w150x", "", *old[152:]]


def test_every_unknown_word_is_searched(spark):
    """A page of 60 unknown words gets 60 proposals; one that stands for several words of the page gets its own at each."""
    vowels = "aeiou"
    known = [f"{a}{b}{c}lmst" for a in "bdfgk" for b in vowels for c in "nprt"][:55]
    asked = [w[:-1] + "q" for w in known] + [known[0][:-1] + "q"] * 5
    lexicon = spark.createDataFrame([(w,) for w in known], "token string")
    rows = [(1, i, 1, 7, False, w) for i, w in enumerate(asked)]
    spans = spark.createDataFrame(rows, "page_index long, position long, revision long, region_id long, protected boolean, text string")
    fragments = spark.createDataFrame([], "page_index long, position long")
    got = reconstruct.proposals_of(spans, lexicon, fragments).collect()
    assert sorted((r.position, r.replacement) for r in got) == [(i, (known + known[:1] * 5)[i]) for i in range(60)]
    assert {(r.kind, r.score) for r in got} == {("spelling", 72)}
