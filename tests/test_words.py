"""Words made inside their page's row, and what is read from them once."""

import random

import numpy as np

import quirewise.plans
from pyspark.sql import functions as F
from quirewise.operators import export, layout, matching
from quirewise.plans.registry import QUERIES
from quirewise.sources.views import Views
from tests.test_sizes import moved

SF = "/root/testdata/sf0.001"
quirewise.plans.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_odd_texts(spark, tmp_path):
    texts = [None, "", " ", "\n\n", "a", " a  bc \n\n  \nd\te é😀 f\r\n", "x\n" * 3, "\n y z", "w " * 5000]
    folder = tmp_path / "odd"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    expected = set()
    for page, text in enumerate(texts):
        lines = [(n, [w for w in line.split(" ") if w]) for n, line in enumerate((text or "").split("\n"))]
        lines, seq = [x for x in lines if x[1]], 0
        for n, words in lines:
            for k, w in enumerate(words):
                expected.add((page, n, k, seq, w, lines[0][0], lines[-1][0], len(words) - 1, 36.0 + 6.0 * sum(len(x) + 1 for x in words[:k])))
                seq += 1
    v = Views(spark, str(folder))
    for words in (v._words, v._loose):
        got = words.select("page_index", "line_no", "word_no", "seq", "text", "first_line", "last_line", "last_word", "x").collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_recognition_rows_are_split_once(spark):
    """A row's fields are split once, words need no window."""
    text = plan(QUERIES["src_tsv"](spark, SF))
    assert text.count("split(") == 1 and "Window" not in text


def test_runs_are_sought_in_their_page(spark):
    """Nearest equal runs, the lower of equals, places beyond the page too; hot runs on one page."""
    rng = random.Random(3)
    pages = {p: [rng.choice("abc"[: 1 + p % 3]) for _ in range(rng.choice([0, 1, 2, 9, 40]))] for p in range(30)} | {99: ["w"] * 20_000}
    wanted = [(p, 100 * p + k, rng.randrange(-5, 50), " ".join(rng.choice("abcd") for _ in range(1 + k % 4))) for p in range(31) for k in range(40)] + [(99, 10_000 + k, 19_990 + k, "w w w") for k in range(20)]
    expected = set()
    for p, seq, at, run in wanted:
        own, run = pages.get(p, []), run.split()
        if places := [i for i in range(len(own) - len(run) + 1) if own[i : i + len(run)] == run]:
            expected.add((p, seq, min(places, key=lambda i: (abs(i - at), i)), len(run)))
    df = spark.createDataFrame(list(pages.items()), "page_index long, words array<string>")
    got = matching.nearest_runs(df, spark.createDataFrame(wanted, "page_index long, seq long, at long, run string")).collect()
    assert len(got) == len(expected) > 200 and {tuple(r) for r in got} == expected


def test_runs_need_no_windows(spark):
    """Words and runs stay where their page is, unsorted."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("jn_nearest_run", "op_reapply_edits"):
            text = plan(QUERIES[name](spark, SF))
            assert "Window" not in text and text.count("Exchange") == text.count("REPARTITION_BY_NUM"), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_boxes_join_as_by_all_pairs(monkeypatch):
    """Boxes of several pages swept at once, few pairs at a time, against every box with every other."""
    monkeypatch.setattr(layout, "PAIRS", 50)
    rng = np.random.default_rng(1)
    for t in range(60):
        n = int(rng.integers(1, 60))
        page, seq, side = rng.integers(0, 3, n), rng.permutation(n) + 5, rng.integers(0, 2, n)
        x, y, w, h = (np.round(rng.uniform(lo, hi, n)) for lo, hi in ((-50, 300), (-20, 60 if t % 2 else 300), (0, 40), (0, 12)))
        if t % 5 == 0:
            h[0], w[-1] = 500, 900
        far = np.array([6.0, 3.0, 250.0])[page]
        group = layout.Groups(n)
        for i in range(n):
            for j in range(n):
                reached = page[i] == page[j] and side[i] == side[j] and (x[i], seq[i]) < (x[j], seq[j]) and x[j] <= x[i] + w[i] + min(200, far[i])
                if reached and min(y[i] + h[i], y[j] + h[j]) - max(y[i], y[j]) >= 0.5 * min(h[i], h[j]):
                    group.tie(i, j)
        tops = [group.top(i) for i in range(n)]
        assert list(layout.joined_boxes(page, side, far, seq, x, y, w, h, 0.5, 200.0)) == [min(seq[k] for k in range(n) if tops[k] == tops[i]) for i in range(n)]


def test_clusters_take_many_pages_at_once(spark):
    assert "FlatMapGroupsInPandas" not in plan(QUERIES["geo_cluster"](spark, SF))


def test_ids_are_covered_as_counted(spark):
    """Runs of ids that overlap, repeat, cross blocks or are out of order, against counting each id."""
    rng = random.Random(8)
    lists = [[], [5, 5, 7], [9_999, 10_000, 10_001], list(range(9_990, 30_010)), [3, 9, 1]] + [[rng.randrange(60) for _ in range(rng.randrange(9))] for _ in range(40)]
    ids = [i for x in lists for i in x]
    df = spark.createDataFrame(list(enumerate(lists)), "page_index long, span_ids array<long>")
    assert [tuple(r) for r in export.covered_ids(df).collect()] == [(len(ids), len(ids) - len(set(ids)))]
    assert [tuple(r) for r in export.covered_ids(df.where("false")).collect()] == [(0, 0)]


def test_composing_moves_no_words(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = Views(spark, SF)
        df = export.compose(v.spans.withColumn("flagged", F.col("seq") > 5), v.dealt_regions, listed=True)
        assert moved(df) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
