"""Golden vectors of the functions, and properties of the operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewise.functions import geometry as G
from quirewise.functions import numerals as N
from quirewise.functions import text as T
from quirewise.operators import edits, issues, layout, sequences, sets, state
from quirewise.sources import readers


def values(spark, function, inputs, *more):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    names = ["i", *"abc"[: len(rows[0]) - 1]]
    df = spark.createDataFrame(rows, names)
    return [r.v for r in df.select("i", function(*(F.col(n) for n in names[1:])).alias("v")).orderBy("i").collect()]


def test_word_markers(spark):
    words = ["world*", "India,†", "Hough²", "Hough12", "1839", "A1", "plain", "Lord!", "wisdom.!"]
    assert values(spark, T.word_marker, words) == ["*", "†", "2", "12", None, None, None, None, "!"]


def test_note_markers(spark):
    words = ["*", "(1)", "2.", "¹", "†Asiatic", "The", "1839", "Why?"]
    assert values(spark, T.note_marker, words) == ["*", "1", "2", "1", "†", None, None, None]


def test_strip_markers(spark):
    assert values(spark, T.strip_word_marker, [("world*,", "*"), ("Hough12.", "12"), ("Hough².", "2")]) == ["world,", "Hough.", "Hough."]
    assert values(spark, T.strip_note_marker, [("(1)", "1"), ("*Hough", "*"), ("The", "1")]) == ["", "Hough", "The"]


def test_confusions(spark):
    found = values(spark, lambda a: F.transform(T.confusions(a), lambda c: c["candidate"]), ["modem", "Egyptlans"])
    assert {"rnodem", "modern"} <= set(found[0]) and "Egyptians" in found[1]


def test_early_modern(spark):
    found = values(spark, T.early_modern, ["vnto", "haue", "warre", "sunne", "musicke", "iustice", "poore", "shew"])
    for modern, variants in zip(["unto", "have", "war", "sun", "music", "justice", "poor", "show"], found, strict=True):
        assert modern in variants


def test_roman(spark):
    assert values(spark, N.roman_value, ["xvii", "MDCCCXXXIX", "CLXXXVIIII", "did", "1839"]) == [17, 1839, None, None, None]
    assert values(spark, N.roman_old, ["CLXXXVIIII", "iiii", "viiii", "iiiiii", "vv"]) == [189, 4, 9, None, None]
    assert values(spark, N.to_roman, [1839, 49]) == ["mdcccxxxix", "xlix"]
    info = values(spark, N.roman_info, ["xvii.", "CLXXXVIIII", "IL", "did", "1839", "Vii"])
    assert (info[0].value, info[1].value, info[1].standard) == (17, 189, "CLXXXIX")
    assert info[2].readings == "II=2, LI=51" and info[3] is None and info[4] is None
    assert info[5].standard == "VII"


def test_ranges_and_labels(spark):
    assert values(spark, lambda a: T.scope_label(T.parse_ranges(a)), ["1-50, 60", "x", "", "5-2", "3;4-6"]) == ["1–50, 60", None, None, None, "3, 4–6"]
    assert values(spark, T.format_bytes, [512, 2048, 5 << 20, 3 << 30]) == ["512 B", "2 KB", "5 MB", "3.0 GB"]
    assert values(spark, T.clip, ["x" * 40, "y" * 41]) == ["x" * 40, "y" * 39 + "…"]
    assert values(spark, T.xml_escape, ['<a & "b">']) == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert values(spark, T.extract_json, ['so: {"a": [1]} end', "none"]) == ['{"a": [1]}', None]


def test_scope_merge(spark):
    rows = [("a", 10, 20), ("a", 1, 5), ("a", 6, 8), ("a", 19, 25), ("a", 600, 700)]
    got = sets.merge_ranges(spark.createDataFrame(rows, "k string, lo int, hi int"), 529, "k").orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in got] == [(1, 8), (10, 25)]


def grammar(spark, sentence):
    rows = [(1, i, w, " ") for i, w in enumerate(sentence.split(" "))]
    flags = sequences.grammar_flags(spark.createDataFrame(rows, "page_index long, seq long, text string, trailing string"))
    return [(r.seq, r.rule, r.fix) for r in flags.orderBy("seq").collect()]


def test_grammar(spark):
    assert grammar(spark, "of the land. and is") == [(3, "capital", "And")]
    assert grammar(spark, "of the the sect") == [(2, "repeated", "the")]
    assert grammar(spark, "dignity,or rank") == [(0, "after_punct", "dignity, or")]
    assert grammar(spark, "a clean sentence. Another vol. iii. c. 31") == []


def test_geometry(spark):
    row = spark.range(1).select(G.rect(0.0, 0.0, 10.0, 10.0).alias("a"), G.rect(5.0, 5.0, 10.0, 10.0).alias("b"))
    got = row.select(G.overlap_fraction(F.col("a"), F.col("b")).alias("f"), G.union(F.col("a"), F.col("b")).alias("u"), G.to_points(G.to_pixels(G.rect(30.0, 40.0, 50.0, 60.0), 300.0, 10.0, 20.0), 300.0, 10.0, 20.0).alias("p")).first()
    assert got.f == 0.25 and tuple(got.u) == (0, 0, 15, 15)
    assert tuple(round(x, 6) for x in got.p) == (30, 40, 50, 60)


def test_tsv(spark):
    text = ["level\tpage_num", "2\t1\t1\t0\t0\t0\t10\t10\t90\t90\t-1\t", "4\t1\t1\t1\t1\t0\t10\t10\t90\t20\t-1\t", "5\t1\t1\t1\t1\t1\t10\t10\t40\t20\t96.5\tTarshish.", "5\t1\t1\t1\t1\t2\t60\t10\tbad\t20\t90\tand", "5\t1\t1\t1\t1\t3\t60\t10\t1\t20\t-1\t", "5\t1"]
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    words = readers.parse_tsv_words(lines).orderBy("word_num").collect()
    assert [(w.text, w.conf, w.width) for w in words] == [("Tarshish.", 96.5, 40.0), ("and", 90.0, 0.0)]
    assert [r.word_count for r in readers.parse_tsv_lines(lines).collect()] == [2]


def test_affixes(spark):
    rules = readers.read_affix_rules("SFX S Y 1\nSFX S y ies [^aeiou]y\nPFX U Y 1\nPFX U 0 un .\n")
    words = readers.expand_dictionary(spark.createDataFrame([("﻿city/S",), ("do/U",), ("toy/S",), ("",)], "value string"), rules)
    assert sorted(r.word for r in words.collect()) == ["cities", "city", "do", "toy", "undo"]


def test_next_issue_wraps_and_never_returns_itself(spark):
    rows = [(1, 1, 0, 10, 50), (1, 2, 0, 11, 90), (2, 1, 0, 12, 70)]
    df = spark.createDataFrame(rows, "page_index long, seq long, created_at long, issue_id long, priority long")
    at = lambda k: dict(zip(df.columns, rows[k], strict=True))
    step = lambda k, **o: [(r.issue_id, r.wrapped) for r in issues.next_issue(df, at(k), **o).collect()]
    assert step(0) == [(11, False)] and step(2) == [(10, True)] and step(0, forward=False) == [(12, True)]
    assert step(1, by_priority=True) == [(12, False)] and step(0, by_priority=True) == [(11, True)]
    assert issues.next_issue(df.where("issue_id = 10"), at(0)).collect() == []


def test_unscored_issues_pass_every_threshold(spark):
    df = spark.createDataFrame([(None, "open"), (39, "open"), (40, "open"), (1, "deferred")], "score long, status string").withColumn("candidate_source", F.lit("x")).withColumn("kind", F.lit("y"))
    assert [r.score for r in df.where(issues.matches(40)).collect()] == [None, 39]


def test_clusters_join_transitively(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 14.0, 2.0, 10.0, 10.0), (1, 2, 28.0, 4.0, 10.0, 10.0), (1, 3, 60.0, 0.0, 10.0, 10.0), (2, 0, 0.0, 0.0, 5.0, 5.0)]
    got = layout.clusters(spark.createDataFrame(rows, "page_index long, seq long, x double, y double, w double, h double"), 6.0).collect()
    assert {(r.page_index, r.seq): r.cluster for r in got} == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (2, 0): 0}


def test_latest_ignores_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 3, "c"), (1, 1, "a"), (2, 1, "z")], "k int, n int, t string")
    assert sorted(map(tuple, state.latest(df, ["k"], ["n"]).collect())) == [(1, 3, "c"), (2, 1, "z")]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=9), st.lists(st.text("abc", min_size=1, max_size=4), max_size=9))
def test_fit_keeps_every_typed_word(old, new):
    out = edits.fit(old, new)
    assert len(out) == len(old)
    assert " ".join(x for x in out if x).split() == new


@pytest.mark.parametrize("old, new, out", [(["the", "cat"], ["the", "cat"], ["the", "cat"]), (["tbe", "cat"], ["the", "cat"], ["the", "cat"]), (["to", "day"], ["today"], ["today", ""]), (["today"], ["to", "day"], ["to day"])])
def test_fit(old, new, out):
    assert edits.fit(old, new) == out
