"""What larger tables ask for: bounded passes, no rows held by the driver, numbers beyond 64 bits."""

from __future__ import annotations

import os

import pytest

import quirewise.plans
from quirewise.operators import reconstruct, spelling
from quirewise.plans import registry
from quirewise.sources import storage

DATA = "/root/testdata/sf0.001"


def shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for d in top for _, _, names in os.walk(d) for f in names)


def near(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggest_in_passes(spark, monkeypatch):
    """Many passes, a length in parts among them, find what comparing all pairs does."""
    monkeypatch.setattr(spelling, "PASS_KEYS", 1)
    known = ["hand", "hands", "candle", "handsome", "unhandsomenesses", "kaleidoscopically", "kaleidoscopicallyy", "a"]
    asked = ["hnad", "hannd", "candel", "Candlex", "candlx", "andle", "handsom", "unhandsomenesse", "kaleidoscopicaly", "kaleidoskopicallyyy", "candle"] + [f"candl{x}" for x in "bcdfghijkm"]
    lexicon = spark.createDataFrame([(w,) for w in known], "token string")
    few = lexicon.where("token = 'hand'")
    passes = spelling._passes(spark.createDataFrame([(w.lower(),) for w in asked], "_w string"), few.withColumnRenamed("token", "suggestion"), 2, 1)
    assert any(parts > 1 for _, parts in passes)
    got = {tuple(r) for r in spelling.suggest(spark.createDataFrame([(w,) for w in asked], "token string"), lexicon, lexicon).collect()}
    assert got == {(a, b, near(a.lower(), b)) for a in asked if a.lower() not in known for b in known if near(a.lower(), b) <= 2}


def test_stored_leaves_no_shuffles(spark):
    """The shuffles of a stored table are gone once it is stored."""
    before = shuffle_files(spark)
    out = storage.stored(spark.range(1000).repartition(7, "id").groupBy("id").count(), "tidy")
    assert shuffle_files(spark) <= before
    assert out.count() == 1000


def test_bytes_beyond_64_bits(spark, tmp_path):
    """Ids whose cubes leave 64 bits are formatted like the others."""
    import __spark_entry__ as entry

    ids = [0, 5, 600_000, 700_000, 6_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = dict(entry.queries()["fn_format_bytes"](spark, str(tmp_path)).collect())
    tenths = {i: (i**3 * 37 * 20 + (1 << 30)) // (1 << 31) for i in ids}
    assert got == {0: "0 B", 5: "5 KB"} | {i: f"{tenths[i] // 10}.{tenths[i] % 10} GB" for i in ids[2:]}


def test_every_numeral(spark):
    """All numbers that have a numeral, not only those that a small table's pages bear."""
    import __spark_entry__ as entry

    rows = {r.n: r for r in entry.queries()["fn_to_roman"](spark, DATA).collect()}
    assert sorted(rows) == list(range(1, 4000)) and rows[3999].numeral == "mmmcmxcix"
    assert sum(r.pages for r in rows.values()) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_equal_ranges_merge(spark):
    """Many equal ranges a book give the plain union, in whatever order they come."""
    from quirewise.operators import sets

    ranges = [(b, lo, lo + lo % 7) for b in range(3) for lo in range(-5, 300, 9 + b) for _ in range(40)]
    got = {tuple(r) for r in sets.merge_ranges(spark.createDataFrame(ranges, "book long, lo long, hi long").repartition(16), 250, "book").select("book", "lo", "hi").collect()}
    pages = {b: {p for c, lo, hi in ranges if c == b for p in range(max(lo, 1), min(hi, 250) + 1)} for b in range(3)}
    assert got == {(b, lo, min(p for p in range(lo, 252) if p + 1 not in own)) for b, own in pages.items() for lo in own if lo - 1 not in own}


def test_refused_anchors():
    """Each note takes the first free anchor that it doesn't refuse, as when all free ones are gone through; a page of many notes takes no longer a note."""
    import random
    import time

    from quirewise.operators.matching import first_free

    def plainly(notes, anchors):
        free, out = sorted(anchors), []
        for note, no in notes:
            if (at := next((x for x in free if x not in no), None)) is not None:
                free.remove(at)
                out.append((note, at))
        return out

    lots = random.Random(1)
    for _ in range(300):
        anchors = sorted(lots.sample(range(40), lots.randrange(12)))
        notes = [(n, set(lots.sample(range(40), lots.randrange(30)))) for n in range(lots.randrange(12))]
        assert first_free(notes, anchors) == plainly(notes, anchors)
    began = time.perf_counter()
    assert len(first_free([(n, {n}) for n in range(200_000)], list(range(200_000)))) >= 199_999
    assert time.perf_counter() - began < 5


def test_lines_that_tie_have_one_order(spark):
    """Lines at one place rank by their number, however the rows are dealt."""
    from quirewise.operators.sequences import lines_of

    rows = [(1, "body", n, 36.0, 50.0, 12.0, 10.0, f"w{n}") for n in range(40)]
    words = spark.createDataFrame(rows[::-1], "page_index long, region_kind string, line_no long, x double, y double, w double, h double, text string")
    assert [r.line_no for r in lines_of(words.repartition(7, "line_no")).orderBy("rank").collect()] == list(range(40))


def moved(df):
    """Hash shuffles of a plan that have words below them, which are exploded from documents."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    out = []
    for i, line in enumerate(lines):
        if (at := line.find("Exchange hashpartitioning(")) >= 0:
            inside = next((k for k in range(i + 1, len(lines)) if not lines[k][:at].strip(" :+-") == ""), len(lines))
            out += [line] * any("Generate posexplode" in x for x in lines[i + 1 : inside])
    return out


@pytest.mark.parametrize("name", ["op_region_merge", "op_auto_apply", "op_auto_apply_proposals", "val_ai_reply", "jn_best_overlap"])
def test_words_are_joined_where_their_page_is(spark, name):
    """Texts are shuffled by page, not the words made of them, which take some five times as much."""
    quirewise.plans.load()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(registry.QUERIES[name](spark, DATA)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_words_with_their_anchors_stay_where_their_page_is(spark):
    """Joins over page breaks are sought and applied without shuffling the words; of the joins themselves there is one a page."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(registry.QUERIES["op_cross_page_join"](spark, DATA)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_fit_compares_few_words():
    """A long line with words dropped and changed is fitted without comparing most words with most others."""
    from quirewise.operators import edits

    old = ["".join(chr(97 + (7 * i + 3 * j * i + j) % 26) for j in range(2 + i % 7)) for i in range(150)]
    new = [w + "x" if i % 7 == 3 else w for i, w in enumerate(old) if i % 5 != 2]
    edits.distance.cache_clear()
    fitted = edits.fit(old, new)
    asked = edits.distance.cache_info()
    assert asked.hits + asked.misses < 10 * len(old)
    assert fitted == ["" if i % 5 == 2 else w + "x" if i % 7 == 3 else w for i, w in enumerate(old)]
    edits.distance.cache_clear()
    assert edits.fit(old, [w + "x" for w in old]) == [w + "x" for w in old]
    asked = edits.distance.cache_info()
    assert asked.hits + asked.misses <= len(old)


def test_decisions_move_no_words(spark):
    """Words, issues and decisions stay dealt by page as they are stored: decisions shuffle nothing after the documents."""
    import __spark_entry__ as entry

    for name in ("op_decide", "op_decide_issues", "op_decide_proposals", "op_decide_history"):
        df = entry.queries()[name](spark, DATA)
        assert df._jdf.queryExecution().sparkPlan().toString().count("Join") > 0
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_layout_moves_no_ink(spark):
    """Components are clustered and united where they are stored: the rows shuffled to unite them are lines."""
    from quirewise.operators import layout

    boxes = spark.range(40).selectExpr("id % 4 AS page_index", "id AS seq", "CAST(id AS DOUBLE) AS x", "0.0D AS y", "1.0D AS w", "10.0D AS h")
    dealt = storage.stored(boxes.repartition(3, "page_index"), "boxes", 3)
    grouped = layout.clusters(dealt, 6.0, boxed=True)
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in layout.union_boxes(grouped, "page_index", "cluster").select("page_index", "cluster", "count", "x", "w").collect()} == {(p, p, 10, float(p), 37.0) for p in range(4)}


def test_discarded_tables_are_gone(spark):
    """Of two tables of one name the one that is given goes, with its files; the other stays readable."""
    where = lambda df: df._stored_at.removeprefix("file:")
    a, b = (storage.stored(spark.range(n).withColumnRenamed("id", "page_index"), "twice", 2) for n in (3, 5))
    storage.discard(a)
    assert not os.path.exists(where(a)) and os.path.exists(where(b))
    assert b.count() == 5
    storage.release(spark)
    assert not os.path.exists(where(b))


def test_reconstruct_holds_few_words(spark, monkeypatch):
    """Of the tables of words at most two are held at once, and each is dealt by page."""
    held, most = {}, []
    keep, drop = storage.stored, storage.discard

    def stored(df, label, parts=None):
        out = keep(df, label, parts)
        if label in ("words", "placed", "spans", "joined"):
            assert parts, label
            held[out._stored_at] = label
            most.append(len(held))
        return out

    def discard(table):
        held.pop(table._stored_at, None)
        drop(table)

    monkeypatch.setattr(reconstruct, "stored", stored)
    monkeypatch.setattr(reconstruct, "discard", discard)
    quirewise.plans.load()
    registry.QUERIES["op_reconstruct"](spark, DATA).count()
    assert max(most) == 2 and list(held.values()) == ["joined"]


def test_layout_keeps_one_table_of_ink(spark, monkeypatch):
    """Text heights and gutters are found where the words are stored: no shuffle, and no second table of all components."""
    from quirewise.operators import layout
    from quirewise.plans import composites
    from quirewise.sources.views import Views

    v = Views(spark, DATA)
    ink = composites._ink(v.settled(places=True))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan(layout.text_height(ink))
    assert "Exchange hashpartitioning" not in plan(layout.gutters(ink, 5.0))
    labels = []
    monkeypatch.setattr(layout, "stored", lambda df, label, parts=None: labels.append(label) or storage.stored(df, label, parts))
    layout.analyze(ink.where("page_index < 9"), 612.0, 792.0, v.parts)
    assert labels == ["heights", "rules", "gutters", "lines", "classed"]


def test_undo_moves_no_words(spark):
    """All joins with words have the page among their keys: the only shuffle of words is the dealing of their texts."""
    import re

    import __spark_entry__ as entry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["op_undo"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan
    assert not re.findall(r"Exchange hashpartitioning\([^)]*span_id#", plan)
