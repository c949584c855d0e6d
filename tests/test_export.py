"""Every check of a written document, once passing and once failing."""

import pytest
from pyspark.sql import functions as F

from quirewise.operators import export

PLAN = [
    (0, 0, 0, 1, "head", "Of Tyre", 2, [1, 2], 0), (0, 1, 1, 1, "body", "The land  was Nineveh", 4, [3, 4, 5, 6], 1), (0, 1, 1, 2, "body", "and more", 2, [7, 8], 0), (0, 1, 2, 1, "side_note", "a note", 2, [9, 10], 0),
    (2, 1, 1, 1, "body", "Second page here", 3, [11, 12, 13], 2), (2, 3, 3, 1, "footer", "foot", 1, [14], 0),
]
TYPES = "page_index long, section long, region_order long, paragraph long, placement string, text string, words long, span_ids array<long>, flags long"


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame(PLAN, TYPES)


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([(0, 1, "see there"), (2, 2, "and  here")], "page_index long, number long, text string")


@pytest.fixture(scope="module")
def joined(spark):
    return spark.createDataFrame([("Nineveh",), ("",)], "text string")


WORKING = export.Settings(working=True, comments=True, drop_caps=True, title="A book")


def verdicts(df):
    return {r.check: (r.ok, r.detail) for r in df.collect()}


@pytest.mark.parametrize("settings", [export.Settings(), WORKING, export.Settings(native=True, title="t"), export.Settings(mirror=False), export.Settings(excluded=("footer",))])
def test_what_is_written_passes(plan, notes, joined, settings):
    paragraphs, parts = export.render(plan, notes, settings)
    found = verdicts(export.validate(paragraphs, parts, plan, notes, joined, settings, 14, 1 if settings.excluded else 0))
    assert len(found) == 14 and all(ok for ok, _ in found.values()), found


def test_each_check_fails_on_its_own(spark, plan, notes, joined):
    paragraphs, parts = (x.cache() for x in export.render(plan, notes, WORKING))
    n = F.col("nth")
    change = lambda column, when, value: paragraphs.withColumn(column, F.when(when, value).otherwise(F.col(column)))
    first = (F.col("page_index") == 0) & (n == 6)
    broken = {
        "structure": (paragraphs, parts.where("part <> 'document'")),
        "frame attributes": (change("attributes", F.col("boxed"), "w:h_space"), parts),
        "side note boxes": (change("boxed", F.col("boxed"), False), parts),
        "text parity": (change("text", first, "and mere"), parts),
        "page boundaries": (change("page_break", F.lit(True), False), parts),
        "linked footnotes": (paragraphs, parts.where("part <> 'footnote' OR name <> '2:2'")),
        "no markers": (change("text", first, "[Page 3] and"), parts),
        "working copy": (change("highlights", F.lit(True), F.lit(0).cast("long")), parts),
        "properties": (paragraphs, parts.where("part <> 'title'")),
        "styles": (paragraphs, parts.withColumn("text", F.when(F.col("part") == "styles", "SideNote").otherwise(F.col("text")))),
        "cross-page words": (change("text", first, "Nineveh and more"), parts),
    }
    for check, (a, b) in broken.items():
        found = verdicts(export.validate(a, b, plan, notes, joined, WORKING, 14, 0))
        assert not found[check][0], check
    assert "first difference on page 0 at paragraph 3: “and more”, “and mere”" in verdicts(export.validate(*broken["text parity"], plan, notes, joined, WORKING, 14, 0))["text parity"][1]
    check = lambda name, *a, **b: verdicts(export.validate(paragraphs, parts, *a, **b))[name]
    assert check("coverage", plan, notes, joined, WORKING, 15, 0) == (False, "14 words and 0 excluded of 15; 0 twice")
    twice = plan.withColumn("span_ids", F.when(F.col("placement") == "footer", F.array(F.lit(3).cast("long"))).otherwise(F.col("span_ids")))
    assert check("coverage", twice, notes, joined, WORKING, 14, 0) == (False, "14 words and 0 excluded of 14; 1 twice")
    assert check("drop caps", plan, notes, joined, WORKING, 14, 0, drop_caps=3) == (False, "2 framed")
    assert check("cross-page words", plan, notes, spark.createDataFrame([("Babel",)], "text string"), WORKING, 14, 0) == (False, "1 not once, as “Babel” 0 times")
    clean = verdicts(export.validate(paragraphs, parts, plan, notes, joined, export.Settings(drop_caps=True), 14, 0))
    assert clean["clean copy"] == (False, "3 highlights, 3 comments")
    native = export.Settings(native=True)
    paragraphs, parts = export.render(plan, notes, native)
    found = verdicts(export.validate(paragraphs, parts.where("part <> 'file' OR name <> 'header0.xml'"), plan, notes, joined, native, 14, 0))
    assert found["heads and feet"] == (False, "1 heads and 1 feet, 1 without a file")


def test_sequences_of_other_lengths(plan, notes, joined):
    settings = export.Settings()
    paragraphs, parts = export.render(plan, notes, settings)
    shorter = paragraphs.where("page_index < 2 OR nth > 2")
    found = verdicts(export.validate(shorter, parts, plan, notes, joined, settings, 14, 0))
    assert found["text parity"][0] is False and found["text parity"][1].startswith("6 planned, 5 read; first difference on page 2 at paragraph 1: “Second page here”, “foot”")
    empty = verdicts(export.validate(paragraphs.where("false"), parts, plan.where("false"), notes.where("false"), joined.where("false"), settings, 0, 0))
    assert empty["text parity"] == (True, "0 paragraphs match") and empty["coverage"][0]
