"""Sinks store what they say, and resume where they stopped."""

import random

import pytest
from pyspark.sql import functions as F

from quirewise.functions import geometry as G
from quirewise.operators import layout
from quirewise.sources import sinks, storage
from quirewise.streaming import progress


def test_publish_all_or_nothing(spark):
    folder, df = storage.new_path(spark, "test"), spark.range(10)
    files, where = sinks._at(spark, folder)
    assert sinks.publish(df, folder, "t", lambda x: x.count() != 10) is None
    assert not files.exists(where) or len(files.listStatus(where)) == 0
    assert sinks.publish(df, folder, "t", lambda x: x.count() == 10).count() == 10
    with pytest.raises(FileExistsError):
        sinks.publish(df, folder, "t", lambda x: True)


def test_appended_words_take_the_next_numbers(spark):
    words = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "page_index long, seq long, text string")
    added = spark.createDataFrame([(1, 7, "x"), (1, 9, "y"), (3, 0, "z")], "page_index long, seq long, text string")
    got = {tuple(r) for r in sinks.append_words(words, added).collect()}
    assert got == {(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (1, 2, "x"), (1, 3, "y"), (3, 0, "z")}


def test_archive_counts_what_it_wrote(spark):
    folder, parts = storage.new_path(spark, "test"), {"a": spark.range(3), "b": spark.range(0)}
    assert {tuple(r) for r in sinks.archive(parts, folder).collect()} == {("a", 3), ("b", 0)}
    assert sinks.read_part(parts["a"], folder, "a").count() == 3


def test_a_restarted_stream_repeats_no_event(spark, tmp_path):
    events = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("event_id"))
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("source", "out", "checkpoint"))
    schema, seen = events(0, 1).schema, []
    for lo, hi in ((0, 50), (50, 80), (80, 80)):
        events(lo, hi).write.mode("append").parquet(source)
        progress.append_to(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
        seen.append(spark.read.parquet(out).count())
    assert seen == [50, 80, 80] and spark.read.parquet(out).distinct().count() == 80


def test_boxes_that_touch_meet_once(spark):
    rng = random.Random(2)
    boxes = [(rng.randrange(2), i, rng.uniform(-50, 900), rng.uniform(-50, 400), rng.uniform(1, 700), rng.uniform(1, 90)) for i in range(120)]
    df = spark.createDataFrame(boxes, "page_index long, i long, x double, y double, w double, h double")
    a, b = layout.celled(df).alias("a"), layout.celled(df).alias("b")
    got = sorted(tuple(r) for r in a.join(b, layout.touching("a", "b")).select("a.i", "b.i").collect())
    plain = df.alias("a").join(df.alias("b"), (F.col("a.page_index") == F.col("b.page_index")) & G.intersects(layout.box("a"), layout.box("b")))
    assert got == sorted(tuple(r) for r in plain.select("a.i", "b.i").collect()) and len(got) > 500
