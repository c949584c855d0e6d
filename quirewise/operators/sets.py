"""Ranges, unions, coverage and parity, error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, total: int, key: str) -> DataFrame:
    """Inclusive ranges (lo, hi) per key, cut to 1..total, overlapping or adjacent ones merged; invalid ones go."""
    cut = ranges.withColumn("lo", F.greatest("lo", F.lit(1))).withColumn("hi", F.least("hi", F.lit(total))).where("lo <= hi")
    order = Window.partitionBy(key).orderBy("lo", "hi")
    so_far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(so_far.isNull() | (F.col("lo") > so_far + 1), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_far", so_far).withColumn("_island", island).groupBy(key, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def known_words(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for more in lists[1:]:
        out = out.union(more)
    return out.distinct()


def coverage_problems(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """How many expected ids were never emitted, and how often one was emitted again."""
    key = expected.columns[0]
    both = expected.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(emitted.select(key, F.lit(0), F.lit(1)))
    per = both.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = per.agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("b") - 1, F.lit(0))), F.lit(0)).alias("twice"))
    return sums.select(F.explode(F.array(F.struct(F.lit("missing").alias("problem"), F.col("missing").alias("n")), F.struct(F.lit("twice").alias("problem"), F.col("twice").alias("n")))).alias("p")).select("p.problem", "p.n")


def first_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per page the first position where two ordered texts differ; pages without a difference have no row."""
    other = b.select("page_index", "seq", F.col("text").alias("_other"))
    return a.join(other, ["page_index", "seq"], "full_outer").where(~F.col("text").eqNullSafe(F.col("_other"))).groupBy("page_index").agg(F.min("seq").alias("first_difference"))


def precision(judged: DataFrame, by: str) -> DataFrame:
    return judged.groupBy(by).agg((F.count_if("ok") / F.nullif(F.count("ok"), F.lit(0))).alias("precision"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """``pairs`` (truth, read) with the edit distance over characters, and over words, by truth's length.

    Words become characters of a private alphabet, in order of first sight, so one distance serves both.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    alphabet = F.array_distinct(F.concat(words("truth"), words("read")))
    spelt = lambda c: F.array_join(F.transform(words(c), lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position("_words", w).cast("long") + 0x4E00), 4, "0")), "UTF-16BE")), "")
    rated = pairs.withColumn("_words", alphabet).withColumn("_a", spelt("truth")).withColumn("_b", spelt("read"))
    wer = F.levenshtein("_a", "_b") / F.nullif(F.length("_a"), F.lit(0))
    return rated.withColumn("cer", F.levenshtein("truth", "read") / F.nullif(F.length("truth"), F.lit(0))).withColumn("wer", wer).drop("_words", "_a", "_b")
