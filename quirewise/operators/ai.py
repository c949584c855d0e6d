"""Suggestions from language models: prices, spending, validation of replies, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.operators.pipeline import cost


def catalog(spark: SparkSession) -> DataFrame:
    """An example catalog: id, prices in dollars per million tokens, the date from which they hold."""
    rows = [("model-a", 2.0, 8.0, "2020-01-01"), ("model-a", 4.0, 16.0, "2024-01-16"), ("model-b", 1.0, 4.0, "2020-01-01"), ("model-b-mini", 0.5, 2.0, "2020-01-01")]
    return spark.createDataFrame(rows, "id string, price_in double, price_out double, valid_from string")


def priced(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Runs with the prices of the longest catalog id that is their model but for a date suffix, as of the run's day.

    The catalog is configuration, a few rows, and the models that occur are few; both are matched before runs are touched.
    """
    models = runs.select(F.col("model").alias("_model")).distinct()
    suffix = F.substring("_model", F.length("id") + 1, F.length("_model"))
    fits = models.join(prices.select("id").distinct(), F.startswith("_model", F.col("id")) & suffix.rlike("^(?:-[0-9]{4}-?[0-9]{2}-?[0-9]{2})?$"))
    named = fits.groupBy("_model").agg(F.max_by("id", F.length("id")).alias("priced_as"))
    out = runs.join(named, F.col("model") == F.col("_model"), "left").drop("_model")
    day = F.date_format("started_at", "yyyy-MM-dd")
    dated = out.join(prices, (F.col("priced_as") == F.col("id")) & (F.col("valid_from") <= day), "left")
    best = F.max_by(F.struct("price_in", "price_out"), "valid_from").alias("_price")
    return dated.groupBy(*out.columns).agg(best).select(*out.columns, "_price.price_in", "_price.price_out")


def with_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    c = F.col
    return priced(runs, prices).withColumn("cost", cost(c("tokens_in"), c("tokens_out"), c("price_in"), c("price_out"), c("requests")))


def estimate(spans: DataFrame) -> DataFrame:
    """Per page with words: words, bytes with a space each, and about a token for four bytes."""
    size = F.sum(F.octet_length("text") + 1)
    return spans.where("text <> ''").groupBy("page_index").agg(F.count("*").alias("words"), size.alias("chars")).withColumn("tokens", F.floor((F.col("chars") + 3) / 4).cast("long"))


def check_replies(items: DataFrame, words: DataFrame) -> DataFrame:
    """The first rule that each suggested change (batch, nth, id, before, after) breaks, or 'ok'.

    ``words`` (batch, id, text) are those that were sent. Only the first of otherwise valid items for a word is taken.
    """
    sent = words.select("batch", "id", F.col("text").alias("_sent"))
    after, before = F.col("after"), F.col("before")
    letters = F.length(F.regexp_replace(after, r"[^\p{L}]", ""))
    reason = (
        F.when(F.col("_sent").isNull(), "unknown word")
        .when(~before.eqNullSafe(F.col("_sent")), "other text")
        .when(F.coalesce(F.trim(after), F.lit("")) == "", "empty")
        .when(after == before, "unchanged")
        .when(F.size(F.split(F.trim(after), r"\s+")) > 2, "too many words")
        .when(F.length(after) > F.greatest(F.lit(20), F.length(before) + 8), "too long")
        .when(2 * letters < F.length(after), "few letters")
        .otherwise("ok")
    )
    judged = items.join(sent, ["batch", "id"], "left").withColumn("verdict", reason)
    nth = F.row_number().over(Window.partitionBy("batch", "id", "verdict").orderBy("nth"))
    return judged.withColumn("verdict", F.when((F.col("verdict") == "ok") & (nth > 1), "duplicate").otherwise(F.col("verdict"))).drop("_sent")


def check_joins(items: DataFrame, breaks: DataFrame) -> DataFrame:
    """Suggested joins over a page break (page_index, nth, left, right, joined): sent, grounded, a plain join, the first."""
    sent = breaks.select("page_index", F.col("last_word").alias("_l"), F.col("first_word").alias("_r"))
    plain = F.concat("left", "right")
    bare = F.concat(F.regexp_replace("left", "-$", ""), "right")
    reason = F.when(F.col("_l").isNull(), "not sent").when((F.col("left") != F.col("_l")) | (F.col("right") != F.col("_r")), "not grounded").when(~F.col("joined").isin(plain, bare), "not a join").otherwise("ok")
    judged = items.join(sent, "page_index", "left").withColumn("verdict", reason)
    nth = F.row_number().over(Window.partitionBy("page_index", "verdict").orderBy("nth"))
    return judged.withColumn("verdict", F.when((F.col("verdict") == "ok") & (nth > 1), "duplicate").otherwise(F.col("verdict"))).drop("_l", "_r")


def batches(items: DataFrame, group: str, order: str, size: Column, most: int, budget: int) -> DataFrame:
    """``items`` with batch: in order, a batch closes at ``most`` items or before ``budget``; -1 for an item above the budget.

    The running total starts anew with each batch, so each group is folded in order.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, count, held, out = 0, 0, 0, []
        for n in pdf["_size"]:
            if n > budget:
                out.append(-1)
                continue
            if count and (count == most or held + n > budget):
                batch, count, held = batch + 1, 0, 0
            count, held = count + 1, held + n
            out.append(batch)
        return pdf[[group, order]].assign(batch=out)

    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    return items.select(group, order, size.cast("long").alias("_size")).groupBy(group).applyInPandas(fold, f"{group} {types[group]}, {order} {types[order]}, batch long")
