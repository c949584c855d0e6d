"""Run log, redo decisions, backlog and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.operators.state import approval


def redo_stage(pages: DataFrame, runs: DataFrame, settings: str) -> DataFrame:
    """The stage to run again: none for pages never recognised or approved; recognition when the last
    whole-page settings differ; text when its own settings (after the semicolon) do."""
    ok = runs.where("status = 'ok'")
    last = ok.groupBy("page_index").agg(F.max_by(F.when((F.col("stage") == "ocr") & ~F.col("region_only"), F.col("settings")), F.when((F.col("stage") == "ocr") & ~F.col("region_only"), F.col("run_id"))).alias("_ocr"), F.max_by(F.when(F.col("stage") == "text", F.col("settings")), F.when(F.col("stage") == "text", F.col("run_id"))).alias("_text"))
    own = settings.partition(";")[2]
    text_differs = F.col("_text").isNull() | (F.substring_index("_text", ";", -1) != own)
    redo = F.when(F.col("_ocr").isNull() | (approval() == "current"), "none").when(F.col("_ocr") != settings, "ocr").when(text_differs, "text").otherwise("none")
    return pages.join(last, "page_index", "left").withColumn("redo", redo).drop("_ocr", "_text")


def next_stage(pages: DataFrame) -> DataFrame:
    """The backlog: layout goes before recognition, text after layout."""
    stage = F.when(F.col("ocr_done") & ~F.col("layout_done"), "layout").when(~F.col("ocr_done"), "ocr").when(F.col("layout_done") & ~F.col("text_done"), "text").otherwise("none")
    rank = F.when(stage == "layout", 0).when(stage == "ocr", 1).when(stage == "text", 2).otherwise(3).cast("long")
    return pages.where("status NOT IN ('unprocessed', 'excluded')").select("page_index", stage.alias("stage"), rank.alias("rank"))


def progress(runs: DataFrame) -> DataFrame:
    """Per stage: units, done, failed, running, elapsed; for recognition with three or more finished, the time left."""
    done, failed, running = (F.count_if(F.col("status") == s) for s in ("ok", "failed", "running"))
    elapsed = F.sum(F.when(F.col("status") != "running", F.col("elapsed_ms")).otherwise(0))
    folded = runs.groupBy("stage").agg(F.count("*").alias("total"), done.alias("done"), failed.alias("failed"), running.alias("running"), elapsed.alias("elapsed_ms"))
    finished = F.col("done") + F.col("failed")
    per_unit = F.when((F.col("stage") == "ocr") & (finished >= 3), F.floor(F.col("elapsed_ms") / finished).cast("long"))
    return folded.withColumn("per_unit_ms", per_unit).withColumn("eta_ms", F.col("per_unit_ms") * (F.col("total") - finished))


def cost(tokens_in, tokens_out, price_in, price_out, requests):
    """Price of a run in dollars; none without requests, unknown without a price."""
    return F.when(requests == 0, F.lit(0.0)).otherwise((tokens_in * price_in + tokens_out * price_out) / 1_000_000)
