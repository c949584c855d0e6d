"""Run events as a stream: progress, backlog state, heartbeats."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.sources.storage import shared_dir

#: Seconds without a heartbeat after which a lock may be taken.
STALE_AFTER = 60


def read_events(spark: SparkSession, folder: str, table: str = "events", files_per_trigger: int = 4) -> DataFrame:
    """The event table as a file stream; back-pressure by files per trigger."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{table}*.parquet").parquet(folder)


def run_updates(events: DataFrame) -> DataFrame:
    """stage, status, elapsed_ms, ts of each event, with a watermark on its time."""
    stage = F.when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "click", "layout").when(F.col("event_type") == "signup", "text").when(F.col("event_type") == "purchase", "export").otherwise("ai")
    status = F.element_at(F.array(*map(F.lit, ("ok", "ok", "failed", "ok", "running"))), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select("event_id", stage.alias("stage"), status.alias("status"), F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"), (F.col("event_id") % 200).alias("page_index"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")


def progress(updates: DataFrame) -> DataFrame:
    """Running totals per stage: a keyed aggregate, for update mode."""
    return updates.groupBy("stage").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "running").alias("running"), F.sum(F.when(F.col("status") != "running", F.col("elapsed_ms")).otherwise(0)).alias("elapsed_ms"),
    )


def windowed(updates: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Units and time per stage and window of event time; late events beyond the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return updates.groupBy(window, "stage").agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("elapsed_ms")).select(F.col("window.start").alias("start"), "stage", "n", "elapsed_ms")


def page_states(updates: DataFrame) -> DataFrame:
    """The last status of every page, kept as state per page and emitted when it changes."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, status, seen = state.get if state.exists else (-1, "", 0)
        for pdf in batches:
            seen += len(pdf)
            top = pdf.loc[pdf.event_id.idxmax()]
            if top.event_id > last:
                last, status = int(top.event_id), str(top.status)
        state.update((last, status, seen))
        yield pd.DataFrame({"page_index": [key[0]], "event_id": [last], "status": [status], "seen": [seen]})

    out = "page_index long, event_id long, status string, seen long"
    return updates.groupBy("page_index").applyInPandasWithState(fold, out, "last long, status string, seen long", "update", GroupStateTimeout.NoTimeout)


def stale_locks(beats: DataFrame, now: str, key: str = "user_id") -> DataFrame:
    """Holders whose last heartbeat lies more than a minute before ``now``."""
    last = beats.groupBy(key).agg(F.max("ts").alias("last"))
    return last.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp")) > STALE_AFTER)


def run_once(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there and give its result (for tests and batch queries).

    Appended rows go to Parquet files in the shared folder; keyed states (update, complete), a row a key and batch, to a memory table.
    """
    name = f"stream_{uuid.uuid4().hex}"
    spark = stream.sparkSession
    where = (checkpoint or shared_dir(spark)).rstrip("/")
    if mode == "append":
        append_to(stream, f"{where}/{name}-rows", f"{where}/{name}").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{where}/{name}-rows")
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{where}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """A resumable sink: offsets and committed files are in the checkpoint, so a restart repeats no event."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def restarted(stream: DataFrame) -> DataFrame:
    """The rows of a resumable sink that was run, stopped and started again from its checkpoint: each event once."""
    spark, name = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    path, checkpoint = f"{shared_dir(spark)}/{name}-rows", f"{shared_dir(spark)}/{name}"
    for _ in range(2):
        query = append_to(stream, path, checkpoint)
        query.awaitTermination()
        query.stop()
    return spark.read.schema(stream.schema).parquet(path)
