"""Exact duplicates by a stateful stream.

Documents are read as a stream. Its state, on disk in RocksDB and checkpointed in the shared folder, is keyed by the digest of the normalised
text (A-Z lower-cased) and holds the stable identifier that stays (the largest doc_id), its content locator (file and row) and how many rows came. No
watermark, so nothing expires: files that come later are held against all before them, and a restart goes on where the last run ended.

A digest that was hit more than once is only a suspicion. The texts of its rows are compared in full with the text at the
locator; copies are first merged where they lie, so a hot text is shuffled once a task. Texts that differ under one digest become groups of their own.

Null text counts as empty; null doc_ids are smaller than any other. Of rows that share the largest doc_id the one latest by file and row
stays. Repeated rows are rows of their own, of which one stays. An empty table gives an empty result. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewise.llm.common import HOT, checked_broadcast, materialize, scratch_path

#: Files of a micro-batch, and megabytes that one executor's state stores share in memory.
FILES, STATE_MB = 10_000, 256
#: What is known of a group: the row that stays, and how many there are.
TOP = ("top_id", "top_file", "top_row", "n")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


Digest = Callable[[Column], Column]


def _located(docs: DataFrame, digest: Digest) -> DataFrame:
    """doc_id, digest, sha, file, row and the normalised text of every row of a table in files; ``digest`` may be a shorter one than SHA-256."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select("doc_id", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"), "file", "row", "text")


def absorb(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, digest: Digest = sha256, files: int = FILES) -> DataFrame:
    """Take all files below ``path`` that ``checkpoint`` hasn't seen into the state; gives the state: digest, top_id, top_file, top_row, n."""
    session = spark.newSession()  # the settings are of this stream alone
    store = "spark.sql.streaming.stateStore"
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        f"{store}.rocksdb.allowFAllocate": "false",  # many small stores must not each reserve megabytes of disk
        f"{store}.rocksdb.boundedMemoryUsage": "true",
        f"{store}.rocksdb.maxMemoryUsageMB": str(STATE_MB),
    }.items():
        session.conf.set(key, value)
    # A pattern for the same path: the source takes a plain path for a folder. No file is too old.
    stream = session.readStream.schema(schema).option("maxFileAge", "36500d").option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    state = _located(stream, digest).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
    query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.recentProgress:  # nothing ever came
        return spark.createDataFrame([], T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("top_id", schema["doc_id"].dataType), T.StructField("top_file", T.StringType()), T.StructField("top_row", T.LongType()), T.StructField("n", T.LongType())]))
    return spark.read.format("statestore").load(checkpoint).select("key.digest", *_flat(F.col("value.max")), F.col("value.count").alias("n"))


def _flat(top: Column) -> list[Column]:
    return [top["doc_id"].alias("top_id"), top["file"].alias("top_file"), top["row"].alias("top_row")]


def impostors(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """digest, text: texts that aren't the one at their digest's locator. Whole texts are compared, copies once a task."""
    kept = (F.col("file") == F.col("top_file")) & (F.col("row") == F.col("top_row"))
    suspects = rows.join(checked_broadcast(hits.select("digest", "top_file", "top_row")), "digest")
    return suspects.groupBy("digest", "text").agg(F.max(kept).alias("same")).where("NOT same").select("digest", "text")


def _judged(rows: DataFrame) -> DataFrame:
    """The verdicts on rows with the top row and size of their group, which are null for a text that came once."""
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top_id"))
    stays = F.col("n").isNull() | ((F.col("file") == F.col("top_file")) & (F.col("row") == F.col("top_row")))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def verdicts(docs: DataFrame, state: DataFrame, digest: Digest = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``, a table in files that ``state`` has seen."""
    rows = _located(docs, digest)
    hits = materialize(state.where("n > 1"), "hits")
    odd = materialize(impostors(rows, hits), "impostors")
    plain = rows.drop("text")
    if not odd.isEmpty():
        doubtful = checked_broadcast(materialize(odd.select("digest").distinct(), "doubtful"))
        split = rows.join(doubtful, "digest", "left_semi")
        own = split.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
        own = materialize(own.select("digest", "text", *_flat(F.col("top")), "n"), "split")
        told_apart = split.join(own, ["digest", "text"]).select("doc_id", "sha", "file", "row", *TOP)
        plain, hits = plain.join(doubtful, "digest", "left_anti"), materialize(hits.join(doubtful, "digest", "left_anti"), "sure-hits")
    else:
        told_apart = None
    # Digests that over 1/1024 of all rows share are few and broadcast; their rows then spread over the next join.
    total = hits.agg(F.sum("n")).first()[0] or 0
    of = lambda rows, name: rows.select(F.col("digest").alias(f"{name}_digest"), *(F.col(c).alias(f"{name}_{c}") for c in TOP))
    hot = F.broadcast(of(hits.where(F.col("n") > total * HOT), "hot"))
    cold = checked_broadcast(of(hits.where(F.col("n") <= total * HOT), "cold"))
    marked = plain.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    key = F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.encode(F.concat_ws("#", "file", "row"), "utf-8"))
    joined = marked.withColumn("key", key).join(cold, F.col("key") == F.col("cold_digest"), "left")
    found = joined.select("doc_id", "sha", "file", "row", *(F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in TOP))
    return _judged(found if told_apart is None else found.unionByName(told_apart))


def duplicates_below(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Digest = sha256, files: int = FILES) -> DataFrame:
    """The verdicts on every row of the Parquet table at ``path``. With the ``checkpoint`` of an earlier call only new files go through the state."""
    docs = spark.read.parquet(path)
    state = absorb(spark, path, docs.schema, checkpoint or scratch_path(spark, "exact-state"), digest, files)
    return verdicts(docs, materialize(state, "state"), digest)


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """As ``duplicates_below``, of a DataFrame, which is first stored."""
    path = scratch_path(docs.sparkSession, "exact-input")
    docs.select("doc_id", F.col("text").cast("string").alias("text")).write.parquet(path)
    return duplicates_below(docs.sparkSession, path, **options)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
