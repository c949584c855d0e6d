"""Sinks: what they write is stored in the shared folder and read back by whoever continues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.sources.storage import stored


def append_words(words: DataFrame, added: DataFrame) -> DataFrame:
    """``words`` (page_index, seq, text) with ``added`` behind each page's last; numbers of old words stay."""
    last = words.groupBy("page_index").agg((F.max("seq") + 1).alias("_next"))
    rank = F.row_number().over(Window.partitionBy("page_index").orderBy("seq")) - 1
    new = added.select("page_index", "text", rank.alias("_nth")).join(last, "page_index", "left")
    new = new.select("page_index", (F.coalesce("_next", F.lit(0)) + F.col("_nth")).cast("long").alias("seq"), "text")
    return stored(words.select("page_index", "seq", "text").unionByName(new), "words")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def archive(parts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each part as packed JSON lines below ``folder``, and the manifest: part and rows, counted in what was written."""
    spark, rows = next(iter(parts.values())).sparkSession, []
    for name, df in parts.items():
        df.write.option("compression", "gzip").json(f"{folder}/{name}")
        rows.append((name, read_part(df, folder, name).count()))
    manifest = spark.createDataFrame(rows, "part string, rows long")
    manifest.coalesce(1).write.json(f"{folder}/manifest")  # a row a part
    return spark.read.schema("part string, rows long").json(f"{folder}/manifest")


def read_part(like: DataFrame, folder: str, name: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).json(f"{folder}/{name}")


def publish(df: DataFrame, folder: str, name: str, valid: Callable[[DataFrame], bool]) -> DataFrame | None:
    """``df`` as ``folder/name``, all at once: written aside, validated as written, then renamed. None, and nothing left, if it isn't valid.

    A name that is taken is not overwritten.
    """
    spark = df.sparkSession
    partial, final = f"{folder}/.partial-{name}", f"{folder}/{name}"
    files, there = _at(spark, final)
    if files.exists(there):
        raise FileExistsError(final)
    df.write.mode("overwrite").parquet(partial)
    _, aside = _at(spark, partial)
    if not valid(spark.read.schema(df.schema).parquet(partial)):
        files.delete(aside, True)
        return None
    if not files.rename(aside, there):
        raise OSError(f"{partial} could not be renamed to {final}")
    return spark.read.schema(df.schema).parquet(final)
