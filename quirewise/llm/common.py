"""Shared plumbing of the corpus operators: scratch tables, checked broadcasts, Arrow chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.sources.storage import shared_dir

#: A side of a join is broadcast only after its rows and bytes have been counted and are at most these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A key with over this share of all rows is a hot one: there are at most 1/HOT of them, so they're broadcast.
HOT = 1 / 1024

#: Bytes of text that one vectorised step works on at a time.
CHUNK_BYTES = 4 << 20

_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quirewise-{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there.

    A lost executor costs the tasks it ran, not this table. Unlike a checkpoint, later readers
    prune its columns and its size is known to the planner.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for x in paths:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table so far. For callers that have stored their results."""
    _delete(spark, _scratch)
    _scratch.clear()


def settle(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, stored. The intermediate tables that were made before, for it or for what it was built from, are deleted."""
    out = materialize(build(), label)
    _delete(spark, _scratch[:-1])
    del _scratch[:-1]
    return out


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is (shuffled, split by AQE).

    ``df`` should be a materialized narrow table: it is counted here.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, of flat columns, has at most ``limit`` rows and ``most_bytes``; reads no more than that."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
    rows, held = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return rows <= limit and (held or 0) <= most_bytes


def join_unique(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """``left`` joined with ``right``, which has each ``key`` once and, in ``n``, how many of the ``rows`` rows of ``left`` have it.

    Keys that over ``HOT`` of them share are few: they're broadcast, so none meets in one task; the rest is shuffled. ``left`` should be stored: it is read twice.
    """
    hot, cold = right.where(F.col(n) > rows * HOT), right.where(F.col(n) <= rows * HOT)
    apart = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot.drop(n)), key).unionByName(apart.join(cold.drop(n), key))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with equal rows numbered from 0 as ``name``, so that all rows differ.

    Equal rows are summed before the shuffle and unfolded after it in two steps, so no array is long.
    """
    n, step = free_name(df, f"{name}_n"), 1 << 16
    base = free_name(df, f"{name}_base")
    counted = df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias(n))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col(n) / step))).alias(base))
    each = F.sequence(F.col(base) * step, F.least(F.col(n), F.col(base) * step + (step - 1)))
    return parts.select(*df.columns, F.explode(each).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` with about ``most`` bytes of text each; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_slices(batch, column):
            yield batch.slice(lo, hi - lo)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
