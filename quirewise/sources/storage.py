"""Tables stored between steps, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a folder of its own; a cluster gets an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        where = f"file://{tempfile.mkdtemp(prefix='quirewise-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_made: list[str] = []
_tables: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/quirewise-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete all that was stored so far. For callers that have stored their results."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        _delete(spark, _made.pop())


def discard(table: DataFrame) -> None:
    """Delete what ``stored`` gave. For callers that have stored all that is read from it."""
    spark, path = table.sparkSession, table._stored_at
    name = _name(path)
    if name in _tables:
        _tables.remove(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _made.remove(path)
    _delete(spark, path)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all that a folder holds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


#: Shuffle files go when the run that made them ends, instead of when the driver's garbage collector finds them unused.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """``df`` written once and read back: what follows reads the table instead of computing it again, also after a lost executor.

    The shuffles on the way to it are deleted: nothing reads them once the table is there. With ``parts``, into how many parts ``df`` is dealt by page, the table
    stays dealt so (a bucket a part): joins, groups and windows by page move none of its rows.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with _tidy(spark):
        if parts is None:
            df.write.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
        else:
            df.write.bucketBy(parts, "page_index").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(_name(path))
            _tables.append(_name(path))
            out = spark.table(_name(path))
    out._stored_at = path
    return out


def dealt(df: DataFrame, parts: int | None) -> DataFrame:
    """``df`` shuffled by page into ``parts``, for small tables that are stored beside those that are dealt so; as it is without ``parts``."""
    return df if parts is None else df.repartition(parts, "page_index")


#: What is broadcast at most: rows, and bytes of their strings and numbers.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df``, a stored table of flat columns, marked for broadcast if it is small enough; it is counted here."""
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8) for f in df.schema.fields), F.lit(0))
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else df
