"""The book's state: latest rows, next states of writes, approvals, history.

Writes are events; a table's present state is a fold over them, so nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDOABLE = ("decision", "group", "edit", "approve", "paragraph")


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the largest version; partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, *(F.col("_row")[c].alias(c) for c in rest))


def approval() -> Column:
    known = F.col("approved_text").isNotNull() & F.col("approved_layout").isNotNull()
    same = (F.col("approved_text") == F.col("text_revision")) & (F.col("approved_layout") == F.col("layout_revision"))
    return F.when(~known, "none").when(same, "current").otherwise("outdated")


def in_process(status: Column) -> Column:
    return ~status.isin("unprocessed", "excluded")


def recent_history(history: DataFrame, limit: int) -> DataFrame:
    top = history.orderBy(F.desc("ts"), F.desc("history_id")).limit(limit)
    kind = F.get_json_object("payload", "$.kind")
    return top.select("history_id", "ts", kind.alias("kind"), F.get_json_object("payload", "$.page").cast("long").alias("page"), kind.isin(*UNDOABLE).alias("undoable"), "undone", "payload")


def catalog_status(catalog: DataFrame, found: DataFrame, key: str) -> DataFrame:
    have = found.select(F.col(key).alias("_key"), F.col("checksum").alias("_have"))
    status = F.when(F.col("_key").isNull(), "missing").when(F.col("_have") == F.col("checksum"), "verified").otherwise("corrupt")
    return catalog.join(have, F.col(key) == F.col("_key"), "left").select(key, status.alias("status"))


def put_layout(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """A manual layout stays unless forced; a written one gets the next revision."""
    new = fresh.select(F.col("page_index").alias("_page"), F.col("regions").alias("_regions"), "force")
    written = F.col("_page").isNotNull() & (~F.coalesce("manual", F.lit(False)) | F.col("force"))
    joined = stored.join(new, F.col("page_index") == F.col("_page"), "full_outer").withColumn("written", F.coalesce(written, F.lit(False)))
    return joined.select(F.coalesce("page_index", "_page").alias("page_index"), F.when(F.col("written"), F.col("_regions")).otherwise(F.col("regions")).alias("regions"), (F.coalesce("revision", F.lit(0)) + F.col("written").cast("long")).alias("revision"), "written")


def save_layout(regions: DataFrame, page_w: float = 612.0, page_h: float = 792.0) -> DataFrame:
    """Boxes cut to the page, empty ones gone, order dense."""
    x0, y0 = F.greatest("x", F.lit(0.0)), F.greatest("y", F.lit(0.0))
    x1, y1 = F.least(F.col("x") + F.col("w"), F.lit(page_w)), F.least(F.col("y") + F.col("h"), F.lit(page_h))
    rest = [c for c in regions.columns if c not in ("x", "y", "w", "h")]
    cut = regions.select(*rest, x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).where("w > 0 AND h > 0")
    order = F.row_number().over(Window.partitionBy("page_index").orderBy("region_order")) - 1
    return cut.withColumn("region_order", order.cast("long")).withColumn("manual", F.lit(True))


def import_pages(source: DataFrame, scope: list[tuple[int, int]]) -> DataFrame:
    """A row for each page of ``source`` (page_index); ``scope``: inclusive ranges, counted from 1."""
    inside = F.lit(False)
    for lo, hi in scope:
        inside = inside | (F.col("page_index") + 1).between(lo, hi)
    return source.select("page_index", F.when(inside, "queued").otherwise("unprocessed").alias("status"))


def export_log(exports: DataFrame) -> DataFrame:
    """One record a path, in lower case with forward slashes: the last export."""
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    return exports.groupBy(path.alias("path")).agg(F.max("export_id").alias("export_id"), F.count("*").alias("replaced"))


def replace_page_text(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposals after the text of ``pages`` was replaced: open ones go, decided ones are stale."""
    touched = pages.select("page_index", F.lit(True).alias("_touched"))
    joined = proposals.join(touched, "page_index", "left").withColumn("_touched", F.coalesce("_touched", F.lit(False)))
    kept = joined.where(~(F.col("_touched") & F.col("status").isin("open", "applied_auto")))
    stale = F.col("_touched") & F.col("status").isin("accepted", "rejected", "deferred")
    return kept.withColumn("status", F.when(stale, "stale").otherwise(F.col("status"))).drop("_touched")


def set_scope(pages: DataFrame, scope: list[tuple[int, int]]) -> DataFrame:
    """Unprocessed pages inside the scope are queued, queued ones outside unprocessed; results stay."""
    inside = F.lit(False)
    for lo, hi in scope:
        inside = inside | (F.col("page_index") + 1).between(lo, hi)
    status = F.when(inside & (F.col("status") == "unprocessed"), "queued").when(~inside & (F.col("status") == "queued"), "unprocessed").otherwise(F.col("status"))
    return pages.withColumn("status", status)
