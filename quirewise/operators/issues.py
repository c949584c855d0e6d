"""The issue inbox: filters, priorities, building, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.operators.state import in_process

#: Priorities of structural issues.
FIXED_PRIORITY = {"flag": 95, "missing_text": 90, "order_ambiguity": 85, "clipping": 80}
#: Kinds that are ranked as joins and as readings: those of proposals and those of issues built from them.
JOINS, READINGS = ("hyphen_join", "questionable_join"), ("low_confidence", "conflicting_readings")


def div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def priority(kind: Column, score: Column, original: Column) -> Column:
    """0 to 100: unsure and longer words come first; without a score, half sure."""
    unsure = F.greatest(F.lit(0), 100 - F.coalesce(score, F.lit(50)))
    length = F.least(F.lit(12), F.length(F.regexp_replace(original, r"[^\p{L}\p{N}]", "")))
    out = F.when(kind.isin(*JOINS), 55 + div(unsure, 5) + length).when(kind.isin(*READINGS), 20 + div(unsure, 3) + length).otherwise(45 + div(unsure, 5) + length)
    for k, n in FIXED_PRIORITY.items():
        out = F.when(kind == k, F.lit(n)).otherwise(out)
    return F.least(F.lit(100), out).cast("long")


def in_scope(issues: DataFrame, pages: DataFrame) -> DataFrame:
    return issues.join(pages.where(in_process(F.col("status"))).select("page_index"), "page_index", "left_semi")


def matches(threshold: int, deferred: bool = False, ai_only: bool = False, excluded: tuple[str, ...] = ()) -> Column:
    """The working set: status, then score below the threshold or none; with ``ai_only`` any AI candidate instead."""
    shown = F.col("status") == ("deferred" if deferred else "open")
    wanted = F.startswith("candidate_source", F.lit("AI ")) if ai_only else F.col("score").isNull() | (F.col("score") < threshold)
    return shown & wanted & (~F.col("kind").isin(*excluded) if excluded else F.lit(True))


def working_set(issues: DataFrame, pages: DataFrame, **options) -> DataFrame:
    return in_scope(issues.where(matches(**options)), pages)


def counts(issues: DataFrame, pages: DataFrame, threshold: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """All counts of the inbox in one pass."""
    scoped, open_ = in_scope(issues, pages), F.col("status") == "open"
    low = F.col("score").isNull() | (F.col("score") < threshold)
    hidden = F.col("kind").isin(*excluded)
    return scoped.agg(
        F.count_if(open_).alias("unresolved"), F.count_if(open_ & low & ~hidden).alias("matching"), F.count_if(open_ & ~low).alias("above_threshold"), F.count_if(open_ & low & hidden).alias("filtered_kind"),
        F.count_if(F.col("status") == "deferred").alias("deferred"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(open_ & (F.col("kind") == "flag")).alias("flagged"),
    )


def page_counts(issues: DataFrame, threshold: int) -> DataFrame:
    open_ = F.col("status") == "open"
    shown = F.col("score").isNull() | (F.col("score") < threshold)
    return issues.groupBy("page_index").agg(F.count_if(open_).alias("open"), F.count_if(open_ & shown).alias("shown"), F.count_if(F.col("status") == "deferred").alias("deferred"))


READING = ["page_index", "seq", "created_at", "issue_id"]


def next_issue(issues: DataFrame, anchor: dict, forward: bool = True, by_priority: bool = False) -> DataFrame:
    """The next issue after ``anchor`` (values of the order's columns), else the first, marked as wrapped. Never the anchor itself.

    Two top-1 searches over the filtered set; nothing is sorted whole.
    """
    keys = (["-priority"] if by_priority else []) + READING
    value = lambda k: -F.col(k[1:]) if k[0] == "-" else F.col(k)
    at = F.struct(*(F.lit(-anchor[k[1:]] if k[0] == "-" else anchor[k]).cast("long") for k in keys))
    here = F.struct(*(value(k).cast("long") for k in keys))
    order = [value(k).asc() if forward else value(k).desc() for k in keys]
    others = issues.where(F.col("issue_id") != anchor["issue_id"])
    ahead = others.where(here > at if forward else here < at).orderBy(*order).limit(1).withColumn("wrapped", F.lit(False))
    around = others.orderBy(*order).limit(1).withColumn("wrapped", F.lit(True))
    return ahead.union(around).orderBy("wrapped").limit(1)


def navigation(issues: DataFrame) -> DataFrame:
    """Every issue's successor in reading order within its page; the batch form of ``next_issue``."""
    order = Window.partitionBy("page_index").orderBy("seq", "created_at", "issue_id")
    return issues.select("page_index", "issue_id", F.lead("issue_id").over(order).alias("next_id"), F.lag("issue_id").over(order).alias("previous_id"))


def lead_proposals(proposals: DataFrame) -> DataFrame:
    """The proposal that leads each span: the highest score, the earlier one of equals."""
    best = F.min_by(F.struct("proposal_id", "kind", "score", "replacement"), F.struct(-F.col("score"), "nth"))
    return proposals.groupBy("span_id").agg(best.alias("_p")).select("span_id", "_p.*")


def candidate_meta(reason: Column) -> tuple[Column, Column]:
    """Where a proposal comes from, as shown, and whether its score is one of the word. ``[label]`` before the reason names an outside source."""
    tagged, unscored = F.startswith(reason, F.lit("[")) & F.contains(reason, F.lit("]")), F.contains(reason, F.lit("no word score"))
    label = F.when(tagged, F.regexp_extract(reason, r"^\[([^\]]*)\]", 1)).when(unscored, "second engine").when(F.contains(reason, F.lit("region OCR")), "region OCR").otherwise("text pass")
    return label, ~tagged & ~unscored


def build(spans: DataFrame, proposals: DataFrame, least: int = 90) -> DataFrame:
    """One issue a word of a region: the best open proposal (page_index, span_id, proposal_id, nth, kind, score, replacement, reason, status) leads and
    all are listed, best first, then the word as read; without any, a recognised word of low confidence is an issue of its own.

    ``candidates``: array<struct<text, score, source, proposal>>, scores null for sources without word scores. A word's proposals meet in one
    sorted array: a few, made from that word.
    """
    label, scored = candidate_meta(F.col("reason"))
    entry = F.struct((-F.col("score")).alias("rank"), "nth", "kind", "reason", scored.alias("scored"), F.struct(F.col("replacement").alias("text"), F.when(scored, F.col("score")).cast("long").alias("score"), label.alias("source"), F.col("proposal_id").alias("proposal")).alias("shown"))
    ranked = proposals.where("status = 'open'").groupBy("page_index", "span_id").agg(F.sort_array(F.collect_list(entry)).alias("_ranked"))
    words = spans.where("region_kind IS NOT NULL").select("page_index", "seq", "span_id", "revision", "text", "confidence", "origin", "protected")
    b = words.join(ranked, ["page_index", "span_id"], "left").withColumn("_lead", F.get("_ranked", F.lit(0)))
    offered, lead = F.col("_lead").isNotNull(), lambda name: F.col("_lead")[name]
    low = (F.col("confidence") < least) & F.col("text").rlike(r"[\p{L}\p{N}]") & (F.col("origin") == "ocr") & ~F.col("protected")
    b = b.where(offered | low)
    sure = F.round("confidence").cast("long")
    kind = F.when(offered & (lead("kind") == "hyphen_join"), "questionable_join").when(offered & lead("scored"), "risky_substitution").otherwise("conflicting_readings")
    score = F.when(offered, lead("shown")["score"]).otherwise(sure)
    raw = F.struct(F.col("text").alias("text"), sure.alias("score"), F.lit("raw OCR").alias("source"), F.lit(None).cast("long").alias("proposal"))
    listed = F.concat(F.coalesce(F.transform("_ranked", lambda p: p["shown"]), F.array().cast("array<struct<text:string,score:bigint,source:string,proposal:bigint>>")), F.array(raw))
    poor = F.concat(F.lit("read with a confidence of "), sure.cast("string"), F.lit(", nothing better known"))
    return b.select(
        "page_index", "seq", "span_id", "revision", kind.alias("kind"), score.alias("score"), F.when(offered, lead("shown")["source"]).otherwise("OCR").alias("score_source"), priority(kind, score, F.col("text")).alias("priority"),
        lead("shown")["proposal"].alias("proposal_id"), F.col("text").alias("original"), lead("shown")["text"].alias("replacement"), F.coalesce(lead("reason"), poor).alias("reason"), listed.alias("candidates"),
    )


#: What ink without words must be like to be shown as missing text, and how near the page's edge words are cut off.
LINE_LIKE, PAGE_EDGE, CLIP_EDGE = "h BETWEEN 3 AND 40 AND w >= 12", 4.0, 2.0


def structural(regions: DataFrame, uncovered: DataFrame, spans: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """page_index, kind, original, priority, region_id: ink without words, regions with words at the page's edge, and regions of uncertain class
    with words, whose place in the reading order is unsure.

    ``regions``: region_id and box; ``spans``: region_id (null outside all) and box; ``uncovered``: boxes.
    """
    near = lambda edge: (F.col("x") <= edge) | (F.col("y") <= edge) | (F.col("x") + F.col("w") >= page_w - edge) | (F.col("y") + F.col("h") >= page_h - edge)
    inside = (F.col("x") >= PAGE_EDGE) & (F.col("y") >= PAGE_EDGE) & (F.col("x") + F.col("w") <= page_w - PAGE_EDGE) & (F.col("y") + F.col("h") <= page_h - PAGE_EDGE)
    worded = spans.where("region_id IS NOT NULL").groupBy("page_index", "region_id").agg(F.bool_or(near(CLIP_EDGE)).alias("_clipped"))
    shown = regions.where(~F.col("kind").isin("ignore", "illustration")).join(worded, ["page_index", "region_id"])

    def row(of: DataFrame, kind: str, region: Column) -> DataFrame:
        place = F.concat(F.lit(f"{kind}@"), F.round("x").cast("long").cast("string"), F.lit(","), F.round("y").cast("long").cast("string"))
        return of.select("page_index", F.lit(kind).alias("kind"), place.alias("original"), F.lit(FIXED_PRIORITY[kind]).cast("long").alias("priority"), region.alias("region_id"))

    out = row(uncovered.where(LINE_LIKE).where(inside), "missing_text", F.lit(None).cast("long"))
    return out.union(row(shown.where("_clipped"), "clipping", F.col("region_id"))).union(row(shown.where("kind = 'uncertain'"), "order_ambiguity", F.col("region_id")))


def carry_over(fresh: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Old decisions on fresh issues with the same key, each used once and in order: ranks within the key are joined."""
    order = lambda d: F.row_number().over(Window.partitionBy("page_index", *key).orderBy("seq", "issue_id"))
    a = fresh.withColumn("_n", order(fresh))
    b = old.withColumn("_n", order(old)).select("page_index", *key, "_n", F.col("decision").alias("carried"))
    return a.join(b, ["page_index", *key, "_n"], "left").drop("_n")
