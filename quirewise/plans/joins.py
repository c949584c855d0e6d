"""Joins: spatial, nearest, first match, adjacent, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirewise.functions import geometry as G
from quirewise.operators import ai, issues, layout, matching
from quirewise.plans.registry import query

_IN = "k.x + k.w / 2 BETWEEN r.x AND r.x + r.w AND k.y + k.h / 2 BETWEEN r.y AND r.y + r.h"
_FIRST = f"""SELECT k.page_index, k.seq, min_by(r.region_id, r.region_order) AS region_id, min_by(r.kind, r.region_order) AS kind
  FROM words k LEFT JOIN regions r ON k.page_index = r.page_index AND {_IN} GROUP BY 1, 2"""


@query("jn_word_region", "SELECT page_index, seq, region_id, kind FROM firsts WHERE kind IS NULL OR kind NOT IN ('ignore', 'illustration')", {"firsts": _FIRST})
def jn_word_region(v):
    return layout.first_region(v.words, v.regions)


_SHIFT = "SELECT page_index, seq, x + 3 AS x, y + 2 AS y, w, h FROM words"
_OVER = "greatest(0, least(a.x + a.w, s.x + s.w) - greatest(a.x, s.x)) * greatest(0, least(a.y + a.h, s.y + s.h) - greatest(a.y, s.y))"


@query(
    "jn_best_overlap",
    f"""SELECT page_index, seq, span_id FROM (SELECT a.page_index, a.seq, s.span_id, {_OVER} / least(a.w * a.h, s.w * s.h) AS o,
      row_number() OVER (PARTITION BY a.page_index, a.seq ORDER BY {_OVER} / least(a.w * a.h, s.w * s.h) DESC, s.seq) AS rn
      FROM shifted a JOIN spans s ON a.page_index = s.page_index AND a.x < s.x + s.w AND s.x < a.x + a.w AND a.y < s.y + s.h AND s.y < a.y + a.h) WHERE rn = 1 AND o >= 0.4""",
    {"shifted": _SHIFT},
)
def jn_best_overlap(v):
    shifted = v.words.select("page_index", "seq", (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"), "w", "h")
    return layout.best_overlap(shifted, v.spans.select("page_index", "seq", "span_id", *"xywh")).select("page_index", "seq", "span_id")


@query("jn_span_proposals", "SELECT s.span_id, count(p.proposal_id) AS n, string_agg(p.replacement, '|' ORDER BY p.proposal_id) AS replacements FROM spans s JOIN proposals p ON s.span_id = p.span_id WHERE p.status <> 'applied_auto' GROUP BY 1")
def jn_span_proposals(v):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("proposal_id", "replacement"))), lambda x: x["replacement"]), "|")
    live = v.proposals.where("status <> 'applied_auto'").groupBy("span_id").agg(F.count("*").alias("n"), listed.alias("replacements"))
    return live.join(v.spans.select("span_id"), "span_id", "left_semi")


@query("jn_span_region_kind", "SELECT s.span_id, r.region_id FROM spans s JOIN regions r ON s.page_index = r.page_index AND s.region_kind = r.kind")
def jn_span_region_kind(v):
    r = v.regions.select("page_index", F.col("kind").alias("region_kind"), "region_id")
    return v.spans.join(r, ["page_index", "region_kind"]).select("span_id", "region_id")


@query("jn_issue_flags", "SELECT s.span_id, i.kind AS flag FROM spans s JOIN (SELECT page_index, seq, max_by(kind, created_at) AS kind FROM issues WHERE status IN ('open', 'deferred') GROUP BY 1, 2) i ON s.page_index = i.page_index AND s.seq = i.seq")
def jn_issue_flags(v):
    last = v.issues.where("status IN ('open', 'deferred')").groupBy("span_id").agg(F.max_by("kind", F.struct("seq", "created_at")).alias("flag"))
    return v.spans.select("span_id").join(last, "span_id")


_FRESH = "SELECT *, row_number() OVER (PARTITION BY page_index, kind, original ORDER BY seq, issue_id) AS n FROM issues"
_OLD = "SELECT *, row_number() OVER (PARTITION BY page_index, kind, original ORDER BY seq, issue_id) AS n FROM issues WHERE decision IS NOT NULL AND seq % 2 = 1"


@query("jn_carry_over", "SELECT f.issue_id, o.decision AS carried FROM fresh f LEFT JOIN old o ON f.page_index = o.page_index AND f.kind = o.kind AND f.original = o.original AND f.n = o.n", {"fresh": _FRESH, "old": _OLD})
def jn_carry_over(v):
    fresh = v.issues.select("page_index", "seq", "issue_id", "kind", "original")
    old = v.issues.where("decision IS NOT NULL AND seq % 2 = 1").select("page_index", "seq", "issue_id", "kind", "original", "decision")
    return issues.carry_over(fresh, old, ["kind", "original"]).select("issue_id", "carried")


@query("jn_flag_survival", "SELECT i.issue_id, min(s.seq) AS seq FROM issues i JOIN spans s ON i.page_index = s.page_index AND i.original = s.text WHERE i.kind = 'flag' AND i.status = 'open' GROUP BY 1")
def jn_flag_survival(v):
    flags = v.issues.where("kind = 'flag' AND status = 'open'").select("page_index", "issue_id", F.col("original").alias("text"))
    first = v.spans.groupBy("page_index", "text").agg(F.min("seq").alias("seq"))
    return flags.join(first, ["page_index", "text"]).select("issue_id", "seq")


_NOTES = "SELECT page_index, seq, CAST(seq % 3 + 1 AS VARCHAR) AS marker FROM words WHERE seq % 11 = 5"
_ANCHORS = "SELECT page_index, seq, CAST(seq % 4 + 1 AS VARCHAR) AS marker FROM words WHERE seq % 7 = 3"


@query(
    "jn_marker",
    "SELECT a.page_index, a.seq AS note, b.seq AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY page_index, marker ORDER BY seq) AS n FROM notes) a JOIN (SELECT *, row_number() OVER (PARTITION BY page_index, marker ORDER BY seq) AS n FROM anchors) b ON a.page_index = b.page_index AND a.marker = b.marker AND a.n = b.n",
    {"notes": _NOTES, "anchors": _ANCHORS},
)
def jn_marker(v):
    """No pair is rejected here; ``matching.link_markers`` handles those too."""
    notes = v.words.where("seq % 11 = 5").select("page_index", "seq", (F.col("seq") % 3 + 1).cast("string").alias("marker"))
    anchors = v.words.where("seq % 7 = 3").select("page_index", "seq", (F.col("seq") % 4 + 1).cast("string").alias("marker"))
    return matching.link_markers(notes, anchors)


@query("jn_marker_rejected")
def jn_marker_rejected(v):
    notes = v.words.where("seq % 11 = 5").select("page_index", "seq", (F.col("seq") % 3 + 1).cast("string").alias("marker"))
    anchors = v.words.where("seq % 7 = 3").select("page_index", "seq", (F.col("seq") % 4 + 1).cast("string").alias("marker"))
    rejected = matching.link_markers(notes, anchors).where("note % 2 = 1")
    return matching.link_markers(notes, anchors, rejected)


@query("jn_nearest_text", "SELECT page_index, seq, new_seq FROM (SELECT o.page_index, o.seq, n.seq AS new_seq, row_number() OVER (PARTITION BY o.page_index, o.seq ORDER BY abs(n.seq - o.seq - 2), n.seq) AS rn FROM spans o JOIN spans n ON o.page_index = n.page_index AND o.text = n.text WHERE o.text <> '') WHERE rn = 1")
def jn_nearest_text(v):
    old = v.spans.where("text <> ''").select("page_index", "seq", "text", (F.col("seq") + 2).alias("at"))
    return matching.nearest_equal(old, v.spans.select("page_index", "text", F.col("seq").alias("new_seq"))).select("page_index", "seq", "new_seq")


@query(
    "jn_nearest_run",
    "SELECT page_index, seq, start FROM (SELECT a.page_index, a.seq, b.seq AS start, row_number() OVER (PARTITION BY a.page_index, a.seq ORDER BY abs(b.seq - a.seq - 5), b.seq) AS rn FROM g a JOIN g b ON a.page_index = b.page_index AND a.run = b.run) WHERE rn = 1",
    {"g": "SELECT page_index, seq, text || ' ' || lead(text) OVER o || ' ' || lead(text, 2) OVER o AS run FROM words WINDOW o AS (PARTITION BY page_index ORDER BY seq)"},
)
def jn_nearest_run(v):
    runs = matching.word_runs(v.page_words, 3).withColumn("at", F.col("seq") + 5)
    return matching.nearest_runs(v.page_words, runs).select("page_index", "seq", "start")


_BODY_LINES = "SELECT page_index, line_no, min(y) + 5 AS cy FROM spans WHERE region_kind = 'body' GROUP BY 1, 2"


@query("jn_side_note_anchor", "SELECT region_id, cy AS anchor_y FROM (SELECT r.region_id, l.cy, row_number() OVER (PARTITION BY r.region_id ORDER BY abs(l.cy - (r.y + 10)), l.line_no) AS rn FROM regions r JOIN body_lines l ON r.page_index = l.page_index WHERE r.kind = 'marginalia') WHERE rn = 1", {"body_lines": _BODY_LINES})
def jn_side_note_anchor(v):
    lines = v.spans.where("region_kind = 'body'").groupBy("page_index", "line_no").agg((F.min("y") + 5).alias("cy"))
    notes = v.regions.where("kind = 'marginalia'").select("page_index", "region_id", (F.col("y") + 10).alias("at"))
    pairs = notes.join(lines, "page_index")
    return pairs.groupBy("region_id").agg(F.min_by("cy", F.struct(F.abs(F.col("cy") - F.col("at")), "line_no")).alias("anchor_y"))


@query("jn_side_note_insert", "SELECT r.region_id, min(l.line_no) AS before_line FROM regions r LEFT JOIN body_lines l ON r.page_index = l.page_index AND l.cy + 5 >= r.y + 100 WHERE r.kind = 'marginalia' GROUP BY 1", {"body_lines": _BODY_LINES})
def jn_side_note_insert(v):
    lines = v.spans.where("region_kind = 'body'").groupBy("page_index", "line_no").agg((F.min("y") + 5).alias("cy")).withColumnRenamed("page_index", "p")
    notes = v.regions.where("kind = 'marginalia'").select("page_index", "region_id", (F.col("y") + 100).alias("at"))
    return notes.join(lines, (F.col("page_index") == F.col("p")) & (F.col("cy") + 5 >= F.col("at")), "left").groupBy("region_id").agg(F.min("line_no").alias("before_line"))


_BLOBS = "SELECT page_index, line_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, 10.0::DOUBLE AS h, count(*) AS n FROM words GROUP BY 1, 2"


@query("jn_uncovered_ink", "SELECT page_index, line_no FROM blobs b WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM words k WHERE k.page_index = b.page_index AND k.seq % 9 = 1 AND k.x < b.x + b.w AND b.x < k.x + k.w AND k.y < b.y + b.h AND b.y < k.y + k.h)", {"blobs": _BLOBS})
def jn_uncovered_ink(v):
    blobs = v.words.groupBy("page_index", "line_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.lit(10.0).alias("h"), F.count("*").alias("n")).where("n >= 3")
    k = layout.celled(v.words.where("seq % 9 = 1").select("page_index", *"xywh")).alias("k")  # these words stand for what recognition has covered
    covered = layout.celled(blobs).alias("b").join(k, layout.touching("b", "k")).select("b.page_index", "b.line_no").distinct()
    return blobs.join(covered, ["page_index", "line_no"], "left_anti").select("page_index", "line_no")


_FRACTION = "greatest(0, least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * greatest(0, least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y)) / (k.w * k.h)"


@query("jn_uncovered_words", f"SELECT page_index, seq FROM words k WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.page_index = k.page_index AND r.kind = 'body' AND {_FRACTION} >= 0.5)")
def jn_uncovered_words(v):
    k, r = v.words.alias("k"), v.regions.where("kind = 'body'").alias("r")
    return k.join(r, (F.col("k.page_index") == F.col("r.page_index")) & (G.overlap_fraction(layout.box("k"), layout.box("r")) >= 0.5), "left_anti").select("page_index", "seq")


@query("jn_seg_disagree", f"SELECT k.page_index, k.line_no FROM blobs k JOIN regions r ON k.page_index = r.page_index AND r.kind NOT IN ('ignore', 'illustration') AND {_FRACTION} >= 0.2 GROUP BY 1, 2 HAVING count(*) >= 2", {"blobs": _BLOBS})
def jn_seg_disagree(v):
    blobs = v.words.groupBy("page_index", "line_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.lit(10.0).alias("h")).alias("k")
    r = v.regions.where(~F.col("kind").isin(*layout.NOT_TEXT)).alias("r")
    pairs = blobs.join(r, (F.col("k.page_index") == F.col("r.page_index")) & (G.overlap_fraction(layout.box("k"), layout.box("r")) >= 0.2))
    return pairs.groupBy(F.col("k.page_index"), F.col("k.line_no")).agg(F.count("*").alias("n")).where("n >= 2").select("page_index", "line_no")


_ENDS = "SELECT page_index, max_by(text, seq) || CASE WHEN page_index % 3 = 0 THEN '-' ELSE '' END AS last_word, min_by(text, seq) AS first_word FROM spans WHERE text <> '' AND region_kind = 'body' GROUP BY 1"


@query("jn_cross_page", "SELECT a.page_index, a.last_word || ' / ' || b.first_word AS original, rtrim(a.last_word, '-') || b.first_word AS replacement FROM ends a JOIN ends b ON b.page_index = a.page_index + 1 WHERE a.last_word LIKE '%-' AND regexp_matches(b.first_word, '^[^\\p{L}\\p{N}''’]*\\p{Ll}')", {"ends": _ENDS})
def jn_cross_page(v):
    body = v.spans.where("text <> '' AND region_kind = 'body'")
    last = F.concat(F.max_by("text", "seq"), F.when(F.col("page_index") % 3 == 0, "-").otherwise(""))
    ends = body.groupBy("page_index").agg(last.alias("last_word"), F.min_by("text", "seq").alias("first_word"))
    return matching.cross_page_joins(ends)


@query(
    "jn_price",
    """SELECT run_id, max_by(id, length(id)) AS priced_as FROM (SELECT r.run_id, c.id FROM ai_runs r LEFT JOIN (VALUES ('model-a'), ('model-b'), ('model-b-mini')) c(id) ON starts_with(r.model, c.id) AND regexp_full_match(substr(r.model, length(c.id) + 1), '(-[0-9]{4}-?[0-9]{2}-?[0-9]{2})?')) GROUP BY run_id""",
)
def jn_price(v):
    return ai.priced(v.ai_runs, ai.catalog(v.spark)).select("run_id", "priced_as")


@query("jn_gt_iou", "SELECT t.page_index, t.region_id AS truth, d.region_id AS found FROM regions t JOIN regions d ON t.page_index = d.page_index AND t.kind = d.kind AND t.region_id = d.region_id WHERE t.kind <> 'ignore' AND (t.w - 5) / (t.w + 5) >= 0.5")
def jn_gt_iou(v):
    """Detected regions are the true ones, five points to the right: the overlap is (w - 5) / (w + 5)."""
    truth = v.regions.where("kind <> 'ignore'")
    found = truth.withColumn("x", F.col("x") + 5)
    return matching.match_regions(truth, found)


@query("jn_superseded", "SELECT DISTINCT b.proposal_id FROM proposals a JOIN proposals b ON a.span_id = b.span_id AND a.proposal_id <> b.proposal_id WHERE a.status = 'accepted' AND b.status = 'open'")
def jn_superseded(v):
    done = v.proposals.where("status = 'accepted'").select("span_id", F.col("proposal_id").alias("by_id")).alias("d")
    return v.proposals.where("status = 'open'").alias("p").join(done, (F.col("p.span_id") == F.col("d.span_id")) & (F.col("proposal_id") != F.col("by_id")), "left_semi").select("proposal_id")


@query("jn_stale_guard", "SELECT page_index, count(*) AS asked, sum(CASE WHEN seq % 4 + 1 <> revision OR seq % 50 = 49 THEN 1 ELSE 0 END)::BIGINT AS stale, bool_and(NOT (seq % 50 = 49)) AS passes FROM spans WHERE seq % 7 = 0 GROUP BY 1")
def jn_stale_guard(v):
    asked = v.spans.where("seq % 7 = 0").select("page_index", "span_id", F.when(F.col("seq") % 50 == 49, F.col("revision") + 1).otherwise(F.col("revision")).alias("asked"))
    return matching.stale_guard(asked, v.spans)
