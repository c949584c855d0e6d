"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirewise.functions import geometry as G
from quirewise.functions import text as T
from quirewise.operators import issues, state
from quirewise.plans.registry import query
from quirewise.sources.views import PAGE_W

_SCOPE = "page_index IN (SELECT page_index FROM book_pages WHERE status NOT IN ('unprocessed', 'excluded'))"
_CORE = r"regexp_replace({0}, '^[^\p{{L}}\p{{N}}''’]+|[^\p{{L}}\p{{N}}''’]+$', '', 'g')"
_WORDS = "SELECT DISTINCT text AS token FROM words"


def tokens(v):
    return v.words.select(F.col("text").alias("token")).distinct()


@query("flt_issue", f"SELECT issue_id, kind, score FROM issues WHERE status = 'open' AND (score IS NULL OR score < 40) AND kind NOT IN ('flag') AND {_SCOPE}")
def flt_issue(v):
    return issues.working_set(v.issues, v.pages, threshold=40, excluded=("flag",)).select("issue_id", "kind", "score")


@query("flt_issue_ai", f"SELECT issue_id, kind, score FROM issues WHERE status = 'deferred' AND starts_with(candidate_source, 'AI ') AND {_SCOPE}")
def flt_issue_ai(v):
    return issues.working_set(v.issues, v.pages, threshold=40, deferred=True, ai_only=True).select("issue_id", "kind", "score")


@query("flt_in_scope", f"SELECT page_index, count(*) AS n FROM issues WHERE {_SCOPE} GROUP BY 1")
def flt_in_scope(v):
    return issues.in_scope(v.issues, v.pages).groupBy("page_index").agg(F.count("*").alias("n"))


@query("flt_scope_range", "SELECT page_index FROM book_pages WHERE page_index + 1 BETWEEN 5 AND 30 OR page_index + 1 BETWEEN 100 AND 140")
def flt_scope_range(v):
    ranges = v.spark.createDataFrame([(5, 30), (100, 140)], "lo long, hi long")
    inside = ranges.select(F.explode(F.sequence("lo", "hi")).alias("display")).distinct()
    return v.pages.join(inside, F.col("page_index") + 1 == F.col("display"), "left_semi").select("page_index")


_APPROVAL = "CASE WHEN approved_text IS NULL OR approved_layout IS NULL THEN 'none' WHEN approved_text = text_revision AND approved_layout = layout_revision THEN 'current' ELSE 'outdated' END"


@query("flt_unreviewed", f"SELECT page_index FROM book_pages WHERE page_index = 3 OR (status NOT IN ('unprocessed', 'excluded') AND {_APPROVAL} <> 'current')")
def flt_unreviewed(v):
    return v.pages.where((F.col("page_index") == 3) | (state.in_process(F.col("status")) & (state.approval() != "current"))).select("page_index")


@query("flt_clean_blockers", f"SELECT page_index, {_APPROVAL} AS approval FROM book_pages WHERE {_APPROVAL} <> 'current'")
def flt_clean_blockers(v):
    return v.pages.withColumn("approval", state.approval()).where("approval <> 'current'").select("page_index", "approval")


@query("flt_body_words", "SELECT span_id FROM spans WHERE text <> '' AND region_kind = 'body'")
def flt_body_words(v):
    return v.spans.where("text <> '' AND region_kind = 'body'").select("span_id")


@query("flt_empty_side_notes", "SELECT region_id FROM regions r WHERE kind = 'marginalia' AND w > 2 AND h > 2 AND NOT EXISTS (SELECT 1 FROM words k WHERE k.page_index = r.page_index AND trim(k.text) <> '' AND k.x + k.w / 2 BETWEEN r.x AND r.x + r.w AND k.y + k.h / 2 BETWEEN r.y AND r.y + r.h)")
def flt_empty_side_notes(v):
    r = v.regions.where("kind = 'marginalia' AND w > 2 AND h > 2").alias("r")
    k = v.words.where(F.trim("text") != "").alias("k")
    box, word = F.struct("r.x", "r.y", "r.w", "r.h"), F.struct("k.x", "k.y", "k.w", "k.h")
    return r.join(k, (F.col("r.page_index") == F.col("k.page_index")) & G.contains_center(box, word), "left_anti").select("region_id")


@query("flt_word_like", rf"SELECT token, regexp_full_match({_CORE.format('token')}, '[\p{{L}}''’-]{{3,}}') AS word_like FROM tk", {"tk": _WORDS})
def flt_word_like(v):
    return tokens(v).select("token", T.word_like(F.col("token")).alias("word_like"))


@query("flt_roman", r"SELECT token FROM tk WHERE regexp_full_match(token, '[ivxlcdmIVXLCDM]+\.*')", {"tk": _WORDS})
def flt_roman(v):
    return tokens(v).where(T.roman_like(F.col("token")))


@query("flt_capitalised", rf"SELECT token FROM tk WHERE regexp_matches({_CORE.format('token')}, '^\p{{Lu}}')", {"tk": _WORDS})
def flt_capitalised(v):
    return tokens(v).where(T.capitalised(F.col("token")))


@query("flt_line_like", f"SELECT page_index, seq FROM words WHERE h BETWEEN 3 AND 40 AND w >= 12 AND x >= 4 AND y >= 4 AND x + w <= {PAGE_W} - 4 AND y + h <= 788")
def flt_line_like(v):
    return v.words.where(f"h BETWEEN 3 AND 40 AND w >= 12 AND x >= 4 AND y >= 4 AND x + w <= {PAGE_W} - 4 AND y + h <= 788").select("page_index", "seq")


@query("flt_noise_components", f"SELECT page_index, seq FROM words WHERE length(text) >= 3 AND w >= 2 AND h >= 2 AND w <= 0.9 * {PAGE_W} AND h <= 0.5 * 792")
def flt_noise_components(v):
    return v.words.where((F.length("text") >= 3) & F.expr(f"w >= 2 AND h >= 2 AND w <= 0.9 * {PAGE_W} AND h <= 0.5 * 792")).select("page_index", "seq")


_LAST = "SELECT page_index, max_by(settings, run_id) FILTER (stage = 'ocr' AND NOT region_only) AS ocr, max_by(settings, run_id) FILTER (stage = 'text') AS text FROM runs WHERE status = 'ok' GROUP BY page_index"


@query(
    "flt_redo_stage",
    f"SELECT p.page_index, CASE WHEN l.ocr IS NULL OR {_APPROVAL} = 'current' THEN 'none' WHEN l.ocr <> 'dpi=300;threshold=91' THEN 'ocr' WHEN l.text IS NULL OR split_part(l.text, ';', 2) <> 'threshold=91' THEN 'text' ELSE 'none' END AS redo FROM book_pages p LEFT JOIN last_runs l ON p.page_index = l.page_index",
    {"last_runs": _LAST},
)
def flt_redo_stage(v):
    from quirewise.operators import pipeline

    return pipeline.redo_stage(v.pages, v.runs, "dpi=300;threshold=91").select("page_index", "redo")


@query("prj_decision_key", "SELECT issue_id, kind || '|' || original || '|' || coalesce(replacement, '') AS key FROM issues")
def prj_decision_key(v):
    return v.issues.select("issue_id", F.concat_ws("|", "kind", "original", F.coalesce("replacement", F.lit(""))).alias("key"))


@query("prj_ocr_fingerprint", "SELECT page_index, 'eng|' || (page_index % 3 * 100 + 200) || 'dpi|psm' || (page_index % 4) AS fingerprint FROM book_pages")
def prj_ocr_fingerprint(v):
    n = F.col("page_index")
    return v.pages.select("page_index", F.format_string("eng|%ddpi|psm%d", n % 3 * 100 + 200, n % 4).alias("fingerprint"))


@query("prj_candidate_meta", "SELECT issue_id, CASE WHEN starts_with(r, '[') THEN regexp_extract(r, '^\\[([^\\]]+)\\]', 1) WHEN contains(r, 'region') THEN 'region OCR' WHEN contains(r, 'second') THEN 'second engine' ELSE 'text pass' END AS label, starts_with(r, '[') AS unscored FROM (SELECT issue_id, CASE WHEN candidate_source = 'AI alpha' THEN '[AI alpha] because' ELSE candidate_source END AS r FROM issues)")
def prj_candidate_meta(v):
    reason = F.when(F.col("candidate_source") == "AI alpha", "[AI alpha] because").otherwise(F.col("candidate_source"))
    tagged = v.issues.select("issue_id", reason.alias("r"))
    label = F.when(F.startswith("r", F.lit("[")), F.regexp_extract("r", r"^\[([^\]]+)\]", 1)).when(F.contains("r", F.lit("region")), "region OCR").when(F.contains("r", F.lit("second")), "second engine").otherwise("text pass")
    return tagged.select("issue_id", label.alias("label"), F.startswith("r", F.lit("[")).alias("unscored"))


_LEN = r"least(12, length(regexp_replace(original, '[^\p{L}\p{N}]', '', 'g')))"
_PRIORITY = f"CAST(least(100, CASE kind WHEN 'flag' THEN 95 WHEN 'missing_text' THEN 90 WHEN 'hyphen_join' THEN 55 + greatest(0, 100 - coalesce(score, 50)) // 5 + {_LEN} WHEN 'low_confidence' THEN 20 + greatest(0, 100 - coalesce(score, 50)) // 3 + {_LEN} ELSE 45 + greatest(0, 100 - coalesce(score, 50)) // 5 + {_LEN} END) AS BIGINT)"


@query("prj_priority", f"SELECT issue_id, {_PRIORITY} AS priority FROM issues")
def prj_priority(v):
    return v.issues.select("issue_id", issues.priority(F.col("kind"), F.col("score"), F.col("original")).alias("priority"))


@query("prj_placement", "SELECT region_id, CASE kind WHEN 'header' THEN '→ running head' WHEN 'footer' THEN '→ footer' WHEN 'marginalia' THEN '→ side note' WHEN 'ignore' THEN 'excluded' ELSE '→ body' END AS placement, CAST(CASE kind WHEN 'header' THEN 0 WHEN 'body' THEN 2 WHEN 'marginalia' THEN 3 WHEN 'footer' THEN 5 ELSE 8 END AS BIGINT) AS class_rank, 'text' AS structure FROM regions")
def prj_placement(v):
    from quirewise.operators import layout

    return layout.with_placement(v.regions).select("region_id", "placement", "class_rank", "structure")
