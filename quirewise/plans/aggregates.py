"""Aggregations, sorts and limits, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators import ai, issues, layout, pipeline, sets, state
from quirewise.plans.registry import query
from quirewise.sources.views import PAGE_H, PAGE_W

_APPROVAL = "CASE WHEN approved_text IS NULL OR approved_layout IS NULL THEN 'none' WHEN approved_text = text_revision AND approved_layout = layout_revision THEN 'current' ELSE 'outdated' END"
_SCOPE = "page_index IN (SELECT page_index FROM book_pages WHERE status NOT IN ('unprocessed', 'excluded'))"


@query(
    "agg_page_counts",
    f"SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('unprocessed', 'excluded')) AS outside, count(*) FILTER ({_APPROVAL} = 'current') AS approved, count(*) FILTER (ocr_done) AS ocr, count(*) FILTER (layout_done) AS layout, count(*) FILTER (text_done) AS text FROM book_pages",
)
def agg_page_counts(v):
    s = F.col("status")
    return v.pages.agg(
        F.count_if(s == "done").alias("done"), F.count_if(s == "queued").alias("queued"), F.count_if(s == "failed").alias("failed"), F.count_if(~state.in_process(s)).alias("outside"),
        F.count_if(state.approval() == "current").alias("approved"), F.count_if("ocr_done").alias("ocr"), F.count_if("layout_done").alias("layout"), F.count_if("text_done").alias("text"),
    )


_O = "status = 'open'"
_LOW = "(score IS NULL OR score < 40)"


@query(
    "agg_issue_counts",
    f"SELECT count(*) FILTER ({_O}) AS unresolved, count(*) FILTER ({_O} AND {_LOW} AND kind <> 'flag') AS matching, count(*) FILTER ({_O} AND NOT {_LOW}) AS above_threshold, count(*) FILTER ({_O} AND {_LOW} AND kind = 'flag') AS filtered_kind, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER ({_O} AND kind = 'flag') AS flagged FROM issues WHERE {_SCOPE}",
)
def agg_issue_counts(v):
    return issues.counts(v.issues, v.pages, 40, ("flag",))


@query("agg_page_issue_counts", f"SELECT page_index, count(*) FILTER ({_O}) AS open, count(*) FILTER ({_O} AND {_LOW}) AS shown, count(*) FILTER (status = 'deferred') AS deferred FROM issues GROUP BY 1")
def agg_page_issue_counts(v):
    return issues.page_counts(v.issues, 40)


@query("agg_proposal_status", "SELECT status, count(*) AS n FROM proposals GROUP BY 1")
def agg_proposal_status(v):
    return v.proposals.groupBy("status").agg(F.count("*").alias("n"))


@query("agg_text_summary", "SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'applied_auto') AS applied, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, (SELECT max(started_at) FROM runs WHERE stage = 'text' AND status = 'ok') AS last_pass FROM proposals")
def agg_text_summary(v):
    n = lambda s: F.count_if(F.col("status") == s)
    rows = v.proposals.select("status", F.lit(None).cast("timestamp_ntz").alias("at")).union(v.runs.where("stage = 'text' AND status = 'ok'").select(F.lit("run"), "started_at"))
    return rows.agg(n("open").alias("open"), n("applied_auto").alias("applied"), n("accepted").alias("accepted"), n("rejected").alias("rejected"), F.max("at").alias("last_pass"))


@query(
    "agg_layout_overview",
    "SELECT coalesce(r.page_index, i.page_index) AS page_index, r.kinds, coalesce(i.n, 0) AS open_structural FROM (SELECT page_index, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT page_index, kind, count(*) AS n FROM regions GROUP BY 1, 2) GROUP BY 1) r FULL JOIN (SELECT page_index, count(*) AS n FROM issues WHERE kind = 'missing_text' AND status = 'open' GROUP BY 1) i ON r.page_index = i.page_index",
)
def agg_layout_overview(v):
    per = v.regions.groupBy("page_index", "kind").agg(F.count("*").alias("n")).groupBy("page_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    open_ = v.issues.where("kind = 'missing_text' AND status = 'open'").groupBy("page_index").agg(F.count("*").alias("open_structural"))
    listed = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return per.join(open_, "page_index", "full_outer").select("page_index", listed.alias("kinds"), F.coalesce("open_structural", F.lit(0)).alias("open_structural"))


@query("agg_ocr_confidence", "SELECT page_index, count(*) AS words, sum(confidence)::DOUBLE / count(*) AS mean FROM words GROUP BY 1 ORDER BY mean, page_index")
def agg_ocr_confidence(v):
    return v.words.groupBy("page_index").agg(F.count("*").alias("words"), (F.sum("confidence") / F.count("*")).alias("mean")).orderBy("mean", "page_index")


@query("agg_mean_conf", "SELECT page_index, coalesce(sum(confidence) FILTER (text <> '')::DOUBLE / nullif(count(*) FILTER (text <> ''), 0), 0) AS mean FROM spans GROUP BY 1")
def agg_mean_conf(v):
    counted = F.when(F.col("text") != "", F.col("confidence"))
    return v.spans.groupBy("page_index").agg(F.coalesce(F.sum(counted) / F.nullif(F.count(counted), F.lit(0)), F.lit(0.0)).alias("mean"))


@query("agg_text_stats", "SELECT s.page_index, s.words, s.paragraphs, coalesce(p.n, 0) AS proposals, coalesce(p.applied, 0) AS applied, coalesce(p.joins, 0) AS joins FROM (SELECT page_index, count(*) AS words, count(*) FILTER (paragraph_start) AS paragraphs FROM spans GROUP BY 1) s LEFT JOIN (SELECT page_index, count(*) AS n, count(*) FILTER (status = 'applied_auto') AS applied, count(*) FILTER (kind = 'hyphen_join') AS joins FROM proposals GROUP BY 1) p ON s.page_index = p.page_index")
def agg_text_stats(v):
    s = v.spans.groupBy("page_index").agg(F.count("*").alias("words"), F.count_if("paragraph_start").alias("paragraphs"))
    p = v.proposals.groupBy("page_index").agg(F.count("*").alias("proposals"), F.count_if(F.col("status") == "applied_auto").alias("applied"), F.count_if(F.col("kind") == "hyphen_join").alias("joins"))
    return s.join(p, "page_index", "left").fillna(0)


_FRACTION = "greatest(0, least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * greatest(0, least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y)) / (k.w * k.h)"


@query(
    "agg_coverage",
    f"""SELECT t.page_index, t.words_total, coalesce(u.n, 0) AS words_uncovered, c.n AS clipped_regions, 20 * coalesce(u.n, 0) > t.words_total AS warning
    FROM (SELECT page_index, count(*) AS words_total FROM words GROUP BY 1) t JOIN (SELECT page_index, count(*) FILTER (x <= 2 OR y <= 2 OR x + w >= {PAGE_W} - 2 OR y + h >= {PAGE_H} - 2) AS n FROM regions GROUP BY 1) c ON t.page_index = c.page_index
    LEFT JOIN (SELECT page_index, count(*) AS n FROM words k WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.page_index = k.page_index AND r.kind <> 'ignore' AND {_FRACTION} >= 0.5) GROUP BY 1) u ON t.page_index = u.page_index""",
)
def agg_coverage(v):
    return layout.coverage(v.words, v.regions, PAGE_W, PAGE_H)


@query("agg_blocks_from_lines", "SELECT page_index, line_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS count FROM words GROUP BY 1, 2")
def agg_blocks_from_lines(v):
    return layout.union_boxes(v.words, "page_index", "line_no").drop("mean_h")


@query("agg_blob", "SELECT page_index, region_kind, min(x) AS x, max(x + w) - min(x) AS w, count(*) AS count, sum(h) / count(*) AS mean_h FROM spans GROUP BY 1, 2")
def agg_blob(v):
    return layout.union_boxes(v.spans, "page_index", "region_kind").drop("y", "h")


@query("agg_component_boxes", "SELECT page_index, seq % 50 AS label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(*) >= 3")
def agg_component_boxes(v):
    return v.words.groupBy("page_index", (F.col("seq") % 50).alias("label")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n")).where("n >= 3")


@query("agg_kind_summary", "SELECT page_index, string_agg(CASE WHEN n > 1 THEN n || ' ' || kind ELSE kind END, ', ' ORDER BY kind) AS summary FROM (SELECT page_index, kind, count(*) AS n FROM proposals GROUP BY 1, 2) GROUP BY 1")
def agg_kind_summary(v):
    per = v.proposals.groupBy("page_index", "kind").agg(F.count("*").alias("n"))
    label = lambda x: F.when(x["n"] > 1, F.concat(x["n"].cast("string"), F.lit(" "), x["kind"])).otherwise(x["kind"])
    return per.groupBy("page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), label), ", ").alias("summary"))


@query("agg_plan_stats", "SELECT region_kind AS placement, count(*) FILTER (paragraph_start) AS paragraphs, count(*) AS words, count(DISTINCT page_index) AS pages FROM spans WHERE text <> '' GROUP BY 1")
def agg_plan_stats(v):
    return v.spans.where("text <> ''").groupBy(F.col("region_kind").alias("placement")).agg(F.count_if("paragraph_start").alias("paragraphs"), F.count("*").alias("words"), F.countDistinct("page_index").alias("pages"))


@query("agg_exclusions", "SELECT page_index, CASE region_kind WHEN 'header' THEN 'running head' ELSE 'footer' END AS reason, count(*) AS words FROM spans WHERE text <> '' AND region_kind <> 'body' GROUP BY 1, 2")
def agg_exclusions(v):
    reason = F.when(F.col("region_kind") == "header", "running head").otherwise("footer")
    return v.spans.where("text <> '' AND region_kind <> 'body'").groupBy("page_index", reason.alias("reason")).agg(F.count("*").alias("words"))


@query("agg_readiness", f"SELECT p.approved, p.indexed, p.indexed - p.approved AS pages_left, p.approved = p.indexed AS clean_ready, i.n AS unresolved FROM (SELECT count(*) FILTER ({_APPROVAL} = 'current') AS approved, count(*) AS indexed FROM book_pages WHERE status NOT IN ('unprocessed', 'excluded')) p, (SELECT count(*) AS n FROM issues WHERE status = 'open' AND {_SCOPE}) i")
def agg_readiness(v):
    pages = v.pages.where(state.in_process(F.col("status"))).select((state.approval() == "current").alias("ok"), F.lit(1).alias("page"), F.lit(0).alias("issue"))
    open_ = issues.in_scope(v.issues.where("status = 'open'"), v.pages).select(F.lit(False), F.lit(0), F.lit(1))
    all_ = pages.union(open_).agg(F.count_if("ok").alias("approved"), F.sum("page").alias("indexed"), F.sum("issue").alias("unresolved"))
    return all_.select("approved", "indexed", (F.col("indexed") - F.col("approved")).alias("pages_left"), (F.col("approved") == F.col("indexed")).alias("clean_ready"), "unresolved")


@query("agg_ai_estimate", "SELECT page_index, count(*) AS words, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS chars, CAST((sum(octet_length(encode(text)) + 1) + 3) // 4 AS BIGINT) AS tokens FROM spans WHERE text <> '' GROUP BY 1")
def agg_ai_estimate(v):
    return ai.estimate(v.spans)


_PRICE = """CASE WHEN regexp_full_match(model, 'model-a(-[0-9]{4}-?[0-9]{2}-?[0-9]{2})?') THEN CASE WHEN started_at >= TIMESTAMP '2024-01-16' THEN 4.0 ELSE 2.0 END WHEN model = 'model-b-mini' THEN 0.5 WHEN model = 'model-b' THEN 1.0 END"""


@query("ai_cost", f"SELECT run_id, CASE WHEN requests = 0 THEN 0 ELSE (tokens_in * ({_PRICE})::DOUBLE + tokens_out * (4 * ({_PRICE}))::DOUBLE) / 1000000 END AS cost FROM ai_runs")
def ai_cost(v):
    return ai.with_cost(v.ai_runs, ai.catalog(v.spark)).select("run_id", "cost")


@query("agg_ai_spend", f"SELECT provider, count(*) AS runs, count(*) FILTER (requests > 0 AND {_PRICE} IS NULL) AS unpriced, round(sum(CASE WHEN requests = 0 THEN 0 ELSE (tokens_in * ({_PRICE})::DOUBLE + tokens_out * (4 * ({_PRICE}))::DOUBLE) / 1000000 END), 6) AS total, max(started_at) AS latest FROM ai_runs GROUP BY 1")
def agg_ai_spend(v):
    runs = ai.with_cost(v.ai_runs, ai.catalog(v.spark))
    return runs.groupBy("provider").agg(F.count("*").alias("runs"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.round(F.sum("cost"), 6).alias("total"), F.max("started_at").alias("latest"))


@query("agg_ai_open", "SELECT count(*) AS n FROM proposals WHERE source LIKE 'ai:%' AND status = 'open'")
def agg_ai_open(v):
    return v.proposals.where("source LIKE 'ai:%' AND status = 'open'").agg(F.count("*").alias("n"))


_KINDS = "[.,;:!?''\"‘’“”()–—-]"


@query("agg_char_kinds", rf"SELECT doc_id, length(regexp_replace(text, '[^\p{{N}}]', '', 'g')) AS num, length(regexp_replace(text, '[^.,;:!?''\"‘’“”()–—-]', '', 'g')) AS punct, length(regexp_replace(text, '[\p{{N}}\p{{L}}\p{{M}}\s.,;:!?''\"‘’“”()–—-]', '', 'g')) AS sym FROM documents")
def agg_char_kinds(v):
    num, punct, sym = T.count_kinds(F.col("text"))
    return v.table("documents").select("doc_id", num.alias("num"), punct.alias("punct"), sym.alias("sym"))


@query("agg_median_upper", "SELECT page_index, list_sort(list(w))[count(*) // 2 + 1] AS median FROM words GROUP BY 1")
def agg_median_upper(v):
    return v.words.groupBy("page_index").agg(layout.upper_median(F.col("w")).alias("median"))


@query("agg_percentile", "SELECT stage, list_sort(list(elapsed_ms))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95 FROM runs GROUP BY 1")
def agg_percentile(v):
    """The value at the rounded rank, from counts by value: what a window sees is bounded by the distinct values of a stage."""
    each = v.runs.groupBy("stage", "elapsed_ms").agg(F.count("*").alias("n"))
    stage = Window.partitionBy("stage")
    ranked = each.select("stage", "elapsed_ms", F.sum("n").over(stage.orderBy("elapsed_ms")).alias("upto"), F.sum("n").over(stage).alias("all"))
    return ranked.where(F.col("upto") > F.floor((F.col("all") - 1) * 0.95 + 0.5)).groupBy("stage").agg(F.min("elapsed_ms").alias("p95"))


@query("agg_precision", "SELECT quality AS by_reviewer, count(*) FILTER (toxic = 0)::DOUBLE / nullif(count(*), 0) AS precision FROM labels GROUP BY 1")
def agg_precision(v):
    return sets.precision(v.table("labels").select(F.col("quality").alias("by_reviewer"), (F.col("toxic") == 0).alias("ok")), "by_reviewer")


@query("agg_layout_pr", "SELECT page_index, count(*) FILTER (m)::DOUBLE / count(*) AS precision, count(*) FILTER (m)::DOUBLE / count(*) AS recall FROM (SELECT page_index, kind <> 'ignore' AND (w - 5) / (w + 5) >= 0.5 AS m FROM regions WHERE kind <> 'ignore') GROUP BY 1")
def agg_layout_pr(v):
    from quirewise.operators import matching

    truth = v.regions.where("kind <> 'ignore'")
    pairs = matching.match_regions(truth, truth.withColumn("x", F.col("x") + 5)).groupBy("page_index").agg(F.count("*").alias("m"))
    n = truth.groupBy("page_index").agg(F.count("*").alias("n")).join(pairs, "page_index", "left").fillna(0)
    return n.select("page_index", (F.col("m") / F.col("n")).alias("precision"), (F.col("m") / F.col("n")).alias("recall"))


@query("agg_cer", "SELECT item_id, levenshtein(a, b)::DOUBLE / length(a) AS cer FROM (SELECT item_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^ -~]', '?', 'g') AS a, replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^ -~]', '?', 'g'), 'rn', 'm') AS b FROM benchmark)")
def agg_cer(v):
    return sets.error_rates(_recognised(v)).select("item_id", "cer")


@query("agg_cer_wer")
def agg_cer_wer(v):
    return sets.error_rates(_recognised(v)).select("item_id", "cer", "wer")


def _recognised(v):
    """Texts as if recognised with one confusion; beyond ASCII both engines count differently, so it is masked."""
    truth = F.regexp_replace(T.norm_ws(F.col("text")), "[^ -~]", "?")
    return v.table("benchmark").select("item_id", truth.alias("truth"), F.replace(truth, F.lit("rn"), F.lit("m")).alias("read"))


@query("agg_distinct_pages", "SELECT DISTINCT page_index FROM spans WHERE contains(text, 'the')")
def agg_distinct_pages(v):
    return v.spans.where(F.contains("text", F.lit("the"))).select("page_index").distinct()


_PROGRESS = "SELECT stage, count(*) AS total, count(*) FILTER (status = 'ok') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, CAST(sum(CASE WHEN status <> 'running' THEN elapsed_ms ELSE 0 END) AS BIGINT) AS elapsed_ms FROM runs GROUP BY 1"


@query("agg_progress", "SELECT *, CASE WHEN stage = 'ocr' AND done + failed >= 3 THEN elapsed_ms // (done + failed) END AS per_unit_ms, CASE WHEN stage = 'ocr' AND done + failed >= 3 THEN elapsed_ms // (done + failed) * (total - done - failed) END AS eta_ms FROM prog", {"prog": _PROGRESS})
def agg_progress(v):
    return pipeline.progress(v.runs)


# ---- sorts and limits


@query("top_issue_lead", "SELECT span_id, proposal_id FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY score DESC, nth) AS rn FROM proposals) WHERE rn = 1")
def top_issue_lead(v):
    return issues.lead_proposals(v.proposals).select("span_id", "proposal_id")


@query("top_priority", "SELECT issue_id, priority FROM (SELECT *, (confidence_rank * 7) % 97 AS priority FROM (SELECT *, seq % 50 AS confidence_rank FROM issues WHERE status = 'open')) ORDER BY priority DESC, page_index, seq, created_at LIMIT 1")
def top_priority(v):
    return v.issues.where("status = 'open'").withColumn("priority", (F.col("seq") % 50 * 7) % 97).orderBy(F.desc("priority"), "page_index", "seq", "created_at").limit(1).select("issue_id", "priority")


@query("top_ai_runs", "SELECT run_id, started_at FROM ai_runs ORDER BY started_at DESC, run_id DESC LIMIT 50")
def top_ai_runs(v):
    return v.ai_runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(50).select("run_id", "started_at")


@query("top_suggest", "SELECT span_id, array_to_string(list_slice(list(replacement ORDER BY score DESC, nth), 1, 2), '|') AS suggestions FROM proposals GROUP BY 1")
def top_suggest(v):
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("score"), F.col("nth"), F.col("replacement").alias("t")))), 1, 2), lambda x: x["t"])
    return v.proposals.groupBy("span_id").agg(F.array_join(best, "|").alias("suggestions"))


@query("top_note_preview", "SELECT page_index, line_no, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS preview FROM (SELECT page_index, line_no, string_agg(text, ' ' ORDER BY seq) AS t FROM spans WHERE text <> '' GROUP BY 1, 2)")
def top_note_preview(v):
    from quirewise.operators.export import ordered_text

    lines = v.spans.where("text <> ''").groupBy("page_index", "line_no").agg(ordered_text(F.col("text")).alias("t"))
    return lines.select("page_index", "line_no", F.when(F.length("t") > 80, F.concat(F.substring("t", 1, 80), F.lit("…"))).otherwise(F.col("t")).alias("preview"))


@query("top_suggest_budget", "SELECT page_index, seq FROM (SELECT page_index, seq, row_number() OVER (PARTITION BY page_index ORDER BY seq) AS rn FROM words WHERE length(text) >= 4 AND confidence < 50) WHERE rn <= 40")
def top_suggest_budget(v):
    eligible = v.words.where("length(text) >= 4 AND confidence < 50")
    return eligible.withColumn("rn", F.row_number().over(Window.partitionBy("page_index").orderBy("seq"))).where("rn <= 40").select("page_index", "seq")


@query("top_cache_evict", "SELECT page_id FROM (SELECT page_id, page_id // 20 AS shelf, sum(length(html)) OVER (PARTITION BY page_id // 20 ORDER BY page_id DESC) AS held FROM pages) WHERE held > 30000")
def top_cache_evict(v):
    """Per shelf, the newest pages that fit into the cap stay; these are the others."""
    held = F.sum(F.length("html")).over(Window.partitionBy(F.floor(F.col("page_id") / 20)).orderBy(F.desc("page_id")))
    return v.table("pages").withColumn("held", held).where("held > 30000").select("page_id")


# ---- sets


_MERGED = """SELECT book, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN far IS NULL OR lo > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT book, lo, hi, max(hi) OVER (PARTITION BY book ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM (SELECT book, greatest(lo, 1) AS lo, least(hi, {total}) AS hi FROM {ranges}) WHERE lo <= hi)) GROUP BY book, island"""


@query("set_scope_union", _MERGED.format(total=520, ranges="scopes"), {"scopes": "SELECT o_custkey AS book, o_orderkey % 500 + CASE o_orderstatus WHEN 'F' THEN 0 ELSE 10 END AS lo, o_orderkey % 500 + CASE o_orderstatus WHEN 'F' THEN 0 ELSE 10 END + o_orderkey % 37 AS hi FROM orders"})
def set_scope_union(v):
    """Two scopes a book, of filled orders and of the others, as one."""
    k = F.col("o_orderkey")
    of = lambda rows, at: rows.select(F.col("o_custkey").alias("book"), (k % 500 + at).alias("lo"), (k % 500 + at + k % 37).alias("hi"))
    orders = v.table("orders")
    return sets.merge_ranges(of(orders.where("o_orderstatus = 'F'"), 0).union(of(orders.where("o_orderstatus <> 'F'"), 10)), 520, "book").select("book", "lo", "hi")


@query("set_lexicon_union", "SELECT token FROM lexicon UNION SELECT lower(p_name) FROM part UNION SELECT lower(text) FROM spans WHERE protected AND text <> ''")
def set_lexicon_union(v):
    return sets.known_words(v.lexicon, v.table("part").select(F.lower("p_name")), v.spans.where("protected AND text <> ''").select(F.lower("text")))


@query("set_dup_guard", "SELECT span_id, min(proposal_id) AS proposal_id, replacement FROM proposals p WHERE source LIKE 'ai:%' AND NOT EXISTS (SELECT 1 FROM proposals q WHERE q.span_id = p.span_id AND q.replacement = p.replacement AND q.status = 'deferred') GROUP BY span_id, replacement")
def set_dup_guard(v):
    have = v.proposals.where("status = 'deferred'").select("span_id", "replacement")
    fresh = v.proposals.where("source LIKE 'ai:%'").join(have, ["span_id", "replacement"], "left_anti")
    return fresh.groupBy("span_id", "replacement").agg(F.min("proposal_id").alias("proposal_id"))


@query("set_spans_coverage", "SELECT 'missing' AS problem, count(*) FILTER (seq % 101 = 7) AS n FROM spans UNION ALL SELECT 'twice', count(*) FILTER (seq % 103 = 9 AND seq % 101 <> 7) FROM spans")
def set_spans_coverage(v):
    emitted = v.spans.where("seq % 101 <> 7").select("span_id")
    emitted = emitted.union(v.spans.where("seq % 103 = 9 AND seq % 101 <> 7").select("span_id"))
    return sets.coverage_problems(v.spans.select("span_id"), emitted)


@query("set_text_parity", "SELECT page_index, min(seq) AS first_difference FROM spans WHERE text <> '' AND seq % 97 = 13 GROUP BY 1")
def set_text_parity(v):
    words = v.spans.where("text <> ''").select("page_index", "seq", "text")
    other = words.withColumn("text", F.when(F.col("seq") % 97 == 13, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sets.first_differences(words, other)
