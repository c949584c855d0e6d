"""Composite operators and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirewise.functions import geometry as G
from quirewise.functions import text as T
from quirewise.operators import ai, edits, export, issues, layout, matching, pipeline, reconstruct, review, state
from quirewise.plans.registry import query
from quirewise.sources import sinks, storage, views
from quirewise.sources.views import PAGE_H, PAGE_W

_STRIP = r"regexp_replace({0}, '^[^\p{{L}}\p{{N}}''’]+|[^\p{{L}}\p{{N}}''’]+$', '', 'g')"


# ---- text

_BW = "SELECT page_index, line_no, word_no, seq, CASE WHEN word_no % 12 = 11 AND length(text) >= 6 THEN substr(text, 1, length(text) // 2) || '-' ELSE text END AS text FROM words"


def broken(v):
    """Words where every twelfth of a line, if long enough, ends in a hyphen; each line is cut after it."""
    half = F.floor(F.length("text") / 2).cast("int")
    cut = (F.col("word_no") % 12 == 11) & (F.length("text") >= 6)
    return v.words.withColumn("text", F.when(cut, F.concat(F.substring("text", F.lit(1), half), F.lit("-"))).otherwise(F.col("text"))).withColumn("line_no", F.col("line_no") * 10_000 + F.floor(F.col("word_no") / 12)).withColumn("y", 36.0 + 14.0 * F.floor(F.col("seq") / 12))


@query("op_reconstruct")
def op_reconstruct(v):
    spans, _ = reconstruct.reconstruct(broken(v), v.regions, v.lexicon, PAGE_W, parts=v.parts)
    return spans.select("page_index", "position", "text", "trailing", "region_kind", "paragraph_start", "origin", "confidence", "revision", F.size("anchors").alias("anchors"))


@query("op_reconstruct_proposals")
def op_reconstruct_proposals(v):
    return reconstruct.reconstruct(broken(v), v.regions, v.lexicon, PAGE_W, parts=v.parts)[1].select("page_index", "span", "position", "kind", "score", "original", "replacement", "cross_page", "auto_applied")


_AUTO = {
    "au_words": "SELECT page_index, seq AS position, text, \"trailing\", origin, confidence, revision, protected, 1 AS n_anchors FROM spans",
    "au_proposals": """SELECT s.page_index, s.position, s.position + 1 AS tail_position, 0 AS nth, CASE WHEN s.position % 5 = 0 THEN s.revision + 1 ELSE s.revision END AS span_revision, 'hyphen_join' AS kind, CASE WHEN s.position % 11 = 0 THEN 80 ELSE 96 END AS score,
      s.text || '+' AS replacement, s.position % 13 = 0 AS cross_page, FALSE AS auto_applied FROM au_words s WHERE s.position % 7 IN (2, 3, 4)
      UNION ALL SELECT page_index, seq, NULL, nth + 1, revision, kind, score, replacement, FALSE, status = 'applied_auto' FROM proposals""",
    "au_may": """SELECT p.*, t.position IS NOT NULL AS tailed FROM au_proposals p JOIN au_words s ON s.page_index = p.page_index AND s.position = p.position AND s.revision = p.span_revision LEFT JOIN au_words t ON t.page_index = p.page_index AND t.position = p.tail_position AND NOT t.protected
      WHERE NOT s.protected AND NOT p.auto_applied AND NOT p.cross_page AND p.score >= 90 AND p.kind IN ('hyphen_join', 'ocr_confusion') AND (p.kind <> 'hyphen_join' OR t.position IS NOT NULL)""",
    "au_first": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_index, position ORDER BY nth) AS rn FROM au_may) WHERE rn = 1",
    "au_chain": """SELECT *, row_number() OVER (PARTITION BY page_index, run ORDER BY position) AS place FROM (SELECT *, sum(fresh) OVER (PARTITION BY page_index ORDER BY position) AS run FROM (
      SELECT *, CASE WHEN lag(tail_position) OVER (PARTITION BY page_index ORDER BY position) = position THEN 0 ELSE 1 END AS fresh FROM au_first WHERE kind = 'hyphen_join'))""",
    "au_joins": "SELECT * FROM au_chain WHERE place % 2 = 1",
    "au_done": "SELECT page_index, position, tail_position, nth, replacement FROM au_joins UNION ALL SELECT page_index, position, NULL, nth, replacement FROM au_first WHERE kind <> 'hyphen_join' AND NOT EXISTS (SELECT 1 FROM au_joins WHERE au_joins.page_index = au_first.page_index AND au_joins.tail_position = au_first.position)",
}


def _proposed(v):
    """Words with anchors, and their proposals: joins at three of every seven places, so that they touch, some stale, low or over a page break; then the table's own."""
    spans = review.anchored(v.spans).select("page_index", F.col("seq").alias("position"), "text", "trailing", "origin", "confidence", "revision", "protected", "anchors")
    p = F.col("position")
    joins = spans.where((p % 7).isin(2, 3, 4)).select(
        "page_index", "position", (p + 1).alias("tail_position"), F.lit(0).cast("long").alias("nth"), (F.col("revision") + (p % 5 == 0).cast("long")).alias("span_revision"), F.lit("hyphen_join").alias("kind"), F.when(p % 11 == 0, 80).otherwise(96).cast("long").alias("score"),
        F.concat("text", F.lit("+")).alias("replacement"), (p % 13 == 0).alias("cross_page"), F.lit(False).alias("auto_applied"),
    )
    own = v.proposals.select("page_index", F.col("seq").alias("position"), F.lit(None).cast("long").alias("tail_position"), F.col("nth") + 1, "revision", "kind", "score", "replacement", F.lit(False), F.col("status") == "applied_auto")
    return spans, joins.union(own)


@query(
    "op_auto_apply",
    """SELECT s.page_index, CAST(row_number() OVER (PARTITION BY s.page_index ORDER BY s.position) - 1 AS BIGINT) AS position, coalesce(d.replacement, s.text) AS text, coalesce(t.trailing, s.trailing) AS trailing, CASE WHEN d.position IS NULL THEN s.origin ELSE 'auto_applied' END AS origin,
      CASE WHEN d.position IS NULL THEN s.confidence END AS confidence, s.revision + CASE WHEN d.position IS NULL THEN 0 ELSE 1 END AS revision, CAST(CASE WHEN t.position IS NULL THEN 1 ELSE 2 END AS BIGINT) AS anchors
    FROM au_words s LEFT JOIN au_done d ON d.page_index = s.page_index AND d.position = s.position LEFT JOIN au_words t ON t.page_index = d.page_index AND t.position = d.tail_position WHERE NOT EXISTS (SELECT 1 FROM au_joins WHERE au_joins.page_index = s.page_index AND au_joins.tail_position = s.position)""",
    _AUTO,
)
def op_auto_apply(v):
    spans, _ = reconstruct.auto_apply(*_proposed(v))
    return reconstruct.dense(spans).select("page_index", "position", "text", "trailing", "origin", "confidence", "revision", F.size("anchors").cast("long").alias("anchors"))


@query("op_auto_apply_proposals", "SELECT p.page_index, p.position, p.nth, p.auto_applied OR d.position IS NOT NULL AS auto_applied FROM au_proposals p LEFT JOIN au_done d ON d.page_index = p.page_index AND d.position = p.position AND d.nth = p.nth", _AUTO)
def op_auto_apply_proposals(v):
    _, proposals = reconstruct.auto_apply(*_proposed(v))
    return proposals.select("page_index", "position", "nth", "auto_applied")


# ---- issues

_META = """SELECT *, CASE WHEN starts_with(reason, '[') THEN regexp_extract(reason, '^\\[([^\\]]*)\\]', 1) WHEN contains(reason, 'no word score') THEN 'second engine' WHEN contains(reason, 'region OCR') THEN 'region OCR' ELSE 'text pass' END AS label, NOT starts_with(reason, '[') AND NOT contains(reason, 'no word score') AS scored
    FROM (SELECT *, CASE WHEN source = 'ai:alpha' THEN '[AI alpha] reads otherwise' WHEN source = 'second_engine' THEN 'another engine, no word score' WHEN nth = 1 THEN 'region OCR reads otherwise' ELSE 'in the dictionary' END AS reason FROM proposals WHERE status = 'open')"""
_BUILT = {
    "bi_meta": _META,
    "bi_ranked": "SELECT *, row_number() OVER (PARTITION BY page_index, seq ORDER BY score DESC, nth) AS rn FROM bi_meta",
    "bi_listed": "SELECT page_index, seq, list({'text': replacement, 'score': CASE WHEN scored THEN score END, 'source': label, 'proposal': proposal_id} ORDER BY rn) AS shown FROM bi_ranked GROUP BY 1, 2",
    "bi_built": r"""SELECT s.page_index, s.seq, s.span_id, s.revision, s.text AS original, s.confidence, CASE WHEN l.seq IS NULL THEN 'conflicting_readings' WHEN l.kind = 'hyphen_join' THEN 'questionable_join' WHEN l.scored THEN 'risky_substitution' ELSE 'conflicting_readings' END AS kind,
      CASE WHEN l.seq IS NULL THEN s.confidence WHEN l.scored THEN l.score END AS score, coalesce(l.label, 'OCR') AS score_source, l.proposal_id, l.replacement, coalesce(l.reason, 'read with a confidence of ' || s.confidence || ', nothing better known') AS reason,
      coalesce(c.shown, []) || [{'text': s.text, 'score': s.confidence, 'source': 'raw OCR', 'proposal': NULL}] AS candidates
      FROM spans s LEFT JOIN (SELECT * FROM bi_ranked WHERE rn = 1) l ON l.page_index = s.page_index AND l.seq = s.seq LEFT JOIN bi_listed c ON c.page_index = s.page_index AND c.seq = s.seq
      WHERE l.seq IS NOT NULL OR (s.confidence < 90 AND regexp_matches(s.text, '[\p{L}\p{N}]') AND s.origin = 'ocr' AND NOT s.protected)""".replace("\\\\p", "\\p"),
}
_LEN = r"least(12, length(regexp_replace(original, '[^\p{L}\p{N}]', '', 'g')))"
_UNSURE = "greatest(0, 100 - coalesce(score, 50))"


def _offered(v):
    """The proposals, with the reasons that their sources give."""
    reason = F.when(F.col("source") == "ai:alpha", "[AI alpha] reads otherwise").when(F.col("source") == "second_engine", "another engine, no word score").when(F.col("nth") == 1, "region OCR reads otherwise").otherwise("in the dictionary")
    return v.proposals.withColumn("reason", reason)


def _shown(of="candidates"):
    """Candidates as text: text|score|source|proposal, one after another."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.array_join(F.transform(of, lambda c: F.concat_ws("|", c["text"], number(c["score"]), c["source"], number(c["proposal"]))), ";")


@query(
    "op_build_issues",
    f"""SELECT span_id, kind, score, score_source, CAST(least(100, CASE kind WHEN 'questionable_join' THEN 55 + {_UNSURE} // 5 WHEN 'risky_substitution' THEN 45 + {_UNSURE} // 5 ELSE 20 + {_UNSURE} // 3 END + {_LEN}) AS BIGINT) AS priority, proposal_id, replacement, reason,
      array_to_string(list_transform(candidates, lambda c: c.text || '|' || coalesce(CAST(c.score AS VARCHAR), '') || '|' || c.source || '|' || coalesce(CAST(c.proposal AS VARCHAR), '')), ';') AS candidates FROM bi_built""",
    _BUILT,
)
def op_build_issues(v):
    built = issues.build(v.spans, _offered(v))
    return built.select("span_id", "kind", "score", "score_source", "priority", "proposal_id", "replacement", "reason", _shown().alias("candidates"))


_PLACED = {
    "st_regions": "SELECT * REPLACE (CASE WHEN kind = 'header' AND page_index % 9 = 0 THEN 'uncertain' ELSE kind END AS kind) FROM regions",
    "st_spans": "SELECT *, page_index * 10 + CASE region_kind WHEN 'header' THEN 0 WHEN 'body' THEN 2 ELSE 3 END AS region_id FROM spans",
    "st_lost": "SELECT k.* FROM words k LEFT JOIN regions r ON r.page_index = k.page_index AND r.kind = 'body' WHERE r.page_index IS NULL OR greatest(0, least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * greatest(0, least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y)) / (k.w * k.h) < 0.5",
}


@query(
    "op_structural_issues",
    f"""SELECT r.page_index, 'clipping' AS kind, 'clipping@' || CAST(round(r.x) AS BIGINT) || ',' || CAST(round(r.y) AS BIGINT) AS original, CAST(80 AS BIGINT) AS priority, r.region_id FROM st_regions r JOIN (SELECT page_index, region_id, bool_or(x <= 2 OR y <= 2 OR x + w >= {PAGE_W} - 2 OR y + h >= 790) AS cut FROM st_spans GROUP BY 1, 2) s USING (page_index, region_id) WHERE kind NOT IN ('ignore', 'illustration') AND cut
    UNION ALL SELECT r.page_index, 'order_ambiguity', 'order_ambiguity@' || CAST(round(r.x) AS BIGINT) || ',' || CAST(round(r.y) AS BIGINT), 85, r.region_id FROM st_regions r WHERE kind = 'uncertain' AND (page_index, region_id) IN (SELECT (page_index, region_id) FROM st_spans)
    UNION ALL SELECT page_index, 'missing_text', 'missing_text@' || CAST(round(x) AS BIGINT) || ',' || CAST(round(y) AS BIGINT), 90, NULL FROM st_lost WHERE h BETWEEN 3 AND 40 AND w >= 12 AND x >= 4 AND y >= 4 AND x + w <= {PAGE_W} - 4 AND y + h <= 788""",
    _PLACED,
)
def op_structural_issues(v):
    """Words outside the body stand for ink without words; the heads of each ninth page for regions of uncertain class."""
    regions = v.regions.withColumn("kind", F.when((F.col("kind") == "header") & (F.col("page_index") % 9 == 0), "uncertain").otherwise(F.col("kind")))
    of = F.when(F.col("region_kind") == "header", 0).when(F.col("region_kind") == "body", 2).otherwise(3)
    k, body = v.words.alias("k"), v.regions.where("kind = 'body'").alias("r")
    uncovered = k.join(body, (F.col("k.page_index") == F.col("r.page_index")) & (G.overlap_fraction(layout.box("k"), layout.box("r")) >= 0.5), "left_anti")
    return issues.structural(regions, uncovered, v.spans.withColumn("region_id", F.col("page_index") * 10 + of), PAGE_W, PAGE_H)


_FRESH = "SELECT *, row_number() OVER (PARTITION BY page_index, kind, original ORDER BY seq, issue_id) AS n FROM issues WHERE seq % 5 <> 0"
_OLD = "SELECT *, row_number() OVER (PARTITION BY page_index, kind, original ORDER BY seq, issue_id) AS n FROM issues WHERE decision IS NOT NULL"


@query(
    "op_rebuild_issues",
    "SELECT f.issue_id, CASE WHEN o.decision IS NULL THEN 'open' ELSE 'resolved' END AS status FROM fresh f LEFT JOIN old o ON f.page_index = o.page_index AND f.kind = o.kind AND f.original = o.original AND f.n = o.n UNION ALL SELECT -o.issue_id, 'stale' FROM old o LEFT JOIN fresh f ON f.page_index = o.page_index AND f.kind = o.kind AND f.original = o.original AND f.n = o.n WHERE f.issue_id IS NULL",
    {"fresh": _FRESH, "old": _OLD},
)
def op_rebuild_issues(v):
    """Fresh issues with carried decisions; old decisions without a fresh issue are stale (shown with a negative id)."""
    key = ["kind", "original"]
    cols = ["page_index", "seq", "issue_id", *key]
    old = v.issues.where("decision IS NOT NULL")
    carried = issues.carry_over(v.issues.where("seq % 5 <> 0").select(*cols), old.select(*cols, "decision"), key)
    fresh = carried.select("issue_id", F.when(F.col("carried").isNull(), "open").otherwise("resolved").alias("status"))
    unmatched = issues.carry_over(old.select(*cols), v.issues.where("seq % 5 <> 0").select(*cols, F.lit("x").alias("decision")), key)
    return fresh.union(unmatched.where("carried IS NULL").select(-F.col("issue_id"), F.lit("stale")))


# ---- decisions

_DECIDE = _BUILT | {
    "de_issues": """SELECT span_id * 2 AS issue_id, page_index, seq, span_id, revision, original, (['open', 'open', 'deferred', 'resolved'])[seq % 4 + 1] AS status, proposal_id, list_transform(candidates, lambda c: {'text': c.text, 'proposal': CAST(c.proposal AS BIGINT)}) AS cs FROM bi_built
      UNION ALL SELECT span_id * 2 + 1, page_index, seq, span_id, revision, text, 'open', NULL, [{'text': text, 'proposal': CAST(NULL AS BIGINT)}] FROM spans WHERE seq % 5 = 0""",
    "de_events": """SELECT span_id * 4 + k * 2 + issue_id % 2 AS event_id, issue_id, page_index, seq, span_id, revision, original, status, proposal_id, cs, seq % 7 <> 0 AS fresh, (['accept', 'edit', 'skip', 'later'])[(seq + k + issue_id % 2) % 4 + 1] AS action,
      CASE (seq + k + issue_id % 2) % 4 WHEN 0 THEN CASE WHEN seq % 3 = 0 THEN trim(original) ELSE trim(cs[1].text) END WHEN 1 THEN CASE WHEN seq % 11 = 0 THEN '' ELSE trim(original || k) END END AS typed FROM de_issues, (SELECT unnest([0, 1]) AS k)""",
    "de_asked": "SELECT *, action IN ('accept', 'edit') AS takes, action IN ('accept', 'edit') AND typed <> original AS changes FROM de_events WHERE status IN ('open', 'deferred') AND fresh AND (action NOT IN ('accept', 'edit') OR typed <> '')",
    "de_ends": "SELECT issue_id, span_id, min(event_id) AS ends, arg_min(changes, event_id) AS by_change FROM de_asked WHERE action <> 'later' GROUP BY 1, 2",
    "de_turns": "SELECT span_id, min(ends) AS turn FROM de_ends WHERE by_change GROUP BY 1",
    "de_held": """SELECT a.*, e.ends, t.turn, max(CASE WHEN action = 'later' THEN a.event_id END) OVER (PARTITION BY a.issue_id ORDER BY a.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS put_off FROM de_asked a LEFT JOIN de_ends e ON e.issue_id = a.issue_id LEFT JOIN de_turns t ON t.span_id = a.span_id
      WHERE (t.turn IS NULL OR a.event_id <= t.turn) AND (a.event_id = e.ends OR (a.action = 'later' AND (e.ends IS NULL OR a.event_id < e.ends)))""",
    "de_turned": "SELECT span_id, issue_id, event_id, typed, CASE action WHEN 'edit' THEN 'manual' ELSE 'accepted' END AS origin, revision + 1 AS raised FROM de_held WHERE changes",
    "de_last": "SELECT issue_id, arg_max(action, event_id) AS action, arg_max(typed, event_id) AS typed, arg_max(revision + CASE WHEN changes THEN 1 ELSE 0 END, event_id) AS now_at, bool_or(action = 'later') AS later FROM de_held GROUP BY 1",
}


def _deciding(v):
    """Issues built from the proposals, and flags on each fifth word; two decisions on each."""
    pick, v = views.pick, v.settled()
    built = issues.build(v.spans, _offered(v))
    # narrow, as it is stored: the word's number follows from its place, and it is the last candidate itself
    columns = lambda flag, status, proposal: ["page_index", "seq", F.lit(flag).alias("flag"), "revision", status.alias("status"), proposal.alias("proposal_id"), F.transform("candidates", lambda c: F.struct(c["text"].alias("text"), c["proposal"].alias("proposal"))).alias("candidates")]
    own = built.select(*columns(0, pick(F.col("seq"), "open", "open", "deferred", "resolved"), F.col("proposal_id")))
    raw = F.array(F.struct("text", F.lit(None).cast("long").alias("proposal")))
    flags = v.spans.where("seq % 5 = 0").withColumn("candidates", raw).select(*columns(1, F.lit("open"), F.lit(None).cast("long")))
    every = storage.stored(own.union(flags), "deciding", v.parts).withColumn("span_id", F.col("page_index") * 10_000_000 + F.col("seq"))
    every = every.withColumn("issue_id", F.col("span_id") * 2 + F.col("flag")).withColumn("original", F.element_at("candidates", -1)["text"])
    k, s = F.col("k"), F.col("seq")
    turn = s + k + F.col("issue_id") % 2
    text = F.when(turn % 4 == 0, F.when(s % 3 == 0, F.col("original")).otherwise(F.get("candidates", F.lit(0))["text"])).when(turn % 4 == 1, F.when(s % 11 == 0, " ").otherwise(F.concat("original", k.cast("string"))))
    e = every.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    events = e.select((F.col("span_id") * 4 + k * 2 + F.col("issue_id") % 2).alias("event_id"), "page_index", "issue_id", (F.col("revision") + (s % 7 == 0).cast("long")).alias("revision"), pick(turn, "accept", "edit", "skip", "later").alias("action"), text.alias("text"))
    return review.decide(v.spans, every.select("issue_id", "page_index", "span_id", "status", "proposal_id", "candidates"), v.proposals, events, v.parts)


@query("op_decide", "SELECT s.span_id, coalesce(t.typed, s.text) AS text, coalesce(t.origin, s.origin) AS origin, coalesce(t.raised, s.revision) AS revision, CASE WHEN t.span_id IS NULL THEN s.confidence END AS confidence FROM spans s LEFT JOIN de_turned t ON s.span_id = t.span_id", _DECIDE)
def op_decide(v):
    return _deciding(v).spans.select("span_id", "text", "origin", "revision", "confidence")


@query(
    "op_decide_issues",
    """SELECT issue_id, CASE WHEN lost THEN 'resolved' ELSE now END AS status, CASE WHEN lost THEN 'superseded' WHEN action IN ('accept', 'edit') THEN action || ':' || typed ELSE action END AS decision, CASE WHEN lost THEN raised ELSE now_at END AS span_revision FROM (
      SELECT *, turning IS NOT NULL AND turning <> issue_id AND now IN ('open', 'deferred') AS lost FROM (
        SELECT d.issue_id, l.action, l.typed, l.now_at, t.issue_id AS turning, t.raised, CASE WHEN l.action IS NULL THEN d.status WHEN l.action = 'later' THEN 'deferred' ELSE 'resolved' END AS now FROM de_issues d LEFT JOIN de_last l ON l.issue_id = d.issue_id LEFT JOIN de_turned t ON t.span_id = d.span_id))""",
    _DECIDE,
)
def op_decide_issues(v):
    return _deciding(v).issues.select("issue_id", "status", "decision", "span_revision")


@query(
    "op_decide_proposals",
    """SELECT p.proposal_id, CASE WHEN l.issue_id IS NULL OR NOT coalesce(c, FALSE) THEN p.status WHEN l.action = 'skip' THEN 'rejected' WHEN l.action = 'later' THEN 'deferred' WHEN p.proposal_id IS NOT DISTINCT FROM list_filter(d.cs, lambda x: x.text = l.typed)[1].proposal THEN 'accepted' ELSE 'rejected' END AS status
    FROM proposals p LEFT JOIN de_issues d ON d.issue_id = p.span_id * 2 LEFT JOIN de_last l ON l.issue_id = d.issue_id,
    LATERAL (SELECT CASE WHEN l.action IN ('accept', 'edit') THEN list_contains(list_transform(d.cs, lambda x: x.proposal), p.proposal_id) AND (p.status IN ('open', 'deferred') OR (l.later AND p.proposal_id = d.proposal_id)) ELSE p.proposal_id = d.proposal_id END AS c)""",
    _DECIDE,
)
def op_decide_proposals(v):
    return _deciding(v).proposals.select("proposal_id", "status")


@query(
    "op_decide_history",
    """SELECT h.event_id AS history_id, CASE WHEN takes AND NOT changes THEN 'Confirmed “' || original || '”' WHEN takes THEN CASE action WHEN 'edit' THEN 'Edited “' ELSE 'Accepted “' END || original || '” → “' || typed || '”' WHEN action = 'skip' THEN 'Kept “' || original || '”' ELSE 'Deferred “' || original || '”' END || ' · page ' || (page_index + 1) AS label,
      CASE WHEN put_off THEN 'deferred' ELSE status END AS old_status, revision + CASE WHEN changes THEN 1 ELSE 0 END AS new_revision, coalesce(n, 0) AS superseded
    FROM de_held h LEFT JOIN (SELECT t.event_id, count(*) AS n FROM de_turned t JOIN de_issues d ON d.span_id = t.span_id AND d.issue_id <> t.issue_id AND d.status IN ('open', 'deferred') LEFT JOIN de_ends e ON e.issue_id = d.issue_id WHERE e.ends IS NULL OR e.ends > t.event_id GROUP BY 1) s ON s.event_id = h.event_id""",
    _DECIDE,
)
def op_decide_history(v):
    payload = F.from_json("payload", review.DECISION_PAYLOAD)
    return _deciding(v).history.withColumn("p", payload).select("history_id", "label", "p.old_status", "p.new_revision", F.size("p.superseded").cast("long").alias("superseded"))


_APPROVED = "SELECT page_index FROM book_pages WHERE approved_text = text_revision AND approved_layout = layout_revision"


@query(
    "op_group_preview",
    f"SELECT s.span_id, regexp_extract(s.text, '^[^\\p{{L}}\\p{{N}}''’]*') || 'thee' || regexp_extract(s.text, '[^\\p{{L}}\\p{{N}}''’]*$') AS replacement, CASE WHEN s.protected THEN 'protected word' WHEN s.origin = 'human' THEN 'already decided by a person' WHEN a.page_index IS NOT NULL THEN 'on an approved page' END AS conflict FROM spans s LEFT JOIN approved a ON s.page_index = a.page_index WHERE {_STRIP.format('s.text')} = 'the'",
    {"approved": _APPROVED},
)
def op_group_preview(v):
    approved = v.pages.where(state.approval() == "current")
    return review.group_preview(v.spans, "the", "thee", approved).select("span_id", "replacement", "conflict")


@query("op_group_apply", f"SELECT span_id, CASE WHEN {_STRIP.format('text')} = 'the' THEN 'thee' ELSE text END AS text, revision + CASE WHEN {_STRIP.format('text')} = 'the' THEN 1 ELSE 0 END AS revision FROM spans")
def op_group_apply(v):
    chosen = v.spans.where(T.strip(F.col("text")) == "the").select("span_id", "revision", F.lit("thee").alias("replacement"))
    return review.group_apply(v.spans, chosen).select("span_id", "text", "revision")


@query("op_group_apply_stale", "SELECT span_id, text, revision FROM spans")
def op_group_apply_stale(v):
    """One stale revision among the chosen: nothing changes."""
    chosen = v.spans.where(T.strip(F.col("text")) == "the").select("span_id", F.when(F.col("seq") % 50 == 49, 99).otherwise(F.col("revision")).alias("revision"), F.lit("thee").alias("replacement"))
    chosen = chosen.union(v.spans.where("seq = 0").select("span_id", F.lit(98).cast("long"), F.lit("x")))
    return review.group_apply(v.spans, chosen).select("span_id", "text", "revision")


def _typing(v):
    """Every line is typed anew, without each fifth word and with each seventh changed; on each sixth line a word has changed since."""
    w = F.col("word_no")
    word = F.struct("word_no", "span_id", (F.col("revision") + ((F.col("line_no") % 6 == 5) & (w == 0)).cast("long")).alias("seen"), F.when(w % 5 != 2, F.when(w % 7 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("new"))
    lines = v.spans.groupBy("page_index", "line_no").agg(F.array_sort(F.collect_list(word)).alias("ws"))  # a line's words
    each = lambda name: F.transform("ws", lambda x: x[name])
    edits_ = lines.select((F.col("page_index") * 100_000 + F.col("line_no")).alias("edit_id"), "page_index", each("span_id").alias("span_ids"), each("seen").alias("seen"), F.array_join(F.filter(each("new"), lambda x: x.isNotNull()), " ").alias("text"))
    return edits.edit_text(review.anchored(v.spans), v.issues.withColumn("span_revision", F.col("revision")), v.proposals, edits_)


@query("op_edit_text")
def op_edit_text(v):
    anchor = F.array_join(F.transform("anchors", lambda a: F.concat_ws(",", a["page"].cast("string"), a["x"].cast("string"), a["y"].cast("string"))), ";")
    return _typing(v).spans.select("span_id", "text", "trailing", "origin", "confidence", "revision", anchor.alias("anchors"))


@query("op_edit_text_history")
def op_edit_text_history(v):
    done = _typing(v)
    return done.history.join(done.records.select(F.col("edit_id").alias("history_id"), "seq", "original", "replacement"), "history_id").select("history_id", "label", "seq", "original", "replacement", F.size(F.from_json("payload", review.UNDO_PAYLOAD)["items"]).alias("items"))


@query("op_paragraph_set", "SELECT span_id, CASE WHEN seq % 13 = 0 THEN TRUE WHEN seq % 13 = 1 THEN FALSE ELSE paragraph_start END AS paragraph_start FROM spans")
def op_paragraph_set(v):
    events = v.spans.where("seq % 13 < 2").select((F.col("span_id") * 2).alias("event_id"), "span_id", (F.col("seq") % 13 == 0).alias("start"))
    return review.paragraph_set(v.spans, events.union(events.select(F.col("event_id") - 1, "span_id", F.lit(True)))).select("span_id", "paragraph_start")


@query(
    "op_reapply_edits",
    """SELECT page_index, edit_id, start, words FROM (SELECT a.page_index, a.seq AS edit_id, b.seq AS start, a.n AS words, row_number() OVER (PARTITION BY a.page_index, a.seq ORDER BY abs(b.seq - a.seq - 3), b.seq) AS rn
      FROM runs_of a JOIN runs_of b ON a.page_index = b.page_index AND a.n = b.n AND a.run = b.run WHERE a.n = a.seq % 3 + 1) WHERE rn = 1""",
    {
        "runs_of": """SELECT page_index, seq, 1 AS n, text AS run FROM words UNION ALL SELECT page_index, seq, 2, text || ' ' || lead(text) OVER o FROM words WINDOW o AS (PARTITION BY page_index ORDER BY seq)
          UNION ALL SELECT page_index, seq, 3, text || ' ' || lead(text) OVER o || ' ' || lead(text, 2) OVER o FROM words WINDOW o AS (PARTITION BY page_index ORDER BY seq)"""
    },
)
def op_reapply_edits(v):
    """An edit at every word, of one to three words, sought three places on."""
    runs = matching.word_runs(v.page_words, F.col("seq") % 3 + 1)
    return edits.reapply(v.page_words, runs.select("page_index", F.col("seq").alias("edit_id"), (F.col("seq") + 3).alias("at"), F.col("run").alias("old")))


_UNDO = {
    "un_words": """SELECT *, seq % 40 AS u, CASE WHEN seq % 40 = 0 THEN span_id * 8 WHEN seq % 40 IN (8, 9) THEN 1000000000000000 + page_index * 1000000 + seq // 400 WHEN seq % 40 IN (16, 17, 18) THEN 2000000000000000 + page_index * 1000000 + seq // 40 WHEN seq % 40 = 24 THEN span_id * 8 + 1 END AS history_id,
      page_index % 17 = 0 AS undone FROM spans WHERE seq % 40 IN (0, 8, 9, 16, 17, 18, 24)""",
    "un_outcomes": """SELECT history_id, undone, CASE WHEN undone THEN 'already undone' WHEN bool_or(CASE WHEN u = 0 THEN seq % 3 = 1 AND seq % 80 = 0 WHEN u IN (8, 9) THEN seq % 400 = 8 AND seq // 400 % 2 = 1 WHEN u = 24 THEN seq % 3 = 2 ELSE u = 17 AND seq // 40 % 4 = 3 END) THEN 'changed since' ELSE 'undone' END AS outcome FROM un_words GROUP BY 1, 2""",
    "un_ok": "SELECT h.*, CASE WHEN u = 0 THEN seq % 80 = 0 ELSE TRUE END AS changed FROM un_words h JOIN un_outcomes b USING (history_id) WHERE outcome = 'undone'",
    "un_pages": "SELECT page_index, CASE WHEN page_index % 17 = 0 THEN 'already undone' WHEN page_index % 10 = 0 THEN 'cannot be undone' ELSE 'undone' END AS outcome FROM book_pages",
}


def _undoing(v):
    """Entries of every kind: a decision at each fortieth word (each second without a new text), groups, typed edits, paragraph breaks, an approval a page. Some have
    changed since, some are undone, on each tenth page one is of a kind that can't be."""
    s, p = F.col("seq"), F.col("page_index")
    none = lambda kind: F.lit(None).cast(kind)
    word = v.spans.withColumn("u", s % 40)
    stale = lambda when: F.col("revision") + F.when(when, 5).otherwise(0)
    entry = lambda df, key, **fields: df.select(key.alias("history_id"), "page_index", F.to_json(F.struct(*(x.alias(n) for n, x in fields.items()))).alias("payload"))
    where = lambda n: F.col("span_id") * n
    decisions = entry(
        word.where("u = 0"), where(8), kind=F.lit("decision"), issue=where(2) + 1, span=F.col("span_id"), page=p, old_text=F.when(s % 80 == 0, "before").otherwise(F.col("text")), new_text=F.col("text"), old_origin=F.lit("ocr"), old_confidence=F.lit(50.0), new_revision=stale(s % 3 == 1),
        old_status=F.lit("open"), proposal=where(4), candidates=F.array(where(4), where(4) + 1), superseded=none("array<struct<issue:bigint,status:string>>"),
    )
    item = lambda text, bad: F.struct(F.col("span_id").alias("span"), p.alias("page"), F.lit(text).alias("old_text"), F.col("text").alias("new_text"), F.lit("  ").alias("old_trailing"), F.lit("ocr").alias("old_origin"), F.lit(40.0).alias("old_confidence"), stale(bad).alias("new_revision"), F.array(F.struct((where(2) + 1).alias("issue"), F.lit("deferred").alias("status"))).alias("issues"), F.array(F.struct(where(4).alias("proposal"), F.lit("deferred").alias("status"))).alias("proposals"))
    groups = word.where("u IN (8, 9)").groupBy("page_index", F.floor(s / 400).alias("g")).agg(F.collect_list(item("grouped", (s % 400 == 8) & (F.floor(s / 400) % 2 == 1))).alias("items"))
    groups = entry(groups, F.lit(10**15) + p * 1_000_000 + F.col("g"), kind=F.lit("group"), items=F.col("items"))
    typed = word.where("u IN (16, 17, 18)").groupBy("page_index", F.floor(s / 40).alias("g")).agg(F.collect_list(item("typed", (F.col("u") == 17) & (F.floor(s / 40) % 4 == 3))).alias("items"))
    typed = entry(typed, F.lit(2 * 10**15) + p * 1_000_000 + F.col("g"), kind=F.lit("edit"), page=p, items=F.col("items"))
    start = F.when(s % 3 == 2, ~F.col("paragraph_start")).otherwise(F.col("paragraph_start"))
    breaks = entry(word.where("u = 24"), where(8) + 1, kind=F.lit("paragraph"), page=p, span=F.col("span_id"), start=start, was=~start, prev=F.col("span_id") - 1, prev_trailing=F.lit("|"))
    approvals = entry(v.pages, 3 * F.lit(10**15) + p, kind=F.when(p % 10 == 0, "note").otherwise("approve"), page=p, prev_revision=F.when(p % 2 == 1, F.lit(1)), prev_outstanding=F.when(p % 2 == 1, p % 7))
    history = decisions.union(groups).union(typed).union(breaks).union(approvals).withColumn("undone", p % 17 == 0)
    return review.undo(v.spans, v.issues.withColumn("span_revision", F.col("revision")), v.proposals, v.pages, history)


@query(
    "op_undo",
    """SELECT s.span_id, CASE WHEN o.changed AND o.u < 24 THEN CASE WHEN o.u = 0 THEN 'before' WHEN o.u < 10 THEN 'grouped' ELSE 'typed' END ELSE s.text END AS text, CASE WHEN o.changed AND o.u < 24 THEN 'ocr' ELSE s.origin END AS origin, CASE WHEN o.changed AND o.u < 24 THEN CASE WHEN o.u = 0 THEN 50 ELSE 40 END ELSE s.confidence END AS confidence,
      s.revision + CASE WHEN o.changed AND o.u < 24 THEN 1 ELSE 0 END AS revision, CASE WHEN o.u = 24 THEN NOT s.paragraph_start ELSE s.paragraph_start END AS paragraph_start, CASE WHEN n.seq IS NOT NULL THEN '|' WHEN o.u IN (16, 17, 18) THEN '  ' ELSE s.trailing END AS trailing
    FROM spans s LEFT JOIN un_ok o ON o.page_index = s.page_index AND o.seq = s.seq LEFT JOIN (SELECT * FROM un_ok WHERE u = 24) n ON n.page_index = s.page_index AND n.seq = s.seq + 1""",
    _UNDO,
)
def op_undo(v):
    return _undoing(v).spans.select("span_id", "text", "origin", "confidence", "revision", "paragraph_start", "trailing")


@query(
    "op_undo_issues",
    """SELECT i.issue_id, CASE WHEN o.u = 0 THEN 'open' WHEN o.u < 24 THEN 'deferred' ELSE i.status END AS status, CASE WHEN o.u < 24 THEN NULL ELSE i.decision END AS decision, i.revision + CASE WHEN o.u < 24 AND o.changed THEN 1 ELSE 0 END AS span_revision FROM issues i LEFT JOIN un_ok o ON o.page_index = i.page_index AND o.seq = i.seq""".replace("i.revision + CASE WHEN o.u < 24 AND o.changed THEN 1 ELSE 0 END", "CASE WHEN o.u = 0 AND o.seq % 3 = 1 THEN i.revision + 5 WHEN o.u < 24 AND o.changed THEN i.revision + 1 ELSE i.revision END"),
    _UNDO,
)
def op_undo_issues(v):
    return _undoing(v).issues.select("issue_id", "status", "decision", "span_revision")


@query(
    "op_undo_proposals",
    """SELECT p.proposal_id, CASE WHEN o.u = 0 AND p.nth < 2 AND p.status IN ('accepted', 'rejected', 'deferred') THEN 'open' WHEN o.u IN (8, 9) AND p.status IN ('accepted', 'rejected') THEN 'open' WHEN o.u IN (16, 17, 18) AND p.nth = 0 THEN 'deferred' ELSE p.status END AS status FROM proposals p LEFT JOIN un_ok o ON o.page_index = p.page_index AND o.seq = p.seq""",
    _UNDO,
)
def op_undo_proposals(v):
    return _undoing(v).proposals.select("proposal_id", "status")


@query(
    "op_undo_pages",
    """SELECT p.page_index, p.text_revision + coalesce(n.n, 0) AS text_revision, CASE WHEN a.outcome <> 'undone' THEN p.approved_text WHEN p.page_index % 2 = 1 THEN 1 END AS approved_text, CASE WHEN a.outcome <> 'undone' OR p.page_index % 2 = 1 THEN p.approved_layout END AS approved_layout
    FROM book_pages p JOIN un_pages a ON a.page_index = p.page_index LEFT JOIN (SELECT page_index, count(*) FILTER (u < 10 AND changed) + count(DISTINCT history_id) FILTER (u BETWEEN 16 AND 18) + count(*) FILTER (u = 24) AS n FROM un_ok GROUP BY 1) n ON n.page_index = p.page_index""",
    _UNDO,
)
def op_undo_pages(v):
    return _undoing(v).pages.select("page_index", "text_revision", "approved_text", "approved_layout")


@query("op_undo_outcomes", "SELECT history_id, outcome FROM un_outcomes UNION ALL SELECT 3000000000000000 + page_index, outcome FROM un_pages", _UNDO)
def op_undo_outcomes(v):
    return _undoing(v).outcomes.select("history_id", "outcome")


_ENDS = "SELECT page_index, max(span_id) AS last_id, min(span_id) AS first_id FROM spans WHERE region_kind = 'body' AND text <> '' GROUP BY 1"
_CROSS = {
    "approved": _APPROVED,
    "ends": _ENDS,
    "free_spans": "SELECT * FROM spans WHERE NOT protected AND origin IN ('ocr', 'auto_applied') AND page_index NOT IN (SELECT page_index FROM approved)",
    "cr_rivals": "SELECT DISTINCT span_id FROM proposals WHERE status IN ('open', 'deferred')",
    "cr_ok": "SELECT a.last_id AS head_id, b.first_id AS tail_id, f.text || t.text AS whole, t.trailing FROM ends a JOIN ends b ON b.page_index = a.page_index + 1 JOIN free_spans f ON f.span_id = a.last_id JOIN free_spans t ON t.span_id = b.first_id WHERE a.last_id NOT IN (SELECT span_id FROM cr_rivals) AND a.page_index % 5 <> 4",
    "cr_joins": "SELECT * FROM cr_ok WHERE head_id NOT IN (SELECT tail_id FROM cr_ok)",
}


@query(
    "op_cross_page_join",
    """SELECT s.span_id, CASE WHEN h.head_id IS NOT NULL THEN h.whole WHEN t.tail_id IS NOT NULL THEN '' ELSE s.text END AS text, CASE WHEN contains(h.trailing, chr(10)) THEN h.trailing WHEN t.tail_id IS NOT NULL THEN '' ELSE s.trailing END AS trailing,
      s.revision + CASE WHEN h.head_id IS NULL AND t.tail_id IS NULL THEN 0 ELSE 1 END AS revision, CAST(CASE WHEN h.head_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS anchors FROM spans s LEFT JOIN cr_joins h ON h.head_id = s.span_id LEFT JOIN cr_joins t ON t.tail_id = s.span_id WHERE region_kind = 'body'""",
    _CROSS,
)
def op_cross_page_join(v):
    """The last word of a page's body with the first one of the next page's; on each fifth page it has been made from other words."""
    body = review.anchored(v.spans.where("region_kind = 'body'"))
    word = F.struct("span_id", "revision", "text")
    ends = body.where("text <> ''").groupBy("page_index").agg(F.max_by(word, "span_id").alias("h"), F.min_by(word, "span_id").alias("t"))
    nxt = ends.select((F.col("page_index") - 1).alias("page_index"), F.col("t").alias("n"))
    original = F.concat("h.text", F.lit(" / "), "n.text", F.when(F.col("page_index") % 5 == 4, "?").otherwise(""))
    joins = ends.join(nxt, "page_index").select("page_index", F.col("h.span_id").alias("head_id"), F.col("n.span_id").alias("tail_id"), F.col("h.revision").alias("head_revision"), original.alias("original"), F.concat("h.text", "n.text").alias("replacement"), F.lit(None).cast("long").alias("proposal_id"))
    done = review.apply_cross_page(body, joins, v.pages.where(state.approval() == "current"), v.proposals)
    return done.select("span_id", "text", "trailing", "revision", F.size("anchors").cast("long").alias("anchors"))


@query("op_approve", "SELECT p.page_index, coalesce(i.n, 0) AS open, CASE WHEN coalesce(i.n, 0) <= p.page_index % 60 THEN 'approved' ELSE 'conflict' END AS outcome FROM book_pages p LEFT JOIN (SELECT page_index, count(*) AS n FROM issues WHERE status = 'open' GROUP BY 1) i ON p.page_index = i.page_index")
def op_approve(v):
    requests = v.pages.select("page_index", (F.col("page_index") % 60).alias("acknowledged"))
    return review.approve(v.pages, v.issues, requests).select("page_index", "open", "outcome")


@query("op_region_merge", "SELECT page_index, count(*) FILTER (seq % 9 <> 4 AND seq % 4 <> 0 AND text = t2) AS agree, count(*) FILTER (seq % 9 = 4 OR text <> t2) AS other FROM (SELECT w.page_index, w.seq, w.text AS t2, s.text FROM words w JOIN spans s ON w.page_index = s.page_index AND w.seq = s.seq WHERE w.seq % 4 <> 0) GROUP BY 1")
def op_region_merge(v):
    reread = v.words.where("seq % 4 <> 0").select("page_index", "seq", F.when(F.col("seq") % 9 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), *"xywh")
    out = review.region_merge(v.spans, reread)
    return out.groupBy("page_index").agg(F.count_if(F.col("outcome") == "agree").alias("agree"), F.count_if(F.col("outcome") != "agree").alias("other"))


@query("op_ai_merge", "SELECT DISTINCT span_id, replacement FROM (SELECT span_id, original || 's' AS replacement FROM issues) f WHERE NOT EXISTS (SELECT 1 FROM proposals p WHERE p.span_id = f.span_id AND p.replacement = f.replacement AND p.status IN ('open', 'deferred'))")
def op_ai_merge(v):
    return review.add_suggestions(v.proposals, v.issues.select("span_id", F.concat("original", F.lit("s")).alias("replacement")))


@query("op_ai_joins", "SELECT DISTINCT span_id, replacement FROM (SELECT span_id, original || 'e' AS replacement FROM issues) f WHERE NOT EXISTS (SELECT 1 FROM proposals p WHERE p.span_id = f.span_id AND p.replacement = f.replacement AND p.status IN ('open', 'deferred', 'rejected'))")
def op_ai_joins(v):
    return review.add_suggestions(v.proposals, v.issues.select("span_id", F.concat("original", F.lit("e")).alias("replacement")), ("open", "deferred", "rejected"))


# ---- footnotes, flags, drafts

_LINKS = "SELECT page_index * 100000 + seq AS event_id, page_index, seq % 6 AS anchor, seq % 5 AS note FROM words WHERE seq < 40"


@query("op_footnote_link", "SELECT page_index, anchor, note FROM (SELECT *, max(event_id) OVER (PARTITION BY page_index, anchor) AS a, max(event_id) OVER (PARTITION BY page_index, note) AS n FROM links) WHERE event_id = a AND event_id = n", {"links": _LINKS})
def op_footnote_link(v):
    events = v.words.where("seq < 40").select((F.col("page_index") * 100_000 + F.col("seq")).alias("event_id"), "page_index", (F.col("seq") % 6).alias("anchor"), (F.col("seq") % 5).alias("note"))
    return review.link_footnotes(events).select("page_index", "anchor", "note")


_R = "SELECT page_index * 100000 + seq AS ref_id, seq % 4 = 1 AS manual, CASE seq % 3 WHEN 0 THEN 'linked' ELSE 'suggested' END AS status, CASE seq % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' END AS action FROM words WHERE seq % 8 = 1"


@query("op_footnote_decide", "SELECT ref_id, CASE action WHEN 'accept' THEN 'linked' WHEN 'reject' THEN 'rejected' ELSE status END AS status FROM rf WHERE NOT (coalesce(action, '') = 'reject' AND manual)", {"rf": _R})
def op_footnote_decide(v):
    s = F.col("seq")
    base = v.words.where("seq % 8 = 1").select((F.col("page_index") * 100_000 + s).alias("ref_id"), (s % 4 == 1).alias("manual"), F.when(s % 3 == 0, "linked").otherwise("suggested").alias("status"), F.when(s % 5 == 0, "accept").when(s % 5 == 1, "reject").alias("action"))
    events = base.where("action IS NOT NULL").select(F.col("ref_id").alias("event_id"), "ref_id", "action")
    return review.decide_footnotes(base.drop("action"), events).select("ref_id", "status")


@query("op_footnote_continue", "SELECT page_index, note, max(CASE WHEN NOT c THEN note END) OVER (PARTITION BY page_index ORDER BY note ROWS UNBOUNDED PRECEDING) AS head FROM (SELECT page_index, seq AS note, seq % 3 = 0 AND row_number() OVER (PARTITION BY page_index ORDER BY seq) > 1 AS c FROM words WHERE seq % 7 = 6 OR seq % 9 = 0)")
def op_footnote_continue(v):
    notes = v.words.where("seq % 7 = 6 OR seq % 9 = 0").select("page_index", F.col("seq").alias("note"))
    return review.continue_footnotes(notes, notes.where("note % 3 = 0")).select("page_index", "note", "head")


@query("op_footnotes", "SELECT a.page_index, a.seq AS note, b.seq AS anchor, CAST(row_number() OVER (PARTITION BY a.page_index ORDER BY b.seq) AS BIGINT) AS number FROM (SELECT *, row_number() OVER (PARTITION BY page_index, seq % 3 ORDER BY seq) AS n FROM words WHERE seq % 11 = 5) a JOIN (SELECT *, row_number() OVER (PARTITION BY page_index, seq % 3 ORDER BY seq) AS n FROM words WHERE seq % 7 = 3) b ON a.page_index = b.page_index AND a.seq % 3 = b.seq % 3 AND a.n = b.n")
def op_footnotes(v):
    from quirewise.operators import sequences

    marker = (F.col("seq") % 3).cast("string").alias("marker")
    links = matching.link_markers(v.words.where("seq % 11 = 5").select("page_index", "seq", marker), v.words.where("seq % 7 = 3").select("page_index", "seq", marker))
    refs = links.select("page_index", F.col("anchor").alias("seq"), "note", F.lit("linked").alias("status"))
    return sequences.footnote_numbers(refs).select("page_index", "note", F.col("seq").alias("anchor"), "number")


@query("op_flag", "SELECT span_id, CAST(95 AS BIGINT) AS priority FROM spans WHERE seq % 19 = 0 AND seq % 2 = 0")
def op_flag(v):
    on = v.spans.where("seq % 19 = 0").select((F.col("span_id") * 2).alias("event_id"), "span_id", F.lit(True).alias("on"))
    off = v.spans.where("seq % 19 = 0 AND seq % 2 = 1").select((F.col("span_id") * 2 + 1).alias("event_id"), "span_id", F.lit(False).alias("on"))
    return review.flags(v.spans, on.union(off)).select("span_id", "priority")


@query("op_drafts", "SELECT user_id AS span_id, max_by(event_type, event_id) AS text FROM events GROUP BY 1")
def op_drafts(v):
    rows = v.table("events").select(F.col("user_id").alias("span_id"), "event_id", F.col("event_type").alias("text"))
    return state.latest(rows, ["span_id"], ["event_id"]).select("span_id", "text")


_RE = {
    "re_kept": "SELECT * REPLACE (CASE WHEN kind = 'header' AND page_index % 4 = 1 THEN 'heading' WHEN kind = 'body' AND page_index % 4 = 2 THEN 'footnote' ELSE kind END AS kind), (kind = 'header' AND page_index % 4 = 1) OR (kind = 'body' AND page_index % 4 = 2) AS manual FROM regions WHERE NOT (kind = 'ignore' AND page_index % 2 = 0)",
    "re_merged": """SELECT page_index, CASE WHEN m THEN page_index * 10 + 2 ELSE region_id END AS region_id, arg_min(kind, m AND region_order = 3) AS kind, arg_min(region_order, m AND region_order = 3) AS region_order, bool_or(manual) OR count(*) > 1 AS manual, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(sum(line_count) AS BIGINT) AS line_count
      FROM (SELECT *, region_order IN (2, 3) AND page_index % 3 = 0 AND (page_index * 10 + 2) IN (SELECT region_id FROM re_kept) AS m FROM re_kept) GROUP BY page_index, CASE WHEN m THEN page_index * 10 + 2 ELSE region_id END""",
    "re_cut": "SELECT *, 0 AS part, y AS y0, CASE WHEN y + 2 < 100 AND y + h - 2 > 100 THEN 100 - y ELSE h END AS h0, line_count AS n FROM re_merged UNION ALL SELECT *, 1, 100.0, y + h - 100, 0 FROM re_merged WHERE y + 2 < 100 AND y + h - 2 > 100",
    "re_placed": "SELECT *, 9 - region_order AS position FROM re_cut WHERE NOT (page_index % 5 = 0 AND region_order = 4)",
}
_CLASS = "CASE kind WHEN 'header' THEN 0 WHEN 'page_number' THEN 1 WHEN 'heading' THEN 2 WHEN 'body' THEN 2 WHEN 'marginalia' THEN 3 WHEN 'footnote' THEN 4 WHEN 'footer' THEN 5 ELSE 8 END"


@query(
    "op_region_edit",
    f"""SELECT page_index, region_id, CAST(part AS INTEGER) AS part, kind, CASE kind WHEN 'heading' THEN 'heading1' ELSE 'text' END AS structure, manual, x, y0 AS y, w, h0 AS h, CAST(n AS BIGINT) AS line_count, CAST(row_number() OVER (PARTITION BY page_index ORDER BY CASE WHEN page_index % 7 = 1 THEN {_CLASS} WHEN page_index % 5 = 0 THEN position ELSE region_order END,
      CASE WHEN page_index % 7 = 1 THEN y0 ELSE 0 END, CASE WHEN page_index % 7 = 1 THEN x ELSE 0 END, region_id, part) - 1 AS BIGINT) AS region_order FROM re_placed""",
    _RE,
)
def op_region_edit(v):
    """By page number: an ignored box is removed, heads and bodies change their class, foot joins body, everything is cut at 100 points, put in the opposite
    order without the side note, or in automatic order."""
    r, p, n = v.regions, F.col("page_index"), F.col("region_order")
    none = lambda kind: F.lit(None).cast(kind)

    def edit(of, action, kind=None, into=None, at=None, position=None):
        fields = ((kind, "string", "kind"), (into, "long", "into"), (at, "double", "at"), (position, "long", "position"))
        return of.select("page_index", F.lit(action).alias("action"), "region_id", *((none(t) if x is None else x.cast(t)).alias(name) for x, t, name in fields))

    every = edit(r.where("kind = 'ignore' AND page_index % 2 = 0"), "remove").union(edit(r.where("kind = 'header' AND page_index % 4 = 1"), "retype", kind=F.lit("heading"))).union(edit(r.where("kind = 'body' AND page_index % 4 = 2"), "retype", kind=F.lit("footnote")))
    every = every.union(edit(r.where("kind = 'footer' AND page_index % 3 = 0"), "merge", into=p * 10 + 2)).union(edit(r, "split", at=F.lit(100.0)))
    every = every.union(edit(r.where("page_index % 5 = 0 AND region_order <> 4"), "reorder", position=9 - n)).union(edit(r.where("page_index % 7 = 1"), "auto"))
    return review.region_edit(r, every)


@query("op_region_split", "SELECT region_id, 0 AS part, y, CASE WHEN y + 2 < 100 AND y + h - 2 > 100 THEN 100 - y ELSE h END AS h FROM regions UNION ALL SELECT region_id, 1, 100.0, y + h - 100 FROM regions WHERE y + 2 < 100 AND y + h - 2 > 100")
def op_region_split(v):
    return layout.split_regions(v.regions, 100.0).select("region_id", "part", "y", "h")


def _ink(v):
    """Words as ink, those of each third page set in two columns; on each fourth page what follows the fourth line is small and stands apart, under a rule."""
    w, line = F.col("word_no"), F.col("line_no")
    two = F.col("page_index") % 3 == 0
    row = line * 4 + F.floor(w / 8)
    x = F.when(two, 40.0 + 290.0 * (F.floor(w / 4) % 2) + 60.0 * (w % 4)).otherwise(F.col("x"))
    noted = (line > 4) & (F.col("page_index") % 4 == 1)
    y = F.when(two, 36.0 + 14.0 * row).otherwise(F.col("y")) + F.when(noted, 40.0).otherwise(0.0)
    box = lambda seq, *xywh: F.struct(seq.alias("seq"), *(c.alias(n) for c, n in zip(xywh, "xywh", strict=True)))
    glyph = box(F.col("seq"), x, y, F.when(two, 50.0).otherwise(F.col("w")), F.when(noted, 8.0).otherwise(F.col("h")))
    rule = box(F.col("seq") + 10_000_000, F.lit(36.0), F.col("y") + 11.0, F.lit(120.0), F.lit(1.0))
    ruled = (line == 4) & (w == 0) & (F.col("page_index") % 4 == 1)
    # no union: with one Spark would no longer know the rows to be dealt by page
    ink = F.when(ruled, F.array(glyph, rule)).otherwise(F.array(glyph))
    return v.words.where(~two | (w < 32)).select("page_index", F.inline(ink))


@query("op_layout")
def op_layout(v):
    """Ink components to lines, blocks and classed regions in columns and reading order."""
    return layout.analyze(_ink(v.settled(places=True)), PAGE_W, PAGE_H, v.parts).select("page_index", "block", "kind", "column", "line_count", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), "reading_order")


# ---- export

_PLAN = """SELECT page_index, section, region_order, paragraph, placement, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS words FROM (
  SELECT s.*, r.region_order, CAST(sum(CASE WHEN paragraph_start THEN 1 ELSE 0 END) OVER (PARTITION BY s.page_index, region_kind ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph,
    CASE region_kind WHEN 'header' THEN 'head' WHEN 'footer' THEN 'footer' ELSE 'body' END AS placement, CAST(CASE region_kind WHEN 'header' THEN 0 WHEN 'footer' THEN 3 ELSE 1 END AS BIGINT) AS section
  FROM spans s JOIN regions r ON s.page_index = r.page_index AND s.region_kind = r.kind WHERE s.text <> '') GROUP BY 1, 2, 3, 4, 5"""


@query("op_compose", "SELECT * FROM plan_rows", {"plan_rows": _PLAN})
def op_compose(v):
    return export.compose(v.spans, v.regions)


@query("snk_docx", "SELECT page_index, count(*) AS paragraphs, CAST(sum(words) AS BIGINT) AS words FROM plan_rows GROUP BY 1", {"plan_rows": _PLAN})
def snk_docx(v):
    """The plan as JSON lines, which a document writer takes; summed per page from what is read back."""
    plan, folder = export.compose(v.spans, v.regions), storage.new_path(v.spark, "plan")
    sinks.archive({"plan": plan}, folder)
    return sinks.read_part(plan, folder, "plan").groupBy("page_index").agg(F.count("*").alias("paragraphs"), F.sum("words").alias("words"))


_DOC = {
    "do_words": "SELECT *, confidence < 20 AND origin = 'ocr' AS flagged, row_number() OVER (PARTITION BY page_index, region_kind ORDER BY seq) AS rn FROM spans WHERE text <> ''",
    "do_paragraphs": """SELECT page_index, region_kind, CAST(sum(CASE WHEN paragraph_start THEN 1 ELSE 0 END) OVER (PARTITION BY page_index, region_kind ORDER BY seq) AS BIGINT) AS paragraph, seq, text, flagged FROM do_words""",
    "do_plan": "SELECT page_index, region_kind, paragraph, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS words, count(*) FILTER (flagged) AS flags FROM do_paragraphs GROUP BY 1, 2, 3",
    "do_sums": "SELECT count(*) AS paragraphs, sum(words) AS words, sum(words) FILTER (region_kind <> 'footer') AS kept, sum(flags) FILTER (region_kind <> 'footer') AS flags, count(*) FILTER (region_kind <> 'footer') AS shown, count(DISTINCT page_index) FILTER (region_kind <> 'footer') AS pages FROM do_plan",
    "do_caps": "SELECT count(*) AS n FROM (SELECT page_index FROM do_plan WHERE region_kind = 'body' AND regexp_matches(text, '^\\p{L}.') GROUP BY 1)",
    "do_notes": "SELECT count(*) AS n FROM words WHERE seq % 211 = 5 AND page_index IN (SELECT page_index FROM do_plan WHERE region_kind <> 'footer')",
}


def _document(v, settings):
    """(plan, notes) of the words, with those of low confidence flagged, and a note for some."""
    flagged = v.spans.withColumn("flagged", (F.col("confidence") < 20) & (F.col("origin") == "ocr"))
    plan = storage.stored(export.compose(flagged, v.dealt_regions, listed=True), "plan", v.parts)
    noted = plan.where(~F.col("placement").isin(*settings.excluded)).select("page_index").distinct()
    notes = v.words.where("seq % 211 = 5").join(noted, "page_index", "left_semi").select("page_index", F.floor(F.col("seq") / 211).alias("number"), F.concat(F.lit("see "), "text").alias("text"))
    return plan, notes


@query(
    "val_export",
    """SELECT unnest(['structure', 'frame attributes', 'side note boxes', 'drop caps', 'text parity', 'coverage', 'cross-page words', 'page boundaries', 'heads and feet', 'linked footnotes', 'no markers', 'working copy', 'properties', 'styles']) AS "check", TRUE AS ok,
      unnest(['1 content types, 1 documents', '0 frames with names outside the schema', '0 of 0 side notes in boxes', do_caps.n || ' framed', shown || ' paragraphs match', kept || ' words and ' || (words - kept) || ' excluded of ' || words || '; 0 twice', '0 joined words once each', (pages - 1) || ' page breaks and 1 sections for ' || pages || ' pages',
        '0 heads and 0 feet, 0 without a file', do_notes.n || ' references to ' || do_notes.n || ' notes, ' || do_notes.n || ' stored', '0 paragraphs with a page marker', flags || ' flags, ' || flags || ' highlights, ' || flags || ' comments', 'title A book', '6 of 6 styles']) AS detail FROM do_sums, do_caps, do_notes""",
    _DOC,
)
def val_export(v):
    """A working copy, written page for page without the feet, read back from its files and checked."""
    settings = export.Settings(working=True, comments=True, drop_caps=True, title="A book", excluded=("footer",))
    plan, notes = _document(v, settings)
    paragraphs, parts = export.render(plan, notes, settings)
    folder = storage.new_path(v.spark, "document")
    sinks.archive({"paragraphs": paragraphs, "parts": parts}, folder)
    words, left = plan.agg(F.sum("words"), F.sum(F.when(F.col("placement").isin(*settings.excluded), F.col("words")).otherwise(0))).first()
    joined = v.spark.createDataFrame([], "text string")
    return export.validate(sinks.read_part(paragraphs, folder, "paragraphs"), sinks.read_part(parts, folder, "parts"), plan, notes, joined, settings, words or 0, left or 0)


_SNAP = {
    "sn_shown": "SELECT * FROM issues WHERE status IN ('open', 'deferred')",
    "sn_flags": "SELECT page_index, span_id, arg_max(kind || '/' || coalesce(CAST(score AS VARCHAR), '-') || '/' || candidate_source || '/' || (status = 'deferred'), (seq, issue_id)) AS flag FROM sn_shown GROUP BY 1, 2",
    "sn_words": "SELECT s.page_index, count(*) AS words, md5(string_agg(s.text, ' ' ORDER BY seq)) AS text, coalesce(md5(string_agg(f.flag, ',' ORDER BY seq)), md5('')) AS flags FROM spans s LEFT JOIN sn_flags f ON f.page_index = s.page_index AND f.span_id = s.span_id GROUP BY 1",
    "sn_issues": "SELECT page_index, count(*) FILTER (status = 'open') AS unresolved, count(*) FILTER (status = 'deferred') AS deferred FROM sn_shown GROUP BY 1",
    "sn_notes": "SELECT page_index, seq AS note, seq % 3 AS m, row_number() OVER (PARTITION BY page_index, seq % 3 ORDER BY seq) AS rn, sum(CASE WHEN seq % 44 = 5 THEN 0 ELSE 1 END) OVER (PARTITION BY page_index ORDER BY seq) AS k FROM words WHERE seq % 11 = 5",
    "sn_heads": "SELECT page_index, note, m, coalesce(max(CASE WHEN note % 44 <> 5 OR first THEN note END) OVER (PARTITION BY page_index ORDER BY note), note) AS head FROM (SELECT *, row_number() OVER (PARTITION BY page_index ORDER BY note) = 1 AS first FROM sn_notes)",
    "sn_anchors": "SELECT page_index, seq AS anchor, seq % 3 AS m, row_number() OVER (PARTITION BY page_index, seq % 3 ORDER BY seq) AS rn FROM words WHERE seq % 7 = 3",
    "sn_refs": "SELECT sn_notes.page_index, anchor, note, sn_notes.m, row_number() OVER (PARTITION BY sn_notes.page_index ORDER BY anchor) AS number FROM sn_notes JOIN sn_anchors ON sn_anchors.page_index = sn_notes.page_index AND sn_anchors.m = sn_notes.m AND sn_anchors.rn = sn_notes.rn",
    "sn_listed": "SELECT page_index, string_agg(number || ':' || anchor || ':' || sn_refs.note || ':' || m || ':' || coalesce(p.parts, ''), ',' ORDER BY number) AS notes FROM sn_refs LEFT JOIN (SELECT page_index, head AS note, string_agg(CAST(note AS VARCHAR), '+' ORDER BY note) AS parts FROM sn_heads GROUP BY 1, 2) p USING (page_index, note) GROUP BY 1",
}


@query(
    "op_snapshot",
    """SELECT p.page_index, p.status, coalesce(r.kinds, '') AS kinds, coalesce(s.words, 0) AS words, coalesce(s.text, md5('')) AS text, coalesce(s.flags, md5('')) AS flags, coalesce(i.unresolved, 0) AS unresolved, coalesce(i.deferred, 0) AS deferred, coalesce(f.notes, '') AS notes FROM book_pages p
    LEFT JOIN (SELECT page_index, string_agg(region_order || ':' || kind, ',' ORDER BY region_order) AS kinds FROM regions GROUP BY 1) r ON p.page_index = r.page_index LEFT JOIN sn_words s ON p.page_index = s.page_index LEFT JOIN sn_issues i ON p.page_index = i.page_index LEFT JOIN sn_listed f ON p.page_index = f.page_index WHERE p.text_done""",
    _SNAP,
)
def op_snapshot(v):
    """The nested documents, told by the order of regions, digests of words and flags in order, and the notes with their parts."""
    from quirewise.operators import sequences

    notes, anchors = v.words.where("seq % 11 = 5"), v.words.where("seq % 7 = 3")
    marker = (F.col("seq") % 3).cast("string").alias("marker")
    links = matching.link_markers(notes.select("page_index", "seq", marker), anchors.select("page_index", "seq", marker))
    refs = sequences.footnote_numbers(links.select("page_index", F.col("anchor").alias("seq"), "note", F.lit("linked").alias("status"))).select("page_index", F.col("seq").alias("anchor"), "note", "number", (F.col("note") % 3).cast("string").alias("marker"))
    own = notes.select("page_index", F.col("seq").alias("note"))
    parts = review.continue_footnotes(own, own.where("note % 44 = 5")).select("page_index", "head", "note")
    issues_ = v.issues.withColumn("reason", F.col("candidate_source"))
    snap = export.snapshot(v.pages, v.spans, v.regions, issues_, refs, parts)
    kinds = F.array_join(F.transform("regions", lambda r: F.concat(r["region_order"].cast("string"), F.lit(":"), r["kind"])), ",")
    text = F.md5(F.array_join(F.transform("spans", lambda s: s["text"]), " "))
    flag = lambda s: F.concat_ws("/", s["flag"]["kind"], F.coalesce(s["flag"]["score"].cast("string"), F.lit("-")), s["flag"]["reason"], s["flag"]["deferred"].cast("string"))
    flags = F.md5(F.array_join(F.transform(F.filter("spans", lambda s: s["flag"].isNotNull()), flag), ","))
    note = lambda n: F.concat_ws(":", n["number"].cast("string"), n["anchor"].cast("string"), n["note"].cast("string"), n["marker"], F.array_join(n["parts"].cast("array<string>"), "+"))
    listed = F.array_join(F.transform("footnotes", note), ",")
    return snap.select("page_index", "status", kinds.alias("kinds"), F.size("spans").cast("long").alias("words"), text.alias("text"), flags.alias("flags"), "unresolved", "deferred", listed.alias("notes"))


# ---- pipeline state

_LAST = "SELECT page_index, max_by(settings, run_id) FILTER (stage = 'ocr' AND NOT region_only) AS ocr, max_by(settings, run_id) FILTER (stage = 'text') AS text FROM runs WHERE status = 'ok' GROUP BY page_index"
_APP = "CASE WHEN approved_text IS NULL OR approved_layout IS NULL THEN 'none' WHEN approved_text = text_revision AND approved_layout = layout_revision THEN 'current' ELSE 'outdated' END"


@query(
    "op_requeue",
    f"SELECT p.page_index, CASE WHEN l.ocr IS NOT NULL AND {_APP} <> 'current' AND (l.ocr <> 'dpi=200;threshold=90' OR l.text IS NULL OR split_part(l.text, ';', 2) <> 'threshold=90') THEN 'queued' ELSE status END AS status FROM book_pages p LEFT JOIN last_runs l ON p.page_index = l.page_index",
    {"last_runs": _LAST},
)
def op_requeue(v):
    redo = pipeline.redo_stage(v.pages, v.runs, "dpi=200;threshold=90")
    return redo.select("page_index", F.when(F.col("redo") != "none", "queued").otherwise(F.col("status")).alias("status"))


@query("op_set_scope", "SELECT page_index, CASE WHEN page_index + 1 BETWEEN 20 AND 80 AND status = 'unprocessed' THEN 'queued' WHEN NOT (page_index + 1 BETWEEN 20 AND 80) AND status = 'queued' THEN 'unprocessed' ELSE status END AS status FROM book_pages")
def op_set_scope(v):
    return state.set_scope(v.pages, [(20, 80)]).select("page_index", "status")


@query("st_backlog", "SELECT page_index, CASE WHEN ocr_done AND NOT layout_done THEN 'layout' WHEN NOT ocr_done THEN 'ocr' WHEN layout_done AND NOT text_done THEN 'text' ELSE 'none' END AS stage FROM book_pages WHERE status NOT IN ('unprocessed', 'excluded')")
def st_backlog(v):
    return pipeline.next_stage(v.pages).select("page_index", "stage")


# ---- validation

_IT = "SELECT page_index AS batch, seq AS nth, CASE WHEN seq % 13 = 0 THEN seq + 1000000 WHEN seq % 17 = 16 THEN seq - 1 ELSE seq END AS id, CASE WHEN seq % 11 = 0 THEN 'other' WHEN seq % 17 = 16 THEN lag(text) OVER (PARTITION BY page_index ORDER BY seq) ELSE text END AS before, CASE seq % 7 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN 'a b c' WHEN 3 THEN repeat('z', 40) ELSE text || 'x' END AS after FROM words"


@query(
    "val_ai_reply",
    r"""SELECT batch, nth, CASE WHEN verdict = 'ok' AND row_number() OVER (PARTITION BY batch, id, verdict ORDER BY nth) > 1 THEN 'duplicate' ELSE verdict END AS verdict FROM (
    SELECT i.batch, i.nth, i.id, CASE WHEN w.seq IS NULL THEN 'unknown word' WHEN i.before IS DISTINCT FROM w.text THEN 'other text' WHEN coalesce(trim(after), '') = '' THEN 'empty' WHEN after = before THEN 'unchanged' WHEN len(regexp_split_to_array(trim(after), '\s+')) > 2 THEN 'too many words'
      WHEN length(after) > greatest(20, length(before) + 8) THEN 'too long' WHEN 2 * length(regexp_replace(after, '[^\p{L}]', '', 'g')) < length(after) THEN 'few letters' ELSE 'ok' END AS verdict
    FROM items i LEFT JOIN words w ON i.batch = w.page_index AND i.id = w.seq)""",
    {"items": _IT},
)
def val_ai_reply(v):
    from quirewise.operators.sequences import page_order

    s, t, prev = F.col("seq"), F.col("text"), F.lag("text").over(page_order("seq"))
    after = F.when(s % 7 == 0, t).when(s % 7 == 1, "").when(s % 7 == 2, "a b c").when(s % 7 == 3, "z" * 40).otherwise(F.concat(t, F.lit("x")))
    items = v.words.select(F.col("page_index").alias("batch"), s.alias("nth"), F.when(s % 13 == 0, s + 1_000_000).when(s % 17 == 16, s - 1).otherwise(s).alias("id"), F.when(s % 11 == 0, "other").when(s % 17 == 16, prev).otherwise(t).alias("before"), after.alias("after"))
    sent = v.words.select(F.col("page_index").alias("batch"), s.alias("id"), "text")
    return ai.check_replies(items, sent).select("batch", "nth", "verdict")


_EW = "SELECT page_index, max_by(text, seq) AS last_word, min_by(text, seq) AS first_word FROM words WHERE page_index % 9 <> 0 GROUP BY 1"


@query(
    "val_joins",
    "SELECT page_index, nth, CASE WHEN verdict = 'ok' AND row_number() OVER (PARTITION BY page_index, verdict ORDER BY nth) > 1 THEN 'duplicate' ELSE verdict END AS verdict FROM (SELECT p.page_index, n.nth, CASE WHEN e.page_index IS NULL THEN 'not sent' WHEN n.nth = 1 THEN 'not grounded' WHEN n.nth = 2 THEN 'not a join' ELSE 'ok' END AS verdict FROM book_pages p JOIN (SELECT unnest([1, 2, 3, 4]) AS nth) n ON TRUE LEFT JOIN ew e ON p.page_index = e.page_index WHERE p.page_index IN (SELECT page_index FROM words))",
    {"ew": _EW},
)
def val_joins(v):
    ends = v.words.groupBy("page_index").agg(F.max_by("text", "seq").alias("last_word"), F.min_by("text", "seq").alias("first_word"))
    nth = F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))
    items = ends.select("page_index", nth.alias("nth"), "last_word", "first_word").select(
        "page_index", "nth", F.when(F.col("nth") == 1, F.concat("last_word", F.lit("?"))).otherwise(F.col("last_word")).alias("left"), F.col("first_word").alias("right"),
        F.when(F.col("nth") == 2, F.lit("~~")).otherwise(F.concat("last_word", "first_word")).alias("joined"),
    )
    return ai.check_joins(items, ends.where("page_index % 9 <> 0")).select("page_index", "nth", "verdict")


@query("val_source_hash", "SELECT page_id, page_id % 10 <> 0 AS ok FROM pages")
def val_source_hash(v):
    now = F.sha2(F.encode("html", "UTF-8"), 256)
    recorded = F.when(F.col("page_id") % 10 == 0, "changed").otherwise(now)
    return v.table("pages").select("page_id", (recorded == now).alias("ok"))


@query("val_stale_ai", "SELECT p.proposal_id FROM proposals p JOIN spans s ON p.page_index = s.page_index AND p.seq = s.seq WHERE p.source LIKE 'ai:%' AND (p.seq % 3 <> 0) AND p.original = s.text")
def val_stale_ai(v):
    seen = F.when(F.col("seq") % 3 == 0, F.col("revision") + 1).otherwise(F.col("revision"))
    asked = v.proposals.where("source LIKE 'ai:%'").select("proposal_id", "span_id", seen.alias("seen"), "original")
    now = v.spans.select("span_id", F.col("revision").alias("now"), "text")
    return asked.join(now, "span_id").where("seen = now AND original = text").select("proposal_id")
