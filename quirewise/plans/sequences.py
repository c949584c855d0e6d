"""Ordered-sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators import ai, issues, layout, sequences, sets, state
from quirewise.plans.registry import query
from quirewise.sources.views import PAGE_W

_SW = "SELECT page_index, region_kind, line_no, seq, text, x, y, w FROM spans WHERE text <> ''"
_LINES = """SELECT *, row_number() OVER (PARTITION BY page_index, region_kind ORDER BY y, x) AS rank FROM (
  SELECT page_index, region_kind, line_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, count(*) AS words, max_by(text, x) AS last_text, min_by(text, x) AS first_text, list(w / greatest(length(text), 1)) AS char_ws FROM sw GROUP BY 1, 2, 3)"""
_PER = """SELECT page_index, region_kind, coalesce(list_sort(list(x) FILTER (words >= 3))[count(*) FILTER (words >= 3) // 2 + 1], 0) AS left_, min(x) AS min_x, max(w) AS widest,
  coalesce(list_sort(list(pitch) FILTER (pitch > 0))[count(*) FILTER (pitch > 0) // 2 + 1], 0) AS usual, list_sort(flatten(list(char_ws))) AS cw
  FROM pitched GROUP BY 1, 2"""
_PITCHED = "SELECT *, y - lag(y) OVER o AS pitch, lag(w) OVER o AS prev_w, lag(last_text) OVER o AS prev_last FROM text_rows WINDOW o AS (PARTITION BY page_index, region_kind ORDER BY rank)"
_STARTED = f"""SELECT p.*, rank = 1 OR (p.region_kind NOT IN ('header', 'footer') AND (p.x - CASE WHEN left_ = 0 THEN min_x ELSE left_ END > greatest(1.5 * greatest(cw[len(cw) // 2 + 1], 1.0), 0.015 * {PAGE_W})
  OR (prev_w < 0.7 * widest AND NOT ends_with(prev_last, '-')) OR (usual > 0 AND pitch > 1.7 * usual))) AS starts
  FROM pitched p JOIN per USING (page_index, region_kind)"""
_V = {"sw": _SW, "text_rows": _LINES, "pitched": _PITCHED, "per": _PER, "started": _STARTED}


def _lines(v):
    return sequences.lines_of(v.spans.where("text <> ''"))


def _started(v):
    return sequences.paragraph_starts(_lines(v), PAGE_W)


@query("win_lines", "SELECT page_index, line_no, x, y, w, words, rank FROM text_rows", _V)
def win_lines(v):
    return _lines(v).select("page_index", "line_no", "x", "y", "w", "words", "rank")


@query("win_paragraph_start", "SELECT page_index, line_no FROM started WHERE starts", _V)
def win_paragraph_start(v):
    return _started(v).where("starts").select("page_index", "line_no")


@query("win_paragraph_id", "SELECT page_index, line_no, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY page_index, region_kind ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM started", _V)
def win_paragraph_id(v):
    return sequences.paragraph_ids(_started(v)).select("page_index", "line_no", "paragraph")


@query("win_trailing", "SELECT page_index, line_no, coalesce(lead(starts) OVER (PARTITION BY page_index, region_kind ORDER BY rank), TRUE) AS breaks FROM started", _V)
def win_trailing(v):
    nxt = F.lead("starts").over(Window.partitionBy("page_index", "region_kind").orderBy("rank"))
    return _started(v).select("page_index", "line_no", F.coalesce(nxt, F.lit(True)).alias("breaks"))


_BROKEN = "SELECT page_index, region_kind, line_no, seq, CASE WHEN seq % 5 = 0 THEN text || '-' ELSE text END AS text, x, y, w FROM spans WHERE text <> ''"


@query(
    "win_hyphen_pair",
    r"SELECT page_index, line_no, last_text AS head, nx AS tail FROM (SELECT *, lead(first_text) OVER (PARTITION BY page_index, region_kind ORDER BY rank) AS nx FROM text_rows) WHERE ends_with(last_text, '-') AND nx IS NOT NULL AND length(regexp_replace(last_text, '^[^\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+$', '', 'g')) >= 2",
    _V | {"sw": _BROKEN},
)
def win_hyphen_pair(v):
    broken = v.spans.where("text <> ''").withColumn("text", F.when(F.col("seq") % 5 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text")))
    return sequences.hyphen_pairs(sequences.lines_of(broken))


@query("win_seq", "SELECT page_index, span_id, CAST(row_number() OVER (PARTITION BY page_index ORDER BY seq) - 1 AS BIGINT) AS dense FROM spans WHERE text <> ''")
def win_seq(v):
    return v.spans.where("text <> ''").select("page_index", "span_id", (F.row_number().over(sequences.page_order("seq")) - 1).cast("long").alias("dense"))


@query("win_reading_order", "SELECT region_id, CAST(row_number() OVER (PARTITION BY page_index ORDER BY CASE kind WHEN 'header' THEN 0 WHEN 'body' THEN 2 WHEN 'marginalia' THEN 3 WHEN 'footer' THEN 5 ELSE 8 END, y, x, region_id) - 1 AS BIGINT) AS reading_order FROM regions")
def win_reading_order(v):
    return layout.reading_order(v.regions.withColumn("column", F.lit(None).cast("long"))).select("region_id", "reading_order")


@query("win_row_split", "SELECT page_index, line_no, CAST(dense_rank() OVER (PARTITION BY page_index ORDER BY y) - 1 AS BIGINT) AS row FROM (SELECT page_index, line_no, min(y) AS y FROM words GROUP BY 1, 2)")
def win_row_split(v):
    """Lines lie fourteen points apart here, so every line is a row of its own."""
    lines = v.words.groupBy("page_index", "line_no").agg(F.min("y").alias("y"), F.max("h").alias("h"))
    return layout.rows_of_lines(lines, 10.0)


_CTX = "concat_ws(' ', lag(text, 4) OVER o, lag(text, 3) OVER o, lag(text, 2) OVER o, lag(text) OVER o, '[' || text || ']', lead(text) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o, lead(text, 4) OVER o)"


@query("win_context", f"SELECT page_index, seq, context FROM (SELECT page_index, seq, {_CTX} AS context FROM words WINDOW o AS (PARTITION BY page_index ORDER BY seq))")
def win_context(v):
    return v.words.select("page_index", "seq", sequences.context(v.words).alias("context"))


@query("win_next_issue", "SELECT page_index, issue_id, lead(issue_id) OVER o AS next_id, lag(issue_id) OVER o AS previous_id FROM issues WHERE status = 'open' WINDOW o AS (PARTITION BY page_index ORDER BY seq, created_at, issue_id)")
def win_next_issue(v):
    return issues.navigation(v.issues.where("status = 'open'"))


@query("win_next_issue_one", "SELECT issue_id, FALSE AS wrapped FROM issues WHERE status = 'open' AND (page_index, seq) > (20, 5) ORDER BY page_index, seq, created_at, issue_id LIMIT 1")
def win_next_issue_one(v):
    anchor = {"page_index": 20, "seq": 5, "created_at": 99, "issue_id": 0}
    return issues.next_issue(v.issues.where("status = 'open'"), anchor).select("issue_id", "wrapped")


@query("win_next_issue_wrap", "SELECT issue_id, TRUE AS wrapped FROM issues WHERE status = 'open' ORDER BY page_index, seq, created_at, issue_id LIMIT 1")
def win_next_issue_wrap(v):
    anchor = {"page_index": 10**9, "seq": 0, "created_at": 0, "issue_id": 0}
    return issues.next_issue(v.issues.where("status = 'open'"), anchor).select("issue_id", "wrapped")


_UN = "status NOT IN ('unprocessed', 'excluded') AND CASE WHEN approved_text IS NULL OR approved_layout IS NULL THEN 'none' WHEN approved_text = text_revision AND approved_layout = layout_revision THEN 'current' ELSE 'outdated' END <> 'current'"


@query("win_nearest_unreviewed", f"SELECT page_index, min(CASE WHEN {_UN} THEN page_index END) OVER (ORDER BY page_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_page, max(CASE WHEN {_UN} THEN page_index END) OVER (ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_page FROM book_pages")
def win_nearest_unreviewed(v):
    return sequences.nearest_unreviewed(v.pages, state.in_process(F.col("status")) & (state.approval() != "current"))


_REFS = "SELECT page_index, seq, CASE seq % 3 WHEN 0 THEN 'linked' WHEN 1 THEN 'suggested' ELSE 'rejected' END AS status FROM words WHERE seq % 8 = 2"


@query("win_footnote_number", "SELECT page_index, seq, CASE WHEN status = 'linked' THEN CAST(sum(CASE WHEN status = 'linked' THEN 1 ELSE 0 END) OVER (PARTITION BY page_index ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS number FROM refs", {"refs": _REFS})
def win_footnote_number(v):
    s = F.col("seq") % 3
    refs = v.words.where("seq % 8 = 2").select("page_index", "seq", F.when(s == 0, "linked").when(s == 1, "suggested").otherwise("rejected").alias("status"))
    return sequences.footnote_numbers(refs).select("page_index", "seq", "number")


_NP = "SELECT *, paragraph_start OR lag(region_kind) OVER o IS DISTINCT FROM region_kind AS st, lag(text) OVER o AS pt FROM spans WINDOW o AS (PARTITION BY page_index ORDER BY seq)"


@query("win_note_paragraphs", "SELECT page_index, seq, max(hd) OVER (PARTITION BY page_index ORDER BY seq ROWS UNBOUNDED PRECEDING) AS head FROM (SELECT page_index, seq, CASE WHEN (st OR (lag(st) OVER o AND pt = '')) AND text <> '' THEN seq END AS hd FROM np WINDOW o AS (PARTITION BY page_index ORDER BY seq))", {"np": _NP})
def win_note_paragraphs(v):
    return sequences.note_paragraphs(v.spans).select("page_index", "seq", "head")


_ENDS = "regexp_matches(text, '[.!?][\"''”’)\\]]*$')"


@query(
    "win_context_sentences",
    f"SELECT page_index, count(*) AS n, min(seq) AS first_seq FROM (SELECT page_index, seq, row_number() OVER o AS n, sum(CASE WHEN {_ENDS} THEN 1 ELSE 0 END) OVER (PARTITION BY page_index ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) - CASE WHEN seq = max(seq) OVER (PARTITION BY page_index) AND {_ENDS} THEN 1 ELSE 0 END AS e FROM words WINDOW o AS (PARTITION BY page_index ORDER BY seq DESC)) WHERE n <= 120 AND e < 2 GROUP BY 1",
)
def win_context_sentences(v):
    return sequences.context_sentences(v.words).groupBy("page_index").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(
    "win_batches",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    f AS (SELECT conv_id, turn, k, CASE WHEN n > 900 THEN -1 ELSE 0 END AS batch, 0 AS current, CASE WHEN n > 900 THEN 0 ELSE 1 END AS c, CASE WHEN n > 900 THEN 0 ELSE n END AS held FROM t WHERE k = 1
      UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN t.n > 900 THEN -1 WHEN f.c > 0 AND (f.c = 3 OR f.held + t.n > 900) THEN f.current + 1 ELSE f.current END,
        CASE WHEN t.n <= 900 AND f.c > 0 AND (f.c = 3 OR f.held + t.n > 900) THEN f.current + 1 ELSE f.current END,
        CASE WHEN t.n > 900 THEN f.c WHEN f.c > 0 AND (f.c = 3 OR f.held + t.n > 900) THEN 1 ELSE f.c + 1 END, CASE WHEN t.n > 900 THEN f.held WHEN f.c > 0 AND (f.c = 3 OR f.held + t.n > 900) THEN t.n ELSE f.held + t.n END
      FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
    SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM f""",
)
def win_batches(v):
    return ai.batches(v.table("conversations"), "conv_id", "turn", F.length("text"), most=3, budget=900)


@query(
    "win_scope_merge",
    """SELECT book, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN far IS NULL OR lo > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT book, lo, hi, max(hi) OVER (PARTITION BY book ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM (
        SELECT user_id AS book, greatest(event_id * 7 % 600 - 20, 1) AS lo, least(event_id * 7 % 600 - 25 + event_id % 40, 529) AS hi FROM events) WHERE lo <= hi)) GROUP BY book, island""",
)
def win_scope_merge(v):
    """A user's events as page ranges, some beyond the book, some the wrong way round."""
    e = F.col("event_id")
    lo = e * 7 % 600 - 20
    return sets.merge_ranges(v.table("events").select(F.col("user_id").alias("book"), lo.alias("lo"), (lo - 5 + e % 40).alias("hi")), 529, "book").select("book", "lo", "hi")


@query(
    "win_latest_undoable",
    "SELECT history_id FROM history h WHERE kind IN ('decision', 'group', 'edit', 'approve', 'paragraph') AND NOT undone ORDER BY ts DESC, history_id DESC LIMIT 1",
)
def win_latest_undoable(v):
    h = v.history.select("history_id", "ts", "kind", F.col("page_index").alias("page"), "undone", F.col("kind").isin(*state.UNDOABLE).alias("undoable"))
    return sequences.latest_undoable(h).select("history_id")


_GC = r"lower(regexp_replace({}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"


@query("win_repeated_word", rf"SELECT page_index, seq FROM (SELECT page_index, seq, text, lag(text) OVER (PARTITION BY page_index ORDER BY seq) AS p FROM words) WHERE length({_GC.format('text')}) >= 2 AND regexp_matches({_GC.format('text')}, '\p{{L}}') AND {_GC.format('text')} = {_GC.format('p')} AND NOT regexp_matches(p, '[^\p{{L}}\p{{N}}]$') AND NOT ends_with(text, '-')")
def win_repeated_word(v):
    return sequences.repeated_words(v.words).select("page_index", "seq")


_PK = "SELECT page_index, CASE WHEN page_index % 13 = 0 THEN 'stop' WHEN page_index % 5 = 0 THEN 'blank' ELSE 'text' END AS kind FROM book_pages"


@query("win_page_breaks", "SELECT page_index, to_page FROM (SELECT page_index, lead(page_index) OVER (PARTITION BY g ORDER BY page_index) AS to_page FROM (SELECT *, sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS g FROM pk) WHERE kind = 'text') WHERE to_page IS NOT NULL", {"pk": _PK})
def win_page_breaks(v):
    n = F.col("page_index")
    return sequences.page_breaks(v.pages.select("page_index", F.when(n % 13 == 0, "stop").when(n % 5 == 0, "blank").otherwise("text").alias("kind")))


_SPACED = "SELECT page_index, seq, CASE WHEN seq % 29 = 0 AND lag(text) OVER (PARTITION BY page_index ORDER BY seq) IS NOT NULL THEN lag(text) OVER (PARTITION BY page_index ORDER BY seq) WHEN seq % 31 = 0 THEN text || ',x' WHEN seq % 37 = 0 THEN ',' ELSE text END AS text, \"trailing\" FROM spans"


@query(
    "fn_grammar",
    rf"""SELECT page_index, seq, rule, fix FROM (SELECT *, lag(text) OVER (PARTITION BY page_index ORDER BY seq) AS p FROM spaced WHERE text <> '') t, LATERAL (
      SELECT 'after_punct' AS rule, regexp_replace(text, '(\p{{Ll}}[,;:])(\p{{L}})', '\1 \2', 'g') AS fix WHERE regexp_matches(text, '\p{{Ll}}[,;:]\p{{L}}')
      UNION ALL SELECT 'before_punct', p || text WHERE p IS NOT NULL AND regexp_full_match(text, '[,.;:!?]+')
      UNION ALL SELECT 'repeated', p WHERE length({_GC.format('text')}) >= 2 AND regexp_matches({_GC.format('text')}, '\p{{L}}') AND {_GC.format('text')} = {_GC.format('p')} AND NOT regexp_matches(p, '[^\p{{L}}\p{{N}}]$') AND NOT ends_with(text, '-'))""",
    {"spaced": _SPACED},
)
def fn_grammar(v):
    before = F.lag("text").over(sequences.page_order("seq"))
    s = F.col("seq")
    text = F.when((s % 29 == 0) & before.isNotNull(), before).when(s % 31 == 0, F.concat("text", F.lit(",x"))).when(s % 37 == 0, ",").otherwise(F.col("text"))
    flags = sequences.grammar_flags(v.spans.select("page_index", "seq", text.alias("text"), "trailing"))
    return flags.where("rule IN ('after_punct', 'before_punct', 'repeated') AND NOT (rule = 'after_punct' AND fix RLIKE '[.!?] ')")


@query("fn_grammar_all")
def fn_grammar_all(v):
    return sequences.grammar_flags(v.spans.select("page_index", "seq", "text", "trailing"))


@query("fn_render_text", "SELECT page_index, rtrim(string_agg(text || CASE WHEN \"trailing\" = chr(10) THEN chr(10) || chr(10) ELSE \"trailing\" END, '' ORDER BY seq), ' ' || chr(10)) AS text FROM spans WHERE text <> '' GROUP BY 1")
def fn_render_text(v):
    from quirewise.operators.export import ordered_text

    piece = F.concat("text", F.when(F.col("trailing") == "\n", F.lit("\n\n")).otherwise(F.col("trailing")))
    joined = v.spans.where("text <> ''").groupBy("page_index").agg(ordered_text(piece, glue="").alias("t"))
    return joined.select("page_index", F.regexp_replace("t", r"[ \n]+$", "").alias("text"))
