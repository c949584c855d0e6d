"""Scans, sinks' next states, and keyed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators import state
from quirewise.plans.registry import query
from quirewise.sources import readers, sinks, storage

_APPROVAL = "CASE WHEN approved_text IS NULL OR approved_layout IS NULL THEN 'none' WHEN approved_text = text_revision AND approved_layout = layout_revision THEN 'current' ELSE 'outdated' END"


@query("src_pages", f"SELECT page_index, status, text_revision, layout_revision, {_APPROVAL} AS approval FROM book_pages")
def src_pages(v):
    return v.pages.select("page_index", "status", "text_revision", "layout_revision", state.approval().alias("approval"))


@query("prj_approval", f"SELECT {_APPROVAL} AS approval, count(*) AS n FROM book_pages GROUP BY 1")
def prj_approval(v):
    return v.pages.groupBy(state.approval().alias("approval")).agg(F.count("*").alias("n"))


_TSV = r"""SELECT page_index AS level_page, line_no, concat_ws(chr(9), '5', page_index, '1', '1', line_no, word_no, CAST(x AS BIGINT), CAST(y AS BIGINT), CASE WHEN seq % 29 = 0 THEN 'bad' ELSE CAST(CAST(w AS BIGINT) AS VARCHAR) END, '10',
  CASE WHEN seq % 31 = 0 THEN '-1' ELSE CAST(confidence AS VARCHAR) END, CASE WHEN seq % 37 = 0 THEN '' ELSE text END) AS line FROM words"""


def _tsv(v) -> DataFrame:
    """Recognition rows as tab-separated text, some damaged."""
    s = F.col("seq")
    width = F.when(s % 29 == 0, "bad").otherwise(F.col("w").cast("long").cast("string"))
    conf = F.when(s % 31 == 0, "-1").otherwise(F.col("confidence").cast("string"))
    text = F.when(s % 37 == 0, "").otherwise(F.col("text"))
    return v.loose_words.select(F.concat_ws("\t", F.lit("5"), "page_index", F.lit("1"), F.lit("1"), "line_no", "word_no", F.col("x").cast("long"), F.col("y").cast("long"), width, F.lit("10"), conf, text).alias("value"))


@query(
    "src_tsv",
    r"""SELECT CAST(p[2] AS BIGINT) AS page_num, CAST(p[5] AS BIGINT) AS line_num, CAST(p[6] AS BIGINT) AS word_num, coalesce(TRY_CAST(p[7] AS DOUBLE), 0) AS left_, coalesce(TRY_CAST(p[9] AS DOUBLE), 0) AS width,
    greatest(coalesce(TRY_CAST(p[11] AS DOUBLE), 0), 0) AS conf, p[12] AS text
    FROM (SELECT string_split(line, chr(9)) AS p FROM tsv) WHERE NOT (coalesce(TRY_CAST(p[11] AS DOUBLE), 0) < 0 AND p[12] = '')""",
    {"tsv": _TSV},
)
def src_tsv(v):
    return readers.parse_tsv_words(_tsv(v)).select("page_num", "line_num", "word_num", F.col("left").alias("left_"), "width", "conf", "text")


_JSON = "SELECT page_index, '[' || string_agg('{\"t\":\"w' || seq || '\",\"c\":' || confidence || '}', ',' ORDER BY seq) || ']' AS cell FROM words WHERE seq < 20 GROUP BY page_index"


@query("src_json_cells", "SELECT page_index, 'w' || seq AS t, confidence AS c FROM words WHERE page_index % 5 <> 0")
def src_json_cells(v):
    cells = v.words.groupBy("page_index").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("w"), F.col("seq").cast("string")).alias("t"), F.col("confidence").alias("c")))).alias("cell"))
    broken = cells.withColumn("cell", F.when(F.col("page_index") % 5 == 0, F.lit("not json")).otherwise(F.col("cell")))
    return readers.explode_json_cells(broken, "cell", "array<struct<t:string,c:bigint>>", "page_index").select("page_index", "t", "c")


@query("src_current_ocr", "SELECT page_index, run_id, settings FROM (SELECT *, row_number() OVER (PARTITION BY page_index ORDER BY started_at DESC, run_id DESC) AS rn FROM runs WHERE stage = 'ocr' AND status = 'ok') WHERE rn = 1")
def src_current_ocr(v):
    return state.latest(v.runs.where("stage = 'ocr' AND status = 'ok'"), ["page_index"], ["started_at", "run_id"]).select("page_index", "run_id", "settings")


@query("src_spans", "SELECT page_index, seq, text, revision FROM spans")
def src_spans(v):
    return v.spans.select("page_index", "seq", "text", "revision").orderBy("page_index", "seq")


@query("src_proposals", "SELECT page_index, proposal_id, kind, score, status FROM proposals")
def src_proposals(v):
    return v.proposals.select("page_index", "proposal_id", "kind", "score", "status").orderBy("page_index", "proposal_id")


@query("src_issues", "SELECT page_index, issue_id, kind, score, status FROM issues")
def src_issues(v):
    return v.issues.select("page_index", "issue_id", "kind", "score", "status").orderBy("page_index", "issue_id")


@query("src_runs", "SELECT page_index, run_id, stage, started_at, status FROM runs WHERE page_index = 17")
def src_runs(v):
    return v.runs.where("page_index = 17").select("page_index", "run_id", "stage", "started_at", "status").orderBy("started_at", "run_id")


_HISTORY = "SELECT history_id, ts, json_extract_string(payload, '$.kind') AS kind, CAST(json_extract_string(payload, '$.page') AS BIGINT) AS page, payload FROM history ORDER BY ts DESC, history_id DESC LIMIT"


@query("src_history", f"SELECT history_id, kind, page, kind IN ('decision', 'group', 'edit', 'approve', 'paragraph') AS undoable FROM ({_HISTORY} 100)")
def src_history(v):
    return state.recent_history(v.history, 100).select("history_id", "kind", "page", "undoable")


@query("top_history", f"SELECT history_id, ts, kind FROM ({_HISTORY} 20)")
def top_history(v):
    return state.recent_history(v.history, 20).select("history_id", "ts", "kind")


@query("src_history_span", f"SELECT history_id, kind FROM ({_HISTORY} 500) WHERE contains(payload, '\"s7\"')")
def src_history_span(v):
    return state.recent_history(v.history, 500).where(F.contains("payload", F.lit('"s7"'))).select("history_id", "kind")


_CORE = r"regexp_replace({}, '^[^\p{{L}}\p{{N}}''’]+|[^\p{{L}}\p{{N}}''’]+$', '', 'g')"


@query("src_vocab", f"SELECT word, CASE WHEN min(CASE WHEN protected THEN 0 ELSE 1 END) = 0 THEN 'protected' ELSE 'vocab' END AS kind, count(*) AS uses FROM (SELECT lower({_CORE.format('text')}) AS word, protected FROM spans) WHERE word <> '' GROUP BY word")
def src_vocab(v):
    words = v.spans.select(F.lower(T.strip(F.col("text"))).alias("word"), "protected").where("word <> ''")
    return words.groupBy("word").agg(F.when(F.bool_or("protected"), "protected").otherwise("vocab").alias("kind"), F.count("*").alias("uses"))


@query("src_lexicon", "SELECT DISTINCT word FROM (SELECT p_name AS word FROM part UNION ALL SELECT p_name || 's' FROM part UNION ALL SELECT 'un' || p_name FROM part WHERE p_partkey % 2 = 0) WHERE word <> ''")
def src_lexicon(v):
    """Headwords with one suffix and one prefix class, expanded as a dictionary's affix rules would."""
    parts = v.table("part")
    entries = parts.select(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("/SU")).otherwise(F.lit("/S"))).alias("value"))
    rules = [readers.Affix("S", True, "", "s", "."), readers.Affix("U", False, "", "un", ".")]
    return readers.expand_dictionary(entries, rules).select("word").distinct()


@query("src_pdf_inspect", "SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, sha256(coalesce(html, '')) AS checksum FROM pages")
def src_pdf_inspect(v):
    """The device reads files; here each page's bytes are a file: size and checksum."""
    content = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return v.table("pages").select("page_id", F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("checksum"))


@query("src_render", "SELECT page_index, CAST(floor(612 * s + 0.5) AS BIGINT) AS width, CAST(floor(792 * s + 0.5) AS BIGINT) AS height FROM (SELECT page_index, least(1.0::DOUBLE + page_index % 8, sqrt(4000000.0::DOUBLE / (612 * 792))) AS s FROM book_pages)")
def src_render(v):
    """The device draws; here are the pixels that it is asked for: the scale, cut so that an image stays below four million."""
    return readers.render_size(v.pages.select("page_index", (1.0 + F.col("page_index") % 8).alias("scale")), 612.0, 792.0, 4_000_000.0)


@query("src_ocr", "SELECT page_index, count(*) AS words, CAST(sum(confidence) AS BIGINT) * 1.0::DOUBLE / count(*) AS mean_confidence FROM spans WHERE text <> '' GROUP BY page_index")
def src_ocr(v):
    return v.spans.where("text <> ''").groupBy("page_index").agg(F.count("*").alias("words"), (F.sum("confidence") / F.count("*")).alias("mean_confidence"))


@query("src_ocr_crop", "SELECT page_index, seq, (x - 10) * 2.0 + 7 AS x, (y - 20) * 2.0 + 5 AS y FROM words WHERE x >= 36 AND x < 236 AND y < 200")
def src_ocr_crop(v):
    """Words of a crop, in pixels of an image of 144 dots an inch whose corner is the crop's."""
    return v.words.where("x >= 36 AND x < 236 AND y < 200").select("page_index", "seq", ((F.col("x") - 10) * 2.0 + 7).alias("x"), ((F.col("y") - 20) * 2.0 + 5).alias("y"))


@query("src_ocr_second", "SELECT page_index, line_no, string_agg(text, ' ' ORDER BY word_no) AS text, CAST(NULL AS BIGINT) AS score FROM words GROUP BY page_index, line_no")
def src_ocr_second(v):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    return v.words.groupBy("page_index", "line_no").agg(joined.alias("text")).withColumn("score", F.lit(None).cast("long"))


@query(
    "src_model_catalog",
    "SELECT c.page_id, CASE WHEN f.page_id IS NULL THEN 'missing' WHEN f.checksum = c.checksum THEN 'verified' ELSE 'corrupt' END AS status FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'x' ELSE sha256(html) END AS checksum FROM pages) c LEFT JOIN (SELECT page_id, sha256(html) AS checksum FROM pages WHERE page_id % 4 <> 1) f ON c.page_id = f.page_id",
)
def src_model_catalog(v):
    digest = v.table("pages").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("checksum"))
    catalog = digest.withColumn("checksum", F.when(F.col("page_id") % 9 == 0, "x").otherwise(F.col("checksum")))
    return state.catalog_status(catalog, digest.where("page_id % 4 <> 1"), "page_id")


@query("src_recent", "SELECT page_index, max(started_at) AS opened FROM runs GROUP BY page_index ORDER BY opened DESC, page_index LIMIT 12")
def src_recent(v):
    return v.runs.groupBy("page_index").agg(F.max("started_at").alias("opened")).orderBy(F.desc("opened"), "page_index").limit(12)


@query("src_queue", "SELECT page_index, status, CAST(row_number() OVER (ORDER BY page_index) AS BIGINT) AS place FROM book_pages WHERE status IN ('queued', 'failed')")
def src_queue(v):
    from quirewise.operators.ordering import numbered

    return numbered(v.pages.where("status IN ('queued', 'failed')"), ["page_index"], "place").select("page_index", "status", "place")


# ---- sinks: the state that a write leaves


@query("snk_page_ocr", "SELECT page_index, run_id, run_id = max(run_id) OVER (PARTITION BY page_index) AS current FROM runs WHERE stage = 'ocr'")
def snk_page_ocr(v):
    return v.runs.where("stage = 'ocr'").select("page_index", "run_id", (F.col("run_id") == F.max("run_id").over(Window.partitionBy("page_index"))).alias("current"))


@query("snk_append_words", "SELECT page_index, count(*) AS words, sum(CASE WHEN page_index % 7 = 0 AND seq < 3 THEN 1 ELSE 0 END)::BIGINT + count(*) AS after_append FROM words GROUP BY page_index")
def snk_append_words(v):
    """Some pages' first words are appended as side notes; counted in the stored table, where new words have the next numbers."""
    old = v.words.select("page_index", "seq", "text")
    out = sinks.append_words(old, old.where("page_index % 7 = 0 AND seq < 3"))
    now = out.groupBy("page_index").agg((F.max("seq") + 1).alias("after_append"), F.countDistinct("seq").alias("numbers"))
    return old.groupBy("page_index").agg(F.count("*").alias("words")).join(now, "page_index").where("after_append = numbers").select("page_index", "words", "after_append")


_LAYOUT = "SELECT page_index, count(*) AS regions, page_index % 3 = 0 AS manual, max(page_index % 4 + 1) AS revision FROM regions GROUP BY page_index"


@query("snk_layout", "SELECT page_index, CASE WHEN manual AND page_index % 2 = 1 THEN revision ELSE revision + 1 END AS revision, NOT (manual AND page_index % 2 = 1) AS written FROM layout", {"layout": _LAYOUT})
def snk_layout(v):
    layout = v.regions.groupBy("page_index").agg(F.count("*").alias("regions")).select("page_index", "regions", (F.col("page_index") % 3 == 0).alias("manual"), (F.col("page_index") % 4 + 1).alias("revision"))
    fresh = layout.select("page_index", F.col("regions").alias("regions"), (F.col("page_index") % 2 == 0).alias("force"))
    return state.put_layout(layout, fresh).select("page_index", "revision", "written")


@query(
    "snk_layout_save",
    "SELECT page_index, region_id, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 612) - greatest(x, 0) AS w, least(y + h, 792) - greatest(y, 0) AS h, CAST(row_number() OVER (PARTITION BY page_index ORDER BY region_order) - 1 AS BIGINT) AS region_order FROM regions WHERE least(x + w, 612) > greatest(x, 0) AND least(y + h, 792) > greatest(y, 0)",
)
def snk_layout_save(v):
    return state.save_layout(v.regions).select("page_index", "region_id", "x", "y", "w", "h", "region_order")


@query("snk_import", "SELECT doc_id AS page_index, CASE WHEN doc_id + 1 BETWEEN 3 AND 40 OR doc_id + 1 BETWEEN 55 AND 60 THEN 'queued' ELSE 'unprocessed' END AS status FROM documents")
def snk_import(v):
    return state.import_pages(v.table("documents").select(F.col("doc_id").alias("page_index")), [(3, 40), (55, 60)])


@query("snk_migrate", "SELECT proposal_id, coalesce(s.page_index, p.page_index) AS page_index FROM proposals p LEFT JOIN (SELECT span_id, page_index FROM spans WHERE page_index % 2 = 0) s ON p.span_id + 10000000 = s.span_id")
def snk_migrate(v):
    words = v.spans.where("page_index % 2 = 0").select(F.col("span_id").alias("of"), F.col("page_index").alias("target"))
    return v.proposals.join(words, F.col("span_id") + 10_000_000 == F.col("of"), "left").select("proposal_id", F.coalesce("target", "page_index").alias("page_index"))


@query("snk_side_note_place", "SELECT page_index, region_id, kind, CASE WHEN kind = 'marginalia' THEN x + 5 ELSE x END AS x, kind = 'marginalia' AS manual FROM regions")
def snk_side_note_place(v):
    nested = v.regions.groupBy("page_index").agg(F.collect_list(F.struct("region_id", "kind", "x")).alias("regions"))
    moved = F.transform("regions", lambda r: F.struct(r["region_id"].alias("region_id"), r["kind"].alias("kind"), F.when(r["kind"] == "marginalia", r["x"] + 5).otherwise(r["x"]).alias("x"), (r["kind"] == "marginalia").alias("manual")))
    return nested.select("page_index", F.inline(moved))


@query("snk_upsert", "SELECT o_custkey AS key, o_orderkey AS version, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def snk_upsert(v):
    rows = v.table("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"), "o_orderdate")
    return state.latest(rows, ["key"], ["o_orderdate", "version"]).select("key", "version", "value")


@query("snk_run_log", "SELECT run_id, CASE WHEN status = 'running' THEN 'running' ELSE status END AS status, CASE WHEN status = 'running' THEN NULL ELSE elapsed_ms END AS elapsed_ms FROM runs")
def snk_run_log(v):
    started = v.runs.select("run_id", F.lit(0).alias("step"), F.lit("running").alias("status"), F.lit(None).cast("long").alias("elapsed_ms"))
    ended = v.runs.where("status <> 'running'").select("run_id", F.lit(1).alias("step"), "status", "elapsed_ms")
    return state.latest(started.union(ended), ["run_id"], ["step"]).select("run_id", "status", "elapsed_ms")


@query("snk_export_log", "SELECT path, max(event_id) AS export_id, count(*) AS replaced FROM (SELECT event_id, lower(replace('C:\\Books\\' || event_type || '/' || (user_id % 5) || '.DOCX', '\\', '/')) AS path FROM events) GROUP BY path")
def snk_export_log(v):
    path = F.concat(F.lit("C:\\Books\\"), "event_type", F.lit("/"), (F.col("user_id") % 5).cast("string"), F.lit(".DOCX"))
    return state.export_log(v.table("events").select(F.col("event_id").alias("export_id"), path.alias("path")))


@query("snk_ai_run", "SELECT provider, model, run_id, tokens_in FROM (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY started_at DESC, run_id DESC) AS rn FROM ai_runs) WHERE rn = 1")
def snk_ai_run(v):
    return state.latest(v.ai_runs, ["provider", "model"], ["started_at", "run_id"]).select("provider", "model", "run_id", "tokens_in")


@query(
    "snk_page_xml",
    """SELECT page_index, '<TextRegion order="' || region_order || '"><Coords points="' || CAST(trunc(x * 300 / 72) AS BIGINT) || ',' || CAST(trunc(y * 300 / 72) AS BIGINT) || '"/>' || t || '</TextRegion>' AS xml
    FROM regions JOIN (SELECT page_index, region_kind, string_agg(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), ' ' ORDER BY seq) AS t FROM spans WHERE text <> '' GROUP BY 1, 2) USING (page_index) WHERE kind = region_kind""",
)
def snk_page_xml(v):
    from quirewise.operators import export

    return export.page_xml(v.spans, v.regions)


@query("snk_archive", "SELECT page_index, kind, count(*) AS n FROM regions GROUP BY 1, 2")
def snk_archive(v):
    """Regions and words are written as parts of an archive; counted in the part that is read back."""
    parts = {"regions": v.regions, "words": v.words.select("page_index", "seq", "text")}
    folder = storage.new_path(v.spark, "archive")
    sinks.archive(parts, folder)
    return sinks.read_part(parts["regions"], folder, "regions").groupBy("page_index", "kind").agg(F.count("*").alias("n"))


@query(
    "snk_page_text",
    """SELECT proposal_id, CASE WHEN page_index % 2 = 1 THEN status WHEN status IN ('accepted', 'rejected', 'deferred') THEN 'stale' ELSE status END AS status FROM proposals WHERE NOT (page_index % 2 = 0 AND status IN ('open', 'applied_auto'))""",
)
def snk_page_text(v):
    return state.replace_page_text(v.proposals, v.pages.where("page_index % 2 = 0")).select("proposal_id", "status")


@query("snk_atomic_publish", "SELECT count(*) AS spans, count(DISTINCT span_id) AS ids, count(*) = count(DISTINCT span_id) AS publish FROM spans")
def snk_atomic_publish(v):
    """Written aside, checked for repeated ids, renamed; counted in what was published."""
    counts = lambda df: df.agg(F.count("*").alias("spans"), F.countDistinct("span_id").alias("ids"))
    rows = v.spans.select("page_index", "seq", "span_id", "text")
    out = sinks.publish(rows, storage.new_path(v.spark, "publish"), "spans", lambda df: counts(df).where("spans <> ids").isEmpty())
    return counts(rows).withColumn("publish", F.lit(False)) if out is None else counts(out).withColumn("publish", F.lit(True))


@query("snk_save_copy", "SELECT page_index, region_id, kind, x, y, w, h FROM regions")
def snk_save_copy(v):
    """A copy, stored whole and read back."""
    return storage.stored(v.regions.select("page_index", "region_id", "kind", "x", "y", "w", "h"), "copy")
