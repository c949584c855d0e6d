"""The book store's tables, derived from the driver's Parquet tables by fixed arithmetic.

A document stands for a page: its lines and words get a typewriter's geometry, and review state follows from residues
of page and word numbers. Every view is stated twice, as a DataFrame here and as SQL in ``SQL``, so that queries
over them can be checked by another engine.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.sources.storage import size_of, stored

#: Bytes of the documents' files to a part of the pages: its words, some twenty times as many bytes as rows, are sorted in memory.
PART = 4_000_000
#: Joins whose keys begin with the page find both sides dealt by page and move nothing.
_BY_PAGE = "spark.sql.requireAllClusterKeysForCoPartition"
#: Texts that go to Python at once: their words take some thirty times as much.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

PAGE_W, PAGE_H = 612.0, 792.0


def _page() -> Window:
    return Window.partitionBy("page_index")


def pick(n: Column, *values: str | None) -> Column:
    """``values[n % len(values)]``."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(n: str, *values: str | None) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[({n}) % {len(values)} + 1]"


class Views:
    """Lazily built views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set(_BY_PAGE, "false")
        spark.conf.set(_BATCH, "2000000")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @functools.cached_property
    def pages(self) -> DataFrame:
        n = F.col("doc_id")
        return self.table("documents").select(
            n.alias("page_index"),
            pick(n, "done", "done", "queued", "done", "unprocessed", "done", "failed", "excluded", "done").alias("status"),
            (n % 5 + 1).alias("text_revision"),
            (n % 4 + 1).alias("layout_revision"),
            F.when(n % 3 == 0, n % 5 + 1).when(n % 3 == 1, n % 5).alias("approved_text"),
            F.when(n % 3 != 2, F.when(n % 11 == 0, n % 4).otherwise(n % 4 + 1)).alias("approved_layout"),
            (n % 2 == 0).alias("ocr_done"),
            (n % 6 < 4).alias("layout_done"),
            (n % 6 < 2).alias("text_done"),
            F.col("n_chars"),
        )

    @functools.cached_property
    def lines(self) -> DataFrame:
        lines = self.table("documents").select(F.col("doc_id").alias("page_index"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        return lines.where(F.trim("line") != "").select("page_index", F.col("line_no").cast("long").alias("line_no"), "line")

    @staticmethod
    def _page_lines(documents: DataFrame) -> DataFrame:
        """page_index and its lines that have words, as an array<struct<line_no, words>>: a page is one row."""
        line = lambda x, i: F.struct(i.alias("line_no"), F.filter(F.split(x, " "), lambda w: w != "").alias("words"))
        lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: F.size(x["words"]) > 0)
        return documents.select(F.col("doc_id").alias("page_index"), lines.alias("lines"))

    @functools.cached_property
    def worded_lines(self) -> DataFrame:
        """page_index, line_no and the line's words in order, made inside the page's row."""
        rows = self._page_lines(self.table("documents")).select("page_index", F.inline("lines"))
        return rows.select("page_index", F.col("line_no").cast("long").alias("line_no"), "words")

    @functools.cached_property
    def parts(self) -> int:
        """Into how many parts pages are dealt."""
        return max(self.spark.sparkContext.defaultParallelism, -(-size_of(self.spark, f"{self.sf_dir}/documents.parquet") // PART))

    @functools.cached_property
    def _dealt(self) -> DataFrame:
        """doc_id and text, dealt by page before words are made of them: texts are shuffled once, words never, as long as the page is among the keys."""
        return self.table("documents").select("doc_id", "text").repartition(self.parts, "doc_id")

    def settled(self, places: bool = False) -> Views:
        """These views over words that are stored by page, for queries that read them several times. Without ``places`` x is null."""
        out = Views(self.spark, self.sf_dir)
        words = self._words.drop("passed")
        out._words = stored(words if places else words.withColumn("x", F.lit(None).cast("double")), "words", self.parts)
        return out

    @functools.cached_property
    def _words(self) -> DataFrame:
        """Words numbered inside their page's row, with the lines and words that come first and last.

        The place in the line is a running sum over the page in order, which is in one part.
        """
        end = lambda at: F.try_element_at("lines", F.lit(at))["line_no"].cast("long")
        word = lambda x: F.transform(x["words"], lambda w, j: F.struct(x["line_no"].alias("line_no"), j.alias("word_no"), w.alias("text"), F.size(x["words"]).alias("n")))
        # outer: words are sought once, not a first time for a filter on pages without any
        rows = self._page_lines(self._dealt).select("page_index", end(1).alias("first_line"), end(-1).alias("last_line"), F.posexplode_outer(F.flatten(F.transform("lines", word))).alias("seq", "k")).where("k IS NOT NULL")
        seq, line_no, word_no = F.col("seq").cast("long"), F.col("k.line_no").cast("long"), F.col("k.word_no").cast("long")
        rows = rows.select("page_index", line_no.alias("line_no"), word_no.alias("word_no"), seq.alias("seq"), F.col("k.text").alias("text"), "first_line", "last_line", (F.col("k.n") - 1).cast("long").alias("last_word"))
        order = _page().orderBy("seq")
        passed = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at_start = F.max(F.when(F.col("word_no") == 0, F.col("passed"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("passed", passed).withColumn("x", 36.0 + 6.0 * (F.col("passed") - at_start))

    @functools.cached_property
    def _loose(self) -> DataFrame:
        """``_words`` for queries of single words: made a batch of pages at a time, which costs a third, but Spark doesn't know them to be dealt by page any more."""
        end = lambda at: F.try_element_at("ws", F.lit(at))["line_no"].cast("long")
        long = lambda name: F.col(f"k.{name}").cast("long").alias(name)
        rows = self._dealt.select(F.col("doc_id").alias("page_index"), T.placed_words("text").alias("ws"))
        # outer: words are sought once, not a first time for a filter on pages without any
        rows = rows.select("page_index", end(1).alias("first_line"), end(-1).alias("last_line"), F.posexplode_outer("ws").alias("seq", "k")).where("k IS NOT NULL")
        return rows.select("page_index", long("line_no"), long("word_no"), F.col("seq").cast("long").alias("seq"), F.col("k.text").alias("text"), "first_line", "last_line", long("last_word"), (36.0 + 6.0 * F.col("k.passed")).alias("x"))

    @functools.cached_property
    def words(self) -> DataFrame:
        return self._shown(self._words)

    @functools.cached_property
    def loose_words(self) -> DataFrame:
        """``words`` for queries that look at each by itself."""
        return self._shown(self._loose)

    @staticmethod
    def _shown(words: DataFrame) -> DataFrame:
        return words.select(
            "page_index", "line_no", "word_no", "seq", "text", "x", (36.0 + 14.0 * F.col("line_no")).alias("y"), (6.0 * F.length("text")).alias("w"), F.lit(10.0).alias("h"),
            ((F.col("page_index") * 31 + F.col("line_no") * 17 + F.col("word_no") * 7) % 101).alias("confidence"),
        )

    @functools.cached_property
    def page_words(self) -> DataFrame:
        """page_index and its words in order, a page a row."""
        return self._dealt.select(F.col("doc_id").alias("page_index"), F.array_remove(F.split("text", "[ \n]+"), "").alias("words"))

    @functools.cached_property
    def texts(self) -> DataFrame:
        """page_index, text of every word, where neither places nor order are asked for: one split a page."""
        rows = self.table("documents").select(F.col("doc_id").alias("page_index"), F.explode(F.split("text", "[ \n]")).alias("text"))
        return rows.where("text <> ''")

    @functools.cached_property
    def regions(self) -> DataFrame:
        return self._regions(self.table("documents"))

    @functools.cached_property
    def dealt_regions(self) -> DataFrame:
        """``regions`` dealt by page as words are: joins of both move only texts."""
        return self._regions(self._dealt)

    def _regions(self, documents: DataFrame) -> DataFrame:
        """Header, body and footer, the boxes of a page's first, middle and last lines, made inside its row; on some pages a side note over the body and an ignored box."""
        fields = lambda kind, x, y, w, h, n: (kind.alias("kind"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), n.cast("long").alias("line_count"))
        n = F.size("lines")

        def lines_box(kind: str, start: Column, count: Column) -> Column:
            part = F.slice("lines", start, F.greatest(count, F.lit(0)))
            right = F.array_max(F.transform(part, lambda x: F.length(F.array_join(x["words"], " "))))
            top, last = F.element_at(part, 1)["line_no"], F.element_at(part, -1)["line_no"]
            return F.struct(*fields(F.lit(kind), F.lit(36.0), 36.0 + 14.0 * top, 6.0 * right, 10.0 + 14.0 * (last - top), F.size(part)))

        def fixed(kind: str, *box: float) -> Column:
            return F.struct(*fields(F.lit(kind), *map(F.lit, box), F.lit(0)))

        page = F.col("page_index")
        boxes = F.array(
            F.when(n > 0, lines_box("header", F.lit(1), F.lit(1))), F.when(n > 2, lines_box("body", F.lit(2), n - 2)), F.when(n > 1, lines_box("footer", F.greatest(n, F.lit(1)), F.lit(1))),
            F.when(page % 7 == 0, fixed("marginalia", 20.0, 50.0, 40.0, 400.0)), F.when(page % 11 == 0, fixed("ignore", 60.0, 60.0, 60.0, 14.0)),
        )
        rows = self._page_lines(documents).select("page_index", F.inline(F.filter(boxes, lambda b: b.isNotNull())))
        order = F.when(F.col("kind") == "header", 0).when(F.col("kind") == "ignore", 1).when(F.col("kind") == "body", 2).when(F.col("kind") == "footer", 3).otherwise(4).cast("long")
        return rows.withColumn("region_order", order).withColumn("region_id", F.col("page_index") * 10 + F.col("region_order"))

    @functools.cached_property
    def spans(self) -> DataFrame:
        s, p = F.col("seq"), F.col("page_index")
        kind = F.when(F.col("line_no") == F.col("first_line"), "header").when(F.col("line_no") == F.col("last_line"), "footer").otherwise("body")
        return self._words.select(
            "page_index", "seq", (p * 10_000_000 + s).alias("span_id"), kind.alias("region_kind"), F.when((s + p) % 61 == 0, "").otherwise(F.col("text")).alias("text"),
            F.when(F.col("word_no") == F.col("last_word"), "\n").otherwise(" ").alias("trailing"), pick(s + p, "ocr", "ocr", "auto_applied", "ocr", "human", "ocr").alias("origin"),
            ((p * 31 + F.col("line_no") * 17 + F.col("word_no") * 7) % 101).alias("confidence"), (s % 4 + 1).alias("revision"), (s % 97 == 0).alias("protected"), (F.col("word_no") == 0).alias("paragraph_start"), "line_no", "word_no",
            "x", (36.0 + 14.0 * F.col("line_no")).alias("y"), (6.0 * F.length(F.col("text"))).alias("w"), F.lit(10.0).alias("h"),
        )

    @functools.cached_property
    def proposals(self) -> DataFrame:
        s, p = F.col("seq"), F.col("page_index")
        rows = self.spans.where((s + p) % 17 == 0).withColumn("nth", F.explode(F.sequence(F.lit(0), ((s + p) % 3).cast("int")))).withColumn("nth", F.col("nth").cast("long"))
        return rows.select(
            "page_index", "seq", "span_id", (F.col("span_id") * 4 + F.col("nth")).alias("proposal_id"), "revision", pick(s + p + F.col("nth"), "hyphen_join", "ocr_confusion", "spelling", "proper_name").alias("kind"),
            F.col("text").alias("original"), F.concat("text", pick(s + F.col("nth"), "e", "s", "")).alias("replacement"), ((s * 7 + F.col("nth") * 13 + p) % 101).alias("score"),
            pick(s + F.col("nth"), "open", "applied_auto", "accepted", "rejected", "deferred", "stale", "open").alias("status"), pick(p + s, "text_pass", "ai:alpha", "second_engine").alias("source"), "nth",
        )

    @functools.cached_property
    def issues(self) -> DataFrame:
        """Low-confidence words, with candidates as ``source=text`` entries."""
        s, p, c = F.col("seq"), F.col("page_index"), F.col("confidence")
        rows = self.spans.where((c < 20) & (F.col("text") != ""))
        score = F.when(s % 13 != 0, (c * 5 + s) % 101)
        return rows.select(
            "page_index", "seq", (F.col("span_id") * 2 + 1).alias("issue_id"), "span_id", pick(s + p, "hyphen_join", "ocr_confusion", "spelling", "proper_name", "low_confidence", "flag", "missing_text").alias("kind"), score.alias("score"),
            F.col("text").alias("original"), F.when(s % 3 != 0, F.concat("text", F.lit("e"))).alias("replacement"), pick(s, "open", "resolved", "open", "deferred", "open", "stale").alias("status"),
            pick(s, None, "accept", None, "later", None).alias("decision"), pick(s + p, "AI alpha", "text pass", "second engine", "region OCR").alias("candidate_source"), (s % 9).alias("created_at"), "revision", "protected",
        )

    @functools.cached_property
    def runs(self) -> DataFrame:
        """Processing runs: an event of a page, in stages by event type."""
        e = F.col("event_id")
        stage = F.when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "click", "layout").when(F.col("event_type") == "signup", "text").when(F.col("event_type") == "purchase", "export").otherwise("ai")
        return self.table("events").select(
            e.alias("run_id"), stage.alias("stage"), (e % 200).alias("page_index"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("started_at"), F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"),
            pick(e, "ok", "ok", "failed", "ok", "running").alias("status"), F.concat(F.lit("dpi="), (e % 3 * 100 + 200).cast("string"), F.lit(";threshold="), (e % 4 + 90).cast("string")).alias("settings"), (e % 8 == 0).alias("region_only"),
        )

    @functools.cached_property
    def history(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("history_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), pick(e, "decision", "group", "edit", "approve", "paragraph", "note", "approve").alias("kind"), (e % 40).alias("page_index"), (e % 5 == 0).alias("undone"),
            F.concat(F.lit('{"kind":"'), pick(e, "decision", "group", "edit", "approve", "paragraph", "note", "approve"), F.lit('","page":'), (e % 40).cast("string"), F.lit(',"span":"s'), (e % 25).cast("string"), F.lit('"}')).alias("payload"),
        )

    @functools.cached_property
    def ai_runs(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").where("event_type = 'error'").select(
            e.alias("run_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("started_at"), pick(e, "acme", "globex", "initech").alias("provider"), pick(e, "model-a", "model-a-2024-05-01", "model-b-mini", "model-x", "model-b").alias("model"), (e % 4).alias("requests"), (e * 37 % 5000).alias("tokens_in"), (e * 11 % 900).alias("tokens_out")
        )

    @functools.cached_property
    def tokens(self) -> DataFrame:
        """token, pages: distinct cores in lower case and the number of pages that have them. Stored, as lookups read it more than once."""
        core = F.lower(F.regexp_replace("text", "^[^\\p{L}\\p{N}'’]+|[^\\p{L}\\p{N}'’]+$", ""))
        return stored(self.texts.select("page_index", core.alias("token")).where("token <> ''").distinct().groupBy("token").agg(F.count("*").alias("pages")), "tokens")

    @functools.cached_property
    def lexicon(self) -> DataFrame:
        return self.tokens.where("pages >= 3").select("token")


SQL = {
    "pages": f"""SELECT doc_id AS page_index, {_sql_pick("doc_id", "done", "done", "queued", "done", "unprocessed", "done", "failed", "excluded", "done")} AS status,
      doc_id % 5 + 1 AS text_revision, doc_id % 4 + 1 AS layout_revision,
      CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 1 WHEN doc_id % 3 = 1 THEN doc_id % 5 END AS approved_text,
      CASE WHEN doc_id % 3 <> 2 THEN CASE WHEN doc_id % 11 = 0 THEN doc_id % 4 ELSE doc_id % 4 + 1 END END AS approved_layout,
      doc_id % 2 = 0 AS ocr_done, doc_id % 6 < 4 AS layout_done, doc_id % 6 < 2 AS text_done, n_chars FROM documents""",
    "lines": """SELECT * FROM (SELECT doc_id AS page_index, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''""",
    "words": """SELECT page_index, line_no, word_no, CAST(row_number() OVER (PARTITION BY page_index ORDER BY line_no, word_no) - 1 AS BIGINT) AS seq, text,
      36.0::DOUBLE + 6.0::DOUBLE * coalesce(sum(length(text) + 1) OVER (PARTITION BY page_index, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS x,
      36.0::DOUBLE + 14.0::DOUBLE * line_no AS y, 6.0::DOUBLE * length(text) AS w, 10.0::DOUBLE AS h, (page_index * 31 + line_no * 17 + word_no * 7) % 101 AS confidence
      FROM (SELECT page_index, line_no, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS word_no, unnest(ws) AS text
            FROM (SELECT page_index, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM lines))""",
    "regions": """SELECT *, page_index * 10 + region_order AS region_id FROM (
      SELECT *, CAST(CASE kind WHEN 'header' THEN 0 WHEN 'ignore' THEN 1 WHEN 'body' THEN 2 WHEN 'footer' THEN 3 ELSE 4 END AS BIGINT) AS region_order FROM (
      SELECT page_index, kind, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(DISTINCT line_no) AS line_count FROM (
        SELECT *, CASE WHEN line_no = min(line_no) OVER (PARTITION BY page_index) THEN 'header' WHEN line_no = max(line_no) OVER (PARTITION BY page_index) THEN 'footer' ELSE 'body' END AS kind FROM words)
      GROUP BY page_index, kind
      UNION ALL SELECT doc_id, 'marginalia', 20.0, 50.0, 40.0, 400.0, 0 FROM documents WHERE doc_id % 7 = 0
      UNION ALL SELECT doc_id, 'ignore', 60.0, 60.0, 60.0, 14.0, 0 FROM documents WHERE doc_id % 11 = 0))""",
    "spans": f"""SELECT page_index, seq, page_index * 10000000 + seq AS span_id,
      CASE WHEN line_no = min(line_no) OVER (PARTITION BY page_index) THEN 'header' WHEN line_no = max(line_no) OVER (PARTITION BY page_index) THEN 'footer' ELSE 'body' END AS region_kind,
      CASE WHEN (seq + page_index) % 61 = 0 THEN '' ELSE text END AS text,
      CASE WHEN word_no = max(word_no) OVER (PARTITION BY page_index, line_no) THEN chr(10) ELSE ' ' END AS trailing,
      {_sql_pick("seq + page_index", "ocr", "ocr", "auto_applied", "ocr", "human", "ocr")} AS origin, confidence, seq % 4 + 1 AS revision, seq % 97 = 0 AS protected,
      word_no = 0 AS paragraph_start, line_no, word_no, x, y, w, h FROM words""",
    "proposals": f"""SELECT page_index, seq, span_id, span_id * 4 + nth AS proposal_id, revision, {_sql_pick("seq + page_index + nth", "hyphen_join", "ocr_confusion", "spelling", "proper_name")} AS kind,
      text AS original, text || {_sql_pick("seq + nth", "e", "s", "")} AS replacement, (seq * 7 + nth * 13 + page_index) % 101 AS score,
      {_sql_pick("seq + nth", "open", "applied_auto", "accepted", "rejected", "deferred", "stale", "open")} AS status, {_sql_pick("page_index + seq", "text_pass", "ai:alpha", "second_engine")} AS source, nth
      FROM (SELECT *, unnest(generate_series(0, (seq + page_index) % 3)) AS nth FROM spans WHERE (seq + page_index) % 17 = 0)""",
    "issues": f"""SELECT page_index, seq, span_id * 2 + 1 AS issue_id, span_id, {_sql_pick("seq + page_index", "hyphen_join", "ocr_confusion", "spelling", "proper_name", "low_confidence", "flag", "missing_text")} AS kind,
      CASE WHEN seq % 13 <> 0 THEN (confidence * 5 + seq) % 101 END AS score, text AS original, CASE WHEN seq % 3 <> 0 THEN text || 'e' END AS replacement,
      {_sql_pick("seq", "open", "resolved", "open", "deferred", "open", "stale")} AS status, {_sql_pick("seq", None, "accept", None, "later", None)} AS decision,
      {_sql_pick("seq + page_index", "AI alpha", "text pass", "second engine", "region OCR")} AS candidate_source, seq % 9 AS created_at, revision, protected
      FROM spans WHERE confidence < 20 AND text <> ''""",
    "runs": f"""SELECT event_id AS run_id, CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'layout' WHEN 'signup' THEN 'text' WHEN 'purchase' THEN 'export' ELSE 'ai' END AS stage,
      event_id % 200 AS page_index, CAST(date_trunc('second', ts) AS TIMESTAMP) AS started_at, CAST(floor(value * 100) AS BIGINT) AS elapsed_ms, {_sql_pick("event_id", "ok", "ok", "failed", "ok", "running")} AS status,
      'dpi=' || (event_id % 3 * 100 + 200) || ';threshold=' || (event_id % 4 + 90) AS settings, event_id % 8 = 0 AS region_only FROM events""",
    "history": f"""SELECT event_id AS history_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS ts, {_sql_pick("event_id", "decision", "group", "edit", "approve", "paragraph", "note", "approve")} AS kind, event_id % 40 AS page_index, event_id % 5 = 0 AS undone,
      '{{"kind":"' || {_sql_pick("event_id", "decision", "group", "edit", "approve", "paragraph", "note", "approve")} || '","page":' || (event_id % 40) || ',"span":"s' || (event_id % 25) || '"}}' AS payload FROM events""",
    "ai_runs": f"""SELECT event_id AS run_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS started_at, {_sql_pick("event_id", "acme", "globex", "initech")} AS provider,
      {_sql_pick("event_id", "model-a", "model-a-2024-05-01", "model-b-mini", "model-x", "model-b")} AS model, event_id % 4 AS requests, event_id * 37 % 5000 AS tokens_in, event_id * 11 % 900 AS tokens_out FROM events WHERE event_type = 'error'""",
    "tokens": r"""SELECT token, count(*) AS pages FROM (SELECT DISTINCT page_index, lower(regexp_replace(text, '^[^\p{L}\p{N}''’]+|[^\p{L}\p{N}''’]+$', '', 'g')) AS token FROM words) WHERE token <> '' GROUP BY token""",
    "lexicon": "SELECT token FROM tokens WHERE pages >= 3",
}
#: The driver registers a table of this name; the derived pages are called so in SQL.
_ALIAS = {"pages": "book_pages"}


def with_views(sql: str, local: dict[str, str] | None = None) -> str:
    """``sql`` behind the definitions of the views it names, in order of need. ``book_pages`` names the pages view."""
    known = {_ALIAS.get(k, k): v for k, v in SQL.items()} | (local or {})
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(known[name])
                order.append(name)

    need(sql)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + "\n" if order else "") + sql
