"""Export: page XML, plans and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.functions.text import xml_escape


def ordered_text(text: Column, order: str = "seq", glue: str = " ") -> Column:
    """An aggregate: texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("_t")))), lambda x: x["_t"]), glue)


def page_xml(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """A TextRegion element for each region with words, at 300 dots an inch."""
    texts = spans.where("text <> ''").groupBy("page_index", F.col("region_kind").alias("kind")).agg(ordered_text(xml_escape(F.col("text"))).alias("_text"))
    pixel = lambda c: (F.col(c) * 300 / 72).cast("long").cast("string")
    element = F.concat(F.lit('<TextRegion order="'), F.col("region_order").cast("string"), F.lit('"><Coords points="'), pixel("x"), F.lit(","), pixel("y"), F.lit('"/>'), "_text", F.lit("</TextRegion>"))
    return regions.join(texts, ["page_index", "kind"]).select("page_index", element.alias("xml"))


#: Where a class of region goes by default, and in which order on its page.
POLICY = (("header", "head", 0), ("page_number", "head", 0), ("heading", "body", 1), ("body", "body", 1), ("marginalia", "side_note", 1), ("footnote", "footnote", 2), ("footer", "footer", 3))


def compose(spans: DataFrame, regions: DataFrame, listed: bool = False) -> DataFrame:
    """The plan: a row for each paragraph (page_index, section, region_order, paragraph), with its text and words, in order. ``listed``: with the words' ids
    and how many of them are flagged (``spans`` has flagged)."""
    placement, rank = F.lit("body"), F.lit(1)
    for kind, place, n in POLICY:
        placement = F.when(F.col("region_kind") == kind, F.lit(place)).otherwise(placement)
        rank = F.when(F.col("region_kind") == kind, F.lit(n)).otherwise(rank)
    orders = regions.select("page_index", F.col("kind").alias("region_kind"), "region_order")
    words = spans.where("text <> ''").join(orders, ["page_index", "region_kind"])
    number = F.sum(F.col("paragraph_start").cast("long")).over(Window.partitionBy("page_index", "region_kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    b = words.withColumn("paragraph", number).withColumn("placement", placement).withColumn("section", rank.cast("long"))
    more = [F.transform(F.array_sort(F.collect_list(F.struct("seq", "span_id"))), lambda x: x["span_id"]).alias("span_ids"), F.count_if("flagged").alias("flags")] if listed else []
    return b.groupBy("page_index", "section", "region_order", "paragraph", "placement").agg(ordered_text(F.col("text")).alias("text"), F.count("*").alias("words"), *more)


def snapshot(pages: DataFrame, spans: DataFrame, regions: DataFrame, issues: DataFrame, refs: DataFrame, parts: DataFrame) -> DataFrame:
    """A nested document for each page that has its text: regions and words in order, each word with the open or deferred issue that flags it, how many
    there are of either, and the numbered notes with their parts.

    ``refs``: page_index, anchor, note, number, marker (number null: not linked); ``parts``: page_index, head, note. Every child table is nested by
    page before it is joined, so none multiplies another's rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("region_order", "region_id", "kind", *"xywh")))
    shown = issues.where("status IN ('open', 'deferred')")
    flag = F.struct("kind", "score", "reason", (F.col("status") == "deferred").alias("deferred"))
    flags = shown.groupBy("page_index", "span_id").agg(F.max_by(flag, F.struct("seq", "issue_id")).alias("flag"))
    words = F.array_sort(F.collect_list(F.struct("seq", "span_id", "text", "trailing", "origin", "confidence", "paragraph_start", "flag")))
    r = regions.groupBy("page_index").agg(listed.alias("regions"))
    s = spans.join(flags, ["page_index", "span_id"], "left").groupBy("page_index").agg(words.alias("spans"))
    i = shown.groupBy("page_index").agg(F.count_if(F.col("status") == "open").alias("unresolved"), F.count_if(F.col("status") == "deferred").alias("deferred"))
    p = parts.groupBy("page_index", F.col("head").alias("note")).agg(F.array_sort(F.collect_list(parts["note"])).alias("parts"))
    notes = refs.where("number IS NOT NULL").join(p, ["page_index", "note"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<bigint>")))
    n = notes.groupBy("page_index").agg(F.array_sort(F.collect_list(F.struct("number", "anchor", "note", "marker", "parts"))).alias("footnotes"))
    out = pages.where("text_done").select("page_index", "status")
    for child in (r, s, i, n):
        out = out.join(child, "page_index", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("page_index", "status", empty("regions"), empty("spans"), zero("unresolved"), zero("deferred"), empty("footnotes"))


@dataclass(frozen=True)
class Settings:
    """How a document is written: a source page a page (``mirror``) or in one flow; with running heads and feet of its own sections (``native``); ``working``
    copies mark flagged words, and comment on those of the body if ``comments`` is set; ``drop_caps`` frames the first letter of a page's body."""

    mirror: bool = True
    native: bool = False
    working: bool = False
    comments: bool = False
    drop_caps: bool = False
    title: str = ""
    excluded: tuple[str, ...] = ()


#: Styles that a document defines; a marker that must not be in its text.
STYLES, MARKERS = ("RunningHead", "PrintedPageNumber", "SideNote", "FooterNote", "FootnoteText", "Heading1"), (r"\[Source page", r"\[Page ")
#: A written paragraph. place: body, side_note, header, footer, footnote; framed: a drop cap, whose paragraph goes on in the next row.
PARAGRAPH = "page_index long, nth long, place string, text string, framed boolean, boxed boolean, attributes string, page_break boolean, section boolean, link string, refs long, highlights long, comments long"


def render(plan: DataFrame, notes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, parts) of the document that a plan (``compose`` with ``listed``) gives; ``notes``: page_index, number, text of linked footnotes.

    Parts are named texts: the document itself, styles, properties, relations from links to heads and feet, notes.
    """
    place = F.when(F.col("placement") == "head", "header").when(F.col("placement") == "footer", "footer").when(F.col("placement") == "side_note", "side_note").otherwise("body")
    if not settings.native:
        place = F.when(place == "side_note", place).otherwise(F.lit("body"))
    kept = plan.where(~F.col("placement").isin(*settings.excluded)) if settings.excluded else plan
    order = Window.partitionBy("page_index").orderBy("section", "region_order", "paragraph")
    b = kept.withColumn("place", place).withColumn("nth", (2 * F.row_number().over(order)).cast("long"))
    first_body = F.min(F.when((F.col("placement") == "body") & F.col("text").rlike(r"^\p{L}."), F.col("nth"))).over(Window.partitionBy("page_index"))
    capped = F.coalesce(F.col("nth") == first_body, F.lit(False)) if settings.drop_caps else F.lit(False)
    row = lambda text, framed, nth, marks: F.struct(nth.alias("nth"), text.alias("text"), framed.alias("framed"), marks.alias("marks"))
    letters = F.array(row(F.substring("text", 1, 1), F.lit(True), F.col("nth") - 1, F.lit(0).cast("long")), row(F.substring("text", 2, 2**31 - 1), F.lit(False), F.col("nth"), F.col("flags")))
    b = b.withColumn("_rows", F.when(capped, letters).otherwise(F.array(row(F.col("text"), F.lit(False), F.col("nth"), F.col("flags")))))
    b = b.select("page_index", "place", "placement", F.inline("_rows"))
    last = F.max("nth").over(Window.partitionBy("page_index")) == F.col("nth")
    pages = notes.groupBy("page_index").agg(F.count(F.lit(1)).alias("_notes"))
    b = b.withColumn("_last", last).join(pages, "page_index", "left")
    end = plan.agg(F.max("page_index")).first()[0]
    ends = F.col("_last") & (F.col("page_index") < F.lit(end))
    native = F.lit(settings.native)
    linked = F.when(native & F.col("place").isin("header", "footer"), F.concat(F.lit("r"), F.col("page_index").cast("string"), F.lit("-"), "place"))
    marks = F.col("marks") if settings.working else F.lit(0).cast("long")
    paragraphs = b.select(
        "page_index", "nth", "place", "text", "framed", (F.col("place") == "side_note").alias("boxed"), F.when(F.col("place") == "side_note", "w:hSpace w:vSpace").alias("attributes"), (ends & F.lit(settings.mirror and not settings.native)).alias("page_break"),
        (F.col("_last") & native).alias("section"), linked.alias("link"), F.when(F.col("_last"), F.coalesce("_notes", F.lit(0))).otherwise(0).cast("long").alias("refs"), marks.alias("highlights"),
        F.when(F.col("place").isin("body", "side_note") & F.lit(settings.comments), marks).otherwise(0).cast("long").alias("comments"),
    )
    spark = plan.sparkSession
    fixed = spark.createDataFrame([("content types", ""), ("document", ""), ("styles", " ".join(STYLES)), ("title", settings.title)], "part string, text string").select(F.col("part"), F.lit(None).cast("string").alias("name"), "text")
    links = paragraphs.where("link IS NOT NULL").select("link", "page_index", "place").distinct()
    target = F.concat("place", F.col("page_index").cast("string"), F.lit(".xml"))
    parts = fixed.unionByName(links.select(F.lit("relation").alias("part"), F.col("link").alias("name"), target.alias("text")))
    parts = parts.unionByName(links.select(F.lit("file").alias("part"), target.alias("name"), F.lit("").alias("text")))
    parts = parts.unionByName(notes.select(F.lit("footnote").alias("part"), F.concat_ws(":", F.col("page_index").cast("string"), F.col("number").cast("string")).alias("name"), "text"))
    return paragraphs, parts


def _sequence(df: DataFrame, name: str) -> DataFrame:
    """Texts that aren't blank, numbered within their page."""
    order = Window.partitionBy("page_index").orderBy("nth")
    shown = df.withColumn("_t", F.trim(F.regexp_replace("text", r"\s+", " "))).where("_t <> ''")
    return shown.select("page_index", F.row_number().over(order).alias("at"), F.col("_t").alias(name))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sums, a row each, as one row."""
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")


#: Ids to a block: runs of ids meet where their blocks are.
BLOCK = 10_000


def covered_ids(plan: DataFrame) -> DataFrame:
    """emitted, doubled of a plan's span_ids, one row: how many there are, and how many of them are there already. Runs of consecutive ids are dealt, not the ids."""
    own = plan.select("page_index", F.monotonically_increasing_id().alias("_row"), F.size("span_ids").cast("long").alias("_n"), F.posexplode_outer(F.array_sort(F.array_distinct("span_ids"))).alias("_k", "_id"))
    runs = own.groupBy("page_index", "_row", (F.col("_id") - F.col("_k")).alias("_at")).agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.max(F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("_n")).otherwise(0)).alias("_n"))
    blocks = runs.withColumn("_b", F.explode_outer(F.sequence(F.floor(F.col("_lo") / BLOCK), F.floor(F.col("_hi") / BLOCK))))
    first = F.coalesce(F.col("_b") == F.floor(F.col("_lo") / BLOCK), F.lit(True))
    blocks = blocks.select("_b", F.greatest("_lo", F.col("_b") * BLOCK).alias("_lo"), F.least("_hi", (F.col("_b") + 1) * BLOCK - 1).alias("_hi"), F.when(first, F.col("_n")).otherwise(0).alias("_n"))
    before = F.max("_hi").over(Window.partitionBy("_b").orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("_hi") - F.greatest(F.col("_lo") - 1, F.coalesce(before, F.col("_lo") - 1)), F.lit(0))
    sums = blocks.withColumn("_new", new).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("emitted"), F.coalesce(F.sum("_new"), F.lit(0)).alias("_once"))
    return sums.select("emitted", (F.col("emitted") - F.col("_once")).alias("doubled"))


def validate(paragraphs: DataFrame, parts: DataFrame, plan: DataFrame, notes: DataFrame, joined: DataFrame, settings: Settings, words: int, excluded: int, drop_caps: int | None = None) -> DataFrame:
    """check, ok, detail for a document that was read back (``paragraphs``, ``parts``) against what was planned.

    ``joined``: words that were joined over a page break (text); ``words``: how many the snapshot has, of which ``excluded`` are left out. Everything
    is compared by page or by key and summed; only the sums meet.
    """
    kept = plan.where(~F.col("placement").isin(*settings.excluded)) if settings.excluded else plan
    order = Window.partitionBy("page_index").orderBy("section", "region_order", "paragraph")
    planned = _sequence(kept.withColumn("nth", F.row_number().over(order)), "planned")
    flow = Window.partitionBy("page_index").orderBy("nth")
    after_cap = F.coalesce(F.lag("framed").over(flow), F.lit(False))
    whole = paragraphs.withColumn("_rest", F.lead("text").over(flow)).withColumn("_cap", after_cap)
    whole = whole.withColumn("_merged", F.col("framed") & F.col("_rest").isNotNull())
    read = _sequence(whole.where("NOT _cap").withColumn("text", F.when(F.col("_merged"), F.concat("text", "_rest")).otherwise(F.col("text"))), "read")
    both = planned.join(read, ["page_index", "at"], "full")
    parity = both.agg(
        F.count("planned").alias("planned"), F.count("read").alias("read"), F.min(F.when(~F.col("planned").eqNullSafe(F.col("read")), F.struct("page_index", "at", "planned", "read"))).alias("first"),
    )

    native = settings.native and settings.mirror
    sums = paragraphs.agg(
        *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("refs", "highlights", "comments", "page_break")), (F.coalesce(F.sum(F.col("section").cast("long")), F.lit(0)) + (0 if native else 1)).alias("sections"), F.countDistinct("page_index").alias("pages"),
        F.count_if(F.col("place") == "side_note").alias("notes_read"), F.count_if(F.col("boxed")).alias("boxes"), F.count_if(F.col("attributes").rlike("w:[hv]_space")).alias("bad_attributes"), F.count_if(F.col("text").rlike("|".join(MARKERS))).alias("markers"),
        F.countDistinct(F.when(F.col("place") == "header", F.col("link"))).alias("heads"), F.countDistinct(F.when(F.col("place") == "footer", F.col("link"))).alias("feet"),
    )
    caps = whole.agg(F.count_if("_merged").alias("caps"))
    targets = parts.where("part = 'relation'").select(F.col("name").alias("link"), F.col("text").alias("_target"))
    files = parts.where("part = 'file'").select(F.col("name").alias("_target"), F.lit(True).alias("_there")).distinct()
    dead = paragraphs.where("link IS NOT NULL").select("link").distinct().join(targets, "link", "left").join(files, "_target", "left").agg(F.count_if(F.col("_there").isNull()).alias("dead"))
    cover = covered_ids(kept)
    wanted = joined.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("asked"))
    in_flow = whole.where("NOT _cap").withColumn("text", F.when(F.col("_merged"), F.concat("text", "_rest")).otherwise(F.col("text")))
    tokens = in_flow.select(F.explode(F.split("text", r"[^\p{L}\p{N}]+")).alias("text"))
    times = wanted.join(tokens.join(wanted.select("text"), "text", "left_semi").groupBy("text").agg(F.count(F.lit(1)).alias("times")), "text", "left").select("text", F.coalesce("times", F.lit(0)).alias("times"))
    across = times.agg(F.count(F.lit(1)).alias("joined"), F.count_if(F.col("times") != 1).alias("unlike"), F.min(F.when(F.col("times") != 1, F.struct("text", "times"))).alias("worst"))
    note_texts = parts.where("part = 'footnote'").select(F.col("text").alias("_t")).distinct()
    squeezed = notes.withColumn("_t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    lost = squeezed.join(note_texts.select(F.trim(F.regexp_replace("_t", r"\s+", " ")).alias("_t")).distinct(), "_t", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    counts = _beside(notes.agg(F.count(F.lit(1)).alias("linked")), parts.where("part = 'footnote'").agg(F.count(F.lit(1)).alias("stored")))
    wish = kept.agg(F.coalesce(F.sum("flags"), F.lit(0)).alias("flags"), F.coalesce(F.sum(F.when(F.col("placement").isin("body", "side_note", "footnote") | F.lit(not settings.native), F.col("flags"))), F.lit(0)).alias("body_flags"), F.count_if(F.col("placement") == "side_note").alias("side_notes"), F.countDistinct("page_index").alias("plan_pages"), F.countDistinct(F.when(F.col("placement") == "head", F.col("page_index"))).alias("headed"))
    known = parts.agg(
        F.count_if(F.col("part") == "content types").alias("types"), F.count_if(F.col("part") == "document").alias("document"), F.max(F.when(F.col("part") == "title", F.col("text"))).alias("title"), F.coalesce(F.max(F.when(F.col("part") == "styles", F.col("text"))), F.lit("")).alias("styles"),
    )
    one = parity
    for other in (sums, caps, dead, cover, across, lost, counts, wish, known):
        one = _beside(one, other)
    c, s = F.col, lambda name: F.col(name).cast("string")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    expect_caps = F.lit(drop_caps) if drop_caps is not None else F.col("caps")
    styled = F.size(F.filter(F.array(*map(F.lit, STYLES)), lambda x: F.array_contains(F.split(c("styles"), " "), x)))
    breaks = c("page_break") == (F.greatest(c("plan_pages"), F.lit(1)) - 1 if settings.mirror and not native else F.lit(0))
    bounds = breaks & (c("sections") == (c("plan_pages") if native else F.lit(1)))
    bound_text = text(s("page_break"), " page breaks and ", s("sections"), " sections for ", s("plan_pages"), " pages")
    same = c("first").isNull()
    differs = text(s("planned"), " planned, ", s("read"), " read; first difference on page ", s("first.page_index"), " at paragraph ", s("first.at"), ": “", F.coalesce(T.clip(c("first.planned")), F.lit("")), "”, “", F.coalesce(T.clip(c("first.read")), F.lit("")), "”")
    covered = (c("emitted") + excluded == words) & (c("doubled") == 0)
    linked = (c("dead") == 0) & (F.lit(not native) | (c("heads") >= c("headed")))
    if settings.working:
        copy = ("working copy", (c("highlights") == c("flags")) & (c("comments") == (c("body_flags") if settings.comments else 0)), text(s("flags"), " flags, ", s("highlights"), " highlights, ", s("comments"), " comments"))
    else:
        copy = ("clean copy", (c("highlights") == 0) & (c("comments") == 0), text(s("highlights"), " highlights, ", s("comments"), " comments"))
    rows = [
        ("structure", (c("types") > 0) & (c("document") > 0), text(s("types"), " content types, ", s("document"), " documents")), ("frame attributes", c("bad_attributes") == 0, text(s("bad_attributes"), " frames with names outside the schema")),
        ("side note boxes", (c("notes_read") == c("side_notes")) & (c("boxes") == c("side_notes")), text(s("boxes"), " of ", s("side_notes"), " side notes in boxes")), ("drop caps", c("caps") == expect_caps, text(s("caps"), " framed")),
        ("text parity", same, F.when(same, text(s("read"), " paragraphs match")).otherwise(differs)), ("coverage", covered, text(s("emitted"), " words and ", str(excluded), " excluded of ", str(words), "; ", s("doubled"), " twice")),
        ("cross-page words", c("unlike") == 0, F.when(c("unlike") == 0, text(s("joined"), " joined words once each")).otherwise(text(s("unlike"), " not once, as “", c("worst.text"), "” ", s("worst.times"), " times"))), ("page boundaries", bounds, bound_text),
        ("heads and feet", linked, text(s("heads"), " heads and ", s("feet"), " feet, ", s("dead"), " without a file")), ("linked footnotes", (c("refs") == c("linked")) & (c("lost") == 0), text(s("refs"), " references to ", s("linked"), " notes, ", s("stored"), " stored")),
        ("no markers", c("markers") == 0, text(s("markers"), " paragraphs with a page marker")), copy, ("properties", F.lit(not settings.title) | F.coalesce(c("title") == settings.title, F.lit(False)), text("title ", F.coalesce(c("title"), F.lit("missing")))),
        ("styles", styled == len(STYLES), text(styled.cast("string"), f" of {len(STYLES)} styles")),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail")) for name, ok, detail in rows))))
