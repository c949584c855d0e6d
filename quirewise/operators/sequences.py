"""Ordered sequences within a page: lines, paragraphs, hyphens, context, sentences, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators.layout import upper_median

#: Classes of region that are one paragraph each.
FURNITURE = ("header", "footer", "page_number", "catchword", "marginalia")
#: A line with so many words says where its region's left edge is; a paragraph is indented by over so many letter widths or such a share of
#: the page's width, follows a line shorter than such a share of the widest, or a pitch of over so many times the usual one.
EDGE_WORDS, INDENT_LETTERS, INDENT_PAGE, SHORT_LINE, WIDE_PITCH = 3, 1.5, 0.015, 0.7, 1.7
#: Words shown on either side of one; sentences and words of context.
AROUND, SENTENCES, CONTEXT_WORDS = 4, 2, 120


def page_order(*order: str, by: tuple[str, ...] = ("page_index",)) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def lines_of(words: DataFrame) -> DataFrame:
    """Lines with box, words and last word, ranked from the top."""
    lines = words.groupBy("page_index", "region_kind", "line_no").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.count("*").alias("words"), F.max_by("text", "x").alias("last_text"), F.min_by("text", "x").alias("first_text"), F.collect_list(F.col("w") / F.greatest(F.length("text"), F.lit(1))).alias("char_ws"),
    )
    return lines.withColumn("rank", F.row_number().over(page_order("y", "x", "line_no", by=("page_index", "region_kind"))).cast("long"))


def paragraph_starts(lines: DataFrame, page_w: float) -> DataFrame:
    """Lines with ``starts``: the first, an indented one, one after a short line, one after a wide gap; furniture has only the first.

    Region-wide measures (left edge, widest line, character width, pitch) are windows over the region's lines.
    """
    region = Window.partitionBy("page_index", "region_kind")
    order = region.orderBy("rank")
    prev = lambda c: F.lag(c).over(order)
    b = lines.withColumn("_pitch", F.col("y") - prev("y")).withColumn("_prev_w", prev("w")).withColumn("_prev_last", prev("last_text"))
    per = b.groupBy("page_index", "region_kind").agg(
        upper_median(F.when(F.col("words") >= EDGE_WORDS, F.col("x"))).alias("_left"), F.min("x").alias("_min_x"), F.max("w").alias("_widest"), upper_median(F.when(F.col("_pitch") > 0, F.col("_pitch"))).alias("_usual"),
        F.sort_array(F.flatten(F.collect_list("char_ws"))).alias("_cw"),
    )
    char_w = F.greatest(F.get("_cw", F.floor(F.size("_cw") / 2).cast("int")), F.lit(1.0))
    per = per.withColumn("_indent", F.greatest(INDENT_LETTERS * char_w, F.lit(INDENT_PAGE * page_w))).withColumn("_edge", F.when(F.col("_left") == 0, F.col("_min_x")).otherwise(F.col("_left"))).drop("_cw", "_left", "_min_x")
    b = b.join(per, ["page_index", "region_kind"])
    indented = F.col("x") - F.col("_edge") > F.col("_indent")
    short = (F.col("_prev_w") < SHORT_LINE * F.col("_widest")) & ~F.endswith("_prev_last", F.lit("-"))
    gap = (F.col("_usual") > 0) & (F.col("_pitch") > WIDE_PITCH * F.col("_usual"))
    starts = (F.col("rank") == 1) | (~F.col("region_kind").isin(*FURNITURE) & (indented | short | gap))
    return b.withColumn("starts", starts).drop("_pitch", "_prev_w", "_prev_last", "_widest", "_usual", "_indent", "_edge", "char_ws")


def paragraph_ids(lines: DataFrame) -> DataFrame:
    running = Window.partitionBy("page_index", "region_kind").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("paragraph", F.sum(F.col("starts").cast("long")).over(running))


def hyphen_pairs(lines: DataFrame) -> DataFrame:
    """A line's last word that ends in a hyphen (two letters or more) with the next line's first word, in one region."""
    order = Window.partitionBy("page_index", "region_kind").orderBy("rank")
    nxt = F.lead("first_text").over(order)
    pairs = lines.withColumn("_next", nxt).where(F.endswith("last_text", F.lit("-")) & (F.length(T.strip(F.col("last_text"))) >= 2) & F.col("_next").isNotNull())
    return pairs.select("page_index", "line_no", F.col("last_text").alias("head"), F.col("_next").alias("tail"))


def context(words: DataFrame, around: int = AROUND) -> Column:
    """A window column: the words around each, itself in brackets."""
    order = page_order("seq")
    before = [F.lag("text", k).over(order) for k in range(around, 0, -1)]
    after = [F.lead("text", k).over(order) for k in range(1, around + 1)]
    return F.concat_ws(" ", *before, F.concat(F.lit("["), "text", F.lit("]")), *after)


def repeated_words(words: DataFrame) -> DataFrame:
    order = page_order("seq")
    core = T.grammar_core(F.col("text"))
    b = words.withColumn("_core", core).withColumn("_prev_core", F.lag(core).over(order)).withColumn("_prev", F.lag("text").over(order))
    same = (F.length("_core") >= 2) & F.col("_core").rlike(r"\p{L}") & (F.col("_core") == F.col("_prev_core")) & ~F.col("_prev").rlike(r"[^\p{L}\p{N}]$") & ~F.endswith("text", F.lit("-"))
    return b.where(same).drop("_core", "_prev_core", "_prev")


def grammar_flags(words: DataFrame) -> DataFrame:
    """page_index, seq, rule, fix: spacing, punctuation, quotation marks, capitals and repeated words. Empty words are skipped."""
    ws = words.where("text <> ''")
    order = page_order("seq")
    b = ws.select("page_index", "seq", "text", "trailing", F.lag("text").over(order).alias("prev"), F.lead("text").over(order).alias("next"))
    t, prev = F.col("text"), F.col("prev")
    core, prev_core = T.grammar_core(t), T.grammar_core(prev)
    flag = lambda rule, when, fix: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), fix.alias("fix")))
    none = F.lit(None).cast("string")
    bare = F.regexp_replace(t, "^[“‘\"'(\\[]+", "")
    flags = F.array(
        flag("spaces", F.col("trailing").rlike(" {2,}|\\t") | t.rlike(r"\s"), none),
        flag("after_punct", t.rlike(r"\p{Ll}[,;:]\p{L}"), F.regexp_replace(t, r"(\p{Ll}[,;:])(?=\p{L})", "$1 ")),
        flag("after_punct", t.rlike(r"\p{Ll}{2}[.!?]\p{Lu}\p{Ll}"), F.regexp_replace(t, r"(\p{Ll}{2}[.!?])(?=\p{Lu}\p{Ll})", "$1 ")),
        flag("before_punct", prev.isNotNull() & t.rlike("^[,.;:!?]+$"), F.concat(prev, t)),
        flag("quote", t.rlike(r"[\p{L}\p{N}.,;:!?][“‘]"), F.regexp_replace(t, r"([\p{L}\p{N}.,;:!?])([“‘])", "$1 $2")),
        flag("quote", t.rlike(r"”[\p{L}\p{N}]"), F.regexp_replace(t, r"”(?=[\p{L}\p{N}])", "” ")),
        flag("quote", t.rlike(r'\p{L}"\p{L}'), none),
        flag("quote", prev.isNotNull() & F.startswith(t, F.lit("”")), F.concat(prev, t)),
        flag("quote", F.col("next").isNotNull() & F.endswith(t, F.lit("“")), F.concat(t, F.col("next"))),
        flag("capital", T.ends_sentence_ui(prev) & bare.rlike(r"^\p{Ll}"), T.capitalise(t)),
        flag("repeated", (F.length(core) >= 2) & core.rlike(r"\p{L}") & (core == prev_core) & ~prev.rlike(r"[^\p{L}\p{N}]$") & ~F.endswith(t, F.lit("-")), prev),
    )
    return b.select("page_index", "seq", F.inline(F.filter(flags, lambda f: f.isNotNull())))


def context_sentences(words: DataFrame, sentences: int = SENTENCES, most: int = CONTEXT_WORDS) -> DataFrame:
    """The words of a page's last ``sentences`` sentences, at most ``most`` words, in order."""
    back = Window.partitionBy("page_index").orderBy(F.desc("seq"))
    ends = T.ends_sentence(F.col("text")).cast("long")
    passed = F.coalesce(F.sum(ends).over(back.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    n = F.row_number().over(back)
    last = F.max("seq").over(Window.partitionBy("page_index"))
    b = words.withColumn("_n", n).withColumn("_ends", passed - F.when((F.col("seq") == last) & (ends == 1), 1).otherwise(0))
    return b.where((F.col("_n") <= most) & (F.col("_ends") < sentences)).drop("_n", "_ends")


def neighbours(pages: DataFrame, wanted: Column, size: int = 1000) -> DataFrame:
    """``pages`` with next_page and previous_page: the nearest ones after and before each for which ``wanted`` holds.

    Found inside stretches of ``size`` page numbers, else taken over from the nearest stretch that has one; only the
    stretches, a row each, are ordered as a whole.
    """
    b = pages.withColumn("_b", F.floor(F.col("page_index") / size)).withColumn("_w", F.when(wanted, F.col("page_index")))
    inside = Window.partitionBy("_b").orderBy("page_index")
    after, before = (1, Window.unboundedFollowing), (Window.unboundedPreceding, -1)
    b = b.withColumn("_after", F.first("_w", ignorenulls=True).over(inside.rowsBetween(*after))).withColumn("_before", F.last("_w", ignorenulls=True).over(inside.rowsBetween(*before)))
    stretches, order = b.groupBy("_b").agg(F.min("_w").alias("_lo"), F.max("_w").alias("_hi")), Window.orderBy("_b")
    ends = stretches.select("_b", F.first("_lo", ignorenulls=True).over(order.rowsBetween(*after)).alias("_lo"), F.last("_hi", ignorenulls=True).over(order.rowsBetween(*before)).alias("_hi"))
    return b.join(ends, "_b").withColumn("next_page", F.coalesce("_after", "_lo")).withColumn("previous_page", F.coalesce("_before", "_hi")).drop("_b", "_w", "_after", "_before", "_lo", "_hi")


def nearest_unreviewed(pages: DataFrame, unreviewed: Column) -> DataFrame:
    """Every page with the nearest unreviewed page after and before it."""
    return neighbours(pages, unreviewed).select("page_index", "next_page", "previous_page")


def page_breaks(pages: DataFrame) -> DataFrame:
    """Consecutive text pages, over blank ones but not over a stop: (page_index, to_page). Pages have kind: text, blank, or stop."""
    following = neighbours(pages, F.col("kind") != "blank").where("kind = 'text'").select("page_index", F.col("next_page").alias("to_page"))
    texts = pages.where("kind = 'text'").select(F.col("page_index").alias("to_page"))
    return following.join(texts, "to_page", "left_semi").select("page_index", "to_page")


def latest_undoable(history: DataFrame) -> DataFrame:
    """The newest entry that can still be undone, passing over approvals that a later note on the page removed."""
    gone = history.where("kind = 'approve' AND NOT undoable").groupBy("page").agg(F.max(F.struct("ts", "history_id")).alias("_removed"))
    b = history.join(gone, "page", "left")
    passed = (F.col("kind") == "approve") & F.coalesce(F.col("_removed") > F.struct("ts", "history_id"), F.lit(False))
    return b.where(F.col("undoable") & ~F.col("undone") & ~passed).orderBy(F.desc("ts"), F.desc("history_id")).limit(1)


def footnote_numbers(refs: DataFrame) -> DataFrame:
    """Linked references numbered from 1 in reading order; others have none."""
    linked = F.col("status") == "linked"
    n = F.sum(linked.cast("long")).over(page_order("seq").rowsBetween(Window.unboundedPreceding, 0))
    return refs.withColumn("number", F.when(linked, n))


def note_paragraphs(words: DataFrame) -> DataFrame:
    """Words of notes with ``head``, the position of the note's first word: a paragraph's start or a new region.

    An emptied first word hands the start to the next word.
    """
    order = page_order("seq")
    fresh = F.col("paragraph_start") | ~F.lag("region_kind").over(order).eqNullSafe(F.col("region_kind"))
    b = words.withColumn("_start", fresh)
    deferred = F.col("_start") | (F.lag("_start").over(order) & (F.lag("text").over(order) == ""))
    b = b.withColumn("_head", F.when(deferred & (F.col("text") != ""), F.col("seq")))
    head = F.last("_head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("head", head).drop("_start", "_head")
