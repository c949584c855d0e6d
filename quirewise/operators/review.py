"""Review actions as folds over events: decisions, groups, edits, undo, approval, footnotes, flags, drafts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators.sequences import context, page_order
from quirewise.operators.state import latest
from quirewise.sources.storage import stored

#: Origins that show a person's decision.
DECIDED = ("human", "manual", "accepted", "inserted")


class Decisions(NamedTuple):
    """What a batch of decisions leaves: the tables it changes, and a history row for each decision that held."""

    spans: DataFrame
    issues: DataFrame
    proposals: DataFrame
    history: DataFrame


#: What a decision is recorded with so that it can be taken back.
DECISION_PAYLOAD = (
    "kind string, issue bigint, span bigint, page bigint, old_text string, new_text string, old_origin string, old_confidence double, old_revision bigint, new_revision bigint, "
    "old_status string, proposal bigint, candidates array<bigint>, superseded array<struct<issue:bigint,status:string>>"
)


def keyed(name: str, *tables: DataFrame) -> list[str]:
    """What tables are joined by: ``name``, and the page where all have it, as rows dealt by page then stay where they are."""
    return [*(["page_index"] if all("page_index" in df.columns for df in tables) else []), name]


def decide(spans: DataFrame, issues: DataFrame, proposals: DataFrame, events: DataFrame, parts: int | None = None) -> Decisions:
    """Decisions (event_id, issue_id, revision, action, text) on issues (issue_id, page_index, span_id, status, proposal_id, candidates), in the order of
    event_id. An issue, its word and its proposals are on one page; events and proposals may have page_index, too. ``parts``: into how many parts all are dealt by page.

    A decision holds if its issue is open or deferred, its word is at the revision seen, and a text to accept or edit isn't blank.
    Accept and edit set the word's text, accept the first candidate with that text and reject the others; skip rejects the leading proposal,
    later defers it. A changed text raises the revision and supersedes the word's other issues, so on each word it is
    the last decision that can hold: the first ending decision of each issue, and of those that change the text the first of each word,
    say which hold, by windows inside the page. Issues without candidates are structural: they can be skipped or deferred only.
    """
    live = ("open", "deferred")
    word = ["page_index", "span_id"]
    about = issues.select("issue_id", "page_index", "span_id", F.col("status").alias("_status"), "proposal_id", "candidates")
    now = spans.select(*word, F.col("text").alias("_old"), F.col("origin").alias("_origin"), F.col("confidence").alias("_confidence"), F.col("revision").alias("_now"))
    of = keyed("issue_id", events)
    asked = events.select(*of, "event_id", F.col("revision").alias("_seen"), "action", F.trim("text").alias("_new")).join(about, of).join(now, word, "left")
    takes = F.col("action").isin("accept", "edit")
    fits = F.when(F.size("candidates") == 0, ~takes).otherwise((F.col("_seen") == F.col("_now")) & (~takes | (F.col("_new") != "")))
    changes = takes & (F.col("_new") != F.col("_old"))
    asked = asked.where(F.col("_status").isin(*live) & F.coalesce(fits, F.lit(False))).withColumn("_changes", F.coalesce(changes, F.lit(False)))
    never, own, ending = F.lit(2**63 - 1), Window.partitionBy("page_index", "issue_id"), F.when(F.col("action") != "later", F.col("event_id"))
    b = asked.withColumn("_ends", F.min(ending).over(own)).withColumn("_by_change", F.col("_changes") & (F.col("event_id") == F.col("_ends")))
    b = b.withColumn("_turn", F.when(F.col("span_id").isNotNull(), F.min(F.when(F.col("_by_change"), F.col("event_id"))).over(Window.partitionBy(*word))))
    held = (F.col("event_id") <= F.coalesce("_turn", never)) & ((F.col("event_id") == F.col("_ends")) | ((F.col("action") == "later") & (F.col("event_id") < F.coalesce("_ends", never))))
    deferred = F.max(F.when(F.col("action") == "later", F.col("event_id"))).over(own.orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    b = b.where(held).withColumn("_was", F.when(deferred.isNotNull(), "deferred").otherwise(F.col("_status")))
    b = b.withColumn("_revision", F.when(F.col("_now").isNull(), 0).otherwise(F.col("_now") + F.col("_changes").cast("long")))
    b = b.withColumn("_offered", F.transform(F.filter("candidates", lambda c: c["proposal"].isNotNull()), lambda c: c["proposal"]))
    b = stored(b.drop("_by_change", "_seen", "_status", "_turn", "candidates"), "held", parts)

    turned = b.where("_changes").select(*word, F.col("_new").alias("_text"), F.when(F.col("action") == "edit", "manual").otherwise("accepted").alias("_by"), F.col("event_id").alias("_turn"), F.col("issue_id").alias("_issue"), F.col("_revision").alias("_raised"))
    out = spans.join(turned.select(*word, "_text", "_by"), word, "left")
    changed = F.col("_by").isNotNull()
    new_spans = out.select(*(F.coalesce("_text", "text").alias(c) if c == "text" else F.coalesce("_by", "origin").alias(c) if c == "origin" else F.when(~changed, F.col(c)).alias(c) if c == "confidence" else (F.col(c) + changed.cast("long")).alias(c) if c == "revision" else F.col(c) for c in spans.columns))

    said = F.when(F.col("action").isin("accept", "edit"), F.concat_ws(":", "action", "_new")).otherwise(F.col("action"))
    issue = ["page_index", "issue_id"]
    last = b.groupBy(*issue).agg(F.max_by(F.struct("action", said.alias("said"), "_new", "_revision", "_changes"), "event_id").alias("_last"), F.max((F.col("action") == "later").cast("int")).alias("_later"))
    judged = issues.join(last, issue, "left").join(turned.select(*word, "_issue", "_raised"), word, "left")
    ended = F.coalesce(F.col("_last.action") != "later", F.lit(False))
    status = F.when(ended, "resolved").when(F.col("_last").isNotNull(), "deferred").otherwise(F.col("status"))
    superseded = F.col("_issue").isNotNull() & (F.col("_issue") != F.col("issue_id")) & status.isin(*live)
    new_issues = judged.select(*(F.when(superseded, "resolved").otherwise(status).alias(c) if c == "status" else F.col(c) for c in issues.columns), F.when(superseded, "superseded").otherwise(F.col("_last.said")).alias("decision"), F.when(superseded, F.col("_raised")).otherwise(F.col("_last._revision")).alias("span_revision"))

    of = keyed("proposal_id", proposals)
    final = issues.join(last, issue).select("page_index", "proposal_id", "_last", "_later", F.transform("candidates", lambda c: F.struct(c["text"].alias("text"), c["proposal"].alias("proposal"))).alias("_c"))
    chosen = F.get(F.filter("_c", lambda c: c["text"] == F.col("_last._new")), F.lit(0))["proposal"]
    fate = lambda c: F.struct(c["proposal"].alias("proposal_id"), F.when(c["proposal"].eqNullSafe(F.col("_chosen")), "accepted").otherwise("rejected").alias("_fate"), (c["proposal"].eqNullSafe(F.col("proposal_id")) & (F.col("_later") == 1)).alias("_forced"))
    lead = F.array(F.struct(F.col("proposal_id"), F.when(F.col("_last.action") == "skip", "rejected").otherwise("deferred").alias("_fate"), F.lit(True).alias("_forced")))
    fates = final.withColumn("_chosen", chosen).withColumn("_all", F.filter("_c", lambda c: c["proposal"].isNotNull()))
    fates = fates.select("page_index", F.inline(F.when(F.col("_last.action").isin("accept", "edit"), F.transform("_all", fate)).otherwise(F.filter(lead, lambda x: x["proposal_id"].isNotNull()))))
    decided = proposals.join(fates.select(*of, "_fate", "_forced"), of, "left")
    moves = F.col("_fate").isNotNull() & (F.col("_forced") | F.col("status").isin(*live))
    new_proposals = decided.select(*(F.when(moves, F.col("_fate")).otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in proposals.columns))

    others = issues.where(F.col("status").isin(*live)).select(*word, F.col("issue_id").alias("_other"), F.col("status").alias("_other_status"))
    before = b.groupBy(*issue).agg(F.min("_ends").alias("_gone"), F.min(F.when(F.col("action") == "later", F.col("event_id"))).alias("_put_off")).withColumnRenamed("issue_id", "_other")
    lost = turned.join(others, word).where("_other <> _issue").join(before, ["page_index", "_other"], "left").where("_gone IS NULL OR _gone > _turn")
    lost = lost.groupBy("page_index", F.col("_turn").alias("event_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("_other").alias("issue"), F.when(F.col("_put_off") < F.col("_turn"), "deferred").otherwise(F.col("_other_status")).alias("status")))).alias("_lost"))  # a word's issues
    page = (F.col("page_index") + 1).cast("string")
    quoted = lambda c: F.concat(F.lit("“"), F.col(c), F.lit("”"))
    label = (
        F.when(takes & ~F.col("_changes"), F.concat(F.lit("Confirmed "), quoted("_old")))
        .when(takes, F.concat(F.when(F.col("action") == "edit", "Edited ").otherwise("Accepted "), quoted("_old"), F.lit(" → "), quoted("_new")))
        .otherwise(F.concat(F.when(F.col("action") == "skip", "Kept ").otherwise("Deferred "), F.coalesce(quoted("_old"), F.lit("the area"))))
    )
    fields = {
        "kind": F.lit("decision"), "issue": F.col("issue_id"), "span": F.col("span_id"), "page": F.col("page_index"), "old_text": F.col("_old"), "new_text": F.when(takes, F.col("_new")).otherwise(F.col("_old")), "old_origin": F.col("_origin"),
        "old_confidence": F.col("_confidence").cast("double"), "old_revision": F.col("_now"), "new_revision": F.col("_revision"), "old_status": F.col("_was"), "proposal": F.col("proposal_id"),
        "candidates": F.col("_offered"), "superseded": F.coalesce("_lost", F.array().cast("array<struct<issue:bigint,status:string>>")),
    }
    payload = F.to_json(F.struct(*(x.alias(n) for n, x in fields.items())))
    history = b.join(lost, ["page_index", "event_id"], "left").select(F.col("event_id").alias("history_id"), "page_index", F.lit("decision").alias("kind"), F.concat(label, F.lit(" · page "), page).alias("label"), payload.alias("payload"))
    return Decisions(new_spans, new_issues, new_proposals, history)


def group_preview(spans: DataFrame, original: str, replacement: str, approved: DataFrame) -> DataFrame:
    """Words whose core is exactly ``original``'s, with context, the new text, and why a match is left out by default."""
    core = T.strip(F.lit(original))
    marked = spans.withColumn("context", context(spans))
    hits = marked.where(T.strip(F.col("text")) == core).join(approved.select("page_index", F.lit(True).alias("_approved")), "page_index", "left")
    conflict = F.when(F.col("protected"), "protected word").when(F.col("origin").isin(*DECIDED), "already decided by a person").when(F.col("_approved"), "on an approved page")
    return hits.select("page_index", "seq", "span_id", "revision", "text", T.replace_core(F.col("text"), T.strip(F.lit(replacement))).alias("replacement"), "context", conflict.alias("conflict"))


def group_apply(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """Spans with all chosen (span_id, revision, replacement) changes, or with none if any of them is stale."""
    asked = chosen.select("span_id", F.col("revision").alias("_seen"), F.col("replacement").alias("_new"))
    now = asked.join(spans.select("span_id", F.col("revision").alias("_now")), "span_id", "left")
    stale = now.where(~F.col("_seen").eqNullSafe(F.col("_now"))).limit(1).select(F.lit(1).alias("_stale"))
    guarded = asked.join(stale, F.lit(True), "left_anti")
    out = spans.join(guarded, "span_id", "left")
    changed = F.col("_new").isNotNull()
    return out.withColumn("text", F.coalesce("_new", "text")).withColumn("revision", F.col("revision") + changed.cast("long")).drop("_seen", "_new")


def paragraph_set(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Paragraph starts after the last event (event_id, span_id, start) on each word; the word before takes the break.

    An emptied word between two words carries no break.
    """
    last = latest(events, ["span_id"], ["event_id"]).select("span_id", F.col("start").alias("_start"))
    b = spans.join(last, "span_id", "left").withColumn("paragraph_start", F.coalesce("_start", "paragraph_start"))
    words = b.where("text <> ''").select("page_index", "seq", F.lead("paragraph_start").over(page_order("seq")).alias("_next"))
    b = b.join(words, ["page_index", "seq"], "left")
    trailing = F.when(F.col("text") == "", "").when(F.coalesce("_next", F.lit(True)), "\n").otherwise(" ")
    return b.withColumn("trailing", trailing).drop("_start", "_next")


class Undone(NamedTuple):
    """The tables after undoing, and what became of each entry that was asked for (history_id, outcome)."""

    spans: DataFrame
    issues: DataFrame
    proposals: DataFrame
    pages: DataFrame
    outcomes: DataFrame


_WERE = "array<struct<{0}:bigint,status:string>>"
#: All that entries of any kind are recorded with.
UNDO_PAYLOAD = (
    "kind string, page bigint, issue bigint, span bigint, old_text string, new_text string, old_origin string, old_confidence double, new_revision bigint, old_status string, proposal bigint, candidates array<bigint>, "
    f"superseded {_WERE.format('issue')}, start boolean, was boolean, prev bigint, prev_trailing string, between array<struct<span:bigint,start:boolean,trailing:string>>, prev_revision bigint, prev_outstanding bigint, "
    f"items array<struct<span:bigint,page:bigint,old_text:string,new_text:string,old_trailing:string,old_origin:string,old_confidence:double,new_revision:bigint,issues:{_WERE.format('issue')},proposals:{_WERE.format('proposal')}>>"
)


def undo(spans: DataFrame, issues: DataFrame, proposals: DataFrame, pages: DataFrame, history: DataFrame) -> Undone:
    """The tables after undoing the entries of ``history`` (history_id, payload, undone), each whole or not at all.

    Decisions, groups and typed edits are taken back if every word they changed is at the revision that they made; a paragraph break if the
    word still starts (or not) as it was set; an approval always. What they settled is open again. Two entries
    on one word can't both hold, as each taken back raises the word's revision.
    """
    h = history.select("history_id", "undone", F.from_json("payload", UNDO_PAYLOAD).alias("p")).select("history_id", "undone", "p.*")
    h = stored(h, "undo")
    single = h.where("kind = 'decision'").select("history_id", "kind", "page", F.col("span").alias("span_id"), "old_text", "new_text", F.lit(None).cast("string").alias("old_trailing"), "old_origin", "old_confidence", "new_revision", F.array(F.struct(F.col("issue"), F.col("old_status").alias("status"))).alias("own"), F.array().cast(_WERE.format("proposal")).alias("were"))
    many = h.where("kind IN ('group', 'edit')").select("history_id", "kind", F.col("page").alias("_page"), F.inline("items"))
    many = many.select("history_id", "kind", F.coalesce("page", "_page").alias("page"), F.col("span").alias("span_id"), "old_text", "new_text", "old_trailing", "old_origin", "old_confidence", "new_revision", F.col("issues").alias("own"), F.col("proposals").alias("were"))
    items = single.unionByName(many).withColumn("changed", ~F.col("old_text").eqNullSafe(F.col("new_text")))
    breaks = h.where("kind = 'paragraph'").select("history_id", "page", F.col("span").alias("span_id"), "start", F.coalesce("was", ~F.col("start")).alias("was"), "prev", "prev_trailing", "between")
    now = spans.select(F.col("page_index").alias("page"), "span_id", F.col("revision").alias("_now"), F.col("paragraph_start").alias("_starts"))
    word = ["page", "span_id"]  # with the page among the keys of all joins with words, what the entries hold is moved to the words, never these
    moved = items.join(now, word, "left").where(((F.col("kind") != "decision") | F.col("changed")) & ~F.col("new_revision").eqNullSafe(F.col("_now"))).select("history_id")
    moved = moved.union(breaks.join(now, word, "left").where(~F.col("start").eqNullSafe(F.col("_starts"))).select("history_id")).distinct().withColumn("_moved", F.lit(True))
    outcome = F.when(F.col("undone"), "already undone").when(~F.col("kind").isin("decision", "group", "edit", "paragraph", "approve") | F.col("kind").isNull(), "cannot be undone").when(F.col("_moved"), "changed since").otherwise("undone")
    outcomes = stored(h.select("history_id", "kind", "undone").join(moved, "history_id", "left").select("history_id", outcome.alias("outcome")), "outcomes")
    good = outcomes.where("outcome = 'undone'").select("history_id")
    items, breaks = stored(items.join(good, "history_id", "left_semi"), "items"), stored(breaks.join(good, "history_id", "left_semi"), "breaks")

    page, word = F.col("page").alias("page_index"), ["page_index", "span_id"]
    sets = items.where("changed OR kind = 'edit'").select(page, "span_id", F.lit(True).alias("_text"), "old_text", F.when(F.col("kind") == "edit", F.coalesce("old_trailing", F.lit(" "))).alias("old_trailing"), "old_origin", "old_confidence")
    between = breaks.select(page, F.inline("between"))
    starts = breaks.select(page, "span_id", F.col("was").alias("_was")).unionByName(between.select("page_index", F.col("span").alias("span_id"), F.col("start").alias("_was")))
    gaps = breaks.where("prev IS NOT NULL AND prev_trailing IS NOT NULL").select(page, F.col("prev").alias("span_id"), F.col("prev_trailing").alias("_gap")).unionByName(between.select("page_index", F.col("span").alias("span_id"), F.col("trailing").alias("_gap")))
    once = lambda df, c: stored(df.groupBy(*word).agg(F.first(c).alias(c)), c.strip("_"))  # noqa: E731  stored: dealt by both keys, they'd draw the words after them
    b = spans.join(sets, word, "left").join(once(starts, "_was"), word, "left").join(once(gaps, "_gap"), word, "left")
    text = F.coalesce("_text", F.lit(False))
    now = {
        "text": F.when(text, F.col("old_text")).otherwise(F.col("text")), "origin": F.when(text, F.col("old_origin")).otherwise(F.col("origin")), "confidence": F.when(text, F.col("old_confidence")).otherwise(F.col("confidence")).cast(spans.schema["confidence"].dataType),
        "trailing": F.coalesce("_gap", "old_trailing", "trailing"), "revision": F.col("revision") + text.cast("long"), "paragraph_start": F.coalesce("_was", "paragraph_start"),
    }
    new_spans = b.select(*(now.get(c, F.col(c)).alias(c) for c in spans.columns))

    raised = F.col("new_revision") + (F.col("changed") | (F.col("kind") != "decision")).cast("long")
    own = items.select(raised.alias("_at"), F.inline("own")).select(F.col("issue").alias("issue_id"), F.col("status").alias("_status"), "_at")
    lost = h.where("kind = 'decision'").join(good, "history_id", "left_semi").select((F.col("new_revision") + (~F.col("old_text").eqNullSafe(F.col("new_text"))).cast("long")).alias("_at"), F.inline("superseded")).select(F.col("issue").alias("issue_id"), F.col("status").alias("_status"), "_at")
    back = own.unionByName(lost).where("issue_id IS NOT NULL").groupBy("issue_id").agg(F.max_by(F.struct("_status", "_at"), "_at").alias("_back"))
    typed = items.where("kind = 'edit'").select("span_id", (F.col("new_revision") + 1).alias("_typed"))
    b = issues.join(back, "issue_id", "left").join(typed, "span_id", "left")
    reopened = F.col("_back").isNotNull()
    now = {
        "status": F.coalesce("_back._status", "status"), "decision": F.when(~reopened, F.col("decision")),
        "span_revision": F.coalesce("_back._at", F.when(F.col("status").isin("open", "deferred"), F.col("_typed")), "span_revision"),
    }
    new_issues = b.select(*(now.get(c, F.col(c)).alias(c) for c in issues.columns))

    decided = h.where("kind = 'decision'").join(good, "history_id", "left_semi").select(F.explode(F.array_union(F.coalesce("candidates", F.array().cast("array<bigint>")), F.array("proposal"))).alias("proposal_id")).distinct().withColumn("_open", F.lit(True))
    grouped = items.where("kind = 'group'").select("span_id").distinct().withColumn("_group", F.lit(True))
    were = items.where("kind = 'edit'").select(F.inline("were")).groupBy(F.col("proposal").alias("proposal_id")).agg(F.first("status").alias("_were"))
    b = proposals.join(decided, "proposal_id", "left").join(were, "proposal_id", "left").join(grouped, "span_id", "left")
    opened = (F.col("_open") & F.col("status").isin("accepted", "rejected", "deferred")) | (F.col("_group") & F.col("status").isin("accepted", "rejected"))
    now = {"status": F.when(F.coalesce(opened, F.lit(False)), "open").otherwise(F.coalesce("_were", "status"))}
    new_proposals = b.select(*(now.get(c, F.col(c)).alias(c) for c in proposals.columns))

    touched = items.where("kind <> 'edit' AND changed").select("page").unionByName(items.where("kind = 'edit'").select("history_id", "page").distinct().select("page")).unionByName(breaks.select("page"))
    touched = touched.groupBy(F.col("page").alias("page_index")).agg(F.count(F.lit(1)).alias("_times"))
    back = h.where("kind = 'approve'").join(good, "history_id", "left_semi").groupBy(F.col("page").alias("page_index")).agg(F.min_by(F.struct("prev_revision", "prev_outstanding"), "history_id").alias("_back"))
    b = pages.join(touched, "page_index", "left").join(back, "page_index", "left")
    gone = F.col("_back").isNotNull() & F.col("_back.prev_revision").isNull()
    now = {
        "text_revision": F.col("text_revision") + F.coalesce("_times", F.lit(0)), "approved_text": F.when(~gone, F.coalesce("_back.prev_revision", "approved_text")), "approved_layout": F.when(~gone, F.col("approved_layout")),
        "approved_outstanding": F.when(gone, 0).when(F.col("_back").isNotNull(), F.coalesce("_back.prev_outstanding", F.lit(0))).otherwise(F.col("approved_outstanding") if "approved_outstanding" in pages.columns else F.lit(0)),
    }
    new_pages = b.select(*(now.get(c, F.col(c)).alias(c) for c in pages.columns))
    return Undone(new_spans, new_issues, new_proposals, new_pages, outcomes)


def apply_cross_page(spans: DataFrame, joins: DataFrame, approved: DataFrame, proposals: DataFrame) -> DataFrame:
    """Spans (with anchors) after joins (page_index, head_id, tail_id, head_revision, original, replacement) over the end of a page: the head takes the whole
    word, the anchors of the tail, which is on the next page, and its line break, the tail is emptied.

    Refused if either word is protected, without anchors or decided by a person, on an approved page or changed since, or if another
    reading of the head (``proposals``: proposal_id, span_id, status) than the join's own (proposal_id, or null) is open or deferred. Of joins that touch, over a page of a
    single word, the later one waits for the next pass.
    """
    free = spans.join(approved.select("page_index"), "page_index", "left_anti").where(~F.col("protected") & F.col("origin").isin("ocr", "auto_applied") & (F.size("anchors") > 0))
    head = free.select("page_index", F.col("span_id").alias("head_id"), F.col("revision").alias("head_revision"), F.col("text").alias("_a"))
    tail = free.select(F.col("page_index").alias("_after"), F.col("span_id").alias("tail_id"), F.col("text").alias("_b"), F.col("anchors").alias("_anchors"), F.col("trailing").alias("_gap"))
    ok = joins.withColumn("_after", F.col("page_index") + 1).join(head, ["page_index", "head_id", "head_revision"]).join(tail, ["_after", "tail_id"]).where(F.col("original") == F.concat("_a", F.lit(" / "), "_b"))
    rival = proposals.where("status IN ('open', 'deferred')").select("page_index", F.col("span_id").alias("head_id"), F.col("proposal_id").alias("_rival"))
    ok = ok.join(rival, (rival["page_index"] == ok["page_index"]) & (rival["head_id"] == ok["head_id"]) & ~rival["_rival"].eqNullSafe(ok["proposal_id"]), "left_anti")
    ok = stored(ok, "cross-page")  # a row a page at most, of words sought on all pages
    ok = ok.join(ok.select(F.col("tail_id").alias("head_id")), "head_id", "left_anti")
    changes = ok.select("page_index", F.col("head_id").alias("span_id"), F.col("replacement").alias("_new"), "_anchors", F.when(F.contains("_gap", F.lit("\n")), F.col("_gap")).alias("_gap"))
    changes = changes.unionByName(ok.select(F.col("_after").alias("page_index"), F.col("tail_id").alias("span_id"), F.lit("").alias("_new"), F.lit(None).cast(spans.schema["anchors"].dataType).alias("_anchors"), F.lit("").alias("_gap")))
    b = spans.join(changes, ["page_index", "span_id"], "left")
    hit = F.col("_new").isNotNull()
    now = {
        "text": F.coalesce("_new", "text"), "trailing": F.coalesce("_gap", "trailing"), "anchors": F.when(F.col("_anchors").isNotNull(), F.concat("anchors", "_anchors")).otherwise(F.col("anchors")), "revision": F.col("revision") + hit.cast("long"),
        "origin": F.when(hit, "auto_applied").otherwise(F.col("origin")), "confidence": F.when(~hit, F.col("confidence")),
    }
    return b.select(*(now.get(c, F.col(c)).alias(c) for c in spans.columns))


def anchored(spans: DataFrame) -> DataFrame:
    """``spans`` with anchors: where on which page each word stands in the scan, at first its own box alone."""
    return spans.withColumn("anchors", F.array(F.struct(F.col("page_index").alias("page"), *"xywh")))


def approve(pages: DataFrame, issues: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (page_index, acknowledged) with the outcome: a conflict if more issues are open than were acknowledged."""
    open_ = issues.where("status = 'open'").groupBy("page_index").agg(F.count("*").alias("open"))
    b = requests.join(pages.select("page_index", "text_revision", "layout_revision"), "page_index").join(open_, "page_index", "left").fillna(0, ["open"])
    ok = F.col("open") <= F.col("acknowledged")
    return b.select("page_index", "open", F.when(ok, "approved").otherwise("conflict").alias("outcome"), F.when(ok, F.col("text_revision")).alias("approved_text"), F.when(ok, F.col("layout_revision")).alias("approved_layout"))


def add_suggestions(proposals: DataFrame, fresh: DataFrame, statuses: tuple[str, ...] = ("open", "deferred")) -> DataFrame:
    """New suggestions (span_id, replacement, ...) without those that are there with one of ``statuses``, and without repeats."""
    have = proposals.where(F.col("status").isin(*statuses)).select("span_id", "replacement")
    return fresh.join(have, ["span_id", "replacement"], "left_anti").dropDuplicates(["span_id", "replacement"])


def link_footnotes(events: DataFrame) -> DataFrame:
    """Links (event_id, page_index, anchor, note) in force: a later link replaces those of either end."""
    last_anchor = F.max("event_id").over(Window.partitionBy("page_index", "anchor"))
    last_note = F.max("event_id").over(Window.partitionBy("page_index", "note"))
    return events.withColumn("_a", last_anchor).withColumn("_n", last_note).where("event_id = _a AND event_id = _n").drop("_a", "_n")


def decide_footnotes(refs: DataFrame, events: DataFrame) -> DataFrame:
    """References after decisions: accepted ones are linked; rejected ones are remembered, or gone if a person made them."""
    last = latest(events, ["ref_id"], ["event_id"]).select("ref_id", F.col("action").alias("_action"))
    b = refs.join(last, "ref_id", "left")
    status = F.when(F.col("_action") == "accept", "linked").when(F.col("_action") == "reject", "rejected").otherwise(F.col("status"))
    return b.where(~((F.coalesce("_action", F.lit("")) == "reject") & F.col("manual"))).withColumn("status", status).drop("_action")


def continue_footnotes(notes: DataFrame, marks: DataFrame) -> DataFrame:
    """Notes with the head they belong to: marked paragraphs continue the one above; the first of a page cannot."""
    m = marks.select("page_index", "note", F.lit(True).alias("_mark"))
    order = page_order("note")
    b = notes.join(m, ["page_index", "note"], "left")
    part = F.coalesce("_mark", F.lit(False)) & (F.row_number().over(order) > 1)
    b = b.withColumn("continues", part).withColumn("_head", F.when(~part, F.col("note")))
    return b.withColumn("head", F.last("_head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_mark", "_head")


def flags(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Flags in force: the last event (event_id, span_id, on, note) on each word turned it on."""
    last = latest(events, ["span_id"], ["event_id"]).where("on")
    return spans.select("page_index", "seq", "span_id").join(last, "span_id").select("page_index", "seq", "span_id", F.lit(95).cast("long").alias("priority"))


def region_edit(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions after a batch of layout edits, a kind after another: removed ones go, retyped ones change kind and structure, merged ones take the first one's
    place with the common box and the sum of lines, split ones get a lower part; then the order is the given list's, or is kept, and dense.

    ``edits``: page_index, action, region_id and, by action, kind (retype), into (merge: the region that takes it in), at (split), position (reorder:
    its place in the list; with one such edit on a page, regions that the list leaves out go), none (auto: the page's regions are put in automatic order).
    """
    from quirewise.operators.layout import class_rank, split_regions, structure_of

    of = lambda action, *fields: edits.where(F.col("action") == action).select("page_index", "region_id", *(F.col(f).alias(f"_{f}") for f in fields))
    key = ["page_index", "region_id"]
    b = regions.join(of("remove"), key, "left_anti").join(of("retype", "kind"), key, "left")
    b = b.withColumn("manual", F.col("_kind").isNotNull()).withColumn("structure", F.when((F.col("_kind") != F.col("kind")) & F.col("_kind").isin("heading", "body"), structure_of(F.col("_kind"))).otherwise(structure_of(F.col("kind"))))
    b = b.withColumn("kind", F.coalesce("_kind", "kind")).drop("_kind")
    there = b.select("page_index", F.col("region_id").alias("_into"), F.lit(True).alias("_there"))
    merges = of("merge", "into").join(there, ["page_index", "_into"], "left_semi").where("region_id <> _into")
    b = b.join(merges, key, "left").withColumn("_first", F.coalesce("_into", "region_id"))
    own = lambda c: F.min_by(c, F.col("_into").isNotNull())
    b = b.groupBy("page_index", F.col("_first").alias("region_id")).agg(
        *(own(c).alias(c) for c in ("kind", "structure", "region_order")), (F.bool_or("manual") | (F.count(F.lit(1)) > 1)).alias("manual"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.sum("line_count").alias("line_count"),
    )
    b = b.withColumn("w", F.col("_r") - F.col("x")).withColumn("h", F.col("_b") - F.col("y")).drop("_r", "_b")
    b = split_regions(b.join(of("split", "at"), key, "left"), F.col("_at")).drop("_at")
    b = b.withColumn("line_count", F.when(F.col("part") == 1, 0).otherwise(F.col("line_count")))
    listed = of("reorder", "position")
    asked = listed.select("page_index", F.lit(True).alias("_listed")).distinct()
    auto = edits.where("action = 'auto'").select("page_index", F.lit(True).alias("_auto")).distinct()
    b = b.join(listed, key, "left").join(asked, "page_index", "left").join(auto, "page_index", "left").where("_listed IS NULL OR _position IS NOT NULL")
    by_rank = F.when(F.col("_auto"), F.struct(class_rank(F.col("kind")).cast("double").alias("a"), F.col("y").alias("b"), F.col("x").alias("c")))
    by_hand = F.struct(F.coalesce("_position", "region_order").cast("double").alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    order = Window.partitionBy("page_index").orderBy(F.coalesce(by_rank, by_hand), "region_id", "part")
    return b.select("page_index", "region_id", "part", "kind", "structure", "manual", "x", "y", "w", "h", "line_count", (F.row_number().over(order) - 1).cast("long").alias("region_order"))


def region_merge(spans: DataFrame, reread: DataFrame, least: float = 0.4) -> DataFrame:
    """A region's second reading against its words: agreements, disagreements (a proposal each), and words that are new,
    with the word after which they belong in reading order."""
    from quirewise.operators.layout import best_overlap

    matched = best_overlap(reread, spans.select("page_index", "seq", "span_id", *"xywh"), least)
    texts = spans.select("page_index", "span_id", F.col("text").alias("_old"))
    b = reread.join(matched.select("page_index", "seq", "span_id"), ["page_index", "seq"], "left").join(texts, ["page_index", "span_id"], "left")
    outcome = F.when(F.col("span_id").isNull(), "new").when(F.col("_old") == F.col("text"), "agree").otherwise("propose")
    b = b.withColumn("outcome", outcome)
    new = b.where("outcome = 'new'").select("page_index", F.col("seq").alias("_seq"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    s = spans.select("page_index", F.col("seq").alias("_at"), F.col("y").alias("_sy"), F.col("x").alias("_sx"))
    before = new.join(s, "page_index").where((F.col("_sy") < F.col("_y") - 5) | ((F.abs(F.col("_sy") - F.col("_y")) <= 5) & (F.col("_sx") <= F.col("_x"))))
    place = before.groupBy("page_index", F.col("_seq").alias("seq")).agg(F.max("_at").alias("after"))
    return b.join(place, ["page_index", "seq"], "left").select("page_index", "seq", "span_id", "outcome", "text", "after")
