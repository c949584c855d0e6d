"""Decisions and typed edits, one at a time by hand, and taken back."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirewise.operators import edits, layout, reconstruct, review

SPANS = "span_id long, page_index long, seq long, text string, trailing string, origin string, confidence long, revision long, paragraph_start boolean, protected boolean"
ISSUES = "issue_id long, page_index long, span_id long, status string, proposal_id long, candidates array<struct<text:string,score:long,source:string,proposal:long>>"
PROPOSALS = "proposal_id long, span_id long, status string"
PAGES = "page_index long, text_revision long, approved_text long, approved_layout long, approved_outstanding long"


def by_hand(spans, issues, proposals, events):
    """The same decisions in turn, on dictionaries."""
    spans, issues, proposals = ({r[0]: dict(zip(names, r)) for r in rows} for rows, names in ((spans, [x.split()[0] for x in SPANS.split(", ")]), (issues, ["issue_id", "page_index", "span_id", "status", "proposal_id", "candidates"]), (proposals, ["proposal_id", "span_id", "status"])))
    history = []
    for event_id, issue_id, seen, action, text in sorted(events):
        i = issues.get(issue_id)
        if i is None or i["status"] not in ("open", "deferred"):
            continue
        takes = action in ("accept", "edit")
        s = spans.get(i["span_id"])
        if not i["candidates"]:
            if takes:
                continue
        elif s is None or s["revision"] != seen or (takes and not text.strip(" ")):
            continue
        was, lost = i["status"], []
        new = text.strip(" ") if takes else None
        if takes:
            chosen = next((c[3] for c in i["candidates"] if c[0] == new), None)
            for c in i["candidates"]:
                p = proposals.get(c[3])
                if p and p["status"] in ("open", "deferred"):
                    p["status"] = "accepted" if c[3] == chosen else "rejected"
            if new != s["text"]:
                s.update(text=new, origin="manual" if action == "edit" else "accepted", confidence=None, revision=s["revision"] + 1)
                for o in issues.values():
                    if o["span_id"] == i["span_id"] and o is not i and o["status"] in ("open", "deferred"):
                        lost.append((o["issue_id"], o["status"]))
                        o.update(status="resolved", decision="superseded")
        elif i["proposal_id"] in proposals:
            proposals[i["proposal_id"]]["status"] = "rejected" if action == "skip" else "deferred"
        i.update(status="deferred" if action == "later" else "resolved", decision=f"{action}:{new}" if takes else action)
        history.append((event_id, was, tuple(sorted(lost))))
    return spans, issues, proposals, history


def some(seed, n=40):
    rng = random.Random(seed)
    spans = [(i, i // 10, i % 10, f"w{i}", " ", "ocr", 50 + i, 1 + i % 3, False, False) for i in range(n)]
    proposals = [(i * 10 + k, i, rng.choice(["open", "open", "deferred", "rejected", "accepted"])) for i in range(n) for k in range(rng.randint(0, 3))]
    issues = []
    for i in range(n):
        own = [p for p in proposals if p[1] == i]
        raw = (f"w{i}", 50, "raw OCR", None)
        issues.append((i * 10, i // 10, i, rng.choice(["open", "open", "deferred", "resolved", "stale"]), own[0][0] if own else None, [(f"w{i}{'abc'[k]}", 80, "text pass", p[0]) for k, p in enumerate(own)] + [raw]))
        if rng.random() < 0.6:
            issues.append((i * 10 + 1, i // 10, i, rng.choice(["open", "deferred"]), None, [raw]))
        if rng.random() < 0.3:
            issues.append((i * 10 + 2, i // 10, i, "open", None, [raw]))
    issues += [(9000 + i, i, None, "open", None, []) for i in range(4)]
    events = []
    for k in range(6 * n):
        issue = rng.choice(issues)
        span = issue[2]
        texts = [c[0] for c in issue[5]] + [f"w{span}", "typed ", "", "  "]
        events.append((k, issue[0], (1 + (span or 0) % 3) + (rng.random() < 0.15), rng.choice(["accept", "accept", "edit", "skip", "later", "later"]), rng.choice(texts)))
    return spans, issues, proposals, events


@pytest.fixture(scope="module", params=[1, 2, 3])
def decided(request, spark):
    rows = some(request.param)
    frames = [spark.createDataFrame(r, t) for r, t in zip(rows, (SPANS, ISSUES, PROPOSALS, "event_id long, issue_id long, revision long, action string, text string"), strict=True)]
    return rows, frames, review.decide(*frames)


def test_decisions_in_turn(decided):
    rows, _, done = decided
    spans, issues, proposals, history = by_hand(*rows)
    assert {r.span_id: (r.text, r.origin, r.confidence, r.revision) for r in done.spans.collect()} == {k: (s["text"], s["origin"], s["confidence"], s["revision"]) for k, s in spans.items()}
    assert {r.issue_id: (r.status, r.decision) for r in done.issues.collect()} == {k: (i["status"], i.get("decision")) for k, i in issues.items()}
    assert {r.proposal_id: r.status for r in done.proposals.collect()} == {k: p["status"] for k, p in proposals.items()}
    payload = F.from_json("payload", review.DECISION_PAYLOAD).alias("p")
    got = [(r.history_id, r.p.old_status, tuple((x.issue, x.status) for x in r.p.superseded)) for r in done.history.select("history_id", payload).collect()]
    assert sorted(got) == history
    assert any(lost for _, _, lost in history) and len(history) > 30


def test_a_changed_text_is_taken_back(spark, decided):
    """Undoing the decisions that changed texts brings back words and their issues."""
    rows, frames, done = decided
    changed = {k for k, s in by_hand(*rows)[0].items() if s["origin"] != "ocr"}
    assert changed
    payload = F.from_json("payload", review.DECISION_PAYLOAD)
    entries = done.history.where(payload["old_text"] != payload["new_text"]).select("history_id", "payload", F.lit(False).alias("undone"))
    pages = spark.createDataFrame([(i, 5, 3, 2, 0) for i in range(4)], PAGES)
    back = review.undo(done.spans, done.issues, done.proposals, pages, entries)
    assert {r.outcome for r in back.outcomes.collect()} == {"undone"}
    before = {s[0]: s for s in rows[0]}
    for r in back.spans.collect():
        s = before[r.span_id]
        assert (r.text, r.origin, r.confidence) == (s[3], s[5], s[6]) and r.revision == s[7] + 2 * (r.span_id in changed)
    after = {r.issue_id: r for r in back.issues.collect()}
    hand = by_hand(*rows)[1]
    for issue_id, _, span, status, *_ in rows[1]:
        if span in changed and hand[issue_id].get("decision") == "superseded":
            assert after[issue_id].status in ("open", "deferred") and after[issue_id].decision is None
    assert {r.page_index: r.text_revision for r in back.pages.collect()} == {p: 5 + sum(s // 10 == p for s in changed) for p in range(4)}
    again = review.undo(back.spans, back.issues, back.proposals, back.pages, entries)
    assert {r.outcome for r in again.outcomes.collect()} == {"changed since"}


def test_groups_are_whole_or_not_at_all(spark):
    spans = spark.createDataFrame([(i, 0, i, "new", " ", "human", None, 2, False, False) for i in range(4)], SPANS)
    item = lambda s, rev: f'{{"span":{s},"page":0,"old_text":"old","new_text":"new","old_origin":"ocr","old_confidence":9.0,"new_revision":{rev},"issues":[],"proposals":[]}}'
    entries = [(1, f'{{"kind":"group","items":[{item(0, 2)},{item(1, 2)}]}}', False), (2, f'{{"kind":"group","items":[{item(2, 2)},{item(3, 7)}]}}', False), (3, f'{{"kind":"edit","page":0,"items":[{item(99, 1)}]}}', False), (4, '{"kind":"approve","page":0,"prev_revision":2,"prev_outstanding":5}', False), (5, '{"kind":"other"}', False), (6, '{"kind":"approve","page":0}', True)]
    done = review.undo(spans, spark.createDataFrame([], ISSUES + ", decision string, span_revision long"), spark.createDataFrame([], PROPOSALS), spark.createDataFrame([(0, 5, 4, 4, 1)], PAGES), spark.createDataFrame(entries, "history_id long, payload string, undone boolean"))
    assert {r.history_id: r.outcome for r in done.outcomes.collect()} == {1: "undone", 2: "changed since", 3: "changed since", 4: "undone", 5: "cannot be undone", 6: "already undone"}
    assert {r.span_id: (r.text, r.revision) for r in done.spans.collect()} == {0: ("old", 3), 1: ("old", 3), 2: ("new", 2), 3: ("new", 2)}
    assert [tuple(r) for r in done.pages.collect()] == [(0, 7, 2, 4, 5)]


def test_edits_that_are_refused(spark):
    """Words that don't follow each other, of two pages, changed since, or already in an earlier edit; and one that changes nothing."""
    spans = review.anchored(spark.createDataFrame([(i, i // 5, i % 5, f"w{i}", "\n" if i % 5 == 2 else " ", "ocr", 50, 1, False, False) for i in range(10)], SPANS).selectExpr("*", "1.0 AS x", "2.0 AS y", "3.0 AS w", "4.0 AS h"))
    asked = [(1, 0, [0, 1, 2], [1, 1, 1], "w0 both"), (2, 0, [0], [1], "late"), (3, 0, [3], [2], "stale"), (4, 1, [5, 7], [1, 1], "gap"), (5, 1, [4, 5], [1, 1], "pages"), (6, 1, [8, 9], [1, 1], " w8  w9 "), (7, 1, [77], [1], "gone"), (8, 1, [6], [1], "")]
    edits_ = spark.createDataFrame(asked, "edit_id long, page_index long, span_ids array<long>, seen array<long>, text string")
    issues = spark.createDataFrame([(10, 0, 1, "open", None, None, None, 1), (11, 0, 2, "deferred", None, None, None, 1), (12, 1, 6, "resolved", None, None, "skip", 1)], ISSUES + ", decision string, span_revision long")
    proposals = spark.createDataFrame([(20, 1, "open"), (21, 6, "deferred"), (22, 3, "open")], PROPOSALS)
    done = edits.edit_text(spans, issues, proposals, edits_)
    got = {r.span_id: (r.text, r.trailing, r.origin, r.revision, len(r.anchors)) for r in done.spans.collect()}
    assert got[0] == ("w0", " ", "ocr", 1, 1)
    assert {got[1][0], got[2][0]} == {"both", ""} and got[6] == ("", "", "manual", 2, 1)
    kept, emptied = (1, 2) if got[1][0] else (2, 1)
    assert got[kept][1:] == ("\n", "manual", 2, 1) and got[emptied][1:] == ("", "manual", 2, 1)
    assert all(got[i][3] == 1 for i in (3, 4, 5, 7, 8, 9))
    assert sorted(r.history_id for r in done.history.collect()) == [1, 8]
    assert {r.issue_id: (r.status, r.decision) for r in done.issues.collect()} == {10: ("resolved", "superseded"), 11: ("resolved", "superseded"), 12: ("resolved", "skip")}
    assert {r.proposal_id: r.status for r in done.proposals.collect()} == {20: "rejected", 21: "rejected", 22: "open"}
    pages = spark.createDataFrame([(0, 5, None, None, 0), (1, 5, None, None, 0)], PAGES)
    back = review.undo(done.spans, done.issues, done.proposals, pages, done.history.select("history_id", "payload", F.lit(False).alias("undone")))
    assert {r.span_id: (r.text, r.trailing, r.origin) for r in back.spans.collect()} == {i: (f"w{i}", "\n" if i % 5 == 2 else " ", "ocr") for i in range(10)}
    assert {r.proposal_id: r.status for r in back.proposals.collect()} == {20: "open", 21: "deferred", 22: "open"}


def test_application_in_turn(spark):
    """Random proposals on random words, applied by the plan and one by one."""
    from tests.test_brute import one_by_one

    rng = random.Random(4)
    for _ in range(3):
        spans = [{"id": i, "text": f"w{i}", "trailing": rng.choice([" ", "\n"]), "anchors": [float(i)], "origin": "ocr", "confidence": 50, "revision": rng.randint(1, 2), "protected": rng.random() < 0.1} for i in range(60)]
        proposals = []
        for s in spans:
            for k in range(rng.randint(0, 3)):
                tail = s["id"] + 1 if rng.random() < 0.6 and s["id"] < 59 else None
                proposals.append({"span": s["id"], "tail": tail, "nth": k, "kind": "hyphen_join" if tail else rng.choice(["ocr_confusion", "spelling"]), "score": rng.choice([70, 90, 96]), "replacement": f"r{s['id']}-{k}", "revision": s["revision"] - (rng.random() < 0.2), "cross": rng.random() < 0.05, "auto": rng.random() < 0.05})
        anchor = lambda s: [(0, s["anchors"][0], 0.0, 1.0, 1.0)]
        table = spark.createDataFrame([(0, s["id"], s["text"], s["trailing"], s["origin"], s["confidence"], s["revision"], s["protected"], anchor(s)) for s in spans], "page_index long, position long, text string, trailing string, origin string, confidence long, revision long, protected boolean, anchors array<struct<page:long,x:double,y:double,w:double,h:double>>")
        offered = spark.createDataFrame([(0, p["span"], p["tail"], p["nth"], p["revision"], p["kind"], p["score"], p["replacement"], p["cross"], p["auto"]) for p in proposals], "page_index long, position long, tail_position long, nth long, span_revision long, kind string, score long, replacement string, cross_page boolean, auto_applied boolean")
        done, marked = reconstruct.auto_apply(table, offered)
        guarded = [p for p in proposals if not spans[p["span"]]["protected"] and not (p["tail"] and spans[p["tail"]]["protected"])]
        one_by_one(spans, guarded)
        got = sorted((r.position, r.text, r.trailing, r.origin, r.confidence, r.revision, [a.x for a in r.anchors]) for r in done.collect())
        assert got == [(s["id"], s["text"], s["trailing"], s["origin"], s["confidence"], s["revision"], s["anchors"]) for s in spans]
        assert Counter((r.position, r.nth) for r in marked.where("auto_applied").collect()) == Counter((p["span"], p["nth"]) for p in proposals if p["auto"])


def test_gutters_of_plain_columns(spark):
    rows = list(itertools.chain.from_iterable([(0, 2 * i, 10.0, 10.0 * i, 100.0, 8.0), (0, 2 * i + 1, 150.0 + i % 3, 10.0 * i, 100.0, 8.0)] for i in range(12)))
    rows += [(1, i, 10.0 + 30 * i, 0.0, 20.0, 8.0) for i in range(5)]
    boxes = spark.createDataFrame(rows, "page_index long, seq long, x double, y double, w double, h double")
    assert [tuple(r) for r in layout.gutters(boxes, 4.0).collect()] == [(0, 110.0, 150.0)]
    assert layout.gutters(boxes.withColumn("least", F.lit(41.0)), "least").collect() == []
