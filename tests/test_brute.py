"""Queries without SQL, against plain Python versions of what they say they do."""

import itertools
import json
from collections import Counter, defaultdict

import pytest
import regex

import quirewise.plans
from quirewise.functions import numerals as N
from quirewise.functions import text as T
from quirewise.operators.sequences import FURNITURE
from quirewise.plans.registry import ORACLE, QUERIES
from quirewise.sources.views import PAGE_W, Views
from tests.test_whole import table_fit

SF = "/root/testdata/sf0.001"
SMALL = 120
quirewise.plans.load()
CHECKED = {"agg_cer_wer", "fn_early_modern", "fn_grammar_all", "fn_roman_info", "geo_merge_body", "geo_text_fit", "jn_marker_rejected", "op_edit_text", "op_edit_text_history", "op_layout", "op_reconstruct", "op_reconstruct_proposals"}


def test_every_query_has_sql_or_a_version_here():
    assert set(QUERIES) - set(ORACLE) == CHECKED


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


@pytest.fixture(scope="module")
def words(v):
    out = defaultdict(list)
    for r in v.words.collect():
        out[r.page_index].append(r)
    return {p: sorted(rows, key=lambda r: r.seq) for p, rows in out.items()}


@pytest.fixture(scope="module")
def lexicon(v):
    return {r.token for r in v.lexicon.collect()}


def core(w):
    return regex.sub(r"^[^\p{L}\p{N}'’]+|[^\p{L}\p{N}'’]+$", "", w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda last, j, old=row, x=x: min(old[j] + 1, last + 1, old[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def test_early_modern(spark, words):
    def one(form):
        for old, new, least, most in T.ENDINGS:
            if form.endswith(old) and least <= len(form) <= (most or 10**9):
                yield form[: len(form) - len(old)] + new
        for tail in ("", "e"):
            body = form[: len(form) - len(tail)]
            if form.endswith(tail) and len(body) >= 3 and body[-1] == body[-2] and body[-1] not in "aeiou":
                yield body[:-1]
        for entry in T.SPELLINGS:
            changed = form
            for pair in entry:
                changed = changed.replace(*pair)
            yield changed

    def variants(w):
        uv = "".join("u" if i == 0 and c == "v" else "v" if c == "u" and 0 < i < len(w) - 1 else c for i, c in enumerate(w))
        ij = "".join("j" if c == "i" and (i == 0 or w[i - 1] in "eao") and w[i + 1 : i + 2] in set("aeouy") else c for i, c in enumerate(w))
        return {uv, ij, *(x for f in (w, uv, ij) for x in one(f))} - {w}

    got = {r.token: set(filter(None, r.variants.split("|"))) for r in QUERIES["fn_early_modern"](spark, SF).collect()}
    assert set(got) == {r.text for rows in words.values() for r in rows}
    for token, found in got.items():
        assert found == variants(core(token).lower()) - {""}, token


def test_roman_info(spark):
    def sum_of(t):
        values = [N.VALUES.get(c, 0) for c in t]
        return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))

    may = {"1": "il", "|": "i", "!": "i", "j": "i", "l": "li", "i": "il"}

    def listed(low):
        ways = [[(0 if a == c else 10, k, a) for k, a in enumerate(may.get(c, c))] for c in low]
        if sum(c in "li1" for c in low) > 9:
            return None
        options = [(sum(w[0] + w[1] for w in way), tuple(w[1] for w in way), "".join(w[2] for w in way)) for way in itertools.product(*ways)]
        return [t for _, _, t in sorted(options) if t != low and regex.match(N.STANDARD, t)][:3]

    def roman(n):
        out = ""
        for value, text in N.TABLE:
            out, n = out + text * (n // value), n % value
        return out

    got = {r.token: r for r in QUERIES["fn_roman_info"](spark, SF).collect()}
    assert len(got) > 2000
    shaped = 0
    for token, r in got.items():
        low = core(token.rstrip("."))
        if r.core is None:
            assert not regex.fullmatch("[ivxlcdm1|!j]{1,12}", low) or not regex.search("[ivxlcdm]", low) or low in N.WORDS or (len(low) == 1 and low not in "vx") or not listed(low), token
            continue
        shaped += 1
        if regex.match(N.STANDARD, low):
            assert (r.core, r.value, r.standard, r.readings) == (low, sum_of(low), None, ""), token
        elif regex.match(N.OLD, low):
            assert (r.core, r.value, r.standard, r.readings) == (low, sum_of(low), roman(sum_of(low)), ""), token
        else:
            assert r.core == low and r.readings == ", ".join(f"{t}={sum_of(t)}" for t in listed(low) or []), token
    assert shaped > 300


def test_marker_rejected(spark, words):
    pair = lambda notes, anchors, no: link(notes, anchors, no)

    def link(notes, anchors, refused):
        free, out = list(anchors), []
        for n in notes:
            if (a := next((a for a in free if (n, a) not in refused), None)) is not None:
                free.remove(a)
                out.append((n, a))
        return out

    expected = set()
    for p, rows in words.items():
        for m in {str(k) for k in range(1, 5)}:
            notes = [r.seq for r in rows if r.seq % 11 == 5 and str(r.seq % 3 + 1) == m]
            anchors = [r.seq for r in rows if r.seq % 7 == 3 and str(r.seq % 4 + 1) == m]
            refused = {x for x in pair(notes, anchors, set()) if x[0] % 2}
            expected |= {(p, *x) for x in pair(notes, anchors, refused)}
    assert {(r.page_index, r.note, r.anchor) for r in QUERIES["jn_marker_rejected"](spark, SF).collect()} == expected


def test_text_fit(spark, words):
    lines = defaultdict(list)
    for p, rows in words.items():
        for r in rows:
            lines[p, r.line_no].append(r.text)
    got = {(r.page_index, r.line_no): json.loads(r.fit) for r in QUERIES["geo_text_fit"](spark, SF).collect()}
    assert set(got) == set(lines)
    short = [k for k in sorted(lines) if len(lines[k]) <= 9][:150]
    assert short
    for key in short:
        old = lines[key]
        assert got[key] == table_fit(old, [w + "x" if i % 4 == 1 else w for i, w in enumerate(old)])
    for key, old in lines.items():
        assert " ".join(filter(None, got[key])).split() == [w + "x" if i % 4 == 1 else w for i, w in enumerate(old)] and len(got[key]) == len(old)


def test_cer_wer(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.item_id: (r.cer, r.wer) for r in QUERIES["agg_cer_wer"](spark, SF).collect()}
    for item, text in items:
        truth = regex.sub("[^ -~]", "?", regex.sub(r"\s+", " ", text).strip(" "))
        read = truth.replace("rn", "m")
        assert got[item] == (pytest.approx(distance(truth, read) / len(truth)), pytest.approx(distance(truth.split(" "), read.split(" ")) / len(truth.split(" "))))


def test_grammar_all(spark, v):
    pages = defaultdict(list)
    for r in v.spans.select("page_index", "seq", "text", "trailing").collect():
        if r.text:
            pages[r.page_index].append(r)
    numeral = regex.compile(T.numeral_pattern("*", 3))

    def bare(w):
        return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w).lower()

    def ends(w):
        s = regex.sub("[”’\"')\\]]+$", "", w)
        if regex.search("[!?]$", s):
            return True
        body = s[:-1] if s.endswith(".") else s
        inner = regex.sub("^[“‘\"'(\\[]+", "", body)
        return s.endswith(".") and bool(regex.search(r"\p{L}{3}$", body)) and "." not in body and bare(body) not in T.ABBREVIATIONS and not (inner and numeral.match(inner))

    expected = Counter()
    for p, rows in pages.items():
        rows.sort(key=lambda r: r.seq)
        for i, r in enumerate(rows):
            t, prev, following = r.text, rows[i - 1].text if i else None, rows[i + 1].text if i + 1 < len(rows) else None
            found = []
            if regex.search(" {2,}|\t", r.trailing) or regex.search(r"[ \t\n\x0B\f\r]", t):
                found.append(("spaces", None))
            for pattern in (r"(\p{Ll}[,;:])(?=\p{L})", r"(\p{Ll}{2}[.!?])(?=\p{Lu}\p{Ll})"):
                if regex.search(pattern, t):
                    found.append(("after_punct", regex.sub(pattern, r"\1 ", t)))
            if prev is not None and regex.fullmatch("[,.;:!?]+", t):
                found.append(("before_punct", prev + t))
            if regex.search(r"[\p{L}\p{N}.,;:!?][“‘]", t):
                found.append(("quote", regex.sub(r"([\p{L}\p{N}.,;:!?])([“‘])", r"\1 \2", t)))
            if regex.search(r"”[\p{L}\p{N}]", t):
                found.append(("quote", regex.sub(r"”(?=[\p{L}\p{N}])", "” ", t)))
            if regex.search(r'\p{L}"\p{L}', t):
                found.append(("quote", None))
            if prev is not None and t.startswith("”"):
                found.append(("quote", prev + t))
            if following is not None and t.endswith("“"):
                found.append(("quote", t + following))
            lead = regex.match("[“‘\"'(\\[]*", t)[0]
            if prev is not None and ends(prev) and regex.match(r"\p{Ll}", t[len(lead) :]):
                found.append(("capital", lead + t[len(lead)].upper() + t[len(lead) + 1 :]))
            if prev is not None and len(bare(t)) >= 2 and regex.search(r"\p{L}", bare(t)) and bare(t) == bare(prev) and not regex.search(r"[^\p{L}\p{N}]$", prev) and not t.endswith("-"):
                found.append(("repeated", prev))
            expected.update((p, r.seq, *f) for f in found)
    got = Counter((r.page_index, r.seq, r.rule, r.fix) for r in QUERIES["fn_grammar_all"](spark, SF).collect())
    assert got - expected == expected - got == Counter()
    assert len({k[2] for k in got}) >= 2


def merged(blocks, gap):
    """(id, box) to the id that each is merged into, top down."""
    kept, into = [], {}
    for block, (x0, y0, x1, y1) in sorted(blocks, key=lambda b: (b[1][1], b[0])):
        for k in reversed(kept):
            a = k[1]
            over = min(a[2], x1) - max(a[0], x0)
            if max(y0 - a[3], a[1] - y1, 0) <= gap and max(over, 0) >= 0.5 * min(a[2] - a[0], x1 - x0):
                k[1] = [min(a[0], x0), min(a[1], y0), max(a[2], x1), max(a[3], y1)]
                into[block] = k[0]
                break
        else:
            kept.append([block, [x0, y0, x1, y1]])
            into[block] = block
    return into


def around(boxes):
    boxes = list(boxes)
    return [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]


def box(r):
    return [r.x, r.y, r.x + r.w, r.y + r.h]


def test_merge_body(spark, words):
    got = {(r.page_index, r.block): r["into"] for r in QUERIES["geo_merge_body"](spark, SF).collect()}
    expected = {}
    for p, rows in words.items():
        lines = defaultdict(list)
        for r in rows:
            lines[r.line_no].append(box(r))
        expected |= {(p, b): i for b, i in merged([(p * 100_000 + n, around(b)) for n, b in lines.items()], 30.0).items()}
    assert got == expected


def groups_of(n, tied):
    """Places 0 to n - 1 in groups, each by its least; ``tied``: pairs."""
    own = list(range(n))
    for a, b in tied:
        old, new = sorted((own[a], own[b]), reverse=True)
        own = [new if g == old else g for g in own]
    return own


def middle(values):
    return sorted(values)[len(values) // 2] if values else 0.0


def ink_of(p, rows):
    """What op_layout reads of a page: (seq, box)."""
    out = []
    for r in rows:
        small = r.line_no > 4 and p % 4 == 1
        apart = 40.0 if small else 0.0
        if p % 3 == 0:
            if r.word_no < 32:
                x, y = 40.0 + 290.0 * (r.word_no // 4 % 2) + 60.0 * (r.word_no % 4), 36.0 + 14.0 * (r.line_no * 4 + r.word_no // 8) + apart
                out.append((r.seq, [x, y, x + 50.0, y + (8.0 if small else r.h)]))
        else:
            out.append((r.seq, [r.x, r.y + apart, r.x + r.w, r.y + apart + (8.0 if small else r.h)]))
        if r.line_no == 4 and r.word_no == 0 and p % 4 == 1:
            out.append((r.seq + 10_000_000, [36.0, r.y + 11.0, 156.0, r.y + 12.0]))
    return out


def analyzed(ink, page_h=792.0):
    """A page's regions, by the steps as they're told: separators, gutters, lines, blocks, classes, columns, order."""
    wide, high = lambda b: b[2] - b[0], lambda b: b[3] - b[1]
    h = max(middle([high(b) for _, b in ink if 4 <= high(b) <= 60 and wide(b) <= 80]), 4.0)
    rules = [b for _, b in ink if wide(b) > 3 * h and high(b) <= 3]
    glyphs = [(k, b) for k, b in ink if b not in rules]
    band = around(b for _, b in glyphs)
    n, cover = int(max(1.0, wide(band))), None
    cover = [0.0] * n
    for _, b in glyphs:
        for c in range(int(max(0.0, b[0] - band[0])), min(n, int(min(b[2] - band[0], n)))):
            cover[c] += high(b)
    white, start = [], None
    for c in range(n + 1):
        empty = c < n and cover[c] <= 0.08 * high(band)
        if empty and start is None:
            start = c
        elif not empty and start is not None:
            if c - start >= 0.4 * h and start > 0 and c < n:
                white.append((band[0] + start, band[0] + c))
            start = None
    white = [(a, z) for a, z in white if sum(b[2] <= a for _, b in glyphs) >= 8 and sum(b[0] >= z for _, b in glyphs) >= 8]
    side = lambda b: sum((a + z) / 2 <= (b[0] + b[2]) / 2 for a, z in white)
    tied = []
    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(glyphs), 2):
        if min(a[3], b[3]) - max(a[1], b[1]) >= 0.5 * min(high(a), high(b)) and max(b[0] - a[2], a[0] - b[2], 0) <= 1.6 * h and side(a) == side(b):
            tied.append((i, j))
    lines = defaultdict(list)
    for g, x in zip(groups_of(len(glyphs), tied), glyphs):
        lines[g].append(x)
    lines = [{"id": min(k for k, _ in own), "box": around(b for _, b in own), "n": len(own), "h": sum(high(b) for _, b in own) / len(own)} for own in lines.values()]
    lines = sorted((x for x in lines if x["n"] >= 2 or wide(x["box"]) >= h), key=lambda x: (x["box"][1], x["id"]))
    tied = []
    for (i, a), (j, b) in itertools.combinations(enumerate(x["box"] for x in lines), 2):
        if max(min(a[2], b[2]) - max(a[0], b[0]), 0) >= 0.3 * min(wide(a), wide(b)) and max(b[1] - a[3], a[1] - b[3], 0) <= 1.3 * h and side(a) == side(b):
            tied.append((i, j))
    stacks = defaultdict(list)
    for g, x in zip(groups_of(len(lines), tied), lines):
        stacks[g].append(x)
    blocks = []
    for own in stacks.values():
        rows, of = [], []
        for x in own:
            b = x["box"]
            if rows and abs((rows[-1][1] + rows[-1][3]) / 2 - (b[1] + b[3]) / 2) < 0.5 * h:
                rows[-1] = around([rows[-1], b])
            else:
                rows.append(list(b))
            of.append(len(rows) - 1)
        gaps = [max(b[1] - a[3], 0.0) for a, b in zip(rows, rows[1:])]
        cut = [g > max(2.5 * middle(gaps), 1.4 * h) for g in gaps]
        widest = max(map(wide, rows))
        if len(rows) >= 4 and rows[0][1] < 0.12 * page_h and (gaps[0] >= 1.5 * max(middle(gaps[1:]), 1.0) or wide(rows[0]) <= 0.8 * widest):
            cut[0] = True
        if len(rows) >= 4 and rows[-1][3] > 0.9 * page_h and wide(rows[-1]) <= 0.6 * widest:
            cut[-1] = True
        part = list(itertools.accumulate([0, *map(int, cut)]))
        for k in set(part):
            mine = [x for x, r in zip(own, of) if part[r] == k]
            blocks.append({"id": min(x["id"] for x in mine), "box": around(x["box"] for x in mine), "n": len(mine), "h": sum(x["h"] for x in mine) / len(mine)})
    if not blocks:
        return []
    widest = max(wide(b["box"]) for b in blocks)
    main = [b["box"] for b in blocks if wide(b["box"]) >= 0.6 * widest and b["n"] >= 3]
    m = around(main) if main else None
    for k in blocks:
        b = k["box"]
        w = wide(b)
        inside = bool(m) and b[0] >= m[0] - 2 * h and b[2] <= m[2] + 2 * h
        outside = bool(m) and (b[2] <= m[0] - 0.5 * h or b[0] >= m[2] + 0.5 * h)
        if b[1] < 0.12 * page_h and k["n"] <= 2 and (not m or b[3] <= m[1] + h):
            k["kind"] = "page_number" if w < 3 * h else "header"
        elif b[3] > 0.9 * page_h and k["n"] <= 2 and (not m or b[1] >= m[3] - h):
            k["kind"] = "catchword" if w < 5 * h and (not m or b[2] >= m[2] - 4 * h) else "footer"
        elif outside and w < 0.35 * PAGE_W:
            k["kind"] = "marginalia"
        elif inside and k["h"] < 0.88 * h and (b[1] >= m[3] - h or any(s[1] < b[1] and s[1] > m[1] and b[1] - s[1] < 6 * h for s in rules)):
            k["kind"] = "footnote"
        elif inside and (k["h"] > 1.25 * h or (w < 0.7 * widest and k["n"] <= 3 and b[1] < m[1] + h)):
            k["kind"] = "heading"
        else:
            k["kind"] = "body" if inside or not m else "uncertain"
    kept = []
    for k in sorted(blocks, key=lambda k: (k["box"][1], k["id"])):
        for o in reversed(kept) if k["kind"] == "body" else ():
            a, b = o["box"], k["box"]
            if o["kind"] == "body" and max(b[1] - a[3], a[1] - b[3], 0) <= 3 * h and max(min(a[2], b[2]) - max(a[0], b[0]), 0) >= 0.5 * min(wide(a), wide(b)) and side(a) == side(b):
                o["box"], o["n"] = around([a, b]), o["n"] + k["n"]
                break
        else:
            kept.append(dict(k))
    inner = [a for a, z in white if m and a > m[0] + h and z < m[2] - h]
    rank = {"header": 0, "page_number": 1, "heading": 2, "body": 2, "marginalia": 3, "footnote": 4, "footer": 5, "catchword": 6, "uncertain": 7}
    out = []
    for k in kept:
        b = k["box"]
        column = sum(b[0] >= a for a in inner) if k["kind"] == "body" and inner else None
        q = [max(b[0] - 0.25 * h, 0.0), max(b[1] - 0.25 * h, 0.0), min(b[2] + 0.25 * h, PAGE_W), min(b[3] + 0.25 * h, page_h)]
        out.append((rank[k["kind"]], column or 0, q[1], q[0], k["id"], k["kind"], column, k["n"], q))
    return [(i, *x[4:8], *(round(v, 6) for v in (x[8][0], x[8][1], x[8][2] - x[8][0], x[8][3] - x[8][1]))) for i, x in enumerate(sorted(out, key=lambda x: x[:5]))]


def test_layout(spark, words):
    got = defaultdict(list)
    for r in QUERIES["op_layout"](spark, SF).collect():
        got[r.page_index].append((r.reading_order, r.block, r.kind, r.column, r.line_count, r.x, r.y, r.w, r.h))
    pages = [p for p in sorted(words) if len(words[p]) <= SMALL]
    assert len(pages) > 20
    for p in pages:
        assert sorted(got.get(p, [])) == analyzed(ink_of(p, words[p])), p
    kinds = {(x[2], x[3]) for p in got for x in got[p]}
    assert {("body", 0), ("body", 1), ("footnote", None)} <= kinds


def upper_median(values):
    return sorted(values)[len(values) // 2] if values else None


def confused(c, lexicon):
    found = []
    for old, new in T.CONFUSIONS:
        at = c.find(old)
        while at >= 0:
            found.append(c[:at] + new + c[at + len(old) :])
            at = c.find(old, at + len(old))
    return [x for x in found if x.lower() in lexicon]


def spelt(span, lexicon):
    """Whether a word is asked about: not known, like a word, no numeral, no fragment's hyphen."""
    c = core(span["text"])
    return span["region"] and regex.fullmatch(r"[\p{L}'’-]{3,}", c) and not span["text"].endswith("-") and not regex.fullmatch(r"[ivxlcdmIVXLCDM]+\.*", c) and c.lower() not in lexicon


def one_by_one(spans, proposals, threshold=90, eligible=("hyphen_join", "ocr_confusion")):
    """Proposals applied in turn to a list of words, as a person would."""
    by_id = {s["id"]: s for s in spans}
    for p in proposals:
        a = by_id.get(p["span"])
        if p["auto"] or p["cross"] or p["score"] < threshold or p["kind"] not in eligible or a is None or a["revision"] != p["revision"]:
            continue
        if p["kind"] == "hyphen_join":
            b = by_id.get(p["tail"])
            if b is None:
                continue
            a["anchors"], a["trailing"] = a["anchors"] + b["anchors"], b["trailing"]
            del by_id[p["tail"]]
        a.update(text=p["replacement"], origin="auto_applied", confidence=None, revision=a["revision"] + 1)
        p["auto"] = True
    spans[:] = [s for s in spans if s["id"] in by_id]


@pytest.fixture(scope="module")
def rebuilt(v, words, lexicon):
    """Spans and proposals of each page, by hand: assignment, lines, paragraphs, joins, application, spelling by confusion, application."""
    regions = defaultdict(list)
    for r in v.regions.collect():
        regions[r.page_index].append(r)
    pages = {}
    for p, rows in words.items():
        lines = defaultdict(list)
        for r in rows:
            text = r.text[: len(r.text) // 2] + "-" if r.word_no % 12 == 11 and len(r.text) >= 6 else r.text
            y = 36.0 + 14.0 * (r.seq // 12)
            hits = [g for g in regions[p] if g.x <= r.x + r.w / 2 <= g.x + g.w and g.y <= y + r.h / 2 <= g.y + g.h]
            g = min(hits, key=lambda g: g.region_order, default=None)
            if g is None or g.kind not in ("ignore", "illustration"):
                word = {"text": text, "x": r.x, "y": y, "w": r.w, "seq": r.seq, "confidence": r.confidence, "kind": g.kind if g else "uncertain", "order": g.region_order if g else 1_000_000, "region": g is not None}
                lines[word["kind"], r.line_no * 10_000 + r.word_no // 12].append(word)
        spans = []
        for kind in {k for k, _ in lines}:
            own = []
            for (k, no), ws in lines.items():
                if k == kind:
                    ws.sort(key=lambda w: w["x"])
                    own.append({"no": no, "ws": ws, "x": min(w["x"] for w in ws), "y": min(w["y"] for w in ws), "w": max(w["x"] + w["w"] for w in ws) - min(w["x"] for w in ws)})
            own.sort(key=lambda a: (a["y"], a["x"]))
            pitches = [b["y"] - a["y"] for a, b in zip(own, own[1:])]
            left, usual = upper_median([a["x"] for a in own if len(a["ws"]) >= 3]), upper_median([q for q in pitches if q > 0])
            edge = min(a["x"] for a in own) if left == 0 else left
            widths = upper_median([w["w"] / max(1, len(w["text"])) for a in own for w in a["ws"]])
            indent, widest = max(1.5 * max(widths, 1.0), 0.015 * PAGE_W), max(a["w"] for a in own)
            starts = []
            for rank, a in enumerate(own, 1):
                last = own[rank - 2]
                indented = edge is not None and a["x"] - edge > indent
                short = rank > 1 and last["w"] < 0.7 * widest and not last["ws"][-1]["text"].endswith("-")
                gap = rank > 1 and usual is not None and a["y"] - last["y"] > 1.7 * usual
                starts.append(rank == 1 or (kind not in FURNITURE and (indented or short or gap)))
            for rank, a in enumerate(own, 1):
                over = rank == len(own) or starts[rank]
                for nth, w in enumerate(a["ws"]):
                    ends = nth == len(a["ws"]) - 1
                    spans.append({**w, "rank": rank, "start": starts[rank - 1] and nth == 0, "ends": ends, "trailing": "\n" if ends and over else " ", "anchors": [w["x"]], "origin": "ocr", "revision": 1})
        spans.sort(key=lambda w: (w["order"], w["rank"], w["x"], w["seq"]))
        for i, w in enumerate(spans):
            w["id"] = i
        pages[p] = spans
    bodies = {p: [w for w in spans if w["kind"] == "body"] for p, spans in pages.items()}

    def join(a, b, cross):
        stem, tail = regex.sub("-+$", "", a["text"]), b["text"]
        score = 96 if stem.lower() + core(tail).lower() in lexicon else 88 if stem.lower() in lexicon and core(tail).lower() in lexicon else 70
        return {"span": a["id"], "tail": b["id"], "kind": "hyphen_join", "score": score, "original": f"{a['text']} / {tail}", "replacement": f"{stem}-{tail}" if score == 88 and not cross else stem + tail, "revision": 1, "cross": cross, "auto": False}

    out = {}
    for p, spans in pages.items():
        last, proposals, fragments = {}, [], set()
        for w in spans:
            a = last.get(w["kind"])
            if a is not None and a["ends"] and a["text"].endswith("-") and len(core(a["text"])) >= 2 and core(w["text"]):
                proposals.append(join(a, w, False))
            last[w["kind"]] = w
        lower = lambda w: regex.match(r"\p{Ll}", core(w["text"]))
        if bodies[p] and bodies.get(p + 1) and bodies[p][-1]["text"].endswith("-") and lower(bodies[p + 1][0]):
            proposals.append(join(bodies[p][-1], bodies[p + 1][0], True))
        if bodies[p] and bodies.get(p - 1) and bodies[p - 1][-1]["text"].endswith("-") and lower(bodies[p][0]):
            fragments.add(bodies[p][0]["id"])
        spans = [dict(w) for w in spans]
        one_by_one(spans, proposals)
        fragments |= {x for q in proposals if not q["auto"] for x in ((q["span"],) if q["cross"] else (q["span"], q["tail"]))}
        for w in spans:
            if w["id"] not in fragments and spelt(w, lexicon) and (hits := confused(core(w["text"]), lexicon)):
                c = core(w["text"])
                name, score = bool(regex.match(r"\p{Lu}", c)), 78 if len(hits) > 1 else 84 if len(c) < 4 else 92
                lead, tail = w["text"].split(c, 1)
                proposals.append({"span": w["id"], "tail": None, "kind": "proper_name" if name else "ocr_confusion", "score": min(score, 60) if name else score, "original": w["text"], "replacement": lead + hits[0] + tail, "revision": w["revision"], "cross": False, "auto": False})
        asked = [dict(w) for w in spans if w["id"] not in fragments]
        one_by_one(spans, proposals)
        out[p] = spans, proposals, asked
    return out


def test_reconstruct(spark, rebuilt):
    got = defaultdict(list)
    for r in QUERIES["op_reconstruct"](spark, SF).collect():
        got[r.page_index].append((r.position, r.text, r.trailing, r.region_kind, r.paragraph_start, r.origin, r.confidence, r.revision, r.anchors))
    assert len(rebuilt) > 50
    for p, (spans, _, _) in rebuilt.items():
        assert sorted(got.get(p, [])) == [(i, w["text"], w["trailing"], w["kind"], w["start"], w["origin"], w["confidence"], w["revision"], len(w["anchors"])) for i, w in enumerate(spans)], p
    assert {"ocr", "auto_applied"} == {w["origin"] for spans, _, _ in rebuilt.values() for w in spans}


def test_reconstruct_proposals(spark, rebuilt, lexicon):
    got = defaultdict(list)
    for r in QUERIES["op_reconstruct_proposals"](spark, SF).collect():
        got[r.page_index].append((r.span, r.kind, r.score, r.original, r.replacement, r.cross_page, r.auto_applied))
    shown = lambda q: (q["span"], q["kind"], q["score"], q["original"], q["replacement"], q["cross"], q["auto"])
    searched = ("spelling", "proper_name")
    for p, (_, proposals, _) in rebuilt.items():
        assert sorted(x for x in got.get(p, []) if x[1] not in searched) == sorted(shown(q) for q in proposals if q["kind"] not in searched), p
    cache = {}

    def nearest(low):
        if low not in cache:
            near = [(d, t) for t in lexicon if abs(len(t) - len(low)) <= 2 and (d := distance(low, t)) <= 2]
            cache[low] = min(near, default=None)
        return cache[low]

    for p in [p for p in sorted(rebuilt) if len(rebuilt[p][0]) <= 60][:12]:
        _, proposals, asked = rebuilt[p]
        expected, budget = sorted(shown(q) for q in proposals), 40
        for w in asked:
            c = core(w["text"])
            if not spelt(w, lexicon) or confused(c, lexicon) or len(c) < 4 or regex.fullmatch(r"\p{Lu}+", c) or not budget:
                continue
            budget -= 1
            name = bool(regex.match(r"\p{Lu}", c))
            if near := nearest(c.lower()):
                score, word = 72 if near[0] == 1 else 55, near[1][0].upper() + near[1][1:] if name else near[1]
                lead, tail = w["text"].split(c, 1)
                expected.append((w["id"], "proper_name" if name else "spelling", min(score, 60) if name else score, w["text"], lead + word + tail, False, False))
        assert sorted(got.get(p, [])) == sorted(expected), p


@pytest.fixture(scope="module")
def typed_lines(v):
    lines = defaultdict(list)
    for r in v.spans.collect():
        lines[r.page_index, r.line_no].append(r)
    return {k: sorted(rs, key=lambda r: r.word_no) for k, rs in lines.items()}


def typed_anew(rs):
    return " ".join(r.text + "x" if r.word_no % 7 == 3 else r.text for r in rs if r.word_no % 5 != 2).split()


def test_edit_text(spark, typed_lines):
    got = {r.span_id: r for r in QUERIES["op_edit_text"](spark, SF).collect()}
    assert len(got) == sum(map(len, typed_lines.values()))
    fitted = changed = 0
    for (page, line), rs in typed_lines.items():
        old, new = [r.text for r in rs], typed_anew(rs)
        now = [got[r.span_id] for r in rs]
        assert all(g.anchors == f"{page},{r.x},{r.y}" for g, r in zip(now, rs))
        if line % 6 == 5 or [w for w in old if w] == new:
            assert [(g.text, g.trailing, g.origin, g.confidence, g.revision) for g in now] == [(r.text, r.trailing, r.origin, r.confidence, r.revision) for r in rs]
            continue
        changed += 1
        texts = [g.text for g in now]
        assert " ".join(filter(None, texts)).split() == new
        if len(old) <= 9:
            fitted += 1
            assert texts == table_fit(old, new), old
        gaps, last = [r.trailing for r in rs], None
        for k, t in enumerate(texts):
            if t:
                last = k
            else:
                if last is not None and gaps[k] and not ("\n" in gaps[last] and "\n" not in gaps[k]):
                    gaps[last] = gaps[k]
                gaps[k] = ""
        for g, r, gap in zip(now, rs, gaps):
            other = g.text != r.text
            assert (g.trailing, g.origin, g.confidence, g.revision) == (gap, "manual" if other else r.origin, None if other else r.confidence, r.revision + (other or gap != r.trailing))
    assert fitted > 100 and changed > 500


def test_edit_text_history(spark, typed_lines):
    got = {r.history_id: r for r in QUERIES["op_edit_text_history"](spark, SF).collect()}
    expected = {}
    for (page, line), rs in typed_lines.items():
        old, new = [r.text for r in rs if r.text], typed_anew(rs)
        if line % 6 != 5 and old != new:
            clip = lambda t: t if len(t) <= 40 else t[:39] + "…"
            expected[page * 100_000 + line] = (f"Edited “{clip(' '.join(old))}” → “{clip(' '.join(new))}” · page {page + 1}", rs[0].seq, old, " ".join(new))
    assert {k: (r.label, r.seq, json.loads(r.original), r.replacement) for k, r in got.items()} == expected
    assert all(r["items"] > 0 for r in got.values())
