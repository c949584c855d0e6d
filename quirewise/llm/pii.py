"""Personal data by weak supervision, in built-in expressions only.

Strict patterns give the base spans, which always stay. Looser patterns give further candidates, and opaque strings
candidates for secrets. Five labelers vote for, against or not at all on every candidate, strict ones too: the
regular expression (strict or only loose), a gazetteer (top-level domains, reserved address ranges, issuer prefixes,
dialling codes, known key prefixes), the words before it, its form (checksum, group sizes, mix of characters) and its
edges. Candidates are counted by votes and features, of which there are a bounded number of patterns;
expectation-maximisation over the counts estimates each labeler's reliability by kind and every pattern's posterior,
and a logistic span classifier is trained on those soft labels. It sees the votes and, beside them, features of the
span and its surroundings that no labeler uses: length, share of digits, the characters next to it. Loose
candidates that it accepts and that overlap no other span are added.

Positions are code points, ends exclusive. They come from running sums over the pieces between matches, so a text is
scanned once a pattern and takes n log n steps in its matches; the patterns use possessive repeats, so long runs cost
linear time.

Null text counts as empty; rows are judged one by one, so repeated rows are equal; of overlapping loose candidates
the first stays, the one of the earlier kind if they start together. Without candidates the classifier is the prior and accepts
nothing; an empty table gives an empty result. Other columns of ``docs`` aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import let, materialize

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
#: The labelers, and how often each is right before any data speak, with the weight of that belief in candidates.
VOTERS = {"regex": 0.8, "gazetteer": 0.7, "context": 0.85, "form": 0.85, "edges": 0.8}
BELIEF = 10
#: What the classifier sees beside the votes.
FEATURES = ("length", "digits", "before", "after")
_SPAN = "array<struct<lo:int,kind:int,hi:int,base:int," + ",".join(f"{x}:int" for x in (*VOTERS, *FEATURES)) + ">>"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl|be|ca|mx|ar"
KEY_PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|sk-|pk_|rk_|xox[abps]-|AIza|eyJ|glpat-"
BEFORE = (
    r"e-?mail|mail|contact|write|reach|kontakt|courriel|correo",
    r"ip|host|server|address|client|login|adresse",
    r"card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    r"tel|phone|call|fax|mobile|whatsapp|telefon|appel",
    r"token|key|secret|passw|pwd|auth|bearer|credential|schl.ssel|clave",
)
AGAINST = (*["version|isbn|issn|order|token|serial|invoice|build"] * 4, "sha|commit|digest|checksum|hash|uuid|etag")
_ASSIGNED = r"""(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer)["']?[\x20]{0,2}[=:]?[\x20]{0,2}["']?$"""


@dataclass(frozen=True)
class Finder:
    """A pattern for one kind. ``needs``: a text with none of these holds no match, so the pattern isn't tried; ``NUMERIC``: none without
    a run of digits and what may stand between them; empty: always tried.

    ``gazetteer`` and ``form`` give votes of 1, -1 or 0 on a match.
    """

    kind: int
    strict: bool
    pattern: str
    holds: Callable[[Column], Column]
    gazetteer: Callable[[Column], Column]
    form: Callable[[Column], Column]
    needs: tuple[str, ...] | str


#: What every match of the patterns for numbers holds: from one digit to another six to nine places on, no more than two marks between digits.
NUMERIC = r"[0-9][\x20().0-9/-]{5,8}[0-9]"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def term(i: Column, d: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return let(digits, lambda d: F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + term(i, d)) % 10 == 0)


def _card(x: Column) -> Column:
    return let(_digits(x), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


def _vote(good: Column) -> Column:
    return F.when(good, F.lit(1)).otherwise(F.lit(-1))


_yes = lambda x: F.lit(True)
_none = lambda x: F.lit(0)


def _hit(pattern: str) -> Callable[[Column], Column]:
    """A vote for what the pattern finds, against the rest."""
    return lambda x: _vote(x.rlike(pattern))


def _long(least: int, most: int) -> Callable[[Column], Column]:
    return lambda x: _vote(F.length(_digits(x)).between(least, most))


_local = _hit(r"^[\p{L}\p{N}._%+-]*\p{L}")
_issuer = lambda x: _vote(_digits(x).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"))
_not_reserved = lambda x: _vote(~x.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])(?:\.|\[|\()"))
_mixed = lambda x: _vote(x.rlike("[0-9].*[0-9].*[0-9]") & x.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]") & ~x.rlike(r"(.)\1{5}"))

FINDERS = (
    Finder(0, True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _yes, _hit(rf"(?i)\.(?:{TOP_DOMAINS})$"), _local, ("@",)),
    Finder(1, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), _not_reserved, lambda x: _vote(~x.rlike(r"(?:^|\.)0[0-9]")), NUMERIC),
    Finder(2, True, r"[0-9](?:[\x20-]?[0-9])++", _card, _issuer, _long(15, 16), NUMERIC),
    Finder(3, True, r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: F.length(_digits(x)).between(10, 15), _hit(r"^\+[1-9]"), _long(11, 13), ("+",)),
    Finder(0, False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++", _yes, _hit(rf"(?i)(?:{TOP_DOMAINS})$"), _local, ("at)", "at]", "AT)", "AT]")),
    Finder(0, False, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]++)++", _yes, _hit(rf"(?i)(?:{TOP_DOMAINS})$"), _local, (" dot ", " DOT ")),
    Finder(1, False, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", _yes, _hit("(?i)^(?:2[0-9a-f]{3}|f[cde][0-9a-f]{2}):"), _none, (":",)),
    Finder(1, False, rf"(?<![0-9.]){_BYTE}(?:(?:\[\.\]|\(\.\)){_BYTE}){{3}}(?![0-9.])", _yes, _not_reserved, _none, ("[.]", "(.)")),
    Finder(2, False, r"(?<![0-9A-Za-z.-])(?:[0-9]{4}[\x20./-]){3}[0-9]{4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z.-])[0-9]{4}[\x20./-][0-9]{6}[\x20./-][0-9]{5}(?![0-9A-Za-z-])|(?<![0-9A-Za-z.-])[0-9]{15,16}(?![0-9A-Za-z-])", lambda x: luhn(_digits(x)), _issuer, lambda x: F.lit(1), NUMERIC),
    Finder(3, False, r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z.-])", _yes, _hit(r"^\(?[2-9][0-9]{2}"), _hit(r"^\(?[0-9]{3}\)?[-.\x20]?[2-9]"), NUMERIC),
    Finder(3, False, r"(?<![0-9A-Za-z+.()-])0(?:0[1-9][0-9]{0,2}[-./\x20][0-9]{2,4}|[1-9][0-9]{1,4})[-./\x20](?:[0-9]{5,8}|[0-9]{2,4}(?:[-.\x20][0-9]{2,4}){1,4})(?![0-9A-Za-z.-])", _yes, _none, _long(9, 14), NUMERIC),
    Finder(SECRET, False, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])", lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]"), lambda x: F.when(x.rlike(rf"^(?:{KEY_PREFIXES})|^(?:[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}}|[0-9A-F]{{32}}|[0-9A-F]{{40}}|[0-9A-F]{{64}})$"), F.lit(1)).when(x.rlike("/.*/|-.*-.*-|_.*_"), F.lit(-1)).otherwise(F.lit(0)), _mixed, ()),
)


def _context(kind: int, near: Column) -> Column:
    return F.when(near.rlike(rf"(?i)\b(?:{BEFORE[kind]})"), F.lit(1)).when(near.rlike(rf"(?i)\b(?:{AGAINST[kind]})"), F.lit(-1)).otherwise(F.lit(0))


def _neighbour(ch: Column) -> Column:
    """0 none or space, 1 letter, 2 digit, 3 other."""
    return F.when(F.coalesce(ch, F.lit("")).rlike(r"^\s*$"), F.lit(0)).when(ch.rlike(r"^\p{L}"), F.lit(1)).when(ch.rlike(r"^\p{N}"), F.lit(2)).otherwise(F.lit(3))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each value and all before it, by doubling: n log n steps, no growing array. ``op`` is associative."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    doubled = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, op(F.get(acc, i - k), x)).otherwise(x))
    return F.aggregate(steps, values, doubled)


def spans(text: Column, finder: Finder, numeric: Column) -> Column:
    """The leftmost non-overlapping matches that hold, with their votes and features. ``numeric``: whether the text has what ``NUMERIC`` finds.

    A text is split, and positions are summed, only if one of its matches holds.
    """
    none = F.array().cast(_SPAN)

    def located(m: Column, pieces: Column, good: Column) -> Column:
        ends = running(F.zip_with(m, F.slice(pieces, F.lit(1), F.size(m)), lambda x, p: F.length(p) + F.length(x)), add)

        def one(i: Column, end: Column) -> Column:
            match, piece, rest = F.get(m, i), F.get(pieces, i), F.concat(F.get(pieces, i + 1), F.coalesce(F.get(m, i + 1), F.lit("")))
            before = _neighbour(F.coalesce(F.nullif(F.substring(piece, -1, 1), F.lit("")), F.substring(F.coalesce(F.get(m, i - 1), F.lit("")), -1, 1)))
            after = _neighbour(F.substring(rest, 1, 1))
            regex = _vote(F.substring(piece, -40, 40).rlike(_ASSIGNED)) if finder.kind == SECRET else F.lit(1 if finder.strict else -1)
            fields = {
                "lo": end - F.length(match), "kind": F.lit(finder.kind), "hi": end, "base": F.lit(int(finder.strict)),
                "regex": regex, "gazetteer": finder.gazetteer(match), "context": _context(finder.kind, F.substring(piece, -40, 40)), "form": finder.form(match), "edges": F.when(before.isin(1, 2) | after.isin(1, 2), F.lit(-1)).otherwise(F.lit(0)),
                "length": F.least(F.floor(F.length(match) / 8), F.lit(3)).cast("int"), "digits": F.floor(3 * F.length(_digits(match)) / F.length(match)).cast("int"), "before": before, "after": after,
            }
            return F.struct(*(x.alias(n) for n, x in fields.items()))

        return let(ends, lambda e: F.transform(good, lambda i: one(i, F.get(e, i)))).cast(_SPAN)

    def judged(m: Column) -> Column:
        holding = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: finder.holds(F.get(m, i)))
        return let(holding, lambda good: F.when(F.size(good) == 0, none).otherwise(let(F.split(text, finder.pattern, -1), lambda pieces: located(m, pieces, good))))

    found = let(F.regexp_extract_all(text, F.lit(finder.pattern), 0), lambda m: F.when(F.size(m) == 0, none).otherwise(judged(m)))
    if not finder.needs:
        return found
    return F.when(numeric if finder.needs == NUMERIC else reduce(or_, (F.contains(text, F.lit(x)) for x in finder.needs)), found).otherwise(none)


def _apart(every: Column) -> Column:
    """The loose spans of ``every`` (sorted) that overlap no base span and no loose one before them."""
    far = F.lit(2**31 - 1)

    def from_base(a: Column) -> Column:
        high = running(F.transform(a, lambda s: F.when(s["base"] == 1, s["hi"]).otherwise(0)), F.greatest)
        low = F.reverse(running(F.reverse(F.transform(a, lambda s: F.when(s["base"] == 1, s["lo"]).otherwise(far))), F.least))
        clear = lambda h, n: F.filter(a, lambda s, i: (s["base"] == 0) & (F.coalesce(F.get(h, i - 1), F.lit(0)) <= s["lo"]) & (F.coalesce(F.get(n, i + 1), far) >= s["hi"]))
        return let(high, lambda h: let(low, lambda n: clear(h, n)))

    def from_loose(a: Column) -> Column:
        return let(running(F.transform(a, lambda s: s["hi"]), F.greatest), lambda h: F.filter(a, lambda s, i: F.coalesce(F.get(h, i - 1), F.lit(0)) <= s["lo"]))

    return let(from_base(every), lambda a: F.when(F.size(a) == 0, a).otherwise(from_loose(a)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and loose spans of every row. Loose spans overlap no base span and no earlier loose one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", let(text, lambda t: let(t.rlike(NUMERIC), lambda numeric: F.sort_array(F.concat(*(spans(t, x, numeric) for x in FINDERS))))).alias("every"))
    loose = F.when(F.exists("every", lambda s: s["base"] == 0), _apart(F.col("every"))).otherwise(F.array().cast(_SPAN))
    return found.select("doc_id", F.filter("every", lambda s: s["base"] == 1).alias("base"), loose.alias("loose"))


#: kind, the votes in the order of VOTERS, then the features in the order of FEATURES.
Pattern = tuple[int, ...]


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def reliabilities(counts: dict[Pattern, int], rounds: int = 50) -> tuple[dict[Pattern, float], dict[tuple[int, str], tuple[float, float]]]:
    """EM over patterns: each pattern's posterior of being personal data, and by kind how often a labeler that votes votes for a true
    candidate and for a false one.

    A labeler that doesn't vote says nothing, nor does one that votes for all. They start from the reliability of ``VOTERS``, which goes on to
    count as ``BELIEF`` candidates of either sort, so labelers stay better than chance where there are few; a kind's share of true candidates is smoothed likewise.
    """
    posterior: dict[Pattern, float] = {}
    says: dict[tuple[int, str], tuple[float, float]] = {}
    start = np.array(list(VOTERS.values()))
    for k in sorted({p[0] for p in counts}):
        own = [p for p in counts if p[0] == k]
        n = np.array([counts[p] for p in own], np.float64)
        votes = np.array([p[1 : 1 + len(VOTERS)] for p in own], np.int8)
        up, down = (votes > 0).astype(np.float64), (votes < 0).astype(np.float64)
        true, false, share = start, 1 - start, 0.5
        for _ in range(rounds):
            q = _sigmoid(_logit(share) + up @ np.log(true / false) + down @ np.log((1 - true) / (1 - false)))
            share = float((n @ q + BELIEF / 2) / (n.sum() + BELIEF))
            true = ((n * q) @ up + start * BELIEF) / ((n * q) @ (up + down) + BELIEF)
            false = ((n * (1 - q)) @ up + (1 - start) * BELIEF) / ((n * (1 - q)) @ (up + down) + BELIEF)
        posterior |= dict(zip(own, q.tolist(), strict=True))
        says |= {(k, name): (t, f) for name, t, f in zip(VOTERS, true.tolist(), false.tolist(), strict=True)}
    return posterior, says


def features(p: Pattern) -> list[tuple[str, int, int]]:
    """(field, kind, value) of all that is 1 for the pattern."""
    return [(name, p[0], value) for name, value in zip(("kind", *VOTERS, *FEATURES), p, strict=False)]


def train(counts: dict[Pattern, int], posterior: dict[Pattern, float], steps: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> dict[tuple[str, int, int], float]:
    """A logistic classifier on one-hot votes and features by kind, fitted to the posteriors; steps are scaled by each weight's past slopes.

    A pattern weighs as the square root of its count, so that rare ones have a say.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    names = sorted({x for p in patterns for x in features(p)})
    place = {x: i for i, x in enumerate(names)}
    at = np.array([[place[x] for x in features(p)] for p in patterns])
    share = np.sqrt(np.array([counts[p] for p in patterns], np.float64))
    share, y = share / max(1.0, share.sum()), np.array([posterior[p] for p in patterns])
    weights, past = np.zeros(len(names)), np.full(len(names), 1e-12)
    for _ in range(steps):
        miss = share * (_sigmoid(weights[at].sum(axis=1)) - y)
        slope = ridge * weights + np.bincount(at.ravel(), np.repeat(miss, at.shape[1]), len(names))
        past += slope * slope
        weights -= rate * slope / np.sqrt(past)
    return dict(zip(names, weights.tolist(), strict=True))


def _score(c: Column, weights: dict[tuple[str, int, int], float]) -> Column:
    return reduce(add, (F.when((c["kind"] == kind) & (c[field] == value), F.lit(w)).otherwise(F.lit(0.0)) for (field, kind, value), w in sorted(weights.items())), F.lit(0.0))


def _listed(of: Column) -> Column:
    label = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, (*KINDS, "secret"))), s["kind"] + 1), s["lo"].cast("string"), s["hi"].cast("string"))
    return F.array_join(F.transform(of, label), ",")


def find_personal_data(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_found of every row.

    ``spans`` holds all that was found: base spans, added ones of the same kinds, and secrets, which come after the four kinds where starts
    are equal. n_added counts the added ones without secrets, n_found all.
    """
    found = materialize(candidates(docs), "pii")
    fields = ["kind", *VOTERS, *FEATURES]
    voted = found.where("size(base) > 0 OR size(loose) > 0").select(F.explode(F.concat("base", "loose")).alias("c"))
    counted = voted.groupBy(*(f"c.{x}" for x in fields)).count().collect()  # a row a pattern: a bounded number, whatever the corpus
    counts = {tuple(r[x] for x in fields): r["count"] for r in counted}
    posterior, _ = reliabilities(counts)
    weights = train(counts, posterior)
    accepted = F.filter("loose", lambda c: _score(c, weights) >= _logit(accept)) if weights else F.col("loose")
    found = found.withColumn("added", accepted)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    secrets = F.size(F.filter("added", lambda s: s["kind"] == SECRET)).cast("long")
    return found.select(
        "doc_id", *(n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        (F.size("added") - secrets).cast("long").alias("n_added"), secrets.alias("n_secret"), (F.size("base") + F.size("added")).cast("long").alias("n_found"),
    )
