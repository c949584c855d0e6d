"""A quality classifier by positive-unlabelled learning.

Only trusted positives and unlabelled documents are learned from: labels other than 1 are never read. The risk of a scorer g is
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)): the negative part is estimated from unlabelled documents minus the
positives' share in them, and kept from going below zero. pi, the share of positives among the unlabelled, is given or estimated
from both samples (``mixture_share``): no set of documents can be rarer among the unlabelled than pi times its
frequency among the positives, so the least ratio over the tops of a ranking bounds pi, and nearly meets it. The ranking is of rows that the ranker
wasn't trained on, all folds together.

Where classes are told apart well, the level of the scores is still as unsure as pi: a pi that is a little too high leaves bad documents above any fixed
threshold. So the level is set by trusted positives that a model of the other folds has scored: if nearly all of them (``KEPT``) lie above
one half, all scores are lowered by as much as keeps them there. They are never raised, and their order stays.

Texts become surface measures and a signed hash profile of their words and word pairs in one pass over whole texts, stored
once. The model is a sum of piecewise constant functions of the measures (cut at quantiles) and a linear function of
the profile, fitted by gradient descent on a sample of at most ``most_positive`` and ``most_unlabelled`` rows, the ones with the
least hash of id and features; every document is then scored.

Null and empty texts have all-zero measures and profiles and are scored like any other. Documents without an id count as held
out. Repeated rows get equal scores; rows that tie in the sample's order are alike. Without positives to learn from, every
score is pi (0.5 if that is unknown). An empty table gives an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import materialize, raw_texts, text_chunks

FOLDS = 5
MOST_POSITIVE, MOST_UNLABELLED = 20_000, 40_000
BINS = 16
#: Buckets of the hash profile.
PROFILE = 256
MEASURES = (
    "log_words", "log_chars", "word_length", "punctuation", "odd_characters", "odd_words", "commonest_mark", "capitals", "digits", "beyond_ascii", "stops", "commas", "distinct", "commonest", "adjacent_equal", "distinct_pairs", "lines", "distinct_lines", "line_words", "capital_words", "letterless_words", "longest_word",
)
#: Rounds of the classifier and of the ranking that estimates pi, their rate, and the ridges of bins and profile.
ROUNDS, PRIOR_ROUNDS, RATE, RIDGE = 600, 150, 0.1, (1e-5, 1e-3)
#: Parts for scoring rows by models that haven't seen them, rounds of those that set the level, and the share of trusted positives that it keeps.
PARTS, LEVEL_ROUNDS, KEPT = 4, 300, 0.995
_MARKS = string.punctuation.encode()
#: Marks that prose has few of.
_ODD = bytes(set(_MARKS) - set(b".,;:!?'\"()-"))
_LETTERS = bytes(b for b in range(256) if chr(b).isalpha() or b >= 128)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _profile(hashes: np.ndarray) -> bytes:
    """Signed counts by bucket, square roots of them, scaled to a byte each."""
    sums = np.bincount((hashes & np.uint64(PROFILE - 1)).astype(np.int64), 1.0 - 2.0 * ((hashes >> np.uint64(40)) & np.uint64(1)), PROFILE)
    roots = np.sign(sums) * np.sqrt(np.abs(sums))
    return np.rint(roots * (127 / max(1e-9, np.abs(roots).max()))).astype(np.int8).tobytes()


def described(text: bytes) -> tuple[list[float], bytes]:
    """The measures of a text and its profile."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(MEASURES), bytes(PROFILE)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    pairs = (hashes[:-1] * _PAIR) ^ (hashes[1:] >> np.uint64(7))
    _, times = np.unique(hashes, return_counts=True)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = [text.count(_MARKS[i : i + 1]) for i in range(len(_MARKS))]
    measures = [
        math.log1p(n), math.log1p(size), size / n, sum(marks) / size, share(_ODD), sum(w.translate(None, _ODD) != w for w in words) / n, max(marks) / size, share(string.ascii_uppercase.encode()), share(b"0123456789"), share(bytes(range(128, 256))), share(b".?!"), share(b",;:"),
        len(times) / n, int(times.max()) / n, int((hashes[1:] == hashes[:-1]).sum()) / n, len(np.unique(pairs)) / n, len(lines) / n, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), sum(map(bytes.isupper, words)) / n, sum(w.translate(None, _LETTERS) == w for w in words) / n, max(map(len, words)),
    ]
    return measures, _profile(np.concatenate([hashes, pairs]))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x, profile of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = [described(t) for t in raw_texts(batch)]
            x, profile = pa.array([m for m, _ in found], pa.list_(pa.float32())), pa.array([p for _, p in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x, profile], ["doc_id", "held_out", "x", "profile"])

    given = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(rows, f"doc_id {id_type}, held_out boolean, x array<float>, profile binary")


class Rows:
    """Features of some documents: measures, and profiles of unit length."""

    def __init__(self, x: pa.ChunkedArray | pa.Array, profile: pa.ChunkedArray | pa.Array):
        self.x = np.array(x.to_pylist(), np.float64).reshape(len(x), len(MEASURES))
        p = np.frombuffer(b"".join(profile.to_pylist()), np.int8).reshape(len(profile), PROFILE).astype(np.float32)
        self.profile = p / np.maximum(1e-9, np.linalg.norm(p, axis=1, keepdims=True))

    def __len__(self) -> int:
        return len(self.x)

    def part(self, at: slice | np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.x, out.profile = self.x[at], self.profile[at]
        return out


class Steps:
    """Maps measures to one-hot bins between quantiles of the unlabelled sample."""

    def __init__(self, sample: np.ndarray, bins: int = BINS):
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in sample.T]
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])
        self.size = int(self.first[-1])

    def index(self, x: np.ndarray) -> np.ndarray:
        """The weight that each measure of each row picks."""
        return np.stack([np.searchsorted(e, column, side="right") + at for e, column, at in zip(self.edges, x.T, self.first, strict=False)], axis=1)


class Scorer:
    """Bins of the measures, their weights, the profile's weights and a bias."""

    def __init__(self, steps: Steps, bias: float):
        self.steps, self.weights = steps, np.zeros(steps.size + PROFILE + 1)
        self.weights[-1] = bias

    def raw(self, index: np.ndarray, profile: np.ndarray) -> np.ndarray:
        w, n = self.weights, self.steps.size
        return w[index].sum(1) + profile @ w[n:-1].astype(np.float32) + w[-1]

    def score(self, rows: Rows) -> np.ndarray:
        return _sigmoid(self.raw(self.steps.index(rows.x), rows.profile)) if len(rows) else np.empty(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Slopes = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def non_negative_risk(prior: float) -> Slopes:
    """Slopes of the non-negative unbiased risk with logistic loss."""

    def slopes(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        away, toward = prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if negative < 0:  # step back from the region where the estimate is negative
            return away, -toward
        return prior * -_sigmoid(-zp) / len(zp) - away, toward

    return slopes


def told_apart(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the logistic loss of positives against unlabelled rows."""
    return -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)


def fit(positive: Rows, unlabelled: Rows, slopes: Slopes, bias: float = 0.0, rounds: int = ROUNDS, rate: float = RATE, ridge: tuple[float, float] = RIDGE) -> Scorer:
    """Gradient descent with steps scaled by past slopes; ``ridge`` holds the weights of bins and of the profile."""
    scorer = Scorer(Steps(unlabelled.x), bias)
    n = scorer.steps.size
    pi, ui = scorer.steps.index(positive.x), scorer.steps.index(unlabelled.x)
    held = np.concatenate([np.full(n, ridge[0]), np.full(PROFILE, ridge[1]), [0.0]])
    moments = [np.zeros(len(held)), np.zeros(len(held))]
    spread = lambda at, g: np.bincount(at.ravel(), np.repeat(g, at.shape[1]), n)
    for t in range(1, rounds + 1):
        gp, gu = slopes(scorer.raw(pi, positive.profile), scorer.raw(ui, unlabelled.profile))
        profile = gp.astype(np.float32) @ positive.profile + gu.astype(np.float32) @ unlabelled.profile
        slope = np.concatenate([spread(pi, gp) + spread(ui, gu), profile, [gp.sum() + gu.sum()]]) + held * scorer.weights
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.999 * moments[1] + 0.001 * slope**2
        scorer.weights = scorer.weights - rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
    return scorer


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, from scores of both that weren't trained on.

    Best-bin estimation: of all tops of the ranking, the one at which the ratio of frequencies, with its margin of error, is least.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))[::-1]
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = sum(math.sqrt(math.log(4 / delta) / 2 / n) for n in (len(positive), len(unlabelled)))
    at = p > 0
    best = np.argmin((u[at] + (1 + gamma) * margin) / p[at])
    return min(0.98, max(0.02, float(u[at][best] / p[at][best])))


def unseen(positive: Rows, unlabelled: Rows, slopes: Slopes, bias: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores of all rows, each by a model fitted to the other parts. Both need a row a part."""
    out = [np.empty(len(positive)), np.empty(len(unlabelled))]
    for part in range(PARTS):
        others = [x.part(np.arange(len(x)) % PARTS != part) for x in (positive, unlabelled)]
        scorer = fit(*others, slopes, bias, rounds)
        for of, x in zip(out, (positive, unlabelled), strict=True):
            own = x.part(slice(part, None, PARTS))
            of[part::PARTS] = scorer.raw(scorer.steps.index(own.x), own.profile)
    return out[0], out[1]


def class_prior(positive: Rows, unlabelled: Rows) -> float:
    """pi, from a ranking of unseen rows; one half if they are too few for that."""
    if min(len(positive), len(unlabelled)) < 2 * PARTS:
        return 0.5
    return mixture_share(*unseen(positive, unlabelled, told_apart, 0.0, PRIOR_ROUNDS))


def train(positive: Rows, unlabelled: Rows, prior: float | None = None) -> Scorer:
    """The scorer for a given or estimated pi, its level set by trusted positives."""
    prior = class_prior(positive, unlabelled) if prior is None else prior
    bias = math.log(prior / (1 - prior))
    scorer = fit(positive, unlabelled, non_negative_risk(prior), bias)
    if min(len(positive), len(unlabelled)) >= 2 * PARTS:
        trusted, _ = unseen(positive, unlabelled, non_negative_risk(prior), bias, LEVEL_ROUNDS)
        scorer.weights[-1] -= max(0.0, float(np.quantile(trusted, 1 - KEPT)))
    return scorer


def _sample(df: DataFrame, most: int) -> Rows:
    """At most ``most`` rows, those with the least hash. Rows that can't be among them are dropped where they lie, so what meets in
    one task is hardly more than the sample."""
    h = F.xxhash64(F.col("doc_id").cast("string"), "x", "profile")
    rows = df.count()
    share = (1.1 * most + 1000) / max(1, rows)
    near = df.where(h < int(share * 2**64) - 2**63) if share < 1 else df
    least = near.select("x", "profile", h.alias("h")).orderBy("h").limit(most).toArrow()
    return Rows(least["x"], least["profile"])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    At most ``most_positive`` trusted positives and ``most_unlabelled`` documents train the model; both are bounds of the fit alone.
    """
    rows = materialize(measured(docs), "measures")
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    training = rows.where("NOT held_out AND doc_id IS NOT NULL")
    positive, unlabelled = _sample(training.join(trusted, "doc_id", "left_semi"), most_positive), _sample(training, most_unlabelled)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if not len(positive) or not len(unlabelled):
        score = F.lit(0.5 if prior is None else prior)
        return rows.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    scorer = train(positive, unlabelled, prior)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scorer.score(Rows(batch.column(2), batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, f"doc_id {id_type}, held_out boolean, score double, predicted int")
