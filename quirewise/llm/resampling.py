"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed runs of one to three words. A bucket's gain is the logarithm of how much commoner it is in the
target than in the corpus; a document's weight is the sum of its gains, taken from an array. The draw without replacement takes the highest
weights after Gumbel noise that the document's id gives, so reruns agree.

Buckets are CRC-32 remainders. The CRC of a run follows from those of its words by one linear map per word length, so each word is hashed
once and runs are combined by table lookups over a chunk of texts.

The draw: scores are cut into intervals by quantiles of the upper tail, each of a bounded number of rows. Every task sorts the eligible rows that it
has into runs of blocks, one run an interval. A task that merges an interval gets the blocks in order of their heads, and a
tournament tree of the open ones gives the next rows; what is open is a block a run. Counts per interval say at which rank each begins, and merging stops
in the interval, and at the row, where the draw is complete; whatever lies below was never sorted together.

Null texts have no features; a null doc_id is hashed as an empty one and comes last of ties. Rows equal in doc_id, weight and n_features are
merged with their number, so a hot one is one row of a run; they take consecutive ranks. Rows that tie in score and doc_id are settled by weight and n_features. An
empty table gives an empty result; an empty target gives its gains by the same formula. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirewise.llm.common import CHUNK_BYTES, materialize, raw_texts, text_chunks

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Rows of an interval about, and of a block of a run.
INTERVAL, BLOCK = 200_000, 8192
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Shift:
    """What CRC-32 becomes when so many bytes follow: for every length a linear map, held as four tables of bytes."""

    MOST = 64

    def __init__(self):
        one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        tables = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
        for _ in range(self.MOST):
            last = tables[-1]
            tables.append((last >> np.uint32(8)) ^ one[last & np.uint32(0xFF)])
        self.flat = np.concatenate([t.ravel() for t in tables])

    def _near(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        base, low = length << 10, np.uint32(0xFF)
        out = self.flat[base + (crc & low)]
        for byte in (1, 2, 3):
            out ^= self.flat[base + (byte << 8) + ((crc >> np.uint32(8 * byte)) & low)]
        return out

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self._near(crc, np.minimum(length, self.MOST))
        rest = length - self.MOST
        far = np.flatnonzero(rest > 0)
        while len(far):
            out[far] = self._near(out[far], np.minimum(rest[far], self.MOST))
            rest[far] -= self.MOST
            far = far[rest[far] > 0]
        return out


_shift: list[Shift] = []


def pieces(texts: list[bytes], longest: int, most: int = CHUNK_BYTES) -> Iterator[list[tuple[int, bytes, int]]]:
    """(text, words, leading words that were in the piece before) of some texts together; a very long one comes in several pieces."""
    whole = [(i, t.translate(_WORD), 0) for i, t in enumerate(texts) if len(t) <= most]
    if whole:
        yield whole
    for i, t in enumerate(texts):
        if len(t) > most:
            t, lo, tail = t.translate(_WORD), 0, []
            while lo < len(t):
                hi = t.find(b" ", lo + most)
                hi = len(t) if hi < 0 else hi
                piece = b" ".join([*tail, t[lo:hi]])
                yield [(i, piece, len(tail))]
                tail, lo = piece.rsplit(None, longest - 1)[-(longest - 1) :] if longest > 1 else [], hi
                tail = b" ".join(tail).split()[-(longest - 1) :] if tail else []


def features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of runs (1, 2, ... words), the texts and buckets of all runs, piece by piece."""
    if not _shift:
        _shift.append(Shift())
    shift = _shift[0]
    for part in pieces(texts, longest):
        split = [t.split() for _, t, _ in part]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for own in split for w in own]
        n = len(words)
        run = np.fromiter(map(zlib.crc32, words), np.uint32, n)
        length = np.fromiter(map(len, words), np.int64, n)
        of = np.repeat(np.array([i for i, _, _ in part], np.int64), counts)
        known = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(np.array([k for _, _, k in part], np.int64), counts)
        spaced = shift(np.full(n, zlib.crc32(b" "), np.uint32), length) ^ run  # each word after a space
        for k in range(min(longest, n)):
            if k:
                run = shift(run[:-1], length[k:] + 1) ^ spaced[k:]
            counted = (of[: n - k] == of[k:]) & ~known[k:]
            yield k + 1, of[k:][counted], (run[counted] % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs in all texts: a row a bucket comes to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_chunks(batches):
            for _, _, found in features(raw_texts(batch), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = [0] * buckets
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    all_s, all_t, b = float(sum(corpus)), float(sum(target)), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + b) / ((s + 1.0) * (all_t + b)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row, in one pass without a shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            size = batch.num_rows
            words, n, weight = (np.zeros(size, np.int64) for _ in range(3))
            for k, at, found in features(raw_texts(batch), longest, len(gain)):
                own = np.bincount(at, minlength=size)
                words += own if k == 1 else 0
                n += own
                weight += np.rint(np.bincount(at, gain[found].astype(np.float64), size)).astype(np.int64)  # whole numbers far below 2^53
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id {id_type}, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of matches between open blocks. The block with the least head wins; the best loser on its way up says how far it may go on."""

    def __init__(self):
        self.size, self.blocks = 1, [None]  # a block: keys, rows, place of its head
        self.won = [-1, -1]  # winners of the matches from 1; then the blocks, -1 where there is none

    def _head(self, block: int) -> tuple:
        keys, _, at = self.blocks[block]
        return keys[at]

    def _better(self, a: int, b: int) -> int:
        return b if a < 0 else a if b < 0 or self._head(a) <= self._head(b) else b

    def _replay(self, block: int) -> None:
        at = (self.size + block) // 2
        while at:
            self.won[at] = self._better(self.won[2 * at], self.won[2 * at + 1])
            at //= 2

    def enter(self, keys: list[tuple], rows: list) -> None:
        if None not in self.blocks:
            self.blocks += [None] * self.size
            self.size *= 2
            self.won = [-1] * self.size + [i if b else -1 for i, b in enumerate(self.blocks)]
            for i in range(0, self.size, 2):
                self._replay(i)
        block = self.blocks.index(None)
        self.blocks[block] = [keys, rows, 0]
        self.won[self.size + block] = block
        self._replay(block)

    def _runner_up(self, block: int) -> tuple | None:
        best, at = -1, self.size + block
        while at > 1:
            best = self._better(best, self.won[at ^ 1])
            at //= 2
        return self._head(best) if best >= 0 else None

    def up_to(self, limit: tuple | None = None) -> Iterator[list]:
        """Rows in order, by slices, as long as they're before ``limit``."""
        while (block := self.won[1]) >= 0 and (limit is None or self._head(block) < limit):
            keys, rows, at = self.blocks[block]
            ends = [x for x in (limit, self._runner_up(block)) if x is not None]
            to = max(at + 1, bisect_left(keys, min(ends), at)) if ends else len(keys)
            yield rows[at:to]
            if to < len(keys):
                self.blocks[block][2] = to
            else:
                self.blocks[block] = None
                self.won[self.size + block] = -1
            self._replay(block)


ROW = ("doc_id", "n_features", "weight", "score")


def _key(r: tuple) -> tuple:
    doc_id, n_features, weight, score = r[:4]
    return -score, doc_id is None, 0 if doc_id is None else doc_id, -weight, -n_features


def sorted_runs(top: DataFrame) -> DataFrame:
    """Blocks of sorted rows; every task has a run in each interval. ``top`` has interval, ROW and n, all rows different."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    names = [*ROW, "n"]
    held = ", ".join(f"{c}s array<{top.schema[c].dataType.simpleString()}>" for c in names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for at in range(lo, hi, BLOCK):
                    n = min(hi - at, BLOCK)
                    lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([c.slice(at, n)])) for c in batch.columns[1:]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), *lists], ["interval", *(f"{c}s" for c in names)])

    return top.sortWithinPartitions("interval", *order).select("interval", *names).mapInArrow(rows, f"interval int, {held}")


def merged(top: DataFrame, begins: dict[int, int], draws: int) -> DataFrame:
    """``top`` with first and drawn: the rank of the first of a row's copies, and how many of them are drawn.

    ``begins``: how many rows lie before each interval. Once the draw is complete rows come out as they are, with none drawn.
    """
    heads = [F.element_at("scores", 1).desc(), F.element_at("doc_ids", 1).asc_nulls_last(), F.element_at("weights", 1).desc(), F.element_at("n_featuress", 1).desc()]
    result = top.select(*ROW, "n", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("drawn")).schema
    arrow = to_arrow_schema(result)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, rank = None, Tournament(), 0
        out: list[tuple] = []

        def take(slices: Iterable[list]) -> None:
            nonlocal rank
            for part in slices:
                for r in part:
                    drawn = min(r[4], max(0, draws - rank))
                    out.append((*r, rank + 1, drawn))
                    rank += r[4]

        def done() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for block in range(batch.num_rows):
                interval, *columns = (c[block].as_py() for c in batch.columns)
                own = list(zip(*columns, strict=True))
                if interval != now:
                    take(tree.up_to())
                    now, tree, rank = interval, Tournament(), begins[interval]
                if rank < draws:
                    keys = [_key(r) for r in own]
                    take(tree.up_to(keys[0]))
                    tree.enter(keys, own)
                else:
                    take([own])
                if len(out) >= BLOCK:
                    yield done()
        take(tree.up_to())
        if out:
            yield done()

    return sorted_runs(top).repartition("interval").sortWithinPartitions("interval", *heads).mapInArrow(rows, result)


def in_intervals(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """``rows`` with interval: how many of ``bounds`` (falling) are above the score; those below all bounds go."""
    rising = np.array(bounds[::-1], np.int64)
    schema = rows.select(F.lit(0).cast("int").alias("interval"), *ROW).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(rising) - np.searchsorted(rising, batch.column(3).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], schema=to_arrow_schema(schema))

    return rows.where(F.col("score") >= bounds[-1]).select(*ROW).mapInArrow(of, schema)


def copies(ranked: DataFrame) -> DataFrame:
    """A row for each copy, with its rank or null; unfolded in two steps, so no array is long."""
    step = 1 << 16
    parts = ranked.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))).alias("base"))
    each = F.sequence(F.col("base") * step, F.least(F.col("n") - 1, F.col("base") * step + (step - 1)))
    nth = parts.select(*ROW, "first", "drawn", F.explode(each).alias("nth"))
    return nth.select(*ROW, F.when(F.col("nth") < F.col("drawn"), F.col("first") + F.col("nth")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, interval: int = INTERVAL) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if undrawn) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = materialize(scored(docs, gain, longest, seed), "scored")
    eligible = rows.where(F.col("n_words") >= least_words)
    count, lowest = eligible.agg(F.count(F.lit(1)), F.min("score")).first()
    draws = percent * count // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not draws:
        return rows.select(*ROW, undrawn)
    tail = min(1.0, 1.1 * draws / count + 0.001)
    while True:  # quantiles are near ones; the tail is widened until it holds the draw
        steps = math.ceil(tail * count / interval)
        found = eligible.agg(F.percentile_approx("score", [1 - tail * (i + 1) / steps for i in range(steps)], F.lit(max(10_000, 20 * steps)))).first()[0]
        bounds = sorted({*found, lowest} if tail >= 1 else set(found), reverse=True)
        top = in_intervals(eligible, bounds).groupBy("interval", *ROW).agg(F.count(F.lit(1)).alias("n"))
        top = materialize(top, "top")
        held = dict(top.groupBy("interval").agg(F.sum("n")).collect())  # a row an interval
        if sum(held.values()) >= draws:
            break
        tail = min(1.0, 2 * tail)
    begins, total = {}, 0
    for i in sorted(held):
        begins[i], total = total, total + held[i]
    last = max(i for i in begins if begins[i] < draws)
    ranked = copies(merged(top.where(F.col("interval") <= last), begins, draws))
    below = rows.where((F.col("n_words") < least_words) | (F.col("score") < bounds[last]))
    return ranked.unionByName(below.select(*ROW, undrawn))
