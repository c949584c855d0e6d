"""Exact substring deduplication with Rabin-Karp hashes of every fixed-length word window.

Documents are dealt into chunks by a hash. Each chunk hashes all its windows with a rolling polynomial; all counting
is over sets of hashes, so copies within a chunk are merged before any shuffle and a passage in a third of all
documents costs one entry a chunk.

First, each chunk sends its distinct hashes, cut to 48 bits, to hash ranges, and is told which of them another chunk
has too. Then it sends, for these and for those that two of its own documents share, the full 128-bit hash with the
least doc_id that holds it, and is told which start in an earlier document elsewhere. A last pass over the chunks marks
those windows and the ones repeated within the chunk, and merges overlapping ones into maximal removal
intervals. So a window is judged by 128 bits, and only repeated ones travel at full width.

Entries travel as sorted byte planes, a row for each chunk and range; answers are bits in the order of the entries. A
chunk addresses at most 2 ** ``STEP`` ranges: where more are needed, the entries of many chunks meet in nodes, which merge
them, ask narrower ranges in turn and pass the answers on. So rows hold hundreds of entries however large the input.

Null text has no words. A null doc_id is neither before nor after another: such rows keep everything and
remove nothing; with texts too short for a window they are finished in place, undealt. doc_ids of integral types are compared as
numbers, others in Spark's order. Rows with equal doc_id don't remove each other. Texts of any length are handled whole. An empty table gives an
empty result. Other columns of ``docs`` aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import materialize, raw_texts

WINDOW = 13
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text in a chunk, about the windows in a hash range, and the bits by which one level of ranges divides.
CHUNK_TEXT, RANGE_WINDOWS, STEP = 8 << 20, 4 << 20, 11
_FIRST_BITS = np.uint64(0xFFFFFFFFFFFF0000)

_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
_SENT = "range long, chunk long, hi binary, lo binary, least binary"
_TOLD = "chunk long, range long, bits binary"
_SENT_SCHEMA = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("least", pa.binary())])
_TOLD_SCHEMA = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("bits", pa.binary())])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray, k: int, base: int = _BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes mod 2**64 of each k consecutive values, from one running sum."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(pow(base, -1, 1 << 64), len(hashes)), dtype=np.uint64)])
    out = (sums[k:] - sums[:-k]) * _powers(base, n)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


class Chunk:
    """Words of some texts, and hash, rank and start of all their windows."""

    def __init__(self, table: pa.Table, k: int):
        self.words = [t.split() for t in raw_texts(table)]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(counts)])
        digests = b"".join(map(xxhash.xxh3_128_digest, itertools.chain.from_iterable(self.words)))
        halves = np.frombuffer(digests, ">u8").reshape(-1, 2)
        own = np.repeat(np.arange(len(counts)), counts)
        hi = rolling(halves[:, 0].astype(np.uint64), k, _BASES[0])
        self.start = np.flatnonzero(own[: len(hi)] == own[k - 1 : k - 1 + len(hi)]) if len(hi) else np.empty(0, np.int64)
        self.hi, self.lo = hi[self.start], rolling(halves[:, 1].astype(np.uint64), k, _BASES[1])[self.start]
        self.rank = table["rank"].to_numpy()[own[self.start]] if len(hi) else np.empty(0, np.int64)


class Entries:
    """Distinct hashes in order, each with the least rank that holds it. With ``lo`` None only ``hi`` tells them apart, and ranks don't matter."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray | None = None, rank: np.ndarray | None = None):
        self.order = np.argsort(hi)
        new = np.ones(len(hi), bool)
        new[1:] = np.diff(hi[self.order]) != 0
        if lo is not None and (np.diff(lo[self.order]) != 0)[~new[1:]].any():  # equal first halves, unequal second ones
            self.order = np.lexsort((lo, hi))
            new[1:] = (np.diff(hi[self.order]) != 0) | (np.diff(lo[self.order]) != 0)
        hi, lo = hi[self.order], None if lo is None else lo[self.order]
        self.first = np.flatnonzero(new)
        self.hi, self.lo = hi[self.first], None if lo is None else lo[self.first]
        self.times = np.diff(np.append(self.first, len(hi)))
        self.least = None if rank is None else np.minimum.reduceat(rank[self.order], self.first) if len(hi) else rank

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The value of each distinct hash for all that were given, in the order given."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, self.times)
        return out

    def ranges(self, width: int) -> list[tuple[int, int, int]]:
        """(range, from, to) for the ranges, by the first ``width`` bits, that have entries."""
        if not len(self.hi):
            return []
        prefix = self.hi >> np.uint64(64 - width) if width else np.zeros(len(self.hi), np.uint64)
        at = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        return list(zip(prefix[at].tolist(), at.tolist(), np.append(at[1:], len(prefix)).tolist(), strict=True))

    def sent(self, chunk: int, width: int) -> pa.Table:
        rows = {"range": [], "chunk": [], "hi": [], "lo": [], "least": []}
        for r, a, b in self.ranges(width):
            rows["range"].append(r)
            rows["chunk"].append(chunk)
            rows["hi"].append(_planes(np.diff(self.hi[a:b], prepend=np.uint64(0))))
            rows["lo"].append(None if self.lo is None else self.lo[a:b].tobytes())
            rows["least"].append(None if self.least is None else _planes(self.least[a:b].view(np.uint64)))
        return pa.table(rows, _SENT_SCHEMA)

    def answers(self, told: pa.Table, width: int) -> np.ndarray:
        """The bits told of each distinct hash; a range that tells nothing says no."""
        out, bits = np.zeros(len(self.hi), bool), dict(zip(told["range"].to_pylist(), told["bits"].to_pylist(), strict=True))
        for r, a, b in self.ranges(width):
            if r in bits:
                out[a:b] = np.unpackbits(np.frombuffer(bits[r], np.uint8), count=b - a).view(bool)
        return out


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that the shuffle's compression removes the high ones."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _received(table: pa.Table) -> tuple[Entries, np.ndarray, np.ndarray | None]:
    """The entries of many senders together, how many each sent, and their own ranks."""
    his = [np.cumsum(_values(x), dtype=np.uint64) for x in table["hi"].to_pylist()]
    full = table["lo"].null_count == 0
    lo = np.concatenate([np.frombuffer(x, np.uint64) for x in table["lo"].to_pylist()]) if full else None
    rank = np.concatenate([_values(x).view(np.int64) for x in table["least"].to_pylist()]) if full else None
    return Entries(np.concatenate(his), lo, rank), np.array([len(x) for x in his]), rank


def _tell(table: pa.Table, merged: Entries, sizes: np.ndarray, rank: np.ndarray | None, elsewhere: np.ndarray) -> pa.Table:
    """Answers to all senders: whether another has the hash too, or with ranks, whether one holds it earlier."""
    said = merged.spread(elsewhere | (merged.times > 1) if rank is None else elsewhere)
    if rank is not None:
        said |= rank > merged.spread(merged.least)
    ends = np.cumsum(sizes)
    parts = [said[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    kept = [i for i, x in enumerate(parts) if x.any()]
    chunk, of = table["chunk"].to_pylist(), table["range"].to_pylist()
    return pa.table({"chunk": [chunk[i] for i in kept], "range": [of[i] for i in kept], "bits": [np.packbits(parts[i]).tobytes() for i in kept]}, _TOLD_SCHEMA)


def ask(sent: DataFrame, width: int, bits: int, windows: int) -> DataFrame:
    """chunk, range, bits: the answers to ``sent``, whose ranges are the first ``width`` bits of ``bits`` to divide by."""

    def answer(table: pa.Table) -> pa.Table:
        merged, sizes, rank = _received(table)
        return _tell(table, merged, sizes, rank, np.zeros(len(merged.hi), bool))

    if width >= bits:
        return sent.groupBy("range").applyInArrow(answer, _TOLD)
    deeper = min(bits, width + STEP)
    nodes = max(1, math.ceil(windows / RANGE_WINDOWS / (1 << width)))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _received(table)[0].sent(key[0].as_py() * nodes + key[1].as_py(), deeper)

    def pass_on(table: pa.Table, told: pa.Table) -> pa.Table:
        merged, sizes, rank = _received(table)
        return _tell(table, merged, sizes, rank, merged.answers(told, deeper))

    own = sent.withColumn("node", F.pmod(F.xxhash64("chunk"), F.lit(nodes)))
    told = ask(own.groupBy("range", "node").applyInArrow(merge, _SENT), deeper, bits, windows)
    told = told.select(F.expr(f"chunk div {nodes}").alias("to"), (F.col("chunk") % nodes).alias("node"), "range", "bits")
    asked = own.groupBy("range", "node").cogroup(told.groupBy("to", "node"))
    return asked.applyInArrow(lambda a, b: pass_on(a, b) if a.num_rows else _TOLD_SCHEMA.empty_table(), _TOLD)


def ranked(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with rank, a long in the order of doc_id."""
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.withColumn("rank", F.col("doc_id").cast("long"))
    ids = docs.select(F.col("doc_id").alias("of")).distinct().orderBy("of")
    ids = materialize(ids.select("of", F.monotonically_increasing_id().alias("rank")), "ranks")
    return docs.join(ids, docs["doc_id"] == ids["of"]).drop("of")


def remove_repeats(docs: DataFrame, window: int = WINDOW, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``text_out`` also kept_text and removed (intervals of words)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, windows = max(1, math.ceil(total / CHUNK_TEXT)), total / 6
    bits = max(0, math.ceil(math.log2(1 + windows / RANGE_WINDOWS)))
    width = min(bits, STEP)
    dealable = F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) >= 2 * window - 1)
    dealt = ranked(docs.where(dealable)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def hashes(chunk: Chunk) -> Entries:
        return Entries(chunk.hi & _FIRST_BITS)

    def elsewhere(chunk: Chunk, told: pa.Table) -> tuple[np.ndarray, Entries]:
        """Which windows another chunk may have too, and these with their full hashes."""
        found = hashes(chunk)
        at = np.flatnonzero(found.spread(found.answers(told, width)))
        return at, Entries(chunk.hi[at], chunk.lo[at], chunk.rank[at])

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return hashes(Chunk(table, window)).sent(key[0].as_py(), width)

    def second(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        return elsewhere(Chunk(table, window), told)[1].sent(key[0].as_py(), width)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        own = Entries(chunk.hi, chunk.lo, chunk.rank)
        earlier = chunk.rank > own.spread(own.least) if len(chunk.hi) else np.zeros(0, bool)
        at, sent = elsewhere(chunk, told.filter(pc.equal(told["asked"], 1)))
        earlier[at] |= sent.spread(sent.answers(told.filter(pc.equal(told["asked"], 2)), width))
        return pa.table(removal(table, chunk, earlier), pa.schema([("doc_id", table["doc_id"].type), *fields]))

    def removal(table: pa.Table, chunk: Chunk, earlier: np.ndarray) -> dict:
        edge = np.zeros(int(chunk.at[-1]) + 1, np.int64)
        np.add.at(edge, chunk.start[earlier], 1)
        np.add.at(edge, chunk.start[earlier] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = {"doc_id": table["doc_id"].combine_chunks(), "n_words": [len(w) for w in chunk.words], "n_removed": [], "kept_sha256": []}
        if text_out:
            rows |= {"kept_text": [], "removed": []}
        for i, w in enumerate(chunk.words):
            out = gone[chunk.at[i] : chunk.at[i + 1]]
            n = int(np.count_nonzero(out))
            kept = b" ".join(itertools.compress(w, (~out).tolist()) if n else w)
            rows["n_removed"].append(n)
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if text_out:
                turns = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                rows["kept_text"].append(kept.decode())
                rows["removed"].append([{"lo": a, "hi": b} for a, b in turns.reshape(-1, 2).tolist()])
        return rows

    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string"
    if text_out:
        fields += [("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
        schema += ", kept_text string, removed array<struct<lo:long,hi:long>>"
    told = ask(dealt.groupBy("chunk").applyInArrow(first, _SENT), width, bits, windows)
    sent = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(second, _SENT)
    both = told.withColumn("asked", F.lit(1)).union(ask(sent, width, bits, windows).withColumn("asked", F.lit(2)))
    long = dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, schema)

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    kept = docs.where(~dealable).select("doc_id", words.alias("words")).withColumn("kept", F.array_join("words", " "))
    short = [F.col("doc_id"), F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")]
    if text_out:
        short += [F.col("kept").alias("kept_text"), F.array().cast("array<struct<lo:long,hi:long>>").alias("removed")]
    return long.unionByName(kept.select(*short))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT r, doc_id, s, array_to_string(words[s:s + 12], ' ') AS h
  FROM (SELECT *, unnest(generate_series(1, len(words) - 12)) AS s FROM w WHERE len(words) >= 13 AND doc_id IS NOT NULL)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(generate_series(s, s + 12)) AS p FROM g JOIN m USING (h) WHERE doc_id > least),
each AS (SELECT r, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
