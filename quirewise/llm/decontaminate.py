"""Benchmark decontamination by winnowing.

A fingerprint is the least k-gram hash of a sliding window of w k-grams, so any span of
w + k - 1 words that a document shares with an item shares a fingerprint: none is missed. Items
shorter than a window are fingerprinted whole (w = 1). Fingerprints of the benchmark go into a bitmap
of fixed size; a document's fingerprints that hit it are extended to all windows around
them, and those are joined with the benchmark's windows by digest. A false hit of the bitmap
costs a digest, never a result.

Null texts have no words and are clean. Rows are told apart by doc_id and text digest, so equal rows
give equal results. Items without an id count as hits but not as items; items that share an id are one. Of equal least
hashes in a window the last is taken, on both sides alike. An empty table gives an empty result, an empty benchmark no hits. Other
columns may have any names: ``drop_contaminated`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import checked_broadcast, free_name, is_small, materialize, raw_texts, text_chunks

WINDOW = 13
GRAM = 7
#: Bits of the bitmap (a power of two): 8 MB whatever the benchmark's size.
BITS = 26

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_EMPTY = hashlib.sha256(b"").hexdigest()


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return out ^ (out >> np.uint64(29))


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash in each w consecutive ones, each position once."""
    if w == 1 or len(grams) == 0:
        return np.arange(len(grams))
    if len(grams) <= w:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)
    return np.unique(len(grams) - 1 - (np.arange(len(view)) + view.argmin(axis=1)))


def classes(lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(window, k, w) for each window length: full windows are winnowed, shorter items kept whole."""
    return [(n, gram, n - gram + 1) if n == window else (n, n, 1) for n in sorted(set(lengths))]


def _slots(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint64(64 - BITS)


def _window_rows(n: int, words: list[bytes]) -> list[bytes]:
    return [hashlib.md5(b" ".join(words[s : s + n])).digest() for s in range(len(words) - n + 1)]


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, n, item: the digest of each window, its words, and the item (as a string) it is in."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            h, n, item = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                if words := words_of(text):
                    k = min(window, len(words))
                    own = list(dict.fromkeys(_window_rows(k, words)))
                    h += own
                    n += [k] * len(own)
                    item += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(n, pa.int32()), pa.array(item, pa.string())], ["h", "n", "item"])

    return bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "h binary, n int, item string")


def benchmark_bitmap(bench: DataFrame, kinds: list[tuple[int, int, int]], window: int = WINDOW) -> np.ndarray:
    """The fingerprints of all items as a bitmap; what reaches the driver is at most its 2**BITS bits."""
    by_length = {n: (k, w) for n, k, w in kinds}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            at = [np.empty(0, np.uint64)]
            for text in raw_texts(batch):
                if words := words_of(text):
                    k, w = by_length[min(window, len(words))]
                    grams = gram_hashes(word_hashes(words), k)
                    at.append(_slots(grams[winnow(grams, w)]))
            found = np.unique(np.concatenate(at))
            bits = (np.uint64(1) << (found & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(6)).astype(np.int32)), pa.array(bits)], ["at", "bits"])

    found = bench.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint64)


def _candidates(words: list[bytes], kinds: list[tuple[int, int, int]], bitmap: np.ndarray) -> list[dict]:
    """The windows around fingerprints that are in the bitmap: digest, words, start positions."""
    out, hashes = [], word_hashes(words)
    for n, k, w in kinds:
        if len(words) < n:
            continue
        grams = gram_hashes(hashes, k)
        at = winnow(grams, w)
        slots = _slots(grams[at])
        at = at[(bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1]
        if not len(at):
            continue
        starts = np.unique((at[:, None] - np.arange(n - k + 1)[None, :]).ravel())
        by_digest: dict[bytes, list[int]] = {}
        for s in starts[(starts >= 0) & (starts <= len(words) - n)].tolist():
            by_digest.setdefault(hashlib.md5(b" ".join(words[s : s + n])).digest(), []).append(s)
        out += [{"h": h, "n": n, "starts": s} for h, s in by_digest.items()]
    return out


_CANDIDATE = pa.list_(pa.struct([("h", pa.binary()), ("n", pa.int32()), ("starts", pa.list_(pa.int32()))]))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, per_hit: int = 20, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and text_md5, a row for each of ``docs``."""
    pairs = materialize(benchmark_windows(bench, window), "bench-windows")
    kinds = classes([r["n"] for r in pairs.select("n").distinct().collect()], window, gram)
    bitmap = docs.sparkSession.sparkContext.broadcast(benchmark_bitmap(bench, kinds, window))
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            digests, counts, found = [], [], []
            for text in raw_texts(batch):
                words = words_of(text)
                digests.append(hashlib.md5(text).hexdigest())
                counts.append(len(words))
                found.append(_candidates(words, kinds, bitmap.value) if kinds else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(counts, pa.int64()), pa.array(found, _CANDIDATE)], ["doc_id", "text_md5", "n_words", "found"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(narrow.mapInArrow(rows, f"doc_id {id_type}, text_md5 string, n_words long, found array<struct<h:binary,n:int,starts:array<int>>>"), "fingerprints")

    small = is_small(pairs)
    windows = pairs.groupBy("h", "n").agg(F.collect_set("item").alias("items"))
    found = base.where(F.size("found") > 0).select("doc_id", "text_md5", F.inline("found")).distinct()
    hits = found.join(F.broadcast(windows) if small else windows, ["h", "n"])
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("lo"), (s + F.col("n")).alias("hi")))))))
    hits = hits.groupBy("doc_id", "text_md5").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hi"))
    covered = F.aggregate(
        "spans", zero, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(acc["hi"], x["lo"]))).alias("n"), F.greatest(acc["hi"], x["hi"]).alias("hi")), lambda acc: acc["n"].cast("long")
    )
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_md5").alias("hit_md5"), covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_md5") == F.col("hit_md5")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(_EMPTY)).alias("items_sha256"), ((n_hit > 0) & (per_hit * n_hit >= F.col("n_words"))).alias("contaminated"), "text_md5"
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    bad_id, bad_md5 = free_name(docs, "bad_id"), free_name(docs, "bad_md5")
    bad = contamination(docs, bench, **options).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_md5").alias(bad_md5))
    bad = materialize(bad.distinct(), "contaminated")
    return docs.join(checked_broadcast(bad), docs["doc_id"].eqNullSafe(F.col(bad_id)) & (F.md5(docs["text"].cast("string").cast("binary")) == F.col(bad_md5)), "left_anti")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS h
  FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS s
        FROM b WHERE len(words) > 0)),
dw AS (
  SELECT r, k.n, s, array_to_string(words[s:s + k.n - 1], ' ') AS h
  FROM (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS s
        FROM w, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n) k),
hit AS (SELECT dw.r, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.h = bw.h AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""
