"""SimHash near-duplicates with pigeonring filtering.

64-bit fingerprints of word shingles link at ``distance`` 3 or less. The 64 bits form a ring of four
segments of 16. By the pigeonring principle, a pair within 3 bits has a segment from which every chain of
l consecutive segments differs in at most l * 3/4 bits: 0, then 1, 2 and 3. So the first segment is
equal, one half of the second is, and one third of the third is: those 29 or 30 bits are the join
key, 24 keys a fingerprint. Within a key, chains are checked segment by segment before the full
distance.

Equal fingerprints are one class from the start. Within a key only a spanning forest is sought: a
fingerprint is compared with those not yet reached, so a dense group of near copies costs a few passes
over its distinct fingerprints and no pairs. Forest edges are joined into components.

Fingerprints that over 1/1024 of all rows share are few: what is found of them is broadcast to their rows, so no join has a
hot key.

Texts without words have fingerprint zero and are linked like any other, null included. Null doc_ids take no part
in the least doc_id (a component of nulls only has none). Equal rows give equal rows; of rows that tie for the least doc_id
``keep_one`` keeps any one. An empty table gives an empty result. Other columns of ``docs`` may have any names: ``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import HOT, checked_broadcast, free_name, materialize, raw_texts, text_chunks
from quirewise.llm.components import stars

SHINGLE = 3
DISTANCE = 3
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bit ranges within a 16-bit segment: halves of the second, thirds of the third.
HALVES = ((0, 8), (8, 8))
THIRDS = ((0, 5), (5, 5), (10, 6))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 200):  # sums of bytes stay below 256
        ones += np.unpackbits(hashes[lo : lo + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long; one pass, no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            fp = np.array([fingerprint(t, shingle) for t in raw_texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id {id_type}, fp long")


def _bits(fp: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def ring_keys(fp: Column) -> Column:
    """The keys of all chain starts: start, half and third in the high bits, then the bits that must agree."""
    keys = []
    for start in range(4):
        for h, (h_at, h_n) in enumerate(HALVES):
            for t, (t_at, t_n) in enumerate(THIRDS):
                key = F.lit((start * 6 + h * 3 + t) << 32)
                key = key.bitwiseOR(F.shiftleft(_bits(fp, 16 * start, 16), 16))
                key = key.bitwiseOR(F.shiftleft(_bits(fp, 16 * ((start + 1) % 4) + h_at, h_n), 8))
                keys.append(key.bitwiseOR(_bits(fp, 16 * ((start + 2) % 4) + t_at, t_n)))
    return F.array(*keys)


def _chain_masks(start: int) -> list[np.uint64]:
    second = 0xFFFF << 16 * ((start + 1) % 4)
    return [np.uint64(second), np.uint64(second | 0xFFFF << 16 * ((start + 2) % 4)), np.uint64((1 << 64) - 1)]


def forest(members: np.ndarray, start: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (root, member) of a spanning forest of the links within one key. ``members``: distinct, unsigned."""
    masks, edges, rest = _chain_masks(start), [], members
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            differ = rest ^ queue.pop()
            near = np.bitwise_count(differ & masks[0]) <= 1
            near[near] = np.bitwise_count(differ[near] & masks[1]) <= 2
            near[near] = np.bitwise_count(differ[near]) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                edges += [(root, x) for x in found]
    return edges


def links(classes: DataFrame) -> DataFrame:
    """a, b: edges that connect all fingerprints within the distance. ``classes``: distinct values of fp."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []  # the last key's members may go on in the next batch

        def edges(key: int, members: np.ndarray) -> list:
            return forest(np.sort(members), (key >> 32) // 6)

        def batch_of(found: list) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(at[1:], len(key))
            found = []
            if held_key is not None and key[0] != held_key:
                found += edges(held_key, np.concatenate(held))
                held = []
            held_key = int(key[-1])
            for i in np.flatnonzero((ends - at > 1) | (at == 0) | (ends == len(key))):
                k, own = int(key[at[i]]), fp[at[i] : ends[i]]
                if at[i] == 0 and held:
                    held.append(own)
                    own = None
                if ends[i] == len(key):
                    if own is not None:
                        held = [own.copy()]
                elif own is None:
                    found += edges(k, np.concatenate(held))
                    held = []
                else:
                    found += edges(k, own)
            yield batch_of(found)
        if held:
            yield batch_of(edges(held_key, np.concatenate(held)))

    keyed = classes.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(rows, "a long, b long").distinct()


def components(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id and fp, stored) with root and component_id."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "classes")
    joined = stars(links(classes.select("fp")))
    rooted = classes.join(joined.select(F.col("member").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", "n")
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.select("fp", "root", "n").join(least, "root")
    hot = F.col("n") > F.lit((classes.agg(F.sum("n")).first()[0] or 0) * HOT)
    few = F.broadcast(found.where(hot).drop("n"))  # at most 1 / HOT rows
    rest = prints.join(F.broadcast(classes.where(hot).select("fp")), "fp", "left_anti")
    return prints.join(few, "fp").unionByName(rest.join(found.where(~hot).drop("n"), "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    found = components(materialize(fingerprints(docs, shingle), "prints"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``: the one with the least doc_id.

    Rows are stored once with their fingerprints. Those to drop are joined by an anti join on doc_id and
    fingerprint; what is left twice (repeated ids) is then told apart by group.
    """
    tag, drop_id, drop_fp, twice_fp, root = (free_name(docs, x) for x in ("simhash_row", "drop_id", "drop_fp", "twice_fp", "simhash_root"))
    id_type = docs.schema["doc_id"].dataType
    inside = [f.name for f in docs.schema.fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            fp = np.array([fingerprint(t, shingle) for t in raw_texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*inside, tag])

    schema = docs.withColumn(tag, F.lit(0).cast("long")).schema
    stored = materialize(docs.mapInArrow(rows, schema), "simhash")
    prints = stored.select(F.col("doc_id").cast(id_type), F.col(tag).alias("fp"))
    groups = materialize(components(prints), "groups")
    chosen = F.col("doc_id").eqNullSafe(F.col("component_id"))
    drop = materialize(groups.where(~chosen).select(F.col("doc_id").alias(drop_id), F.col("fp").alias(drop_fp)).distinct(), "drop")
    kept = stored.join(checked_broadcast(drop), stored["doc_id"].eqNullSafe(F.col(drop_id)) & (stored[tag] == F.col(drop_fp)), "left_anti")
    twice = groups.where(chosen).groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = materialize(groups.where(chosen).join(twice, "root", "left_semi").select(F.col("fp").alias(twice_fp), F.col("root").alias(root)).distinct(), "twice")
    if twice.isEmpty():
        return kept.drop(tag)
    marked = kept.join(checked_broadcast(twice), kept[tag] == F.col(twice_fp), "left")
    once = marked.where(F.col(root).isNull()).select(*inside)
    return once.union(marked.where(F.col(root).isNotNull()).dropDuplicates([root]).select(*inside))
