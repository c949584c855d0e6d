"""Mixing sources to target weights by the cube method.

A source's target over its size gives every document of the source the same expected number of copies:
a whole part, and an inclusion probability for one more. The probabilities are moved through the null space of
two constraints per source, the number of documents and the number of words, until they are 0 or 1.
This flight runs in blocks of a source's documents. The largest open document is always settled next, against all smaller ones:
they share its move so that both totals stay (or the words alone, where the document is too large for both), so what is large is settled while
many small ones can make up for it. A block leaves its smallest documents open, and those too large for it;
they fly on with other blocks' rests, level by level, until each source has one block. Its last few documents are the landing: of all ways to settle
them, those that miss the words by at most half of the smallest one (or least, if none comes so near) are drawn from by their probabilities.

Moves are drawn from generators seeded by source, block and level, and documents are flown in an order fixed by
their values, largest first, so reruns agree.

Null text has size 0. A null source is a source of its own, last in order. Repeated rows are units of their own,
numbered so that they spread over blocks. Sources that tie in order of cap by weight are taken by name, documents of one size by id.
An empty table gives an empty result; sources of size 0 get target 0. Other columns of ``docs`` may have any names: ``mix`` keeps them.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewise.llm.common import checked_broadcast, free_name, materialize, numbered

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Documents in a block, blocks whose rests fly on together, documents that a block leaves open and that are landed.
BLOCK, FAN_IN, REST, LANDING = 1024, 100, 8, 10
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, weight, target. ``units`` has source and size.

    A source that would pass ``most`` times its size stops there and the rest is shared again: in order of cap
    by weight, sources are capped as long as the common level lies above their cap. The windows run over
    one row a source.
    """
    sources = materialize(units.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "sources")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    total = share * F.sum("source_size").over(everything)
    stepped = ranked.select("*", total.alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"), F.sum("weight").over(after).alias("open_weight"))
    stepped = stepped.withColumn("is_capped", F.col("cap") / F.col("weight") * F.col("open_weight") + F.col("capped") <= F.col("total"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("is_capped"), F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("is_capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("is_capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return stepped.select("source", "n_docs", "source_size", "weight", target.cast("double").alias("target"))


def direction(size: np.ndarray) -> np.ndarray | None:
    """Moves of all documents for one of the first: documents and words stay if no other moves further, else the words do. None if the
    others haven't the words. ``size``: falling."""
    rest = size[1:]
    away = rest - rest.mean()
    spread = float(away @ away)
    if spread > 0 or size[0] == rest.mean():
        slope = (size[0] - rest.mean()) / spread if spread else 0.0
        both = -1 / len(rest) - slope * away
        if np.abs(both).max() <= 1:
            return np.concatenate([[1.0], both])
    words = float(rest.sum())
    if words <= 0:
        return np.concatenate([[1.0], np.full(len(rest), -1 / len(rest))]) if not size[0] else None
    return np.concatenate([[1.0], np.full(len(rest), -size[0] / words)])


def fly(pi: np.ndarray, size: np.ndarray, rng: random.Random, land: bool) -> None:
    """Settle all but some of ``pi`` (changed in place; sizes falling), all of them if ``land``. Expectations are kept up to the landing."""
    open_at = np.flatnonzero((pi > 0) & (pi < 1))
    aside: list[int] = []
    while len(open_at) > (LANDING if land else REST):
        u = direction(size[open_at])
        if u is None or (not land and size[open_at[0]] > 0.25 * size[open_at[1:]].sum()):
            aside.append(int(open_at[0]))  # the next level has more to make up for it
            open_at = open_at[1:]
            continue
        p = pi[open_at]
        moved = u != 0
        v, p = u[moved], p[moved]
        up = float(np.where(v > 0, (1 - p) / np.abs(v), p / np.abs(v)).min())
        down = float(np.where(v > 0, p / np.abs(v), (1 - p) / np.abs(v)).min())
        p = p + (up if rng.random() * (up + down) < down else -down) * v
        pi[open_at[moved]] = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
        open_at = open_at[(pi[open_at] > 0) & (pi[open_at] < 1)]
    if land:
        landed = np.sort(np.concatenate([np.array(aside, np.int64), open_at]))
        wish = float(pi[landed] @ size[landed])
        many, few = landed[:-LANDING], landed[-LANDING:]
        pi[many] = np.round(pi[many])
        wish -= float(pi[many] @ size[many])
        if len(few):
            ways = (np.arange(1 << len(few))[:, None] >> np.arange(len(few)) & 1).astype(np.float64)
            misses = np.abs(ways @ size[few] - wish)
            near = np.flatnonzero(misses <= max(misses.min(), 0.5 * size[few].min()) + _EPS)
            p = np.clip(pi[few], _EPS, 1 - _EPS)
            likely = np.exp(ways[near] @ np.log(p) + (1 - ways[near]) @ np.log(1 - p))
            at = np.searchsorted(np.cumsum(likely), rng.random() * likely.sum(), side="right")
            pi[few] = ways[near[min(at, len(near) - 1)]]


def cube_mix(units: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``units`` (source, size, and ids of any name) with source_size, target and copies (0 to ``most``)."""
    ids = [c for c in units.columns if c not in ("source", "size")]
    units = materialize(units, "units")
    targets = materialize(source_targets(units, weights, share, most), "targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    of = checked_broadcast(targets.select(F.col("source").alias("of"), "n_docs", "source_size", "target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = units.join(of, units["source"].eqNullSafe(of["of"])).withColumn("pi", rate)
    state = state.withColumn("whole", F.floor("pi").cast("int")).withColumn("pi", F.col("pi") - F.col("whole"))
    blocks = F.ceil(F.col("n_docs") / BLOCK).cast("long")
    state = state.select(*ids, "source", "size", "source_size", "target", "whole", "pi", F.pmod(F.xxhash64(*ids, "size"), blocks).alias("block"))
    schema = state.schema
    key = [schema.names.index(c) for c in ids]
    settled, level, now = [], 0, math.ceil(largest / BLOCK)

    def one_level(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            size, pi = table["size"].to_numpy(), table["pi"].to_numpy().copy()
            tie = [str(row) for row in zip(*(table.column(k).to_pylist() for k in key), strict=True)] if key else [""] * len(pi)
            order = np.array(sorted(range(len(pi)), key=lambda i: (-size[i], tie[i])))
            p = pi[order]
            fly(p, size[order].astype(np.float64), random.Random(f"{seed}|{level}|{table['source'][0].as_py()}|{table['block'][0].as_py()}"), last)
            pi[order] = p
            return table.set_column(table.column_names.index("pi"), "pi", pa.array(pi))

        return run

    while True:
        last = now <= 1
        flown = state.where("pi > 0 AND pi < 1").groupBy("source", "block").applyInArrow(one_level(level, last), schema)
        if level == 0:
            settled.append(state.where("pi <= 0 OR pi >= 1"))
        flown = materialize(flown, f"flight{level}")
        settled.append(flown.where("pi <= 0 OR pi >= 1"))
        if last:
            break
        now, level = math.ceil(now / FAN_IN), level + 1
        state = flown.where("pi > 0 AND pi < 1").withColumn("block", F.pmod("block", F.lit(now)).cast(T.LongType()))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*ids, "source", "size", "source_size", "target", (F.col("whole") + F.col("pi").cast("int")).alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies of every row."""
    units = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    mixed = cube_mix(numbered(units, "nth"), **options)  # equal rows must not all fall into one block
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Equal rows are one unit and fare alike."""
    same = ["doc_id", "source", "digest"]
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.md5(F.col("text").cast("string").cast("binary")).alias("digest"), word_count(F.col("text")).alias("size"))
    units = narrow.groupBy(*same).agg(F.sum("size").alias("size"))
    taken = materialize(cube_mix(units, **options).where("copies > 0").select(F.struct(*same).alias("unit"), "copies"), "copies")
    tag, of, copies = (free_name(docs, x) for x in ("mix_unit", "mix_unit_of", "mix_copies"))
    unit = F.struct(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(F.col("text").cast("string").cast("binary")).alias("digest"))
    tagged = docs.withColumn(tag, unit)
    taken = taken.select(F.col("unit").alias(of), F.col("copies").alias(copies))
    joined = tagged.join(taken, F.col(tag).eqNullSafe(F.col(of)))
    return joined.withColumn(tag, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
