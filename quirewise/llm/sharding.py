"""Sharding by balanced label propagation.

Documents with equal texts are linked through their text's hash: a hub. Linked documents begin in a shard
given by a hash. In each round a hub ranks the shards by the bytes its documents have there and asks for the
first ones with room, as many as its bytes need; documents elsewhere move to one of these, admitted
by hash up to the shard's quota of free bytes. Rounds are joins and sums per (hub, shard), one stored table each.

Hubs larger than half a shard or with over 1/1024 of all rows are heavy: bounded in number, they go first and their
few wishes are broadcast to their documents. A light hub fits in one shard, so its wish is one ``max_by``, and a
round shuffles its documents by hub once; no key of that shuffle is hot.

Law ``bytes``: shards overfull with linked documents give some up; these and the unlinked documents
level all shards: the few larger than 1/256 of a shard go to the least loaded one by one, the others fill the
remaining room in the order of a running sum. Sizes then differ by at most about the size of a small document.

Null text has no bytes and is linked with empty texts. Equal rows are numbered, so they're placed one by one and may
part. Ties between shards are settled by hash. Slots count from 0 in every shard. An empty table gives an empty
result. Other columns of ``docs`` aren't read, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.llm.common import HOT, checked_broadcast, materialize, numbered

SHARDS, OVERHEAD, ROUNDS = 24, 8, 3
#: Rows that one sorted run of a prefix sum holds about, and documents above 1/GIANT of a shard are placed singly.
RUN_ROWS, GIANT = 20_000, 256
#: Up to so many runs, they may be shorter, so that all cores share them.
MANY_RUNS, FEW_ROWS = 400, 500


#: What tells rows apart.
ROW = ("doc_id", "hub", "nth")


def _unit(*of: Column | str) -> Column:
    """A hash in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def level(loads: list[float], pool: float) -> float:
    """The height to which ``pool`` fills the lowest of ``loads``."""
    loads, taken = sorted(loads), 0.0
    for i, x in enumerate(loads):
        taken += x
        height = (pool + taken) / (i + 1)
        if i + 1 == len(loads) or height <= loads[i + 1]:
            return height
    return 0.0


def _by_intervals(value: Column, widths: list[float]) -> Column:
    """The index of the interval, of those with ``widths`` side by side, in which ``value`` lies."""
    ends = F.array(*(F.lit(x) for x in itertools.accumulate(widths)))
    return F.least(F.size(F.filter(ends, lambda e: e <= value)), F.lit(len(widths) - 1)).cast("int")


def loads_of(df: DataFrame, shards: int) -> list[float]:
    found = {r["shard"]: float(r["b"]) for r in df.groupBy("shard").agg(F.sum("size").alias("b")).collect()}  # a row a shard
    return [found.get(s, 0.0) for s in range(shards)]


def propagate(linked: DataFrame, cap: float, held: list[float], rounds: int, heavy: bool) -> DataFrame:
    """``linked`` (doc_id, nth, size, hub, ...) with shard: hubs' documents drawn together under the quotas.

    ``held``: bytes that each shard has of other documents, which stay. ``heavy``: hubs are few and may fill
    several shards; else every hub fits in one, and none has a large share of the rows.
    """
    shards, names = len(held), [*linked.columns, "shard"]
    open_room = [max(0.0, cap - x) for x in held]
    open_room = open_room if sum(open_room) else [1.0] * shards
    state = linked.withColumn("shard", _by_intervals(_unit(*ROW, F.lit("start")) * sum(open_room), open_room))
    for k in range(rounds):
        loads = [a + b for a, b in zip(held, loads_of(state, shards), strict=True)]
        roomy = (F.element_at(F.array(*[F.lit(max(0.0, cap - x)) for x in loads]), F.col("shard") + 1) >= cap / 100).cast("int")
        dealt = state if heavy else state.repartition("hub")
        cells = dealt.groupBy("hub", "shard").agg(F.sum("size").alias("bytes"))
        if heavy:
            hub = Window.partitionBy("hub")
            first = F.greatest(roomy, (F.col("bytes") >= cap / 2).cast("int"))
            ranked = cells.select("*", F.sum("bytes").over(hub).alias("all"), F.row_number().over(hub.orderBy(F.desc(first), F.desc("bytes"), F.xxhash64("hub", "shard"))).alias("rank"))
            wanted = ranked.where(F.col("rank") <= F.ceil(F.col("all") / cap)).groupBy("hub").agg(F.array_sort(F.collect_list("shard")).alias("wanted"))  # at most all shards
            asked = state.join(F.broadcast(wanted), "hub")
            pick = F.element_at("wanted", (F.pmod(F.xxhash64(*ROW, F.lit(k)), F.size("wanted")) + 1).cast("int"))
            to = F.when(F.array_contains("wanted", F.col("shard")), F.col("shard")).otherwise(pick)
        else:
            wanted = cells.groupBy("hub").agg(F.max_by("shard", F.struct(roomy, F.col("bytes"), F.xxhash64("hub", "shard"))).alias("wanted"))
            asked, to = dealt.join(wanted, "hub"), F.col("wanted")
        asked = materialize(asked.select(*names, to.alias("to")), "asked")
        moves = asked.where("to <> shard").groupBy("shard", "to").agg(F.sum("size").alias("b")).collect()  # a row a pair of shards
        if not moves:
            return asked.select(*names)
        demand, leaving = [0.0] * shards, [0.0] * shards
        for r in moves:
            demand[r["to"]] += r["b"]
            leaving[r["shard"]] += r["b"]
        quota = [min(1.0, max(0.0, cap - loads[s] + 0.5 * leaving[s]) / demand[s]) if demand[s] else 0.0 for s in range(shards)]
        admitted = _unit(*ROW, F.lit(k)) < F.element_at(F.array(*map(F.lit, quota)), F.col("to") + 1)
        state = asked.withColumn("shard", F.when(admitted, F.col("to")).otherwise(F.col("shard"))).select(*names)
    return state


def running(df: DataFrame, by: list[str], value: Column, name: str, rows: int) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, per ``by``, in an order given by a hash.

    Two levels: sums of runs dealt by the hash, and a window inside each run, so no group meets in one task.
    """
    runs = max(1, math.ceil(rows / RUN_ROWS), min(MANY_RUNS, rows // FEW_ROWS))
    df = df.withColumn("run", F.pmod(F.xxhash64(*ROW, F.lit("run")), F.lit(runs)).cast("int"))
    sums = df.groupBy(*by, "run").agg(F.sum(value).alias("own"))
    before = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select(*by, "run", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset")), "runs")
    inside = Window.partitionBy(*by, "run").orderBy("order_hash", *ROW).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("order_hash", F.xxhash64(*ROW, F.lit("order"))).withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(checked_broadcast(sums), [*by, "run"]).withColumn(name, F.col("offset") + F.col("inside")).drop("run", "order_hash", "inside", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hub"))
    nodes = materialize(numbered(rows, "nth"), "nodes")
    names = nodes.columns
    total, rows = nodes.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, cap = total or 0, max(1.0, (total or 0) / shards)
    hubs = materialize(nodes.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1"), "hubs")
    is_heavy = (F.col("bytes") > cap / 2) | (F.col("n") > rows * HOT)
    heavy, light = F.broadcast(hubs.where(is_heavy).select("hub")), checked_broadcast(hubs.where(~is_heavy).select("hub"))  # heavy: at most 2 * shards + 1 / HOT
    others = nodes.join(heavy, "hub", "left_anti")
    first = propagate(nodes.join(heavy, "hub", "left_semi").select(*names), cap, [0.0] * shards, rounds, True)
    second = propagate(others.join(light, "hub", "left_semi").select(*names), cap, loads_of(first, shards), rounds, False)
    linked = first.unionByName(second)

    stay = F.lit(True)
    loads = loads_of(linked, shards)
    share = [1.0 if x <= 1.001 * cap else 0.97 * cap / x for x in loads]
    if min(share) < 1.0:
        stay = _unit(*ROW, F.lit("stay")) < F.element_at(F.array(*map(F.lit, share)), F.col("shard") + 1)
        loads = loads_of(linked.where(stay), shards)
    placed = linked.where(stay)
    pool = materialize(others.join(light, "hub", "left_anti").select(*names).unionByName(linked.where(~stay).select(*names)), "pool")

    giant = F.col("size") > cap / GIANT
    # At most GIANT * shards rows, as together they are larger than that many shares of the total.
    giants = sorted(pool.where(giant).select(*ROW, "size").collect(), key=lambda r: (-r["size"], r["doc_id"] is None, *((r["doc_id"],) if r["doc_id"] is not None else ()), r["hub"], r["nth"]))
    homes = []
    for r in giants:
        s = min(range(shards), key=lambda s: (loads[s], s))
        loads[s] += r["size"]
        homes.append((r["doc_id"], r["hub"], r["nth"], s))
    if homes:
        schema = f"g_id {docs.schema['doc_id'].dataType.simpleString()}, g_hub long, g_nth long, shard int"
        own = pool.where(giant)
        match = own["doc_id"].eqNullSafe(F.col("g_id")) & (own["hub"] == F.col("g_hub")) & (own["nth"] == F.col("g_nth"))
        placed = placed.unionByName(own.join(F.broadcast(docs.sparkSession.createDataFrame(homes, schema)), match).select(*names, "shard"))

    small = pool.where(~giant)
    left = small.agg(F.sum("size")).first()[0] or 0
    height = level(loads, float(left))
    middle = F.col("before") + F.col("size") / 2
    filled = running(small, [], F.col("size"), "before", rows).withColumn("shard", _by_intervals(middle, [max(0.0, height - x) for x in loads]))
    placed = materialize(placed.unionByName(filled.select(*names, "shard")), "placed")

    out = running(placed, ["shard"], F.lit(1), "slot", math.ceil(rows / shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
