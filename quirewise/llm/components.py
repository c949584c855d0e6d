"""Connected components by alternating large and small stars, in joins on narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import join_unique, materialize


def stars(links: DataFrame) -> DataFrame:
    """member, root for every node of ``links`` (columns a, b: longs) that isn't its component's least node.

    Each round points a node's larger neighbours, then its smaller ones, to its least neighbour. Rounds are
    stored, so a lost executor costs a part of one round. They number about the logarithm of the
    longest path. Stops when a round changes nothing. Centres that over 1/1024 of the edges share are broadcast to them.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("member"), F.least("a", "b").alias("root")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("member", "root").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges
        mark = now
        both = edges.select(F.col("member").alias("u"), F.col("root").alias("v")).union(edges.select("root", "member"))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = join_unique(both, least, "u", "n", 2 * now[0])
        large = materialize(large.where("v > u").select(F.col("v").alias("member"), F.col("m").alias("root")).distinct(), "large-star")
        least = materialize(large.groupBy("member").agg(F.min("root").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_unique(large, least, "member", "n", now[0])
        small = small.where("root <> m").select(F.col("root").alias("member"), F.col("m").alias("root")).union(least.select("member", "m"))
        edges = materialize(small.distinct(), "small-star")
