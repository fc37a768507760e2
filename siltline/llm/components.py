"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import hot_keys, joined, scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, root) for every node that ``edges`` name; root is the smallest node it can reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): O(log^2 n) rounds, no row ever grows, and the
    minimum of a node's neighbours is aggregated before the shuffle, so that hubs stay cheap; a hub's edges meet its minimum
    where they are. Each round is written to the shared folder. Edges with a null end and loops are ignored; an empty table
    gives an empty one.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    with scratch(edges.sparkSession):
        now, state = written(ends.distinct(), name, keep=True), None
        while True:
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
            if state == tuple(seen):
                break
            state = tuple(seen)
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            with_low = joined(both, low.select("u", F.least("u", "m").alias("m")), "u", hot_keys(low, "u", 2 * state[0]))
            large = written(with_low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), name)
            low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = joined(large, low.select("u", "m"), "u", hot_keys(low, "u", state[0])).select(
                F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
            )
            now = written(small.select("e.u", "e.v").where("u > v").distinct(), name, keep=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
