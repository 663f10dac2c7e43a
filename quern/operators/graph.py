"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discard, materialise, salted_left_join


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all ends of edges (a, b): large and small stars in turn until
    nothing changes. Minima are partial sums; the way back to a hub's edges is salted. Each turn is written to the shared
    folder, so lineage stays short and lost executors cost one turn."""
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = digest(now)
    while state["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = salted_left_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_left_join(large, least, "u", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        old, now = now, materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        seen = digest(now)
        discard(old)
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
