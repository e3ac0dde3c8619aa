"""Connected components by alternating large-star and small-star steps, each a group and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import forget, written


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, label), written, for each id of ``edges`` (a, b): the label is the smallest id of its component.

    ``edges`` is a written table, as it is read more than once; edges with a null end or equal ends count for nothing,
    repeated ones once. The minima are combined before the shuffle and written, so that the join that follows is of two
    plain inputs and a hub's edges can be split. The small-star step sorts the edges of an id to smaller ids; they are as
    many as the minima around it. The end is seen by the minima: every id has smaller neighbours or larger ones, never
    both, and of the smaller ones a single one.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    old = []
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, below, high = F.min("v").alias("low"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"), F.max("v").alias("high")
        unsettled = F.col("below").isNotNull() & ((F.col("low") != F.col("below")) | (F.col("high") > F.col("u")))
        least = written(both.groupBy("u").agg(low, below, high).select("u", F.least("u", "low").alias("m"), unsettled.alias("unsettled")), "minima")
        if least.where("unsettled").isEmpty():
            forget(*old)
            return least.select(F.col("u").alias("id"), F.col("m").alias("label"))
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every v that lies above u, and u's own edge to its minimum
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u"))).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = written(small.where("u != v").distinct(), "small-star")
        forget(least, *old)
        old = [pairs]
    raise RuntimeError(f"no end after {rounds} rounds")
