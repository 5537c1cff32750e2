"""Connected components by alternating large-star and small-star steps over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricelane.llm.work import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: every node links its larger neighbours to the smallest of itself and its neighbours.
    Otherwise it links itself and its smaller neighbours to the smallest of them."""
    sides = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    if large:
        sides = sides.unionAll(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
    smallest = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = sides.join(smallest, "u")
    if large:
        linked = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("high"), F.col("m").alias("low"))
    else:
        linked = met.select(F.col("v").alias("high"), F.col("m").alias("low")) \
            .unionAll(smallest.select(F.col("u").alias("high"), F.col("m").alias("low")))
    return linked.filter(F.col("high") > F.col("low")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root for every node of `edges` (low, high with low < high) but the roots, the smallest ids."""
    seen = None
    while True:
        edges = written(_stars(edges, large=True), "large")
        edges = written(_stars(edges, large=False), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("high").alias("id"), F.col("low").alias("root"))
        seen = tuple(state)
