"""Connected components of a distributed edge table by alternating stars.

Large-star links each vertex's larger neighbours to its smallest neighbour, small-star
its smaller ones; the edges shrink to one star a component. Edges stay in tables:
each round is written to the shared folder and only two sums reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    pairs = both.join(least, "u")
    if large:
        out = pairs.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(u, v) edges to (id, label): label is the smallest id reachable; ids without
    a smaller one to reach, the labels themselves, have no row."""
    table = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table, last = staged(table, "edges"), None
    for _ in range(max_rounds):
        found = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found == last or not found.n:
            return table.select(F.col("u").alias("id"), F.col("v").alias("label"))
        last = found
        table = staged(_star(_star(table, True), False), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
