"""Connected components by alternating large and small stars.

Everything is a DataFrame of edges; nothing but two numbers per round comes to
the driver.  Rounds are staged, so that plans stay short and a lost executor
costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over edges (a > b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # staged, so that this is a plain join of two exchanges, which the adaptive planner splits at a node of many edges
    joined = both.join(staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least"), "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """a, b -> node, root: every node of an edge with the smallest node it reaches.

    Nodes are of one orderable type; loops and repeated edges do no harm.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
    kind = edges.schema["a"].dataType
    found = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast(kind).alias("a"), F.least("a", "b").cast(kind).alias("b")).distinct()
    found = staged(found, "edges")
    before = mark(found)
    for _ in range(most_rounds):
        found = staged(_stars(_stars(found, large=True), large=False), "edges")
        after = mark(found)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
