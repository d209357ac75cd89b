"""Connected components of a graph given as edges."""

from pyspark.sql import DataFrame, functions as F

from docketry.llm.frames import written

#: Rounds after which a graph of any size that fits a cluster has settled.
MOST_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; ``root`` is the
    smallest node of its component.

    Each round links the neighbours of a node to the smallest one among them,
    first the larger neighbours, then the smaller ones, which halves the depth
    of what is left.  A node with many neighbours is reduced by partial
    aggregation and joined back, so no group is held in one task.  Every round
    is written to the shared folder.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(ordered.filter("a != b").distinct(), "components")
    before = None
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
