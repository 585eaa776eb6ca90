"""Connected components by random-priority contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.skew import skew_join
from lotwise.session import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of ``edges`` (pairs of bigint; nulls and loops are ignored): nodes have the
    same root exactly when a path joins them. The root is one of the component's nodes.

    Each round lets every node point at the node of least priority in its closed neighbourhood (priorities are a
    hash that changes from round to round, so that no order of ids makes long chains), then replaces the nodes by
    what they point at. Nodes without an edge left are done. Rounds grow with the logarithm of the longest path.
    Aggregates combine before the shuffle and joins split hot nodes; each round's tables are written out.
    """
    both = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).filter("u <> v")
    pairs = written(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    label = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    turn = 0
    while not pairs.isEmpty():
        turn += 1
        ends = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("id"))
        least = ends.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        to = written(least.select("u", F.least(rank(F.col("u")), F.col("m"))["id"].alias("p")), "parents")
        moved = skew_join(pairs, to, ["u"]).select(F.col("p").alias("a"), "v")
        moved = skew_join(written(moved, "half"), to.select(F.col("u").alias("v"), F.col("p").alias("b")), ["v"]).filter("a <> b")
        pairs = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        label = skew_join(label, to.select(F.col("u").alias("root"), "p"), ["root"], "left")
        label = written(label.select("node", F.coalesce("p", "root").alias("root")), "labels")
    return label
