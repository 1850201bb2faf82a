"""Connected components of an edge table, by contraction of stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy, written


class _Forest:
    """Union-find with the smallest member as the root; for the few edges of one batch or cell."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


@tidy
def components(edges: DataFrame, a: str = "a", b: str = "b", *, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (longs): the smallest node reachable, itself included.

    Alternating large-star and small-star steps: each node hands its larger neighbours to its smallest one, then the same
    for its smaller neighbours, until each component is a star around its smallest node. Each step is a grouped minimum
    (folded before the shuffle) and an equi-join; every round is written to the shared folder. Loops and repeated edges
    are fine, edges with a null end are left out, an empty table gives an empty one.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    loops = ends.filter("a = b").select(F.col("a").alias("node")).distinct()
    star = written(ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        n, mark = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == before or n == 0:
            break
        before = (n, mark)
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        hung = large.join(least, F.col("u") == F.col("k"))
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("k", "m"))
        star = written(small.distinct(), "edges")
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = star.select(F.col("v").alias("node")).distinct()
    labels = star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    return labels.union(loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
