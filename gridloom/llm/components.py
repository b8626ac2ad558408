"""Connected components of an undirected graph that is a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (x, y) reaches.

    In each round every node points to its smallest neighbour, or itself if that is
    larger; pointers are followed to their ends by doubling, and the edges are
    contracted to those ends. At least half of the nodes that still have edges go in
    a round. A node with many neighbours meets them in a pre-aggregated minimum, and
    each join adds one row's pointer to each edge.
    """
    now = written(edges.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).where("u < v").distinct(), "edges", edges.count())
    roots, nodes = None, 0
    while n := now.count():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")).select("node", F.least("node", "to").alias("to"))
        to = written(to, "pointers", 2 * n)
        nodes = nodes or to.count()
        while True:
            far = to.join(to.toDF("to", "next"), "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
            far = written(far, "pointers", 2 * n)
            to = far.drop("moved")
            if far.where("moved").isEmpty():
                break
        roots = to.toDF("node", "root") if roots is None else written(roots.join(to.toDF("root", "end"), "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots", nodes)
        ends = now.join(to.toDF("u", "a"), "u").join(to.toDF("v", "b"), "v")
        now = written(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "edges", n)
    return roots if roots is not None else now.toDF("node", "root")
