"""Connected components by contraction: no node, link or component leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stopwise.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns ``a``, ``b``); the root is one node of the component.

    Every round points each node to its smallest neighbour where that is smaller, follows the pointers
    twice, and replaces both ends of every link by what they point to. Links within one node vanish, so
    the graph shrinks by a factor each round and is gone after about the logarithm of its diameter. Joins
    are on staged tables, where a node that many others point to is split at run time; the minimum is
    combined before the shuffle.
    """
    both = links.select("a", "b").filter("a <> b")
    graph = staged(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    roots = None
    while not graph.isEmpty():
        step = graph.groupBy("a").agg(F.min("b").alias("low"))
        step = staged(step.select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "step")
        for _ in range(2):
            step = staged(_through(step, "root", step), "jump")
        roots = step if roots is None else staged(_through(roots, "root", step), "roots")
        moved = _through(_through(graph, "a", step), "b", step)
        graph = staged(moved.filter("a <> b").distinct(), "graph")
    return graph.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def _through(rows: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """Replace ``column`` by what it points to; what points nowhere stays."""
    to = step.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = rows.join(to, rows[column] == to["_node"], "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")
