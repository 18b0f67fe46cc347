"""Operators on edge tables: levels, circles, neighbourhoods, components, orphans, exports.

Traversals are frontier steps on edge tables, written to the shared folder in between; none collects the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators import local
from headwater.scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct()


def execution_levels(edges: DataFrame) -> DataFrame:
    """Level of each node: 0 without sources, else one above its highest source. Nodes on circles and behind them have level null.

    edges: src, dst (dst depends on src). Result: node, level, is_circular. A table of at most LOCAL_EDGES edges is worked off by one
    task. Of a larger one, each round takes off the nodes that nothing left leads to, and writes only what remains.
    """
    scratch = Scratch(edges.sparkSession, "levels")
    left = scratch.save(_clean(edges))
    nodes = scratch.save(_both(left))
    if left.count() <= local.LOCAL_EDGES:
        done = scratch.save(local.in_one_task(left, local.levels, "node string, level int").select(F.col("node").cast(nodes.schema["node"].dataType).alias("node"), "level"))
    else:
        done, open_, level = scratch.append("done", nodes.select("node", F.lit(0).alias("level")).limit(0)), nodes, 0
        while True:
            ready = scratch.save(open_.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
            if ready.isEmpty():
                break
            done = scratch.append("done", ready.withColumn("level", F.lit(level)))
            rest = scratch.save(open_.join(ready, "node", "left_anti"))
            if level:
                scratch.drop(open_)
            left, open_, level = scratch.replace(left, left.join(ready.select(F.col("node").alias("src")), "src", "left_anti")), rest, level + 1
            scratch.drop(ready)
    return nodes.join(done, "node", "left").withColumn("is_circular", F.col("level").isNull())


def bfs_levels(edges: DataFrame, start: str, max_depth: int = 5) -> DataFrame:
    """Fewest links from one node to the others, up to a depth: node, depth."""
    scratch = Scratch(edges.sparkSession, "bfs")
    e = scratch.save(_clean(edges))
    seen = scratch.save(e.sparkSession.createDataFrame([(start, 0)], "node string, depth int"))
    for depth in range(1, max_depth + 1):
        step = seen.filter(F.col("depth") == depth - 1).join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = scratch.replace(seen, seen.unionByName(new))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """Connected component of each node, named by its least node: node, component. Labels jump over those already found, so the
    rounds are logarithmic in a component's width for most graphs."""
    scratch = Scratch(edges.sparkSession, "components")
    e = _clean(edges)
    e = scratch.save(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = scratch.save(_both(e).withColumn("component", F.col("node")))
    while True:
        near = e.join(label, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("c"))
        step = label.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("c", "component")).alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("c2"))
        nxt = scratch.save(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("c2", "new")).alias("component"), (F.least("new", F.coalesce("c2", "new")) != F.col("component")).alias("moved")))
        scratch.drop(label)
        label = nxt
        if label.filter("moved").isEmpty():
            return label.select("node", "component")


def adjacency(edges: DataFrame) -> DataFrame:
    """Per node, the number of nodes it leads to and of those that lead to it."""
    e = _clean(edges)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """Nodes nothing leads to."""
    return nodes.join(edges.select(F.col("dst").alias(key)).distinct(), key, "left_anti")


def focus(edges: DataFrame, node: str) -> DataFrame:
    """Edges that start or end at a node."""
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def connected_nodes(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """Nodes with any edge."""
    return nodes.join(_both(edges.select("src", "dst")).withColumnRenamed("node", key), key, "left_semi")
