"""Connected components and reach in graphs given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def components(edges: DataFrame, node: str = "node", lower: str = "lower") -> DataFrame:
    """(node, lowest) of every node with an edge to a lower one, lowest being the lowest node that it reaches.

    Every round hooks the lower ends of a node to its lowest one, and lets each node look past its parent, until there is
    one parent each and it is the lowest. Rounds are written to the shared folder; nothing goes to the driver.
    """
    edges = materialize(edges.select(F.col(node).alias("x"), F.col(lower).alias("r")).filter("x <> r").distinct(), "edges")
    while True:
        parent = materialize(edges.groupBy("x").agg(F.min("r").alias("p"), F.count(F.lit(1)).alias("n")), "parents")
        step = parent.select(F.col("x").alias("px"), F.col("p").alias("pp"))
        if parent.filter("n > 1").isEmpty() and parent.join(step, F.col("p") == F.col("px"), "left_semi").isEmpty():
            discard(edges)
            return parent.select(F.col("x").alias(node), F.col("p").alias("lowest"))
        hooked = edges.join(step, F.col("x") == F.col("px")).filter("r <> pp").select(F.greatest("r", "pp").alias("x"), F.least("r", "pp").alias("r"))
        past = parent.join(step, F.col("p") == F.col("px"), "left").select("x", F.coalesce("pp", "p").alias("r"))
        new = materialize(hooked.unionByName(past).distinct(), "edges")
        discard(edges)
        discard(parent)
        edges = new


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Edges (node, lower) of pairs in any order."""
    return pairs.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("lower"))


def component_of(nodes: DataFrame, pairs: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Every node with its component, named by its lowest member; alone, its own."""
    labels = components(undirected(pairs, a, b)).withColumnRenamed("node", "__node")
    return nodes.join(labels, F.col(node) == F.col("__node"), "left").select(*nodes.columns, F.coalesce("lowest", node).alias("component"))


def neighbours(pairs: DataFrame, seeds: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Nodes one step from a seed that aren't seeds: column ``key``."""
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v")))
    s = seeds.select(F.col(key).alias("__s")).distinct()
    reached = both.join(s, F.col("u") == F.col("__s"), "left_semi").select(F.col("v").alias(key)).distinct()
    return reached.join(s, F.col(key) == F.col("__s"), "left_anti")


def inner_edges(pairs: DataFrame, members: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Pairs with how many of their ends are members: column ``ends``."""
    m = members.select(F.col(key).alias("__m")).distinct()
    side = lambda df, c, out: df.join(m.withColumnRenamed("__m", f"__{out}"), F.col(c) == F.col(f"__{out}"), "left").withColumn(out, F.col(f"__{out}").isNotNull().cast("int")).drop(f"__{out}")
    return side(side(pairs, a, "in_a"), b, "in_b").withColumn("ends", F.col("in_a") + F.col("in_b")).drop("in_a", "in_b")
