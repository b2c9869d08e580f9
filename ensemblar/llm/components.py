"""Connected components of a table of links, by pointer jumping and label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import durable


def _jumped(labels: DataFrame) -> DataFrame:
    """labels (node, component, ...) with each component's own component, where it has one, as u_component."""
    up = labels.select(F.col("node").alias("u_node"), F.col("component").alias("u_component"))
    return labels.join(up, F.col("component") == F.col("u_node"), "left").drop("u_node")


def roots(links: DataFrame) -> DataFrame:
    """(node, component) for every b of links (a, b) with a < b and at most one a for each b.

    Such links are trees whose roots are their smallest nodes: pointers alone find them,
    in about log n steps for a path of length n.  Roots are not among the nodes.
    """
    labels = durable(links.select(F.col("b").alias("node"), F.col("a").alias("component")))
    while True:
        step = durable(_jumped(labels).select("node", F.coalesce("u_component", "component").alias("component"), F.col("u_component").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return labels
        labels = step.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each step takes the smallest label among the neighbours, then the label of that label.
    Labels only fall: when none does, all neighbours have the same.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        told = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("own"))
        told = told.union(labels.select("node", "component", F.col("component").alias("own")))
        step = durable(told.groupBy("node").agg(F.min("component").alias("component"), F.max("own").alias("own")))
        now = durable(_jumped(step).select("node", F.least("component", F.coalesce("u_component", "component")).alias("component"), "own"))
        labels = now.drop("own")
        if now.filter("component < own").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component; no node is a component) after further links (a_part, b_part) between components."""
    top = components(links.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))).filter("node <> component")
    t = top.select(F.col("node").alias("t_node"), F.col("component").alias("t_component"))
    moved = labels.join(t, F.col("component") == F.col("t_node"), "left").select("node", F.coalesce("t_component", "component").alias("component"))
    return durable(moved.union(top))
