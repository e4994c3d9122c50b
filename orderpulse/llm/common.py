"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpulse.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/orderpulse/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(settled: DataFrame, rows: int) -> DataFrame:
    """A written frame marked for a broadcast if it holds at most `rows` rows; else the join is left to a shuffle."""
    return F.broadcast(settled) if settled.count() <= rows else settled


def free_name(columns: list[str], base: str) -> str:
    """A column name that clashes with none of the given ones, compared without case as Spark does."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph of the links (u, v): every node but the smallest of its group, and that smallest."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of one long type: rows (node, root), one for each node of a link.

    Every node joins its neighbour (or itself) of the least hashed id, links are rewritten to those, and so on until
    none joins two different nodes; expected rounds grow with the logarithm of the longest path. A node's row count
    shrinks with every round, and a hub is reduced by a minimum that is combined before the shuffle.
    """
    links = settle(edges.where("a <> b").select("a", "b").distinct(), "links")
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("a", "b")
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        low = both.groupBy("a").agg(F.min(order).alias("m")).select(F.col("a").alias("node"), F.least("m", own)["b"].alias("up"))
        step = settle(low, "step")
        steps.append(step)
        to_a = step.toDF("a", "x")
        to_b = step.toDF("b", "y")
        links = settle(links.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].toDF("node", "root")
    for step in steps[1:]:
        found = found.join(step.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return found
