"""Connected components of requests, so that small ones can be walked one by one, all of them side by side.

Requests of different components never wait for each other. So a batch of any size whose components are small is
decided in one pass, however long its chains are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.sources.staging import cut


def components(rows: DataFrame) -> DataFrame:
    """Labels (node, label) of the nodes that share a `mark` with another one. rows: node long, mark; repeats allowed.

    By contraction: every node points to its smallest neighbour if that is smaller, the pointers are followed to their
    roots by doubling, and the edges between different roots go on. With hashes as nodes a path loses about two thirds
    of its nodes per round, and pointers are short.
    """
    least = rows.groupBy("mark").agg(F.min("node").alias("least"))
    edges = cut(rows.join(least, "mark").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    waves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _roots(both.groupBy("a").agg(F.min("b").alias("up")).filter("up < a").select(F.col("a").alias("node"), "up"))
        waves.append(roots)
        first, second = (roots.select(F.col("node").alias(c), F.col("up").alias(f"_{c}")) for c in "ab")
        moved = edges.join(first, "a", "left").join(second, "b", "left")
        ends = moved.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        edges = cut(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not waves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = waves.pop()
    while waves:  # what a root of an earlier wave became later
        later = labels.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        labels = labels.unionByName(waves.pop().join(later, "up", "left").select("node", F.coalesce("_up", "up").alias("up")))
    tops = labels.select(F.col("up").alias("node")).distinct().withColumn("up", F.col("node"))
    return cut(labels.unionByName(tops).withColumnRenamed("up", "label"))


def _roots(up: DataFrame) -> DataFrame:
    """Pointers (node, up) to smaller nodes, followed until `up` points nowhere."""
    up = cut(up)
    while True:
        onward = up.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        if up.join(onward, "up", "left_semi").isEmpty():
            return up
        up = cut(up.join(onward, "up", "left").select("node", F.coalesce("_next", "up").alias("up")))


def small_and_large(rows: DataFrame, node: str, labels: DataFrame, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of nodes without a component, those of components of at most `last` rows, with their label, and the others."""
    placed = cut(rows.join(labels.withColumnRenamed("node", node), node, "left"))
    large = placed.filter("label is not null").groupBy("label").count().filter(F.col("count") > last).select("label")
    inside = placed.filter("label is not null")
    return (
        placed.filter("label is null").drop("label"),
        inside.join(large, "label", "left_anti"),
        inside.join(large, "label", "left_semi").drop("label"),
    )
