"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): the smallest id that it reaches.

    A round lets each node point to its smallest neighbour if that is smaller, shortens the pointers to their ends by
    doubling, and contracts the edges to the ends. What is left is at most half as many nodes a round; nothing is
    gathered at the driver, and each step is a table in the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")), "hooks")
        while True:
            on = to.select(F.col("id").alias("mid"), F.col("to").alias("end")).where("mid <> end")
            if on.join(to.where("id <> to").select("to"), F.col("mid") == F.col("to"), "left_semi").isEmpty():
                break
            to = cut(to.join(on, F.col("to") == F.col("mid"), "left").select("id", F.coalesce("end", "to").alias("to")), "hooks")
        if found is None:
            found = to.select("id", F.col("to").alias("component"))
        else:
            moved = found.join(to.withColumnRenamed("id", "r"), F.col("component") == F.col("r"), "left")
            found = cut(moved.select("id", F.coalesce("to", "component").alias("component")), "components")
        for end in ("a", "b"):
            edges = edges.join(to, edges[end] == to["id"]).drop(end, "id").withColumnRenamed("to", end)
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if found is None else found
