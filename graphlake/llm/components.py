"""Connected components over an edge table of any size.

Every round, each node points to the smallest of itself and its neighbours,
pointers are followed twice, and the edges are drawn again between the nodes
pointed to.  The smallest node of a component always points to itself, so it is
what the component ends up as.  A hub's edges are combined to one minimum before
they are shuffled, and drawn again where they lie (``join_spread``); each round's
tables lie in the shared folder, so neither links nor components ever meet in one
task or in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import hot_keys, join_spread, materialize


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of an edge between two different nodes.

    Direction, loops and repeated edges do not matter; edges with a null end are
    ignored.  No edges give an empty table.
    """
    rest = materialize(_pairs(edges, src, dst), "edges")
    kind = rest.schema["a"].dataType
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(rest.select("b", "a"))
        least = ends.groupBy("node").agg(F.min("other").alias("other"), F.count("*").alias("n"))
        to = materialize(least.select("node", F.least("node", "other").alias("to"), "n"), "pointers")
        # No more nodes point to a node than it has edges, so hubs are all that many rows of either join can meet in.
        total = to.agg(F.sum("n")).first()[0]
        pair = lambda df, key, value: df.select(F.col("node").alias(key), F.col("to").alias(value))  # noqa: E731, B023
        up = pair(to, "to", "up"), pair(hot_keys(to, "n", total), "to", "up")
        to = materialize(join_spread(to, *up, ["to"]).select("node", F.col("up").alias("to"), "n"), "pointers")
        rounds.append(to.drop("n"))
        drawn = rest
        for end, new in (("a", "x"), ("b", "y")):
            drawn = join_spread(drawn, pair(to, end, new), pair(hot_keys(to, "n", total), end, new), [end])
        drawn = drawn.select("x", "y")
        rest = materialize(_pairs(drawn, "x", "y"), "edges")
    if not rounds:
        return rest.select(F.col("a").cast(kind).alias("node"), F.col("b").alias("component"))
    found = rounds[0].select("node", F.col("to").alias("component"))
    for to in rounds[1:]:
        nxt = to.select(F.col("node").alias("component"), F.col("to").alias("next"))
        found = materialize(found, "components")
        hot = hot_keys(found.groupBy("component").agg(F.count("*").alias("n")), "n").join(nxt, "component").select("component", "next")
        found = join_spread(found, nxt, hot, ["component"]).select("node", F.coalesce("next", "component").alias("component"))
    return materialize(found, "components")
