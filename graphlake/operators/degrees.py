"""Counts of edges at each node, once for each snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.schema import DISPATCH_SOURCE, EXECUTION, STRUCTURAL


def degrees(edges: DataFrame) -> DataFrame:
    """``in_all out_all in_real out_real in_exec out_exec export_fan_in`` by id.

    Both ends of an edge are rows of one aggregate, so hubs are combined before
    the only shuffle.
    """
    real, execution, exports = ~F.col("kind").isin(STRUCTURAL), F.col("kind").isin(EXECUTION), F.col("kind") == "exports"
    ends = edges.select(
        F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("side")))).alias("e"),
        real.alias("real"), execution.alias("execution"), exports.alias("exports"),
    )
    into, out = F.col("e.side") == 1, F.col("e.side") == 0
    return ends.groupBy(F.col("e.id").alias("id")).agg(
        F.count_if(into).alias("in_all"), F.count_if(out).alias("out_all"),
        F.count_if(into & F.col("real")).alias("in_real"), F.count_if(out & F.col("real")).alias("out_real"),
        F.count_if(into & F.col("execution")).alias("in_exec"), F.count_if(out & F.col("execution")).alias("out_exec"),
        F.count_if(into & F.col("exports")).alias("export_fan_in"),
    )


def export_fan_in(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'exports'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("export_fan_in"))


HUB = 12


def dispatch_edges(nodes: DataFrame, edges: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Edges from a declaration without a body to what overrides or implements it, and those of hubs that have too many.

    A declaration has no body if it runs nothing; only those that do run
    something are dispatched to. An edge has the place at which it is overridden.
    """
    runs = edges.filter(F.col("kind").isin(EXECUTION)).select(F.col("src").alias("id")).distinct()
    place = [c for c in ("line", "col") if c in edges.columns]
    up = edges.filter(F.col("kind").isin(DISPATCH_SOURCE)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *place)
    up = up.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    up = up.join(runs.withColumnRenamed("id", "dst"), "dst", "left_semi").join(runs.withColumnRenamed("id", "src"), "src", "left_anti")
    up = up.groupBy("src", "dst").agg(F.min(F.struct(*place)).alias("p")) if place else up.distinct()
    made = up.select("src", "dst", F.lit("dispatches").alias("kind"), *[F.col(f"p.{c}") for c in place])
    few = up.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") < hub).select("src")
    return made.join(few, "src", "left_semi"), made.join(few, "src", "left_anti")


def open_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``degrees`` without the edges whose other end is a closure, which a tour does not show."""
    if "closure" not in nodes.columns:
        return degrees(edges)
    closed = nodes.filter("closure").select("id")
    into = edges.join(closed.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "kind")
    out = edges.join(closed.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "kind")
    left, right = degrees(into), degrees(out)
    cols = ["in_all", "in_real", "in_exec", "export_fan_in"]
    joined = left.select("id", *cols).join(right.select("id", "out_all", "out_real", "out_exec"), "id", "full_outer")
    return joined.fillna(0).select("id", "in_all", "out_all", "in_real", "out_real", "in_exec", "out_exec", "export_fan_in")


def shared_utilities(nodes: DataFrame, degree: DataFrame, fan_in: int = HUB, fan_out: int = 1) -> DataFrame:
    """Nodes that many use and that run next to nothing."""
    return degree.filter((F.col("in_real") >= fan_in) & (F.col("out_exec") <= fan_out)).join(nodes.select("id"), "id", "left_semi").select("id", "in_real", "out_exec")
