"""A graph small enough to draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.sources.shared import materialize


def display_kind(kind: Column) -> Column:
    return (
        F.when(kind.isin("calls", "instantiates", "renders", "accesses"), "value-call")
        .when(kind == "type_ref", "type-ref")
        .when(kind.isin("extends", "implements", "overrides"), "heritage")
        .otherwise(kind)
    )


def reduce_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 1200, keep_external: bool = False, keep_ignored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes of the highest degree, with their edges; none is isolated. External and ignored ones are kept if asked for.

    What is kept is bounded by ``max_nodes`` ids and is told to all tasks; the
    edges between live nodes are found once.
    """
    own = nodes if keep_external else nodes.filter(~F.col("external"))
    own = own if keep_ignored else own.filter(~F.col("ignored"))
    live = edges
    for end in ("src", "dst"):
        live = live.join(own.select(F.col("id").alias(end)), end, "left_semi")
    live = materialize(live.select(*edges.columns), "live")

    def degree(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))

    top = own.select("id").join(degree(live), "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(max_nodes)
    top = materialize(top.select("id"), "top")
    kept_e = live
    for end in ("src", "dst"):
        kept_e = kept_e.join(F.broadcast(top.select(F.col("id").alias(end))), end, "left_semi")
    kept_e = materialize(kept_e.select(*edges.columns), "kept")
    kept = nodes.join(F.broadcast(top), "id", "left_semi").join(degree(kept_e), "id")
    return kept, kept_e.withColumn("family", display_kind(F.col("kind")))


def drop_counts(nodes: DataFrame, edges: DataFrame, kept_nodes: DataFrame, kept_edges: DataFrame) -> dict[str, int]:
    """How many nodes and edges a reduction left out."""
    return {"nodes": nodes.count() - kept_nodes.count(), "edges": edges.count() - kept_edges.count()}


def reroot(nodes: DataFrame) -> DataFrame:
    """``file`` relative to the longest folder that all absolute paths share.

    The common beginning of all strings is that of the least and the greatest.
    """
    ends = nodes.filter(F.startswith("file", F.lit("/"))).agg(F.min("file").alias("a"), F.max("file").alias("b")).first()
    if not ends or ends["a"] is None:
        return nodes
    a, b = ends["a"].split("/")[:-1], ends["b"].split("/")[:-1]
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    root = "/".join(a[:n]) + "/"
    return nodes.withColumn("file", F.when(F.startswith("file", F.lit(root)), F.substring("file", len(root) + 1, 1 << 20)).otherwise(F.col("file")))
