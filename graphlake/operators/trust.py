"""How far an answer can be relied on: coverage and what could not be resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.schema import EDGE_KINDS

# Edge families that an operation reads.
FAMILIES = {
    "lookup": [k for k in EDGE_KINDS if k not in ("contains", "imports")],
    "entrypoints": [k for k in EDGE_KINDS if k not in ("contains", "imports")],
    "trace": [k for k in EDGE_KINDS if k not in ("contains", "exports", "imports")],
    "details": EDGE_KINDS,
    "overview": EDGE_KINDS,
    "tour": EDGE_KINDS,
}


def coverage_of(coverage: DataFrame, operation: str) -> DataFrame:
    return coverage.filter(F.col("family").isin(FAMILIES[operation]))


def unresolved_reasons(unresolved: DataFrame, operation: str) -> DataFrame:
    return unresolved.filter(F.col("family").isin(FAMILIES[operation])).groupBy("reason").agg(F.count("*").alias("n"))


def provenance(edges: DataFrame) -> DataFrame:
    """``provider``, ``language``, ``n``: who said how much."""
    return edges.groupBy("provider", "language").agg(F.count("*").alias("n"))


def examples(unresolved: DataFrame, operation: str, limit: int = 3) -> DataFrame:
    """A few unresolved places of each reason (those first by file and line) that an operation could have needed."""
    own = unresolved.filter(F.col("family").isin(FAMILIES[operation]))
    order = F.row_number().over(W.partitionBy("reason").orderBy("evidence.file", "evidence.startLine", "family"))
    return own.withColumn("r", order).filter(F.col("r") <= limit).select("reason", "family", "evidence.file", "evidence.startLine", "r")


def audit(kind: str, indexer: str) -> str:
    """What an answer rests on, in a sentence."""
    by = f" by {indexer}" if indexer else ""
    if kind == "escape":
        return "The caller left the graph; this answer holds none of its facts."
    if kind == "topology":
        return "Topology is as declared, or as the owning tool says; files are tied to it only while the code stood still."
    if kind in ("lookup", "entrypoints", "tour"):
        return f"Every name and place is a fact indexed{by}; which of them are shown is a ranking."
    return f"Every name, edge and place is a fact indexed{by}; limits of the request are the only cut."


def next_action(kind: str, n_found: int, truncated: bool = False) -> str:
    """answer, inspect, outside or clarify."""
    if kind == "escape":
        return "outside"
    if not n_found:
        return "clarify"
    return "inspect" if truncated else "answer"
