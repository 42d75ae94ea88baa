"""Architecture at a glance: counts, layers, hotspots, public API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions.text import dirname, is_public_api_noise, is_support_path
from graphlake.schema import PUBLIC_KINDS


def _own(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("external") & ~F.col("ignored") & (F.col("kind") != "file") & ~is_support_path(F.col("file")))


def _shown() -> Column:
    return F.coalesce("qualified_name", "name")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``files``, ``nodes``, ``edges``."""
    n = nodes.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count("*").alias("nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def layers(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Folders by distinct files of product code, with what they export."""
    grouped = _own(nodes).groupBy(dirname(F.col("file")).alias("dir")).agg(
        F.count_distinct("file").alias("files"), F.sum(F.col("exported").cast("long")).alias("exported")
    )
    return grouped.orderBy(F.desc("files"), "dir").limit(limit)


def hotspots(nodes: DataFrame, degree: DataFrame, limit: int = 10) -> DataFrame:
    """Declarations with the most relationships that are not structural."""
    own = _own(nodes).select("id", _shown().alias("name"), "kind")
    hot = degree.select("id", F.col("in_real").alias("fan_in"), F.col("out_real").alias("fan_out")).filter("fan_in + fan_out > 0")
    return own.join(hot, "id").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(limit)


def public_api(nodes: DataFrame, degree: DataFrame, limit: int = 15) -> DataFrame:
    """Exported declarations by degree."""
    own = nodes.filter(F.col("exported") & ~F.col("external") & F.col("kind").isin(PUBLIC_KINDS) & ~is_public_api_noise(F.col("file")))
    d = degree.select("id", (F.col("in_real") + F.col("out_real")).alias("degree"))
    return own.select("id", _shown().alias("name"), "kind", "file").join(d, "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(limit)
