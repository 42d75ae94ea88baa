"""Identities that outlive a build, and what becomes of edges when ids change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.functions.docs import encode_component
from graphlake.streaming.generations import canonical_digest

FIELDS = ["language", "role", "symbol", "module", "target", "unit", "document", "overload"]


def semantic_ids(nodes: DataFrame, generation: str) -> DataFrame:
    """``semantic_id`` of nodes with the columns of FIELDS, ``display`` and ``kind``.

    A digest over length-prefixed fields. Nodes of one digest whose kind or
    display differ are not one symbol; they are told apart within the generation.
    """
    named = nodes.withColumn("__d", canonical_digest(F.lit("v2"), *[F.col(c) for c in FIELDS]))
    facts = named.groupBy("__d").agg(F.count_distinct(F.struct("kind", "display")).alias("__n"))
    joined = named.join(facts, "__d")
    scoped = canonical_digest(F.lit("g2"), *[F.col(c) for c in FIELDS], F.lit(generation), F.col("kind"), F.col("display"))
    prefix = F.when(F.col("__n") == 1, F.lit("@v2")).otherwise("@g2")
    digest = F.when(F.col("__n") == 1, F.col("__d")).otherwise(scoped)
    made = F.concat(prefix, F.lit("/"), "language", F.lit("/"), digest, F.lit("#"), encode_component(F.col("display")), F.lit(":"), "kind")
    return joined.withColumn("semantic_id", made).drop("__d", "__n")


def remap_edges(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between new ids (``id`` to ``semantic_id``), and those dropped as an end stands for several.

    An end is the sole new id of its old one; else, for the source, the one whose
    extent (``line`` to ``end_line``) holds the edge's line, if that is one.
    """
    sole = ids.groupBy("id").agg(F.count_distinct("semantic_id").alias("n"), F.min("semantic_id").alias("s"))
    src = edges.join(sole.select(F.col("id").alias("src"), F.col("n").alias("sn"), F.col("s").alias("ss")), "src", "left")
    both = src.join(sole.select(F.col("id").alias("dst"), F.col("n").alias("dn"), F.col("s").alias("ds")), "dst", "left")
    spans = ids.select(F.col("id").alias("src"), "semantic_id", F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    odd = both.filter("sn > 1").join(spans, "src").filter("lo <= line AND line <= hi")
    held = odd.groupBy("src", "dst", "kind").agg(F.count_distinct("semantic_id").alias("hn"), F.min("semantic_id").alias("hs")).filter("hn = 1")
    full = both.join(held, ["src", "dst", "kind"], "left")
    new_src = F.when(F.col("sn") == 1, F.col("ss")).when(F.col("sn") > 1, F.col("hs")).otherwise(F.when(F.col("sn").isNull(), F.col("src")))
    new_dst = F.when(F.col("dn") == 1, F.col("ds")).otherwise(F.when(F.col("dn").isNull(), F.col("dst")))
    full = full.withColumns({"__s": new_src, "__t": new_dst})
    kept = full.filter("__s IS NOT NULL AND __t IS NOT NULL").select(F.col("__s").alias("src"), F.col("__t").alias("dst"), "kind", "line")
    return kept, full.filter("__s IS NULL OR __t IS NULL").select("src", "dst", "kind")
