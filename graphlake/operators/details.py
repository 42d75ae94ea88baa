"""What stands around a set of declarations: members, calls, types, implementations, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.functions.text import is_external, is_test_path
from graphlake.schema import CONTAINERS, EXECUTION, HERITAGE, STRUCTURAL

# How edge kinds rank among the references of a declaration, of an entry point, and on a walk; kinds not listed rank 10.
DETAIL_RANK = {"calls": 0, "instantiates": 1, "accesses": 2, "renders": 2, "tests": 3, "overrides": 4, "decorates": 4, "extends": 5, "implements": 5, "type_ref": 6}
ENTRY_RANK = {**DETAIL_RANK, "references": 2}
TRACE_RANK = {"calls": 0, "dispatches": 1, "instantiates": 1, "renders": 2, "accesses": 3, "tests": 4, "overrides": 5, "decorates": 5, "extends": 6, "implements": 6, "type_ref": 7}


def kind_rank(kind: Column, ranks: dict[str, int], other: int = 10) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def place_rank(edges: DataFrame) -> Column:
    """Edges by line and column (``line``, and ``col`` if there is one); a missing place comes late."""
    column = F.col("col") if "col" in edges.columns else F.lit(None).cast("int")
    return F.coalesce("line", F.lit(9_999)) * 100 + F.coalesce(column, F.lit(999))


def bundled_last(file: Column) -> Column:
    return F.when(F.startswith(file, F.lit("bundled://")), 20_000).otherwise(0)


def members(wanted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``member``, ``name``, ``kind``, ``line`` of what containers among the wanted ids contain."""
    owners = nodes.filter(F.col("kind").isin(CONTAINERS)).join(wanted.select("id"), "id", "left_semi").select(F.col("id").alias("src"))
    inner = edges.filter("kind = 'contains'").join(owners, "src", "left_semi").select("src", "dst")
    n = nodes.select(F.col("id").alias("dst"), F.coalesce("qualified_name", "name").alias("name"), "kind", "line")
    return inner.join(n, "dst").select(F.col("src").alias("id"), F.col("dst").alias("member"), "name", "kind", "line")


def literal_members(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``ord``, ``name``, ``kind``, ``line``, ``signature`` of what variables and enums spell out in their own row.

    ``object_members`` is an array of (name, kind, line, signature) of a variable,
    ``enum_members`` one of (name, value) of an enum.
    """
    own = nodes.join(wanted.select("id"), "id", "left_semi")
    objects = own.filter("kind = 'variable'").select("id", F.posexplode("object_members").alias("ord", "m"))
    objects = objects.select("id", "ord", "m.name", "m.kind", F.col("m.line").cast("int").alias("line"), "m.signature")
    enums = own.filter("kind = 'enum'").select("id", F.coalesce("qualified_name", "name").alias("owner"), F.posexplode("enum_members").alias("ord", "m"))
    signature = F.when(F.col("m.value").isNotNull(), F.concat("m.name", F.lit(" = "), "m.value"))
    enums = enums.select("id", "ord", F.concat("owner", F.lit("."), "m.name").alias("name"), F.lit("property").alias("kind"), F.lit(None).cast("int").alias("line"), signature.alias("signature"))
    return objects.unionByName(enums)


def _limited(refs: DataFrame, limit: int, distinct: bool) -> DataFrame:
    """The first references of each id by rank, and how many there are; with ``distinct``, one of each (kind, other).

    All of an id meet once: distinct rows, order and count need no other shuffle,
    and what ``refs`` joins is read once.
    """
    refs = refs.select("id", "kind", "other", "rank").repartition("id")
    if distinct:
        refs = refs.groupBy("id", "kind", "other").agg(F.min("rank").alias("rank"))
    order, every = W.partitionBy("id").orderBy("rank", "kind", "other"), W.partitionBy("id")
    counted = refs.withColumns({"r": F.row_number().over(order), "available": F.count("*").over(every)})
    return counted.filter(F.col("r") <= limit).select("id", "kind", "other", "r", "available")


def references(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: list[str] | None, forward: bool, limit: int, distinct: bool = True, include_external: bool = False) -> DataFrame:
    """References of the wanted ids along (or against) edges of some kinds, or of all that are not structural.

    ``id``, ``kind``, ``other``, ``r`` (from 1) and ``available``. What tests say
    comes last, then edges go by kind, line and column.
    """
    own, far = ("src", "dst") if forward else ("dst", "src")
    keep = F.col("kind").isin(kinds) if kinds else ~F.col("kind").isin(STRUCTURAL)
    found = edges.filter(keep).join(wanted.select(F.col("id").alias(own)).distinct(), own, "left_semi")
    found = found.select(F.col(own).alias("id"), F.col(far).alias("other"), "kind", place_rank(edges).alias("place"))
    n = nodes if include_external else nodes.filter(~is_external(F.col("external"), F.col("file")))
    if distinct:
        n = n.filter("kind <> 'file'")
    test = F.when(is_test_path(F.col("file")), 10_000_000).otherwise(0)
    found = found.join(n.select(F.col("id").alias("other"), (test + bundled_last(F.col("file"))).alias("late")), "other")
    rank = F.col("late") + kind_rank(F.col("kind"), DETAIL_RANK) * 100_000 + F.col("place")
    return _limited(found.withColumn("rank", rank), limit, distinct)


def calls(wanted, nodes, edges, limit=2, include_external=False):
    return references(wanted, nodes, edges, EXECUTION, True, min(4, limit), include_external=include_external)


def types(wanted, nodes, edges, limit=2, include_external=False):
    return references(wanted, nodes, edges, ["type_ref", *HERITAGE], True, min(4, limit), include_external=include_external)


def implemented_by(wanted, nodes, edges, limit=2, include_external=False):
    return references(wanted, nodes, edges, ["implements", "overrides"], False, min(4, limit), include_external=include_external)


def depends_on(wanted, nodes, edges, limit=2, include_external=False):
    return references(wanted, nodes, edges, None, True, min(3, limit), distinct=False, include_external=include_external)


def depended_on_by(wanted, nodes, edges, limit=2, include_external=False):
    return references(wanted, nodes, edges, None, False, min(3, limit), distinct=False, include_external=include_external)


def entry_neighbours(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, forward: bool, limit: int = 2) -> DataFrame:
    """Neighbours of entry points: distinct, not structural, no files, by their own ranks."""
    own, far = ("src", "dst") if forward else ("dst", "src")
    found = edges.filter(~F.col("kind").isin(STRUCTURAL)).join(wanted.select(F.col("id").alias(own)).distinct(), own, "left_semi")
    found = found.select(F.col(own).alias("id"), F.col(far).alias("other"), "kind", place_rank(edges).alias("place"))
    n = nodes.filter("kind <> 'file'").select(F.col("id").alias("other"), bundled_last(F.col("file")).alias("late"))
    rank = kind_rank(F.col("kind"), ENTRY_RANK) * 100_000 + F.col("place") + F.col("late")
    return _limited(found.join(n, "other").withColumn("rank", rank), min(2, limit), True)
