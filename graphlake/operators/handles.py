"""Resolution of handles (ids, names, dotted names) to declarations, for a table of handles at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.functions.text import callable_base, file_stem, is_support_path


def symbol_index(nodes: DataFrame) -> DataFrame:
    """``symbol``, ``id``: names and qualified names; a node for which both are the same has two rows, as both count."""
    own = nodes.filter("kind <> 'file'")
    return own.select("id", F.col("name").alias("symbol")).unionAll(own.filter("qualified_name IS NOT NULL").select("id", "qualified_name")).select("symbol", "id")


def suffix_index(nodes: DataFrame) -> DataFrame:
    """``symbol``, ``id`` for every proper dotted end of a qualified name, so that an end is an equi-join."""
    parts = F.split("qualified_name", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return nodes.filter(F.contains("qualified_name", F.lit("."))).select(F.explode(ends).alias("symbol"), "id")


def keys(nodes: DataFrame) -> DataFrame:
    """``lane``, ``key``, ``id``: all that a node can be called.

    ``id``; ``legacy`` (file#name:kind); ``name`` (also qualified); ``cpp``, the
    same and their ends for C++, where ``::`` is a dot; ``suffix``, the dotted ends
    of a qualified name; ``call``, names of callables without their arguments and
    their dotted ends; ``stem`` and ``stem_call``, a file's stem with a name.
    """
    own = nodes.filter("kind <> 'file'").withColumn("full", F.coalesce("qualified_name", F.lit("")))
    calls = own.filter(F.col("kind").isin("function", "method", "constructor"))
    calls = calls.select("id", "file", callable_base(F.col("name")).alias("name"), callable_base(F.col("full")).alias("full"))
    cpp = own.filter("language = 'cpp'").select("id", F.regexp_replace("name", "::", ".").alias("name"), F.regexp_replace("full", "::", ".").alias("full"))
    both = lambda df, lane: df.select(F.lit(lane).alias("lane"), F.explode(F.array("name", "full")).alias("key"), "id")
    ends = lambda df, lane: suffix_index(df.select("id", F.col("full").alias("qualified_name"))).select(F.lit(lane).alias("lane"), F.col("symbol").alias("key"), "id")
    stem = lambda df: df.withColumns({c: F.when(F.col(c) != "", F.concat(file_stem(F.col("file")), F.lit("."), c)).otherwise("") for c in ("name", "full")})
    every = [
        nodes.select(F.lit("id").alias("lane"), F.col("id").alias("key"), "id"),
        own.select(F.lit("legacy").alias("lane"), F.concat("file", F.lit("#"), F.coalesce("qualified_name", "name"), F.lit(":"), "kind").alias("key"), "id"),
        both(own, "name"),
        both(cpp, "cpp"),
        ends(cpp, "cpp"),
        ends(own, "suffix"),
        both(calls, "call"),
        ends(calls, "call").filter(F.contains("key", F.lit("."))),
        both(stem(own), "stem"),
        both(stem(calls), "stem_call"),
    ]
    return reduce(lambda a, b: a.unionAll(b), every).filter("key <> ''")


def tries(handles: DataFrame) -> DataFrame:
    """``handle``, ``tier``, ``lane``, ``key``: how a handle may be read, in the order in which readings are tried.

    As an id; as a name, first as it is written, then with dots for ``::``; as a
    file's stem and a name; and at last its member alone, for which what comes
    before the last dot is a value.
    """
    h, dotted = F.col("handle"), F.regexp_replace("handle", "::", ".")
    again = F.contains(h, F.lit("::"))

    def member(form: Column) -> Column:
        symbol = F.regexp_replace(F.substring_index(form, "#", -1), ":[^:]*$", "")
        dot = F.when(F.rlike(form, F.lit(r"^.+\.[^.]+$")), F.substring_index(form, ".", -1))
        return F.when(F.contains(form, F.lit("#")), F.when(symbol != "", symbol)).otherwise(dot)

    def named(form: Column) -> list[tuple[str, Column]]:
        has = F.contains(form, F.lit("."))
        return [
            ("name", form),
            ("cpp", F.when(has | F.contains(form, F.lit("::")), F.regexp_replace(form, "::", "."))),
            ("suffix", F.when(has, form)),
            ("call", F.when(~F.contains(form, F.lit("(")), form)),
        ]

    def filed(form: Column) -> list[tuple[str, Column]]:
        split = F.rlike(form, F.lit(r"^[^.]+\..")) & F.lit(True)
        key = F.when(split, F.concat(F.lower(F.regexp_extract(form, r"^([^.]+)\.", 1)), F.lit("."), F.regexp_extract(form, r"(?s)^[^.]+\.(.*)$", 1)))
        return [("stem", key), ("stem_call", F.when(~F.contains(form, F.lit("(")), key))]

    second = F.when(again, dotted)
    order = [("id", h), ("legacy", h), *named(h), *named(second), *filed(h), *filed(second), *named(member(h)), *named(member(second))]
    each = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(lane).alias("lane"), key.alias("key")) for i, (lane, key) in enumerate(order)])
    return handles.select("handle").distinct().select("handle", F.explode(each).alias("t")).select("handle", "t.tier", "t.lane", "t.key").filter("key <> ''")


def candidates(handles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``handle``, ``tier``, ``id`` of the first reading that finds anything (``tries``, ``keys``): one join for all readings."""
    found = tries(handles).join(keys(nodes), ["lane", "key"]).select("handle", "tier", "id").distinct()
    best = found.groupBy("handle").agg(F.min("tier").alias("tier"))
    return found.join(best, ["handle", "tier"])


def rank_candidates(found: DataFrame, nodes: DataFrame, degree: DataFrame, limit: int = 12) -> DataFrame:
    """Candidates of each handle by how central they are; ties by id."""
    n = nodes.select("id", "external", "exported", "file")
    d = degree.select("id", (F.col("in_all") + F.col("out_all")).alias("d"), "export_fan_in")
    joined = found.join(n, "id").join(d, "id", "left").fillna(0, ["d", "export_fan_in"])
    score = (
        F.least(F.lit(48.0), F.log2(1 + F.col("export_fan_in")) * 20)
        + F.when(F.col("exported"), 12).otherwise(0)
        - F.when(F.col("external"), 60).otherwise(0)
        - F.when(is_support_path(F.col("file")), 30).otherwise(0)
        + F.least(F.lit(24.0), F.log2(1 + F.col("d")) * 6)
    )
    ranked = joined.withColumn("score", F.round(score, 6))
    order = F.row_number().over(W.partitionBy("handle").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("rank", order).filter(F.col("rank") <= limit).select("handle", "tier", "rank", "id", "score")


def resolve(handles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``handle``, ``status`` (node or ambiguous) and ``id`` (null if ambiguous); unknown handles have no row."""
    found = candidates(handles, nodes).groupBy("handle").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return found.select("handle", F.when(F.col("n") == 1, "node").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))
