"""A graph from source texts: extraction in Arrow batches, resolution in joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.sources.shared import materialize
from graphlake.sources.static import extract

FACTS = (
    "fact string, file string, language string, pos int, name string, kind string, qualified_name string, owner string, line int, end_line int, "
    "exported boolean, relation string, receiver string, signature string"
)


def extract_facts(sources: DataFrame) -> DataFrame:
    """Rows of every source (file, language, text): declarations, imports, supertypes, decorators and uses of names."""
    columns = [c.split()[0] for c in FACTS.split(", ")]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, language, text in zip(part["file"], part["language"], part["text"], strict=True):
                text = text or ""
                found = extract.declarations(text, language)
                declared = {(d.line, d.name) for d in found}
                for pos, d in enumerate(found):
                    q = d.qualified
                    rows.append(("declaration", file, language, pos, d.name, d.kind, q, d.owner, d.line, d.end + 1, d.exported, None, None, d.head))
                    rows += [("supertype", file, language, pos, name.split(".")[-1], d.kind, q, None, d.line, None, None, rel, None, None) for rel, name in d.supertypes]
                    rows += [("decorator", file, language, pos, name.split(".")[-1], d.kind, q, None, d.line, None, None, "decorates", None, None) for name in d.decorators]
                rows += [("import", file, language, pos, name, None, None, None, None, None, None, "imports", None, None) for pos, name in enumerate(extract.imports(text, language))]
                pos = 0
                for line, receiver, name, how in extract.uses(text, language):
                    if (line, name) not in declared:
                        rows.append(("use", file, language, pos, name, None, None, None, line, None, None, how, receiver, None))
                        pos += 1
            yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int32", "line": "Int32", "end_line": "Int32", "exported": "boolean"})

    # Reading takes far longer than moving a text: a few large input files would leave most cores idle.
    spark = sources.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return sources.select("file", "language", "text").repartition(parts, "file").mapInPandas(read, FACTS)


def node_id(file="file", name="qualified_name", kind="kind"):
    return F.concat(F.col(file), F.lit("#"), F.col(name), F.lit(":"), F.col(kind))


def first_types(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``kind``, ``line`` of supertypes and decorators: the first target of the name, in its own file before all others.

    Order is that of files by path, then of places by id. In C# and Swift the kind
    of the target decides: a class extends a class, and implements what is an
    interface; an interface extends.
    """
    joined = refs.join(targets.select("language", "name", "t_file", "dst", "t_kind"), ["language", "name"]).filter("src <> dst")
    order = F.struct((F.col("t_file") != F.col("file")).alias("far"), "t_file", "dst")
    first = joined.groupBy("src", "language", "kind", "name", "relation", "line").agg(F.min_by(F.struct("dst", "t_kind"), order).alias("t"))
    by_target = F.when((F.col("t.t_kind") == "interface") & (F.col("kind") != "interface"), "implements").otherwise("extends")
    decided = F.col("language").isin("csharp", "swift") & F.col("relation").isin("extends", "implements")
    return first.select("src", F.col("t.dst").alias("dst"), F.when(decided, by_target).otherwise(F.col("relation")).alias("kind"), "line")


def static_graph(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of source texts.

    A use counts for the innermost declaration that holds it, and refers to what
    its name stands for in the same language: in the same file if it is declared
    once there, else anywhere if it is declared once at all. A tie makes no edge.
    """
    facts = materialize(extract_facts(sources), "facts")
    own = facts.filter("fact = 'declaration'").withColumn("id", node_id())
    nodes = own.groupBy("id").agg(F.min_by(F.struct("kind", "language", "name", "qualified_name", "file", "exported", "line", "end_line", "signature", "owner"), "pos").alias("n")).select("id", "n.*")
    nodes = nodes.withColumns({"external": F.lit(False), "ignored": F.lit(False)})
    nodes = materialize(nodes, "nodes")
    targets = nodes.select("language", "name", F.col("file").alias("t_file"), F.col("id").alias("dst"), F.col("kind").alias("t_kind"), F.col("qualified_name").alias("t_q"))
    owner = nodes.select("file", F.col("qualified_name").alias("owner"), F.col("id").alias("src"))
    owner = owner.groupBy("file", "owner").agg(F.min("src").alias("src"))
    contains = nodes.join(owner, ["file", "owner"], "left").select(F.coalesce("src", "file").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), "line")
    exports = nodes.filter("exported AND owner IS NULL").select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("exports").alias("kind"), "line")
    imports = facts.filter("fact = 'import'").select(F.col("file").alias("src"), F.concat(F.lit("external:"), "language", F.lit(":"), "name").alias("dst"), F.lit("imports").alias("kind"), F.lit(None).cast("int").alias("line"))

    def resolved(refs: DataFrame) -> DataFrame:
        """The sole target of each ref by name, in its own file first."""
        tier = F.when(F.col("t_file") == F.col("file"), 0).otherwise(1)
        joined = refs.join(targets, ["language", "name"]).filter("src <> dst").withColumn("tier", tier)
        best = joined.withColumn("best", F.min("tier").over(W.partitionBy("src", "file", "name", "relation"))).filter("tier = best")
        return best.groupBy("src", "file", "name", "relation").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst"), F.min("t_kind").alias("t_kind"), F.min("line").alias("line")).filter("n = 1")

    typed = facts.filter("fact IN ('supertype', 'decorator')").withColumn("src", node_id())
    typed = first_types(typed.select("src", "file", "language", "kind", "name", "relation", "line"), targets).select("src", "dst", "kind", "line")
    # The innermost declaration of the file that holds the line; an equi-join on the file and a range within it.
    scopes = nodes.select("file", F.col("id").alias("scope"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    known = targets.select("language", "name").distinct()
    used = facts.filter("fact = 'use'").join(known, ["language", "name"], "left_semi")
    held = used.join(scopes, "file", "left").filter("scope IS NULL OR (lo <= line AND line <= hi)")
    held = held.groupBy("file", "language", "name", "line", "pos", "relation").agg(F.min_by("scope", F.struct(-F.col("lo"), "hi", "scope")).alias("src"))
    outside = used.join(held.select("file", "pos"), ["file", "pos"], "left_anti").select("file", "language", "name", "line", "pos", "relation", F.lit(None).cast("string").alias("src"))
    refs = held.unionByName(outside).withColumn("src", F.coalesce("src", "file"))
    found = resolved(refs.select("src", "file", "language", "name", "relation", "line"))
    kind = (
        F.when((F.col("relation") == "new") | (F.col("relation").isin("call") & F.col("t_kind").isin("class")), "instantiates")
        .when(F.col("relation") == "call", "calls")
        .when((F.col("relation") == "argument") & F.col("t_kind").isin("function", "method"), "accesses")
        .when(F.col("t_kind").isin("class", "interface", "type", "enum"), "type_ref")
        .otherwise("accesses")
    )
    dependency = found.select("src", "dst", kind.alias("kind"), "line")
    every = contains.unionByName(exports).unionByName(imports).unionByName(typed).unionByName(dependency)
    return nodes.drop("owner"), every.groupBy("src", "dst", "kind").agg(F.min("line").alias("line"))
