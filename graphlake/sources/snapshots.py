"""Graphs from the tables of native snapshots: clang symbols, TypeScript dumps, Rust shards, Go method sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions.text import basename
from graphlake.operators.assembly import dedupe_edges
from graphlake.sources.artifacts import ROLES, native_occurrences, native_relations

# Kinds of native symbols by their code; others are external symbols.
NATIVE_KINDS = {
    1: "module", 2: "namespace", 3: "namespace", 4: "variable", 5: "file", 6: "enum", 7: "class", 8: "class", 9: "interface", 10: "type", 11: "type",
    12: "type", 13: "function", 14: "variable", 15: "field", 16: "field", 17: "method", 18: "method", 19: "method", 20: "property", 21: "property",
    22: "property", 23: "constructor", 24: "method", 25: "method", 26: "parameter", 27: "type", 28: "type", 29: "type", 30: "parameter", 31: "interface",
}
# Further bits of native roles.
DECLARATION, DEFINITION = 1 << 0, 1 << 1
#: The order in which a snapshot's lanes are read; of equal edges the first lane's counts, so a use keeps its exact place.
LANES = ("symbols", "includes", "modules", "occurrences", "relations", "macros")
EDGE = ["src", "dst", "kind", "line"]


def native_kind(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in NATIVE_KINDS.items() for x in kv])
    return F.coalesce(F.element_at(known, code), F.lit("external_symbol"))


def native_graph(lanes: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes``, ``edges`` and unresolved sites of a native snapshot's tables.

    ``symbols`` (id, owner, name, code, file, line, exported), ``includes``
    (source, target, line), ``modules`` (name, file, line), ``occurrences``
    (owner, symbol, target_kind, roles, line), ``relations`` (subject, object,
    roles) and ``macros`` (name, roles, file, definition, line). A symbol is in its
    owner, or in its file; what it exports, its file does. Any lane may be absent.
    """
    spark = next(iter(lanes.values())).sparkSession
    null = F.lit(None).cast("int")
    edge = lambda df, a, b, kind, line: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), line.cast("int").alias("line"))
    macro_id, module_id = F.concat(F.lit("macro:"), "name"), F.concat(F.lit("module:"), "name")
    made: dict[str, list[DataFrame]] = {lane: [] for lane in LANES}
    files, nodes = [], []
    unresolved = spark.createDataFrame([], "owner string, symbol string, family string, reason string")
    if (s := lanes.get("symbols")) is not None:
        nodes.append(s.select("id", native_kind(F.col("code")).alias("kind"), "name", "file", F.col("line").cast("int").alias("line"), F.col("exported")))
        files.append(s.select("file"))
        made["symbols"] = [
            edge(s, F.coalesce(F.when(F.col("owner") != "", F.col("owner")), F.col("file")), F.col("id"), "contains", F.col("line")),
            edge(s.filter("exported"), F.col("file"), F.col("id"), "exports", F.col("line")),
        ]
    if (i := lanes.get("includes")) is not None:
        files += [i.select(F.col(c).alias("file")) for c in ("source", "target")]
        made["includes"] = [edge(i, F.col("source"), F.col("target"), "imports", F.col("line"))]
    if (m := lanes.get("modules")) is not None:
        nodes.append(m.select(module_id.alias("id"), F.lit("module").alias("kind"), "name", "file", null.alias("line"), F.lit(False).alias("exported")))
        files.append(m.select("file"))
        made["modules"] = [edge(m, F.col("file"), module_id, "imports", F.col("line"))]
    if (o := lanes.get("occurrences")) is not None:
        ids = lanes["symbols"].select("id") if "symbols" in lanes else o.select(F.col("symbol").alias("id"))
        found, unresolved = native_occurrences(o, ids)
        made["occurrences"] = [found.select("src", "dst", "kind", F.col("line").cast("int").alias("line"))]
    if (r := lanes.get("relations")) is not None:
        made["relations"] = [native_relations(r).withColumn("line", null)]
    if (c := lanes.get("macros")) is not None:
        nodes.append(c.select(macro_id.alias("id"), F.lit("variable").alias("kind"), "name", F.col("definition").alias("file"), null.alias("line"), F.lit(False).alias("exported")))
        files += [c.select("file"), c.select(F.col("definition").alias("file"))]
        uses, definitions = F.col("roles").bitwiseAND(ROLES["reference"]) != 0, F.col("roles").bitwiseAND(DECLARATION | DEFINITION) != 0
        made["macros"] = [
            edge(c.filter(uses), F.coalesce(F.when(F.col("file") != "", F.col("file")), F.col("definition")), macro_id, "references", F.col("line")),
            edge(c.filter(definitions), F.col("definition"), macro_id, "contains", F.col("line")),
        ]
    order = lambda lane: F.struct(F.lit(LANES.index(lane)).alias("lane"), F.coalesce("line", F.lit(1 << 30)).alias("at")).alias("ord")
    every = [df.select(*EDGE, order(lane)) for lane in LANES for df in made[lane]]
    edges = dedupe_edges(reduce(lambda a, b: a.unionByName(b), every).filter("src <> dst")).drop("ord")
    file = reduce(lambda a, b: a.unionByName(b), files).filter("file <> ''").distinct()
    own = file.select(F.col("file").alias("id"), F.lit("file").alias("kind"), basename(F.col("file")).alias("name"), "file", null.alias("line"), F.lit(False).alias("exported"))
    rows = reduce(lambda a, b: a.unionByName(b), [own, *nodes])
    first = F.min_by(F.struct("kind", "name", "file", "line", "exported"), F.struct(F.coalesce("line", F.lit(1 << 30)), "kind", "file")).alias("f")
    return rows.groupBy("id").agg(first).select("id", "f.*"), edges, unresolved


def fold_modules(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A TypeScript dump with its module nodes as the files they are: sources of edges follow, one file node each."""
    modules = nodes.filter("kind = 'module'").select(F.col("id").alias("src"), F.col("file").alias("__file"))
    files = modules.select(F.col("__file").alias("id")).distinct()
    named = {"kind": F.lit("file"), "name": basename(F.col("id")), "file": F.col("id"), "language": F.lit("typescript"), "external": F.lit(False)}
    made = files.select(*[F.col("id") if c == "id" else named[c].alias(c) if c in named else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns])
    moved = edges.join(modules, "src", "left").withColumn("src", F.coalesce("__file", "src")).select(*edges.columns)
    return nodes.filter("kind <> 'module'").unionByName(made), moved


def dump_violations(nodes: DataFrame, edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """``rule``, ``subject`` of what is wrong with a TypeScript dump: fields of other kinds, ends, repeats after folding, files that were not loaded."""
    allowed = {"literals": ["type", "enum"], "enum_members": ["enum"], "object_members": ["variable"]}
    rule = lambda df, text, *subject: df.select(F.lit(text).alias("rule"), F.concat_ws(" ", *subject).alias("subject"))
    found = [rule(nodes.groupBy("id").count().filter("count > 1"), "duplicate node", "id")]
    found += [rule(nodes.filter(F.col(c).isNotNull() & ~F.col("kind").isin(kinds)), f"{c} of another kind", "id") for c, kinds in allowed.items() if c in nodes.columns]
    found.append(rule(edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti"), "unknown source", "src", "dst", "kind"))
    targets = nodes.filter("kind <> 'module'").select(F.col("id").alias("dst"))
    found.append(rule(edges.join(targets, "dst", "left_anti"), "unknown or folded target", "src", "dst", "kind"))
    _, moved = fold_modules(nodes, edges)
    found.append(rule(moved.groupBy("src", "dst", "kind").count().filter("count > 1"), "duplicate edge after folding", "src", "dst", "kind"))
    found.append(rule(nodes.select("file").distinct().join(manifest.select("file"), "file", "left_anti"), "facts of a file that was not loaded", "file"))
    return reduce(lambda a, b: a.unionAll(b), found)


def rust_shard(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A Rust shard's own nodes, its edges and unresolved sites under graph ids (``native``, ``id``), and the ends that have none.

    Candidates of a site without an id stay as they are.
    """
    own = nodes.filter(~F.col("external")).join(ids.withColumnRenamed("id", "__id"), F.col("id") == F.col("native")).drop("id", "native").withColumnRenamed("__id", "id")
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(ids.select(F.col("native").alias(end), F.col("id").alias(f"__{end}")), end, "left")
    bad = moved.filter("__src IS NULL OR __dst IS NULL").select(F.when(F.col("__src").isNull(), F.col("src")).otherwise(F.col("dst")).alias("end")).distinct()
    kept = moved.filter("__src IS NOT NULL AND __dst IS NOT NULL").select(*[F.col(f"__{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])
    sites = unresolved.select("*", F.posexplode_outer("candidates").alias("__p", "native")).join(ids, "native", "left")
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("__p").isNotNull(), F.struct("__p", F.coalesce("id", "native").alias("c"))))), lambda s: s["c"])
    rest = [c for c in unresolved.columns if c != "candidates"]
    return own.select(*nodes.columns), kept, sites.groupBy(*rest).agg(named.alias("candidates")), bad


def go_dispatches(methods: DataFrame) -> DataFrame:
    """Edges of Go method sets (type, abstract, name, signature, id): a type implements an interface whose methods it all has.

    Types: ``implements`` from the concrete to the abstract one; methods:
    ``dispatches`` from the abstract to the concrete one. An interface without
    methods is implemented by nothing here. An equi-join by method and a count.
    """
    wanted = methods.filter("abstract").select(F.col("type").alias("base"), "name", "signature", F.col("id").alias("declared"))
    size = wanted.groupBy("base").agg(F.count("*").alias("n"))
    have = methods.filter("NOT abstract").select(F.col("type").alias("impl"), "name", "signature", F.col("id").alias("body"))
    met = have.join(wanted, ["name", "signature"])
    full = met.groupBy("impl", "base").agg(F.count("*").alias("n")).join(size, ["base", "n"]).select("impl", "base")
    types = full.select(F.col("impl").alias("src"), F.col("base").alias("dst"), F.lit("implements").alias("kind"))
    bodies = met.join(full, ["impl", "base"]).select(F.col("declared").alias("src"), F.col("body").alias("dst"), F.lit("dispatches").alias("kind"))
    return types.unionByName(bodies).distinct()


def is_go_test(file: Column, name: Column, signature: Column) -> Column:
    """Whether a Go function is a test, benchmark, fuzz target or example, by file, name and parameters."""
    takes = F.rlike(signature, F.lit(r"^func\([^,)]*\*testing\.(T|B|F)\)$")) & F.rlike(name, F.lit(r"^(Test|Benchmark|Fuzz)([^a-z]|$)"))
    shows = F.rlike(signature, F.lit(r"^func\(\)$")) & F.rlike(name, F.lit(r"^Example([^a-z]|$)"))
    return F.endswith(file, F.lit("_test.go")) & (takes | shows)
