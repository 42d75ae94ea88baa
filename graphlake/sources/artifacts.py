"""Graphs from what other tools export: symbol indexes, reference lists, occurrence tables, package lists.

Only rows are adapted here; running the tools is not this library's business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.operators.assembly import innermost_owner
from graphlake.sources.shared import materialize

# Bits of the roles of an occurrence.
DEFINITION, IMPORT, WRITE, READ = 1, 2, 4, 8
INDEX = (
    "documents array<struct<relativePath:string,language:string,"
    "occurrences:array<struct<range:array<int>,symbol:string,symbolRoles:int,enclosingRange:array<int>>>,"
    "symbols:array<struct<symbol:string,displayName:string,kind:string,enclosingSymbol:string,"
    "relationships:array<struct<symbol:string,isReference:boolean,isImplementation:boolean,isTypeDefinition:boolean>>>>>>, "
    "externalSymbols array<struct<symbol:string,displayName:string,kind:string>>"
)


def read_symbol_index(spark: SparkSession, path: str) -> DataFrame:
    """A decoded symbol index as JSON; what does not fit the schema fails."""
    return spark.read.schema(INDEX).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _pos(line: Column, char: Column) -> Column:
    return line.cast("long") * 1_000_000 + char


def _ends(range_: Column) -> tuple[Column, Column]:
    """Begin and end of a range of three or four numbers."""
    last = F.size(range_) == 3
    return _pos(F.get(range_, F.lit(0)), F.get(range_, F.lit(1))), F.when(last, _pos(F.get(range_, F.lit(0)), F.get(range_, F.lit(2)))).otherwise(_pos(F.get(range_, F.lit(2)), F.get(range_, F.lit(3))))


def symbol_index_graph(index: DataFrame, languages: list[str]) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of a symbol index: definitions, and references from the innermost scope around them.

    A reference proves no more than that; calls are not made up. Of a symbol that
    is there twice the first row counts; symbols of no document become external
    nodes when something refers to them.
    """
    docs = index.select(F.posexplode("documents").alias("doc", "d")).select("doc", "d.*").filter(F.lower("language").isin(languages))
    symbols = docs.select("doc", F.col("relativePath").alias("file"), "language", F.posexplode("symbols").alias("pos", "s")).select("doc", "file", "language", "pos", "s.*")
    first = symbols.groupBy("symbol").agg(F.min_by(F.struct("file", "language", "displayName", "kind", "enclosingSymbol", "relationships"), F.struct("doc", "pos")).alias("n"))
    first = first.select(F.col("symbol").alias("id"), "n.*")
    occ = docs.select(F.col("relativePath").alias("file"), "language", F.posexplode("occurrences").alias("o", "x")).select("file", "language", "o", "x.*")
    begin, end = _ends(F.col("range"))
    lo, hi = _ends(F.col("enclosingRange"))
    is_def = F.coalesce(F.col("symbolRoles").bitwiseAND(DEFINITION) != 0, F.lit(False))
    places = occ.filter(is_def).groupBy("symbol").agg(F.min_by((F.get("range", F.lit(0)) + 1), F.struct("file", "o")).alias("line")).withColumnRenamed("symbol", "id")
    scopes = occ.filter(is_def & F.col("enclosingRange").isNotNull()).select("file", lo.alias("start"), hi.alias("end"), F.col("symbol").alias("owner"))
    refs = occ.filter(~is_def).select("file", "language", begin.alias("pos"), F.col("symbol").alias("dst"), (F.get("range", F.lit(0)) + 1).alias("line"))
    held = innermost_owner(refs, scopes).filter(F.col("owner") != F.col("dst"))
    named = F.coalesce("displayName", F.regexp_extract("id", r"([\w$]+)[^\w$]*$", 1))
    nodes = first.join(places, "id", "left").select("id", F.lower("kind").alias("kind"), F.lower("language").alias("language"), named.alias("name"), "file", F.lit(False).alias("external"), "line")
    far = index.select(F.explode("externalSymbols").alias("e")).select(F.col("e.symbol").alias("id"), "e.displayName")
    outside = refs.select(F.col("dst").alias("id"), "language").groupBy("id").agg(F.min("language").alias("language")).join(nodes.select("id"), "id", "left_anti").join(far, "id", "left")
    outside = outside.select("id", F.lit("external_symbol").alias("kind"), F.lower("language").alias("language"), named.alias("name"), F.lit("").alias("file"), F.lit(True).alias("external"), F.lit(None).cast("int").alias("line"))
    edges = held.select(F.col("owner").alias("src"), "dst", F.lit("references").alias("kind"), "line")
    inside = first.filter("enclosingSymbol IS NOT NULL").select(F.col("enclosingSymbol").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit(None).cast("int").alias("line"))
    typed = first.select("id", F.explode("relationships").alias("r")).filter("r.isTypeDefinition").select(F.col("id").alias("src"), F.col("r.symbol").alias("dst"), F.lit("type_ref").alias("kind"), F.lit(None).cast("int").alias("line"))
    every = edges.unionByName(inside).unionByName(typed)
    return nodes.unionByName(outside), every.groupBy("src", "dst", "kind").agg(F.min("line").alias("line"))


def reference_kind(before: Column, after: Column, target: Column) -> Column:
    """What a reference is, by the text around it and the kind of what it refers to; the first rule that fits."""
    call = F.rlike(after, F.lit(r"^\s*(?:<[^>()]*>)?\s*(?:\?\.)?\s*\("))
    types, state = target.isin("class", "interface", "type", "enum"), target.isin("property", "field", "variable")
    made = target.isin("class", "constructor")
    handed = target.isin("function", "method") & F.rlike(before, F.lit(r"[(,]\s*$")) & F.rlike(after, F.lit(r"^\s*[,)]"))
    return (
        F.when(F.rlike(before, F.lit(r"(^|[^A-Za-z0-9_$])new\s+$")), "instantiates")
        .when(F.rlike(before, F.lit(r"(^|[^A-Za-z0-9_$])typeof\s+$")), F.when(types, "type_ref").otherwise("accesses"))
        .when(F.rlike(before, F.lit(r"<\s*$")) & F.rlike(after, F.lit(r"^\s*(?:/?>|[A-Za-z]+=)")), "renders")
        .when(call, F.when(made, "instantiates").otherwise("calls"))
        .when(handed, "accesses")
        .when(types, "type_ref")
        .when(state, "accesses")
        .when(F.rlike(before, F.lit(r"\.\s*$")), "accesses")
        .otherwise("references")
    )


# Bits of native roles, and kinds of native symbols that are types or constructors.
ROLES = {"reference": 1 << 2, "read": 1 << 3, "write": 1 << 4, "call": 1 << 5, "dynamic": 1 << 6, "name_reference": 1 << 20}
NATIVE_TYPES = [6, 7, 8, 9, 10, 11, 12, 28, 29, 31]
NATIVE_CONSTRUCTOR = 23
# Bits of native relations; the kind of edge that each makes, and whether the object comes first.
RELATIONS = [
    ("child_of", 1 << 10, "contains", True),
    ("contained_by", 1 << 17, "contains", True),
    ("base_of", 1 << 11, "extends", True),
    ("extended_by", 1 << 15, "extends", True),
    ("override_of", 1 << 12, "overrides", False),
    ("called_by", 1 << 14, "calls", True),
    ("accessor_of", 1 << 16, "accesses", False),
    ("specialization_of", 1 << 19, "instantiates", False),
]


def native_occurrences(occurrences: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of occurrences (owner, symbol, target_kind, roles, line), and those that are dynamic and unresolved.

    An occurrence makes an edge for each of its roles: a call of a constructor is
    a call and an instantiation, a reference to a type a reference and a type
    reference.
    """
    joined = occurrences.join(targets.select(F.col("id").alias("symbol")), "symbol", "left_semi")
    has = lambda *names: F.col("roles").bitwiseAND(sum(ROLES[n] for n in names)) != 0
    kinds = F.array_compact(
        F.array(
            F.when(has("call"), F.lit("calls")),
            F.when(has("call") & (F.col("target_kind") == NATIVE_CONSTRUCTOR), F.lit("instantiates")),
            F.when(has("read", "write"), F.lit("accesses")),
            F.when(has("reference"), F.lit("references")),
            F.when(has("reference", "name_reference") & F.col("target_kind").isin(NATIVE_TYPES), F.lit("type_ref")),
        )
    )
    edges = joined.select(F.col("owner").alias("src"), F.col("symbol").alias("dst"), F.explode(kinds).alias("kind"), "line").filter("src <> dst")
    dynamic = occurrences.filter(has("dynamic")).select("owner", "symbol", F.lit("dispatches").alias("family"), F.lit("dynamic").alias("reason"))
    return edges, dynamic


def native_relations(relations: DataFrame) -> DataFrame:
    """Edges of relations (subject, object, roles): a role decides the kind and which end comes first."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(swap).alias("swap"), (F.col("roles").bitwiseAND(bit) != 0).alias("on")) for _, bit, kind, swap in RELATIONS])
    rows = relations.select("subject", "object", F.explode(F.filter(each, lambda r: r["on"])).alias("r"))
    a, b = F.when(F.col("r.swap"), F.col("object")).otherwise(F.col("subject")), F.when(F.col("r.swap"), F.col("subject")).otherwise(F.col("object"))
    return rows.select(a.alias("src"), b.alias("dst"), F.col("r.kind").alias("kind")).filter("src <> dst").distinct()


# Kinds that a Lua export names, and the kinds of node that they are.
LUA_KINDS = {"local": "variable", "function": "function", "global": "variable", "field": "field", "method": "method"}
LUA_PLACE = "struct<file:string,startLine:int,startColumn:int,endLine:int,endColumn:int>"
LUA = f"schemaVersion int, files array<string>, nodes array<struct<name:string,kind:string,location:{LUA_PLACE},body:{LUA_PLACE}>>, edges array<struct<`from`:int,kind:string,location:{LUA_PLACE}>>, warnings array<string>"


def read_lua_export(spark, path: str) -> DataFrame:
    """Reports of a Lua exporter, one a file; a malformed one, or one of another version, fails when it is read."""
    doc = spark.read.schema(LUA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    # Both lists depend on the version, so no reader can prune the check away.
    checked = lambda c: F.when(F.col("schemaVersion") == 2, F.col(c)).otherwise(F.raise_error(F.lit("not an export of version 2")))
    return doc.withColumns({c: checked(c) for c in ("nodes", "edges")}).withColumn("report", F.input_file_name())


def lua_graph(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of Lua reports.

    Places are counted from 0 there and from 1 here. Of declarations with one
    identity (file, name, place, kind) the first counts. A use runs from the
    innermost declaration whose body holds it to what is declared; the place of
    the declaration itself, and uses outside of all bodies, say nothing. A
    relationship has the place of its first use.
    """
    declared = reports.select("report", F.posexplode("nodes").alias("pos", "n")).select("report", "pos", "n.*")
    kinds = F.create_map(*[F.lit(x) for kv in LUA_KINDS.items() for x in kv])
    start, col = F.col("location.startLine") + 1, F.col("location.startColumn") + 1
    known = declared.withColumn("node_kind", F.element_at(kinds, F.col("kind"))).filter("node_kind IS NOT NULL").withColumns({"file": F.col("location.file"), "line": start, "col": col})
    known = known.withColumn("id", F.concat("file", F.lit("#"), "name", F.lit("@"), "line", F.lit(":"), "col", F.lit(":"), "node_kind"))
    known = materialize(known, "declared")
    nodes = known.groupBy("id").agg(F.min_by(F.struct(F.col("node_kind").alias("kind"), "name", "file", "line", "col"), F.struct("report", "pos")).alias("f"))
    nodes = nodes.select("id", "f.*", F.lit("lua").alias("language"), F.lit(False).alias("external"))
    uses = reports.select("report", F.posexplode("edges").alias("use", "e")).select("report", "use", F.col("e.from").alias("n"), F.col("e.location").alias("at"))
    target = known.select("report", (F.col("pos") + 1).alias("n"), F.col("id").alias("dst"), F.col("location").alias("own"))
    uses = uses.join(target, ["report", "n"])
    place = lambda s: F.struct(F.col(f"{s}.file"), F.col(f"{s}.startLine"), F.col(f"{s}.startColumn"))
    uses = uses.filter(place("at") != place("own")).withColumn("file", F.col("at.file"))
    spot = lambda s, e: F.struct(F.col(f"{s}.{e}Line").alias("l"), F.col(f"{s}.{e}Column").alias("c"))
    spans = known.withColumn("body", F.coalesce("body", "location"))
    bodies = spans.select("report", F.col("body.file").alias("file"), F.col("id").alias("src"), "pos", spot("body", "start").alias("lo"), spot("body", "end").alias("hi"))
    at = spot("at", "start")
    held = uses.join(bodies, ["report", "file"]).filter((F.col("lo") <= at) & (at <= F.col("hi")))
    inner = held.groupBy("report", "use", "dst", "at").agg(F.max_by("src", F.struct("lo", -F.col("pos"))).alias("src")).filter("src <> dst")
    first = F.min_by(F.struct((F.col("at.startLine") + 1).alias("line"), (F.col("at.startColumn") + 1).alias("col")), F.struct("report", "use")).alias("f")
    edges = inner.groupBy("src", "dst").agg(first).select("src", "dst", F.lit("references").alias("kind"), "f.line", "f.col")
    return nodes, edges


def resolve_shard_ends(edges: DataFrame, declared: DataFrame, external: DataFrame) -> DataFrame:
    """Edges between native ids as edges between ids: declared symbols first, then external ones; others go."""
    both = declared.select("native", "id", F.lit(0).alias("p")).unionAll(external.select("native", "id", F.lit(1)))
    ids = both.groupBy("native").agg(F.min_by("id", "p").alias("id"))
    joined = edges.join(ids.select(F.col("native").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("native").alias("dst"), F.col("id").alias("d")), "dst")
    return joined.groupBy(F.col("s").alias("src"), F.col("d").alias("dst"), "kind").agg(F.min("line").alias("line"))


def package_topology(packages: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations of a package list (name, version, path, dependencies map, scripts map, main, bin).

    Packages are contained in the workspace and depend on packages of the list;
    their files are entrypoints, their scripts tasks, which are never run.
    """
    root = f"repository://{workspace}"
    pkg = packages.withColumn("id", F.concat(F.lit(root + "/package/"), "name"))
    node = lambda df, kind, id_, name, file=F.lit(None).cast("string"), path=F.lit(None).cast("string"): df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), id_.alias("coordinate"), file.alias("file"), path.alias("root"))
    tasks = pkg.select("id", F.explode("scripts").alias("task", "command"))
    entry = pkg.select("id", "path", F.explode(F.array_compact(F.array("main", "bin"))).alias("e")).withColumn("e", F.regexp_replace(F.concat_ws("/", "path", "e"), r"/\./", "/"))
    nodes = (
        node(packages.sparkSession.range(1), "workspace", F.lit(root), F.lit(workspace), path=F.lit("."))
        .unionAll(node(pkg, "package", F.col("id"), F.col("name"), path=F.col("path")))
        .unionAll(node(tasks, "task", F.concat("id", F.lit("/task/"), "task"), F.col("task")))
        .unionAll(node(entry, "entrypoint", F.concat("id", F.lit("/entrypoint/"), "e"), F.col("e"), F.col("e")))
    )
    deps = pkg.select("id", F.explode("dependencies").alias("name", "wanted")).join(pkg.select("name", F.col("id").alias("to")), "name")
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    edges = (
        edge(pkg, F.lit(root), F.col("id"), "contains")
        .unionAll(edge(deps, F.col("id"), F.col("to"), "depends-on"))
        .unionAll(edge(tasks, F.col("id"), F.concat("id", F.lit("/task/"), "task"), "contains"))
        .unionAll(edge(entry, F.concat("id", F.lit("/entrypoint/"), "e"), F.col("id"), "entrypoint-of"))
    )
    return nodes.distinct(), edges.distinct()
