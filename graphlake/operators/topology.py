"""The repository's own graph: packages, targets, tasks, and which files they hold."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions.docs import SAFE, encode_component
from graphlake.functions.text import dirname
from graphlake.sources.shared import materialize


def inspect(nodes: DataFrame, edges: DataFrame, query: str | None = None, relations: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes whose id, name or coordinate is the query (or all), what an edge ties to them, and the edges that touch one of them.

    The limit cuts the hits first; what is left of it goes to their neighbours.
    Edges are kept if both their ends are.
    """
    limit = max(1, min(500, limit))
    query = (query or "").strip()
    hits = nodes if not query else nodes.filter((F.col("id") == query) | (F.col("name") == query) | (F.col("coordinate") == query))
    seeds = hits.select("id").orderBy("id").limit(limit)  # at most 500 rows
    used = edges.filter(F.col("kind").isin(relations)) if relations else edges
    ends = [used.join(F.broadcast(seeds.select(F.col("id").alias(e))), e, "left_semi").select(*used.columns) for e in ("src", "dst")]
    used = ends[0].unionByName(ends[1]).distinct()
    near = used.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).alias("hop"))
    rank = seeds.select("id", F.lit(0).alias("hop")).unionByName(near).groupBy("id").agg(F.min("hop").alias("hop"))
    kept = nodes.join(rank, "id").orderBy("hop", "id").limit(limit)
    for end in ("src", "dst"):
        used = used.join(F.broadcast(kept.select(F.col("id").alias(end))), end, "left_semi")  # at most 500 rows
    return kept, used


def ancestors(files: DataFrame) -> DataFrame:
    """``file``, ``root`` for every folder above a file, and ``.`` for the repository."""
    parts = F.split(dirname(F.col("file")), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select("file", F.explode(F.array_distinct(F.array_append(F.filter(ups, lambda u: u != ""), F.lit(".")))).alias("root"))


def file_joins(nodes: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """``id``, ``file``: a node's own file, and every file under its root.

    That a folder begins a path becomes an equi-join: a file has a row for each
    folder above it.
    """
    own = nodes.filter("file IS NOT NULL").select("id", "file").join(files.select("file").distinct(), "file", "left_semi")
    under = nodes.filter("root IS NOT NULL").select("id", "root").join(ancestors(files.select("file").distinct()), "root").select("id", "file")
    every = own.select("id", "file").unionAll(under).distinct()
    return every if limit is None else every.orderBy("id", "file").limit(max(0, min(500, limit)))


# Families of relations between parts of a repository.
RELATIONS = "contains depends-on source-of test-of produces invokes entrypoint-of joins-file".split()


def node_id(ecosystem: str, configuration: Column, kind: str, coordinate: Column) -> Column:
    """``repository://ecosystem/configuration/kind/coordinate``, each part as a URI component."""
    return F.concat(F.lit(f"repository://{quote(ecosystem, safe=SAFE)}/"), encode_component(configuration), F.lit(f"/{quote(kind, safe=SAFE)}/"), encode_component(coordinate))


def assemble(providers: dict[str, dict[str, DataFrame]], failed: dict[str, tuple[str, str]], spark: SparkSession) -> dict[str, DataFrame]:
    """The topology of all providers: ``nodes``, ``edges``, ``coverage``, ``shards`` and ``warnings``.

    ``providers`` has each one's tables of these names (shards: key, digest);
    ``failed`` an ecosystem and a message of each that has none, which then covers
    no family. Of equal nodes and edges the first provider's (by name) counts;
    shards are named after theirs.
    """
    order = sorted(providers)
    stack = lambda t: [providers[p][t].withColumn("__p", F.lit(i)) for i, p in enumerate(order) if t in providers[p]]

    def first(t: str, key: list[str]) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stack(t))
        rest = [c for c in rows.columns if c not in (*key, "__p")]
        kept = rows.groupBy(*key).agg(F.min_by(F.struct(F.lit(0).alias("__x"), *rest), F.struct("__p", *rest)).alias("f"))
        return kept.select(*key, *[F.col(f"f.{c}").alias(c) for c in rest])

    none = spark.createDataFrame([(p, e, "unavailable", f, "unsupported") for p, (e, _) in sorted(failed.items()) for f in RELATIONS], "provider string, ecosystem string, target string, family string, state string")
    coverage = reduce(lambda a, b: a.unionByName(b), [none, *[df.drop("__p") for df in stack("coverage")]])
    shards = [providers[p]["shards"].select(F.concat(F.lit(f"{p}/"), "key").alias("key"), "digest") for p in order if "shards" in providers[p]]
    said = [f"repository context unavailable: {p}: {message}" for p, (_, message) in sorted(failed.items())]
    out = {"coverage": coverage, "warnings": spark.createDataFrame([(w,) for w in said], "text string")}
    if order:
        out |= {"nodes": first("nodes", ["id"]), "edges": first("edges", ["src", "dst", "kind"])}
    if shards:
        out["shards"] = reduce(lambda a, b: a.unionByName(b), shards)
    return out


def cargo(packages: DataFrame, members: DataFrame, resolved: DataFrame, workspace: str, folder: str = ".") -> tuple[DataFrame, DataFrame]:
    """Nodes and relations of resolved Cargo metadata.

    ``packages`` (id, name, version, path, targets: array of (name, kind array,
    file)), ``members`` (id), ``resolved`` (id, features, dependencies). A package
    contains its build targets, a target its source set, which is of the package
    (a test of it, if it is a test or bench) and is joined to its file; binaries,
    examples, tests and benches have an entry point.
    """
    eco = "cargo"
    config = F.when(F.size("features") > 0, F.concat(F.lit("features="), F.array_join(F.array_sort("features"), ","))).otherwise(F.lit("default"))
    pkg = packages.join(resolved.select("id", config.alias("configuration"), "dependencies"), "id", "left").fillna("default", ["configuration"])
    pkg = pkg.join(members.select("id").distinct().withColumn("member", F.lit(True)), "id", "left")
    pkg = pkg.withColumn("coordinate", F.concat("name", F.lit("@"), "version", F.lit(":"), "path"))
    pkg = materialize(pkg.withColumn("node", node_id(eco, F.col("configuration"), "package", F.col("coordinate"))), "packages")
    one = packages.sparkSession.range(1)
    root = one.select(node_id(eco, F.lit("default"), "workspace", F.lit(folder)).alias("id")).first()["id"]
    t = pkg.select("node", "id", "configuration", F.explode("targets").alias("t")).withColumn("kinds", F.array_join("t.kind", "+"))
    t = t.withColumn("coordinate", F.concat("id", F.lit("#"), "t.name", F.lit(":"), "kinds"))
    t = materialize(t.withColumns({"target": node_id(eco, F.col("configuration"), "build-target", F.col("coordinate")), "set": node_id(eco, F.col("configuration"), "source-set", F.col("coordinate")), "entry": node_id(eco, F.col("configuration"), "entrypoint", F.col("coordinate"))}), "targets")
    runs = t.filter(F.arrays_overlap("t.kind", F.array(*map(F.lit, ("bin", "example", "test", "bench")))))
    null = F.lit(None).cast("string")
    node = lambda df, id_, kind, name, coordinate, external, file=null, root=null: df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), coordinate.alias("coordinate"), external.alias("external"), file.alias("file"), root.alias("root"))
    outside = F.rlike("t.file", F.lit(r"^(/|\.\./)"))
    nodes = [
        node(one, F.lit(root), "workspace", F.lit(workspace), F.lit(folder), F.lit(False), root=F.lit(folder)),
        node(pkg, F.col("node"), "package", F.col("name"), F.col("coordinate"), F.col("member").isNull()),
        node(t, F.col("target"), "build-target", F.col("t.name"), F.col("coordinate"), outside, F.col("t.file")),
        node(t, F.col("set"), "source-set", F.col("kinds"), F.col("coordinate"), outside, F.col("t.file")),
        node(runs, F.col("entry"), "entrypoint", F.col("t.name"), F.col("coordinate"), outside, F.col("t.file")),
    ]
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    ids = pkg.select(F.col("id").alias("dependency"), F.col("node").alias("to"))
    deps = pkg.select("node", F.explode("dependencies").alias("dependency")).join(ids, "dependency")
    tests = F.array_contains("t.kind", "test") | F.array_contains("t.kind", "bench")
    edges = [
        edge(pkg.filter("member"), F.lit(root), F.col("node"), "contains"),
        edge(t, F.col("node"), F.col("target"), "contains"),
        edge(t, F.col("target"), F.col("set"), "contains"),
        edge(t, F.col("set"), F.col("node"), "source-of"),
        edge(t, F.col("set"), F.col("t.file"), "joins-file"),
        edge(t.filter(tests), F.col("set"), F.col("node"), "test-of"),
        edge(runs, F.col("target"), F.col("entry"), "contains"),
        edge(runs, F.col("entry"), F.col("target"), "entrypoint-of"),
        edge(runs, F.col("entry"), F.col("t.file"), "joins-file"),
        edge(deps, F.col("node"), F.col("to"), "depends-on"),
    ]
    join = lambda rows: reduce(lambda a, b: a.unionByName(b), rows).distinct()
    return join(nodes), join(edges)


#: Lines of a Gradle model: a letter and fields in URL-safe base64 without padding, between tabs.
GRADLE = {"M": ("path", "name", "folder"), "T": ("path", "task", "name"), "S": ("path", "kind", "folder", "generated"), "D": ("path", "module")}


def read_gradle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The rows of a Gradle model by their letter: modules, tasks, source folders and dependencies."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p"))

    def field(i: int) -> Column:
        text = F.translate(F.get("p", F.lit(i)), "-_", "+/")
        return F.decode(F.unbase64(F.rpad(text, F.ceil(F.length(text) / 4) * 4, F.lit("="))), "UTF-8")

    return {k: parts.filter(F.get("p", F.lit(0)) == k).select(*[field(i).alias(c) for i, c in enumerate(names, 1)]) for k, names in GRADLE.items()}


def gradle(model: dict[str, DataFrame], workspace: str, root: str) -> tuple[DataFrame, DataFrame, int]:
    """Nodes and relations of a Gradle model, and how many dependencies name no module, or several.

    The workspace contains projects, a project its build target and its tasks
    (which are never run), a target its source folders; a folder is of the project,
    and a test of it if its kind says so. A dependency is a module's path, or a
    name that one module alone has.
    """
    eco, default, null = "gradle", F.lit("default"), F.lit(None).cast("string")
    ident = lambda kind, coordinate: node_id(eco, default, kind, coordinate)
    relative = lambda c: F.when(c == root, F.lit(".")).when(F.startswith(c, F.lit(root + "/")), F.substring(c, len(root) + 2, 1 << 20)).otherwise(c)
    m = materialize(model["M"].withColumns({"project": ident("project", F.col("path")), "target": ident("build-target", F.col("path"))}), "modules")
    one = m.sparkSession.range(1)
    top = one.select(ident("workspace", F.lit(".")).alias("id")).first()["id"]
    s = model["S"].join(m.select("path", "project", "target"), "path").withColumn("at", relative(F.col("folder")))
    s = s.withColumn("coordinate", F.concat("path", F.lit(":"), "at")).withColumn("role", F.when(F.col("generated") == "true", "generated-root").otherwise("source-root"))
    s = materialize(s.withColumn("id", F.when(F.col("role") == "source-root", ident("source-root", F.col("coordinate"))).otherwise(ident("generated-root", F.col("coordinate")))), "folders")
    t = model["T"].join(m.select("path", "project"), "path").withColumn("id", ident("task", F.col("task")))
    node = lambda df, id_, kind, name, coordinate, external=F.lit(False), folder=null: df.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), coordinate.alias("coordinate"), external.alias("external"), null.alias("file"), folder.alias("root"))
    nodes = [
        node(one, F.lit(top), F.lit("workspace"), F.lit(workspace), F.lit(".")),
        node(m, F.col("project"), F.lit("project"), F.col("name"), F.col("path")),
        node(m, F.col("target"), F.lit("build-target"), F.col("path"), F.col("path")),
        node(s, F.col("id"), F.col("role"), F.substring_index("folder", "/", -1), F.col("coordinate"), F.startswith("at", F.lit("/")), F.col("at")),
        node(t, F.col("id"), F.lit("task"), F.col("name"), F.col("task")),
    ]
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    by_path = m.select(F.col("path").alias("module"), F.col("project").alias("p"))
    by_name = m.groupBy(F.col("name").alias("module")).agg(F.count("*").alias("n"), F.min("project").alias("q")).filter("n = 1").drop("n")
    d = model["D"].join(m.select("path", "project"), "path").join(by_path, "module", "left").join(by_name, "module", "left")
    d = materialize(d.select("project", F.coalesce("p", "q").alias("to")), "dependencies")
    edges = [
        edge(m, F.lit(top), F.col("project"), "contains"),
        edge(m, F.col("project"), F.col("target"), "contains"),
        edge(s, F.col("target"), F.col("id"), "contains"),
        edge(s, F.col("id"), F.col("project"), "source-of"),
        edge(s.filter(F.startswith("kind", F.lit("test"))), F.col("id"), F.col("project"), "test-of"),
        edge(t, F.col("project"), F.col("id"), "contains"),
        edge(d.filter("to IS NOT NULL"), F.col("project"), F.col("to"), "depends-on"),
    ]
    join = lambda rows: reduce(lambda a, b: a.unionByName(b), rows).distinct()
    return join(nodes), join(edges), d.filter("to IS NULL").count()


def fence(code_project: str, topology_project: str, generation: str | None, confirmed: str | None, published: bool) -> dict[str, str | None]:
    """Whether files of a topology may be tied to code: one project, a topology that was published, and code that stood still while it was read."""
    reason = None
    if code_project != topology_project:
        reason = "the code and the topology are of different projects"
    elif not published:
        reason = "no provider published a topology"
    elif generation is None:
        reason = "the code says no input generation"
    elif generation != confirmed:
        reason = "the code moved while the topology was read"
    return {"state": "unavailable" if reason else "compatible", "codeInputGeneration": generation, "reason": reason}


def verdict(n_nodes: int, n_hits: int) -> str:
    return "outside" if not n_nodes else "answer" if n_hits else "clarify"
