"""From rows of a reader to a graph: kinds, identities, duplicates, derived nodes and edges, checks.

Tables are ``nodes`` (id, kind, language, name, qualified_name, file, external,
...) and ``edges`` (src, dst, kind, line, ...). Where an earlier or later row
wins, ``ord`` says which is which.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.functions.text import callable_base, member_key, owner_key
from graphlake.schema import EDGE_KINDS, NODE_KINDS
from graphlake.sources.shared import materialize

EDGE_KEY = ["src", "dst", "kind"]


def full_name() -> Column:
    return F.coalesce("qualified_name", "name")


def normalise_kinds(nodes: DataFrame) -> DataFrame:
    """A variable whose owner (by file and dotted name) is a class or interface is a property; the last owner of a name counts."""
    owners = nodes.groupBy(F.col("file").alias("f"), full_name().alias("o")).agg(F.max_by("kind", "ord").alias("owner_kind"))
    keyed = nodes.withColumn("o", owner_key(full_name())).withColumn("f", F.col("file"))
    kind = F.when((F.col("kind") == "variable") & F.col("owner_kind").isin("class", "interface"), "property").otherwise(F.col("kind"))
    return keyed.join(owners, ["f", "o"], "left").withColumn("kind", kind).select(*nodes.columns)


def mark_closures(nodes: DataFrame) -> DataFrame:
    """A declaration inside a function, method or constructor (by its dotted name, in its file) is a closure."""
    callables = nodes.filter(F.col("kind").isin("function", "method", "constructor")).select("file", full_name().alias("up")).distinct()
    parts = F.split(full_name(), r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    inside = (
        nodes.filter(F.contains(full_name(), F.lit(".")))
        .select("id", "file", F.explode(ups).alias("up"))
        .join(callables, ["file", "up"], "left_semi")
        .select("id")
        .distinct()
        .withColumn("__in", F.lit(True))
    )
    return nodes.drop("closure").join(inside, "id", "left").withColumn("closure", F.coalesce("__in", F.lit(False))).drop("__in")


def mark_ignored(nodes: DataFrame, ignored_files: DataFrame) -> DataFrame:
    """Nodes of files that version control ignores (``file``)."""
    listed = ignored_files.select("file").distinct().withColumn("__ig", F.lit(True))
    marked = F.coalesce("__ig", F.col("ignored"), F.lit(False))
    return nodes.join(listed, "file", "left").withColumn("ignored", marked).select(*nodes.columns)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row of each (src, dst, kind): the first."""
    rest = [c for c in edges.columns if c not in (*EDGE_KEY, "ord")]
    first = F.min_by(F.struct(*rest), "ord").alias("__first")
    got = edges.groupBy(*EDGE_KEY).agg(first, F.min("ord").alias("ord"))
    return got.select(*[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in edges.columns])


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row of each id: the last."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    got = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("__last"), F.max("ord").alias("ord"))
    return got.select(*[F.col(f"__last.{c}").alias(c) if c in rest else F.col(c) for c in nodes.columns])


def merge_semantic_nodes(nodes: DataFrame, facts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of one semantic id as one: flags are or-ed, the first two places are its evidence and implementation.

    Returns the merged rows and the ids whose ``facts`` disagree, which the
    caller reports.
    """
    fact = F.to_json(F.struct(*facts), {"ignoreNullFields": "false"})
    places = F.array_sort(F.array_distinct(F.collect_list(F.struct("file", "line"))))
    got = nodes.groupBy("id").agg(
        F.count_distinct(fact).alias("__facts"),
        F.min_by(F.struct(*facts), "ord").alias("__f"),
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("ignored", "exported", "closure") if c in nodes.columns],
        places.alias("__at"),
        F.min("ord").alias("ord"),
    )
    flags = [c for c in ("ignored", "exported", "closure") if c in nodes.columns]
    merged = got.filter("__facts = 1").select(
        "id", *[F.col(f"__f.{c}").alias(c) for c in facts], *flags,
        F.get("__at", F.lit(0)).alias("evidence"), F.get("__at", F.lit(1)).alias("implementation"), "ord",
    )
    return merged, got.filter("__facts > 1").select("id")


def synthesise_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A file node for every file of the workspace with declarations, and for every path that an edge leaves from.

    A file has the language of its first declaration (by ``ord``, else by id); a
    bare path that of the first node it leads to, or is unknown.
    """
    order = F.col("ord") if "ord" in nodes.columns else F.col("id")
    own = nodes.filter(~F.col("external") & (F.col("file") != "") & (F.col("kind") != "file"))
    of_nodes = own.groupBy(F.col("file").alias("id")).agg(F.min_by("language", order).alias("language"))
    first = F.col("ord") if "ord" in edges.columns else F.col("dst")
    bare = edges.select("src", "dst", first.alias("__o")).join(nodes.select(F.col("id").alias("src")), "src", "left_anti").filter((F.col("src") != "") & ~F.contains("src", F.lit("#")))
    bare = bare.join(nodes.select(F.col("id").alias("dst"), "language"), "dst", "left")
    of_edges = bare.groupBy(F.col("src").alias("id")).agg(F.coalesce(F.min_by("language", "__o"), F.lit("unknown")).alias("language"))
    every = of_nodes.unionByName(of_edges.join(of_nodes.select("id"), "id", "left_anti"))
    made = every.join(nodes.select("id"), "id", "left_anti")
    named = {"kind": F.lit("file"), "name": F.substring_index("id", "/", -1), "file": F.col("id"), "external": F.lit(False), "ignored": F.lit(False), "exported": F.lit(False), "closure": F.lit(False)}
    cols = [named[c].alias(c) if c in named else F.col(c) if c in ("id", "language") else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]
    return nodes.unionByName(made.select(*cols))


def synthesise_containment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A contains edge to every declaration from its owner by dotted name in its file, or else from its file, unless there is that edge.

    Of several owners of a name the last counts (by ``ord``, else by id).
    """
    order = F.col("ord") if "ord" in nodes.columns else F.col("id")
    local = nodes.filter(~F.col("external") & (F.col("kind") != "file"))
    owners = local.groupBy("file", full_name().alias("__o")).agg(F.max_by("id", order).alias("owner"))
    keyed = local.filter(F.col("file") != "").select(F.col("id").alias("dst"), "file", owner_key(full_name()).alias("__o"))
    made = keyed.join(owners, ["file", "__o"], "left").select(F.coalesce("owner", "file").alias("src"), "dst", F.lit("contains").alias("kind"))
    made = made.join(edges.filter("kind = 'contains'").select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    cols = [F.col(c) if c in EDGE_KEY else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns]
    return edges.unionByName(made.select(*cols))


def override_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of types tied by implements or extends that share a name, arguments included, which is unique on both sides."""
    pairs = edges.filter(F.col("kind").isin("implements", "extends")).select("src", "dst", F.col("kind").alias("how"))
    members = (
        edges.filter("kind = 'contains'")
        .select(F.col("src").alias("owner"), F.col("dst").alias("id"))
        .distinct()
        .join(nodes.filter(F.col("kind").isin("method", "property", "field")).select("id", member_key(F.col("name")).alias("key")), "id")
    )
    unique = members.groupBy("owner", "key").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    own = unique.select(F.col("owner").alias("src"), "key", F.col("id").alias("a"))
    base = unique.select(F.col("owner").alias("dst"), "key", F.col("id").alias("b"))
    kind = F.when(F.col("how") == "implements", "implements").otherwise("overrides")
    return pairs.join(own, "src").join(base, ["dst", "key"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("kind")).distinct()


def export_surface(own: DataFrame, forwards: DataFrame) -> DataFrame:
    """What each file exports: its own names and what it forwards.

    ``own`` (file, id, name); ``forwards`` (file, source, name), a null name
    forwards all. The least fixpoint, by semi-naive rounds: each joins what the
    last one found with the forwards and keeps what is new.
    """
    found = materialize(own.select("file", "id", "name").distinct(), "surface")
    delta = found
    while not delta.isEmpty():
        f = forwards.select(F.col("file").alias("to"), F.col("source").alias("file"), F.col("name").alias("only"))
        nxt = delta.join(f, "file").filter(F.col("only").isNull() | (F.col("only") == F.col("name")))
        nxt = nxt.select(F.col("to").alias("file"), "id", "name").distinct().join(found, ["file", "id", "name"], "left_anti")
        delta = materialize(nxt, "surface")
        found = found.unionByName(delta)
    return found.select("file", "id").distinct()


def export_edges(nodes: DataFrame, forwards: DataFrame) -> DataFrame:
    """``src`` (a file), ``dst``, ``kind``: every file that puts a declaration on the wire, itself or by forwarding it."""
    own = nodes.filter(~F.col("external") & (F.col("file") != "") & F.col("exported")).select("file", "id", "name")
    return export_surface(own, forwards).select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("exports").alias("kind"))


def finalise(nodes: DataFrame, edges: DataFrame, forwards: DataFrame, ignored_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The facts that no single file shows: kinds of members, closures, what is ignored, and the export surface.

    Doing it again changes nothing.
    """
    if "ord" not in nodes.columns:
        nodes = nodes.withColumn("ord", F.col("id"))
    nodes = mark_closures(normalise_kinds(nodes))
    if ignored_files is not None:
        nodes = mark_ignored(nodes, ignored_files)
    nodes = materialize(nodes, "nodes")
    made = export_edges(nodes, forwards).join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    cols = [F.col(c) if c in EDGE_KEY else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns]
    return nodes, edges.unionByName(made.select(*cols))


def resolve_modules(imports: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """``target`` of each import (file, path): the first of ``path + suffix`` that is a file."""
    tried = F.posexplode(F.array(*map(F.lit, suffixes))).alias("rank", "suffix")
    tries = imports.select("file", "path", tried).withColumn("target", F.concat("path", "suffix"))
    hits = tries.join(files.select(F.col("file").alias("target")), "target", "left_semi")
    return hits.groupBy("file", "path").agg(F.min_by("target", "rank").alias("target"))


def merge_lanes(strict: DataFrame, generic: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both lanes, strict ones first; a key in both is an error when the table is read."""
    both = strict.select(*key).distinct().join(generic.select(*key).distinct(), key, "left_semi").limit(1).count()
    if both:
        raise ValueError(f"both lanes have rows of one {', '.join(key)}")
    return strict.withColumn("lane", F.lit(0)).unionByName(generic.withColumn("lane", F.lit(1)), allowMissingColumns=True)


def lane_overlap(strict: DataFrame, generic: DataFrame, key: list[str]) -> DataFrame:
    return strict.select(*key).distinct().join(generic.select(*key).distinct(), key, "left_semi")


def _rule(df: DataFrame, text: str, *subject: str) -> DataFrame:
    return df.select(F.lit(text).alias("rule"), F.concat_ws(" ", *(subject or EDGE_KEY)).alias("subject"))


#: Paths are relative, with single slashes and no steps back, or name what a tool bundles.
_PATH = r"^(?!/)(?!.*(^|/)\.{0,2}(/|$))(?!.*[\\\x00])(?!^[A-Za-z]:).+$"
_ID = r"^(.*[^\\]|)#.*:([a-z_]+)$"


def violations(
    nodes: DataFrame,
    edges: DataFrame,
    coverage: DataFrame | None = None,
    unresolved: DataFrame | None = None,
    languages: list[str] | None = None,
    provenance: DataFrame | None = None,
) -> DataFrame:
    """``rule`` and ``subject`` of everything that makes a graph invalid.

    Spans are read where the tables have them (``line`` and ``end_line``); the
    trust tables are held against each other where they are given.
    """
    ids, files = nodes.select("id"), nodes.select("file").distinct()
    null = F.lit("\0")
    text = F.col("id").isNull() | (F.col("id") == "") | F.contains("id", null) | F.col("name").isNull() | (F.col("name") == "") | F.contains("name", null)
    if "qualified_name" in nodes.columns:
        text = text | F.coalesce((F.col("qualified_name") == "") | F.contains("qualified_name", null), F.lit(False))
    fileless = F.col("external") & (F.col("kind") == "external_symbol") & (F.col("file") == "")
    bundled = F.startswith("file", F.lit("bundled://"))
    old = ~F.startswith("id", F.lit("@v2/")) & ~F.startswith("id", F.lit("@g2/")) & ~fileless & (F.col("kind") != "file") & F.contains("id", F.lit("#"))
    found = [
        _rule(nodes.groupBy("id").count().filter("count > 1"), "duplicate node", "id"),
        _rule(nodes.filter(text), "identity or name is empty", "id"),
        _rule(nodes.filter(~F.col("kind").isin(NODE_KINDS) | F.col("kind").isNull()), "unknown node kind", "id"),
        _rule(nodes.filter(F.col("file").isNull() | ~fileless & ~bundled & ~F.rlike("file", F.lit(_PATH))), "path is not canonical", "id"),
        _rule(nodes.filter(old & ((F.regexp_extract("id", _ID, 2) != F.col("kind")) | ~F.startswith("id", F.concat(F.regexp_replace("file", "([#\\\\])", r"\\$1"), F.lit("#"))))), "id does not match its file and kind", "id"),
        _rule(edges.groupBy(*EDGE_KEY).count().filter("count > 1"), "duplicate edge"),
        _rule(edges.filter(~F.col("kind").isin(EDGE_KINDS) | F.col("kind").isNull()), "unknown edge kind"),
    ]
    for df, subject in ((nodes, ("id",)), (edges, tuple(EDGE_KEY))):
        if "line" in df.columns:
            found.append(_rule(df.filter(F.col("line") < 1), "line is not positive", *subject))
            if "end_line" in df.columns:
                found.append(_rule(df.filter(F.col("end_line") < F.col("line")), "span ends before it begins", *subject))
    for e in ("src", "dst"):
        open_ends = edges.select(F.col(e).alias("id"), *EDGE_KEY).join(ids, "id", "left_anti").join(files.select(F.col("file").alias("id")), "id", "left_anti")
        found.append(_rule(open_ends, f"missing {e}"))
    if languages is not None:
        found.append(_rule(nodes.filter(~F.col("language").isin(languages)), "language is not of the dump", "id"))
    if provenance is not None:
        found += provenance_violations(provenance, languages)
    if coverage is not None:
        key = ["provider", "language", "target", "family"]
        rows = coverage.groupBy(*key[:3]).agg(F.count_distinct("family").alias("n"))
        found.append(_rule(rows.filter(F.col("n") != len(EDGE_KINDS)), "coverage is not exhaustive", *key[:3]))
        found.append(_rule(coverage.groupBy(*key).count().filter("count > 1"), "duplicate coverage", *key))
        if provenance is not None:
            said = provenance.select("provider", F.explode("languages").alias("language"))
            found.append(_rule(said.join(coverage, ["provider", "language"], "left_anti"), "coverage is missing", "provider", "language"))
        if unresolved is not None:
            left = unresolved.join(coverage.filter("state = 'partial'").select(*key), key, "left_anti")
            found.append(_rule(left.distinct(), "unresolved without partial coverage", "provider", "family"))
    if unresolved is not None and provenance is not None:
        owners = provenance.select("provider", F.explode("languages").alias("language"), "universe")
        found.append(_rule(unresolved.join(owners, ["provider", "language", "universe"], "left_anti").select("provider", "language", "universe").distinct(), "unresolved of another universe", "provider", "language"))
    return reduce(lambda a, b: a.unionAll(b), found)


def provenance_violations(provenance: DataFrame, languages: list[str] | None = None) -> list[DataFrame]:
    """Rules on who says what: (provider, languages, facts, capabilities, tool, schema_version, protocol_version, universe, manifest, content)."""
    digest = r"^[0-9a-f]{64}$"
    repeated = F.lit(False)
    for c in ("languages", "facts", "capabilities"):
        repeated = repeated | (F.size(c) != F.size(F.array_distinct(c)))
    envelope = (F.size("languages") == 0) | (F.col("tool") == "") | (F.col("schema_version") < 1) | (F.col("protocol_version") < 0)
    envelope = envelope | F.array_contains("capabilities", "") | ~F.array_contains("capabilities", "universe")
    found = [
        _rule(provenance.groupBy("provider").count().filter("count > 1 OR provider = ''"), "provider is empty or there twice", "provider"),
        _rule(provenance.filter(repeated), "a list of the provider repeats itself", "provider"),
        _rule(provenance.filter(envelope), "the producer's envelope is invalid", "provider"),
    ]
    found += [_rule(provenance.filter(~F.rlike(c, F.lit(digest))), f"{c} is no SHA-256", "provider") for c in ("universe", "manifest", "content")]
    if languages is not None:
        claimed = provenance.select("provider", F.explode("languages").alias("language")).filter(~F.col("language").isin(languages))
        found.append(_rule(claimed, "provider claims an absent language", "provider", "language"))
    return found


def coverage_matrix(languages: DataFrame, supported: list[str], provider: str = "static") -> DataFrame:
    """Languages times families: partial where supported. Both sides are lists of a fixed length."""
    families = F.explode(F.array(*map(F.lit, EDGE_KINDS))).alias("family")
    rows = languages.select("language").distinct().select(F.lit(provider).alias("provider"), "language", families)
    return rows.withColumn("state", F.when(F.col("family").isin(supported), "partial").otherwise("unsupported"))


def legacy_handles(nodes: DataFrame) -> DataFrame:
    """``handle`` of each node of a semantic id: file, name (with and without arguments) and kind."""
    bare = F.when(F.col("kind").isin("function", "method", "constructor"), callable_base(full_name())).otherwise(full_name())
    names = F.array_distinct(F.array(full_name(), bare))
    return nodes.select("id", F.explode(names).alias("n"), "file", "kind").select("id", F.concat("file", F.lit("#"), "n", F.lit(":"), "kind").alias("handle"))


def innermost_owner(uses: DataFrame, scopes: DataFrame) -> DataFrame:
    """``owner`` of each use (file, pos): the innermost scope (file, start, end, owner) that holds it.

    An equi-join on the file and a range within it; of several, the one that
    starts last, then ends first.
    """
    held = uses.join(scopes, "file").filter((F.col("start") <= F.col("pos")) & (F.col("pos") <= F.col("end")))
    rank = F.struct(-F.col("start"), F.col("end"), F.col("owner"))
    return held.groupBy(*uses.columns).agg(F.min_by("owner", rank).alias("owner"))


def distant_owners(declarations: DataFrame) -> DataFrame:
    """Contains edges to members that name their owner and lie outside of it: C++ definitions out of line, Swift extensions.

    ``declarations`` (id, language, kind, full, owner_id, owner_name, has_body,
    exported). In C++ the owner is a type of that name, or else one that is so
    called without its anonymous namespaces; of several, one with a body, then one
    that is exported, then the smallest id. In Swift it is the sole type of the name.
    """
    types = F.col("kind").isin("class", "interface", "namespace", "module", "enum")
    loose = declarations.filter("owner_id IS NULL AND owner_name IS NOT NULL").select(F.col("id").alias("dst"), "language", F.col("owner_name").alias("full"))
    cpp = declarations.filter((F.col("language") == "cpp") & types)
    bare = F.array_join(F.filter(F.split("full", r"\."), lambda n: n != "(anonymous namespace)"), ".")
    best = F.struct((~F.col("has_body")).alias("b"), (~F.col("exported")).alias("e"), F.col("id").alias("i"))
    exact = cpp.select("full", best.alias("k"), F.lit(0).alias("tier"), "id")
    alias = cpp.filter(bare != F.col("full")).select(bare.alias("full"), best.alias("k"), F.lit(1).alias("tier"), "id")
    named = exact.unionByName(alias).groupBy("full").agg(F.min_by("id", F.struct("tier", "k")).alias("src"))
    swift = declarations.filter(F.col("language") == "swift").filter(F.col("kind").isin("class", "interface", "enum", "type"))
    sole = swift.groupBy("full").agg(F.count("*").alias("n"), F.min("id").alias("src")).filter("n = 1").drop("n")
    made = loose.filter("language = 'cpp'").join(named, "full").unionByName(loose.filter("language = 'swift'").join(sole, "full"))
    return made.filter("src <> dst").select("src", "dst", F.lit("contains").alias("kind"))


def sole_endpoint(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``target`` of references (ref, name, file): the sole node of the name in the file, else the sole one anywhere.

    A tie gives no row.
    """
    in_file = nodes.groupBy("name", "file").agg(F.count("*").alias("n"), F.min("id").alias("target"))
    anywhere = in_file.groupBy("name").agg(F.sum("n").alias("all_n"), F.min("target").alias("all_target"))
    # Counts meet the references, never the nodes themselves: names that thousands share make no pairs.
    near = refs.select("ref", "name", "file").join(in_file, ["name", "file"], "left")
    far = near.filter("n IS NULL").select("ref", "name").join(anywhere, "name")
    none = F.lit(None).cast("string")
    every = near.filter("n IS NOT NULL").select("ref", "n", "target", F.lit(0).cast("long").alias("all_n"), none.alias("all_target"))
    every = every.unionByName(far.select("ref", F.lit(0).cast("long").alias("n"), none.alias("target"), "all_n", "all_target"))
    found = every.groupBy("ref").agg(*[F.sum(c).alias(c) for c in ("n", "all_n")], *[F.min(c).alias(c) for c in ("target", "all_target")])
    return found.filter("n = 1 OR n = 0 AND all_n = 1").select("ref", F.coalesce("target", "all_target").alias("target"))
