"""Graph queries over the standard tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import docs
from graphlake.functions import text as X
from graphlake.operators import assembly, contract, degrees, details, handles, identity, lookup, overview, reduce, topology, tour, trace, trust
from graphlake.plans import testgraph
from graphlake.sources import artifacts, snapshots
from graphlake.sources.static import tables
from graphlake.streaming import generations

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Callable], Query]:
    """Register a function of (spark, sf_dir, nodes, edges); its SQL sees ``nodes`` and ``edges``."""

    def add(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir, *testgraph.build(spark, sf_dir))

        _queries[f.__name__] = run
        if sql:
            body = sql.strip()
            more = body[4:].lstrip() if body.upper().startswith("WITH") else None
            head = "WITH RECURSIVE " if recursive else "WITH "
            _sql[f.__name__] = head + testgraph.SQL.strip() + (", " + more if more else "\n" + body)
        return run

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REAL = "kind NOT IN ('contains', 'exports', 'imports')"
EXEC = "kind IN ('calls', 'instantiates', 'accesses', 'renders')"
DEGREE = f"""
degree AS (
  SELECT n.id, coalesce(i.a, 0) AS in_all, coalesce(o.a, 0) AS out_all, coalesce(i.r, 0) AS in_real, coalesce(o.r, 0) AS out_real,
         coalesce(i.x, 0) AS in_exec, coalesce(o.x, 0) AS out_exec, coalesce(i.e, 0) AS export_fan_in
  FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) n
  LEFT JOIN (SELECT dst AS id, count(*) AS a, count(*) FILTER (WHERE {REAL}) AS r, count(*) FILTER (WHERE {EXEC}) AS x,
                    count(*) FILTER (WHERE kind = 'exports') AS e FROM edges GROUP BY dst) i ON i.id = n.id
  LEFT JOIN (SELECT src AS id, count(*) AS a, count(*) FILTER (WHERE {REAL}) AS r, count(*) FILTER (WHERE {EXEC}) AS x FROM edges GROUP BY src) o ON o.id = n.id
)
"""


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def overview_counts(spark, sf, nodes, edges):
    return overview.counts(nodes)


SHOWN = "coalesce(qualified_name, name)"


@query("""
SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT file) AS files, sum(exported::INT)::BIGINT AS exported
FROM nodes JOIN flags USING (id) WHERE NOT external AND NOT ignored AND NOT support GROUP BY 1 ORDER BY files DESC, dir LIMIT 10
""")
def overview_layers(spark, sf, nodes, edges):
    return overview.layers(nodes)


@query("SELECT count(*) FILTER (WHERE kind = 'file') AS files, count(*) AS nodes, (SELECT count(*) FROM edges) AS edges FROM nodes")
def overview_totals(spark, sf, nodes, edges):
    return overview.totals(nodes, edges)


@query(f"""
WITH {DEGREE} SELECT nodes.id, {SHOWN} AS name, kind, in_real AS fan_in, out_real AS fan_out FROM nodes JOIN flags USING (id) JOIN degree USING (id)
WHERE NOT external AND NOT ignored AND NOT support AND in_real + out_real > 0 ORDER BY in_real + out_real DESC, id LIMIT 10
""")
def overview_hotspots(spark, sf, nodes, edges):
    return overview.hotspots(nodes, degrees.degrees(edges))


@query(rf"""
WITH {DEGREE} SELECT nodes.id, {SHOWN} AS name, kind, file, coalesce(in_real + out_real, 0) AS degree FROM nodes JOIN flags USING (id) LEFT JOIN degree USING (id)
WHERE exported AND NOT external AND kind IN ('class', 'interface', 'function', 'type', 'enum') AND NOT support AND NOT regexp_matches(file, '(^|/|\.)typings\.[cm]?ts$|(^|/)internal/')
ORDER BY degree DESC, id LIMIT 15
""")
def overview_public_api(spark, sf, nodes, edges):
    return overview.public_api(nodes, degrees.degrees(edges))


@query("SELECT id, test AS is_test, support AS is_support, outside AS is_external FROM flags")
def path_classes(spark, sf, nodes, edges):
    file = F.col("file")
    return nodes.select("id", X.is_test_path(file).alias("is_test"), X.is_support_path(file).alias("is_support"), X.is_external(F.col("external"), file).alias("is_external"))


@query(f"WITH {DEGREE} SELECT * FROM degree")
def degree_real(spark, sf, nodes, edges):
    return degrees.degrees(edges)


@query("SELECT dst AS id, count(*) AS export_fan_in FROM edges WHERE kind = 'exports' GROUP BY dst")
def export_fan_in(spark, sf, nodes, edges):
    return degrees.export_fan_in(edges)


WORDS = "list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda w: len(w) > 0), lambda w: lower(w))"


def _lookup_sql(whole: str, terms: list[str], codes: list[str], kinds: list[str], internal: bool, support: bool) -> str:
    """The score in SQL, for a query whose words, spelled-out names and wishes are given."""
    hit = "CASE WHEN list_contains(nw, '{0}') THEN 12 WHEN list_contains(fw, '{0}') THEN 8 WHEN contains(n, '{0}') THEN 5 WHEN list_contains(pw, '{0}') THEN 3 ELSE 0 END"
    inside = "(list_contains(nw, '{0}') OR list_contains(fw, '{0}') OR contains(n, '{0}'))"
    code = "CASE WHEN n = '{0}' OR q = '{0}' THEN 110 WHEN ends_with(q, '.{0}') THEN 95 WHEN contains('{0}', '.') AND ends_with(q, '{0}') THEN 85 ELSE 0 END"
    asked = f"CASE WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN 16 ELSE 0 END" if kinds else "0"
    return f"""
WITH {DEGREE}, named AS (
  SELECT nodes.*, test, support, lower(name) AS n, lower({SHOWN}) AS q, {WORDS.format('name')} AS nw, {WORDS.format(SHOWN)} AS fw, {WORDS.format('file')} AS pw
  FROM nodes JOIN flags USING (id) WHERE NOT outside
), based AS (
  SELECT *, CASE WHEN n = '{whole}' OR q = '{whole}' THEN 100 WHEN contains(q, '.') AND contains('{whole}', q) THEN 85 WHEN contains('{whole}', '.') AND contains(q, '{whole}') THEN 60 ELSE 0 END
    + {" + ".join([hit.format(t) for t in terms] + [code.format(c) for c in codes])} + {asked}
    + CASE WHEN {" AND ".join(inside.format(t) for t in terms)} THEN 10 ELSE 0 END + CASE WHEN starts_with(n, '{terms[0]}') THEN 4 ELSE 0 END AS base FROM named
), scored AS (
  SELECT id, file, floor(round((base + least(8, 2 * log2(1 + coalesce(in_real + out_real, 0)))) * (1 + least(0.4, 0.14 * log2(1 + coalesce(export_fan_in, 0))))
    * CASE WHEN ignored THEN 0.3 ELSE 1 END * CASE WHEN test THEN 0.7 ELSE 1 END * CASE WHEN support AND NOT {support} THEN 0.35 ELSE 1 END
    * CASE WHEN NOT {internal} AND (starts_with({SHOWN}, '_') OR contains({SHOWN}, '._') OR list_has_any(fw, ['internal', 'internals'])) THEN 0.82 ELSE 1 END, 6) + 0.5)::BIGINT AS score
  FROM based LEFT JOIN degree USING (id) WHERE base > 0
)
"""


LOOKUP = "supplier 7 class"
LOOKUP_SQL = _lookup_sql("supplier 7 class", ["supplier", "7", "class"], [], ["class"], False, False)
#: Spells out names, asks for two kinds, for tests and for what is internal; one word stands twice.
SPELLED = "`order7` method or Customer.order12 function in internal tests, order7"
SPELLED_SQL = _lookup_sql(
    "`order7` method or customer.order12 function in internal tests, order7",
    ["order7", "method", "or", "customer", "order12", "function", "in", "internal", "tests", "order7"], ["order7", "order12", "customer.order12"],
    ["constructor", "function", "method", "variable"], True, True,
)
PER_FILE = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS r FROM scored) SELECT id, file, score FROM ranked WHERE r <= 3 ORDER BY score DESC, id LIMIT 5"


@query(LOOKUP_SQL + " SELECT * FROM scored")
def lookup_score(spark, sf, nodes, edges):
    return lookup.score(nodes, degrees.degrees(edges), LOOKUP)


@query(SPELLED_SQL + " SELECT * FROM scored")
def lookup_spelled(spark, sf, nodes, edges):
    return lookup.score(nodes, degrees.degrees(edges), SPELLED)


@query(LOOKUP_SQL + PER_FILE)
def lookup_topk_per_file(spark, sf, nodes, edges):
    return lookup.lookup(nodes, degrees.degrees(edges), LOOKUP)


def _handles(nodes: DataFrame) -> DataFrame:
    """Ids, names, old handles, dotted ends, names without arguments, names in a file, other spellings, and some that nothing has."""
    full, base = F.coalesce("qualified_name", "name"), F.split_part("name", F.lit("("), F.lit(1))
    types = nodes.filter(F.col("kind").isin("class", "module")).select(F.explode(F.array("id", "name", F.concat(F.lit("no."), "name"), F.concat("file", F.lit("#"), full, F.lit(":"), "kind"))))
    some = nodes.filter("kind = 'method' AND line % 50 = 0")
    calls = some.select(F.explode(F.array(base, F.concat(F.split_part("qualified_name", F.lit("."), F.lit(1)), F.lit("."), base), F.concat(X.file_stem(F.col("file")), F.lit("."), base), F.concat(F.upper(X.file_stem(F.col("file"))), F.lit("."), "name"))))
    cpp = nodes.filter("language = 'cpp'").select(F.explode(F.array(F.regexp_replace("qualified_name", "::", "."), "qualified_name")))
    return types.unionAll(calls).unionAll(cpp).toDF("handle")


STEM = "lower(regexp_replace(regexp_extract(file, '[^/]*$'), '(.)\\.[^.]*$', '\\1'))"
ENDS = "SELECT id, unnest(list_transform(range(2, len(parts) + 1), lambda i: array_to_string(parts[i:], '.'))) AS key FROM (SELECT id, string_split({0}, '.') AS parts FROM {1})"
CANDIDATES = f"""
asked AS (
  SELECT DISTINCT unnest([id, name, 'no.' || name, file || '#' || {SHOWN} || ':' || kind]) AS handle FROM nodes WHERE kind IN ('class', 'module')
  UNION SELECT unnest([split_part(name, '(', 1), split_part(qualified_name, '.', 1) || '.' || split_part(name, '(', 1), {STEM} || '.' || split_part(name, '(', 1), upper({STEM}) || '.' || name]) FROM nodes WHERE kind = 'method' AND line % 50 = 0
  UNION SELECT unnest([replace(qualified_name, '::', '.'), qualified_name]) FROM nodes WHERE language = 'cpp'
), calls AS (
  SELECT id, file, rtrim(split_part(name, '(', 1)) AS base, rtrim(split_part(coalesce(qualified_name, ''), '(', 1)) AS qualified FROM nodes WHERE kind IN ('function', 'method', 'constructor')
), cpp AS (
  SELECT id, replace(name, '::', '.') AS base, replace(coalesce(qualified_name, ''), '::', '.') AS qualified FROM nodes WHERE language = 'cpp'
), keys AS (
  SELECT 'id' AS lane, id AS key, id FROM nodes
  UNION ALL SELECT 'legacy', file || '#' || {SHOWN} || ':' || kind, id FROM nodes
  UNION ALL SELECT 'name', unnest([name, qualified_name]), id FROM nodes
  UNION ALL SELECT 'cpp', unnest([base, qualified]), id FROM cpp UNION ALL SELECT 'cpp', key, id FROM ({ENDS.format('qualified', 'cpp')})
  UNION ALL SELECT 'suffix', key, id FROM ({ENDS.format('qualified_name', 'nodes')})
  UNION ALL SELECT 'call', unnest([base, qualified]), id FROM calls UNION ALL SELECT 'call', key, id FROM ({ENDS.format('qualified', 'calls')}) WHERE contains(key, '.')
  UNION ALL SELECT 'stem', {STEM} || '.' || unnest([name, qualified_name]), id FROM nodes
  UNION ALL SELECT 'stem_call', {STEM} || '.' || unnest([base, nullif(qualified, '')]), id FROM calls
), forms AS (
  SELECT handle, 0 AS second, handle AS form FROM asked UNION ALL SELECT handle, 1, replace(handle, '::', '.') FROM asked WHERE contains(handle, '::')
), readings AS (
  SELECT handle, 2 + 4 * second AS base, form FROM forms
  UNION ALL SELECT handle, 14 + 4 * second, CASE WHEN contains(form, '#') THEN regexp_replace(regexp_extract(form, '[^#]*$'), ':[^:]*$', '') WHEN regexp_matches(form, '^.+\\.[^.]+$') THEN regexp_extract(form, '[^.]*$') END FROM forms
), filed AS (
  SELECT handle, second, form, lower(regexp_extract(form, '^([^.]+)\\.', 1)) || '.' || regexp_extract(form, '^[^.]+\\.(.*)$', 1) AS key FROM forms WHERE regexp_matches(form, '^[^.]+\\..')
), tries AS (
  SELECT handle, 0 AS tier, 'id' AS lane, handle AS key FROM asked UNION ALL SELECT handle, 1, 'legacy', handle FROM asked
  UNION ALL SELECT handle, base, 'name', form FROM readings
  UNION ALL SELECT handle, base + 1, 'cpp', replace(form, '::', '.') FROM readings WHERE contains(form, '.') OR contains(form, '::')
  UNION ALL SELECT handle, base + 2, 'suffix', form FROM readings WHERE contains(form, '.')
  UNION ALL SELECT handle, base + 3, 'call', form FROM readings WHERE NOT contains(form, '(')
  UNION ALL SELECT handle, 10 + 2 * second, 'stem', key FROM filed UNION ALL SELECT handle, 11 + 2 * second, 'stem_call', key FROM filed WHERE NOT contains(form, '(')
), tiers AS (SELECT DISTINCT handle, tier, id FROM tries JOIN keys USING (lane, key) WHERE key <> ''),
firsts AS (SELECT handle, min(tier) AS tier FROM tiers GROUP BY handle),
found AS (SELECT handle, tier, id FROM tiers JOIN firsts USING (handle, tier))
"""


@query(f"WITH {CANDIDATES} SELECT handle, CASE WHEN count(DISTINCT id) = 1 THEN 'node' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM found GROUP BY handle")
def handle_exact(spark, sf, nodes, edges):
    return handles.resolve(_handles(nodes), nodes)


@query("SELECT DISTINCT regexp_replace(qualified_name, '^[^.]*\\.', '') AS symbol, id FROM nodes WHERE contains(qualified_name, '.')")
def handle_suffix(spark, sf, nodes, edges):
    return handles.suffix_index(nodes)


@query(f"""
WITH {DEGREE}, {CANDIDATES}, scored AS (
  SELECT handle, tier, id, round(least(48, log2(1 + coalesce(export_fan_in, 0)) * 20) + CASE WHEN exported THEN 12 ELSE 0 END
    - CASE WHEN external THEN 60 ELSE 0 END - CASE WHEN support THEN 30 ELSE 0 END + least(24, log2(1 + coalesce(in_all + out_all, 0)) * 6), 6) AS score
  FROM found JOIN nodes USING (id) JOIN flags USING (id) LEFT JOIN degree USING (id)
), ranked AS (SELECT handle, tier, row_number() OVER (PARTITION BY handle ORDER BY score DESC, id) AS rank, id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 12
""")
def handle_rank(spark, sf, nodes, edges):
    return handles.rank_candidates(handles.candidates(_handles(nodes), nodes), nodes, degrees.degrees(edges))


def _wanted(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind).select("id")


@query(f"SELECT src AS id, dst AS member, coalesce(n.qualified_name, n.name) AS name, n.kind, n.line FROM edges JOIN nodes o ON o.id = src AND o.kind = 'class' JOIN nodes n ON n.id = dst WHERE edges.kind = 'contains'")
def details_members(spark, sf, nodes, edges):
    return details.members(_wanted(nodes, "class"), nodes, edges)


@query("""
SELECT 'p:' || p_partkey AS id, unnest([0, 1]) AS ord, unnest(['size', p_type]) AS name, unnest(['property', 'method']) AS kind, unnest([NULL, p_size]) AS line, unnest(['size: number', NULL]) AS signature FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'p:' || p_partkey, unnest([0, 1]), p_brand || '.' || unnest(['A', 'B']), 'property', NULL, unnest(['A = ' || p_size, NULL]) FROM part WHERE p_partkey % 2 = 1
""")
def details_literal_members(spark, sf, nodes, edges):
    part, null, odd = _t(spark, sf, "part"), F.lit(None).cast("string"), F.col("p_partkey") % 2 == 1
    objects = F.array(F.struct(F.lit("size").alias("name"), F.lit("property").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit("size: number").alias("signature")), F.struct(F.col("p_type").alias("name"), F.lit("method").alias("kind"), F.col("p_size").cast("int").alias("line"), null.alias("signature")))
    values = F.array(F.struct(F.lit("A").alias("name"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("B").alias("name"), null.alias("value")))
    rows = part.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.when(odd, "enum").otherwise("variable").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("qualified_name"), objects.alias("object_members"), values.alias("enum_members"))
    return details.literal_members(rows, rows)


# Places of an edge in its source, and how its kind ranks, as the details of a declaration and its entry points order them.
PLACE = "coalesce(e.line, 9999) * 100 + coalesce(e.col, 999)"
KIND_RANK = "CASE e.kind WHEN 'calls' THEN 0 WHEN 'instantiates' THEN 1 WHEN 'accesses' THEN 2 WHEN 'renders' THEN 2 WHEN 'tests' THEN 3 WHEN 'overrides' THEN 4 WHEN 'decorates' THEN 4 WHEN 'extends' THEN 5 WHEN 'implements' THEN 5 WHEN 'type_ref' THEN 6 ELSE 10 END"
LIMITED = "ordered AS (SELECT id, kind, other, row_number() OVER (PARTITION BY id ORDER BY rank, kind, other) AS r, count(*) OVER (PARTITION BY id) AS available FROM refs) SELECT * FROM ordered WHERE r <= {}"


def _refs_sql(own: str, far: str, keep: str, wanted: str, limit: int) -> str:
    return f"""
WITH refs AS (
  SELECT e.{own} AS id, e.kind, e.{far} AS other, CASE WHEN test THEN 10000000 ELSE 0 END + {KIND_RANK} * 100000 + {PLACE} AS rank
  FROM edges e JOIN nodes w ON w.id = e.{own} JOIN flags f ON f.id = e.{far} WHERE w.kind = '{wanted}' AND NOT outside AND e.{keep}
), {LIMITED.format(limit)}
"""


@query(_refs_sql("src", "dst", EXEC, "method", 2))
def details_calls(spark, sf, nodes, edges):
    return details.calls(_wanted(nodes, "method"), nodes, edges)


@query(_refs_sql("src", "dst", "kind IN ('type_ref', 'extends', 'implements', 'overrides')", "function", 4))
def details_types(spark, sf, nodes, edges):
    return details.types(_wanted(nodes, "function"), nodes, edges, 4)


@query(_refs_sql("dst", "src", "kind IN ('implements', 'overrides')", "class", 2))
def details_implemented_by(spark, sf, nodes, edges):
    return details.implemented_by(_wanted(nodes, "class"), nodes, edges)


@query(_refs_sql("src", "dst", REAL, "method", 3))
def details_depends_on(spark, sf, nodes, edges):
    return details.depends_on(_wanted(nodes, "method"), nodes, edges, 3)


@query(_refs_sql("dst", "src", REAL, "class", 3))
def details_depended_on_by(spark, sf, nodes, edges):
    return details.depended_on_by(_wanted(nodes, "class"), nodes, edges, 3)


def _entry_sql(own: str, far: str, wanted: str) -> str:
    return f"""
WITH refs AS (
  SELECT e.{own} AS id, e.kind, e.{far} AS other, CASE WHEN e.kind = 'references' THEN 2 ELSE {KIND_RANK} END * 100000 + {PLACE} AS rank
  FROM edges e JOIN nodes w ON w.id = e.{own} AND w.kind = '{wanted}' JOIN nodes n ON n.id = e.{far} WHERE e.{REAL}
), {LIMITED.format(2)}
"""


@query(_entry_sql("src", "dst", "function"))
def entry_neighbours(spark, sf, nodes, edges):
    return details.entry_neighbours(_wanted(nodes, "function"), nodes, edges, True)


@query(_entry_sql("dst", "src", "class"))
def entry_used_by(spark, sf, nodes, edges):
    return details.entry_neighbours(_wanted(nodes, "class"), nodes, edges, False)


WALK = "kind NOT IN ('contains', 'exports', 'imports')"


def _reach_sql(own: str, far: str, kind: str) -> str:
    return f"""
WITH walk(seed, id, depth) AS (
  SELECT id, id, 0 FROM nodes WHERE kind = '{kind}'
  UNION SELECT seed, {far}, depth + 1 FROM walk JOIN (SELECT DISTINCT src, dst FROM edges WHERE {WALK}) e ON e.{own} = walk.id WHERE depth < 3
) SELECT seed, id, min(depth) AS depth FROM walk GROUP BY seed, id
"""


def _reach(nodes, edges, kind, forward):
    starts = nodes.filter(F.col("kind") == kind).select(F.col("id").alias("seed"))
    return trace.reach(starts, edges.filter(trace.traversable(F.col("kind"), "all")), 3, forward)


@query(_reach_sql("src", "dst", "method"), recursive=True)
def trace_forward_d3(spark, sf, nodes, edges):
    """What all methods reach in three steps."""
    return _reach(nodes, edges, "method", True)


@query(_reach_sql("dst", "src", "interface"), recursive=True)
def trace_reverse_d3(spark, sf, nodes, edges):
    """What reaches any interface in three steps."""
    return _reach(nodes, edges, "interface", False)


def _order_sql(first: str, far: str) -> str:
    return f"""
SELECT e.src, e.dst, e.kind, ({first})::BIGINT * 10000000000 + {PLACE} AS rank FROM edges e JOIN nodes n ON n.id = e.{far} JOIN flags f ON f.id = n.id
WHERE e.{WALK} AND NOT outside
"""


TRACE_KIND = "CASE e.kind WHEN 'calls' THEN 0 WHEN 'instantiates' THEN 1 WHEN 'renders' THEN 2 WHEN 'accesses' THEN 3 WHEN 'tests' THEN 4 WHEN 'overrides' THEN 5 WHEN 'decorates' THEN 5 WHEN 'extends' THEN 6 WHEN 'implements' THEN 6 WHEN 'type_ref' THEN 7 ELSE 10 END"
TRACE_END = "CASE WHEN test THEN 6 WHEN n.kind IN ('function', 'method', 'constructor', 'class') THEN 0 WHEN n.kind = 'variable' THEN 1 WHEN n.kind IN ('property', 'field') THEN 2 WHEN n.kind IN ('interface', 'type') THEN 4 ELSE 3 END"
IMPACT_END = "CASE WHEN test THEN 0 WHEN exported THEN 1 WHEN external OR ignored THEN 4 ELSE 2 END"


@query(_order_sql(f"{TRACE_KIND} * 100 + {TRACE_END}", "src"))
def trace_order_reverse(spark, sf, nodes, edges):
    """All edges that a walk back may take, with the order in which it takes them."""
    return trace.walkable(nodes, edges, "all", False, False)[0].select("src", "dst", "kind", "rank")


@query(_order_sql(f"{IMPACT_END} * 100 + {TRACE_KIND}", "src"))
def trace_order_impact(spark, sf, nodes, edges):
    """The same for a walk of impact."""
    return trace.walkable(nodes, edges, "all", False, False, True)[0].select("src", "dst", "kind", "rank")


@query("SELECT id, list_filter([CASE WHEN exported THEN 'exported' END, CASE WHEN test THEN 'test' END], lambda r: r IS NOT NULL)::VARCHAR AS roles FROM nodes JOIN flags USING (id)")
def trace_roles(spark, sf, nodes, edges):
    return trace.roles(nodes).select("id", F.concat(F.lit("["), F.array_join("roles", ", "), F.lit("]")).alias("roles"))


DISPATCH = f"""
runs AS (SELECT DISTINCT src AS id FROM edges WHERE {EXEC}), ups AS (
  SELECT DISTINCT dst AS base, src AS impl FROM edges WHERE kind IN ('overrides', 'implements')
    AND src IN (SELECT id FROM runs) AND dst NOT IN (SELECT id FROM runs)
), per AS (SELECT base, count(*) AS n FROM ups GROUP BY base)
"""


@query("WITH " + DISPATCH + " SELECT base AS src, impl AS dst, 'dispatches' AS kind FROM ups JOIN per USING (base) WHERE n < 12")
def dispatch_candidates(spark, sf, nodes, edges):
    return degrees.dispatch_edges(nodes, edges)[0].select("src", "dst", "kind")


@query("WITH " + DISPATCH + " SELECT base AS id, n FROM per WHERE n >= 12")
def dispatch_hub_cut(spark, sf, nodes, edges):
    return degrees.dispatch_edges(nodes, edges)[1].groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


def _ends(edges: DataFrame) -> tuple[str, str]:
    """Two nodes that call the same part, one of them in the first place."""
    calls = edges.filter("kind = 'calls' AND src LIKE 'o:%'")
    row = calls.join(F.broadcast(calls.agg(F.min("dst").alias("dst"))), "dst").agg(F.min("src"), F.max("src")).first()
    return row[0], row[1]


ENDS_SQL = "shared AS (SELECT src FROM edges WHERE kind = 'calls' AND src LIKE 'o:%' AND dst = (SELECT min(dst) FROM edges WHERE kind = 'calls' AND src LIKE 'o:%')), a AS (SELECT min(src) AS id FROM shared), z AS (SELECT max(src) AS id FROM shared)"


@query(f"""
WITH {ENDS_SQL}, near AS (
  SELECT 0 AS side, dst AS id, kind, 0 AS way, {PLACE} AS place FROM edges e WHERE {WALK} AND src = (SELECT id FROM a)
  UNION ALL SELECT 0, src, kind, 1, {PLACE} FROM edges e WHERE {WALK} AND dst = (SELECT id FROM a)
  UNION ALL SELECT 1, dst, kind, 0, {PLACE} FROM edges e WHERE {WALK} AND src = (SELECT id FROM z)
  UNION ALL SELECT 1, src, kind, 1, {PLACE} FROM edges e WHERE {WALK} AND dst = (SELECT id FROM z)
), firsts AS (SELECT side, id, arg_min(kind, (way, place, kind)) AS kind FROM near GROUP BY side, id)
SELECT x.id, x.kind AS from_kind, y.kind AS to_kind,
       CASE WHEN n.kind IN ('variable', 'property', 'field') THEN 3 ELSE 0 END + CASE WHEN x.kind = 'accesses' THEN 2 ELSE 0 END + CASE WHEN y.kind = 'accesses' THEN 2 ELSE 0 END AS score
FROM firsts x JOIN firsts y ON x.id = y.id AND x.side = 0 AND y.side = 1 JOIN nodes n ON n.id = x.id JOIN flags f ON f.id = x.id WHERE NOT outside ORDER BY score DESC, x.id LIMIT 4
""")
def trace_junctions(spark, sf, nodes, edges):
    return trace.junctions(nodes, edges, *_ends(edges))


INVOKED = """
invoked AS (
  SELECT src, dst FROM edges WHERE kind IN ('calls', 'instantiates', 'renders')
  UNION SELECT dst, src FROM edges WHERE kind IN ('overrides', 'implements') AND dst NOT IN (SELECT src FROM edges WHERE kind IN ('calls', 'instantiates', 'renders'))
), hop AS (SELECT DISTINCT src, dst FROM invoked WHERE dst IN (SELECT id FROM production))
"""


def _files_sql(seeds: str, bounded: bool = True) -> str:
    """Levels of a walk over ``hop``; if bounded, each but the first from seeds that have seen fewer than 400 nodes."""
    out = f"seen0 AS (SELECT id AS seed, id FROM {seeds}), level0 AS (SELECT * FROM seen0)"
    for n in range(1, 5):
        few = f"WHERE seed IN (SELECT seed FROM seen{n - 1} GROUP BY seed HAVING count(*) < 400)" if bounded else ""
        out += f""", level{n} AS (SELECT seed, dst AS id FROM level{n - 1} JOIN hop ON src = level{n - 1}.id {few} EXCEPT SELECT * FROM seen{n - 1}),
        seen{n} AS (SELECT * FROM seen{n - 1} UNION ALL SELECT * FROM level{n})"""
    return out + ", reached AS (SELECT seed AS id, count(DISTINCT file) FILTER (WHERE seed <> id) AS files FROM seen4 JOIN nodes USING (id) GROUP BY seed)"


@query(f"WITH {INVOKED}, methods AS (SELECT id FROM nodes WHERE kind = 'method'), {_files_sql('methods', False)} SELECT id AS seed, files FROM reached")
def reach_files_d4(spark, sf, nodes, edges):
    """Files that all methods reach in four invocations."""
    return tour.files_reached(nodes.filter("kind = 'method'").select("id"), nodes, edges)


SURFACE = """
surface AS (
  SELECT n.id, greatest(coalesce(d.export_fan_in, 0), coalesce(max(o.export_fan_in), 0)) AS s FROM nodes n LEFT JOIN degree d ON d.id = n.id
  LEFT JOIN edges e ON e.dst = n.id AND e.kind = 'contains' LEFT JOIN nodes p ON p.id = e.src AND p.kind NOT IN ('file', 'module') LEFT JOIN degree o ON o.id = p.id
  GROUP BY n.id, d.export_fan_in
)
"""


@query(f"WITH {DEGREE}, {SURFACE} SELECT id, s AS public_fan_in FROM surface")
def public_fan_in(spark, sf, nodes, edges):
    return tour.public_fan_in(nodes, edges, degrees.degrees(edges))


CENTRAL = f"""
{DEGREE}, {INVOKED}, {SURFACE}, fans AS (
  SELECT dst AS id, count(*) AS fan FROM edges WHERE kind IN ('calls', 'instantiates', 'renders') AND src IN (SELECT id FROM production) GROUP BY dst
), seeds AS (
  SELECT id, s, coalesce(fan, 0) AS e FROM production JOIN surface USING (id) LEFT JOIN fans USING (id) WHERE s > 0
), {_files_sql('seeds')},
raws AS (SELECT id, log2(1 + s) * greatest(files / greatest(1, max(files) OVER ()), e / greatest(1, max(e) OVER ())) AS r FROM seeds JOIN reached USING (id)),
central AS (SELECT id, CASE WHEN max(r) OVER () > 0 THEN round(100 * r / max(r) OVER (), 4) ELSE 0 END AS centrality FROM raws)
"""


@query(f"WITH {CENTRAL} SELECT * FROM central")
def centrality(spark, sf, nodes, edges):
    return tour.centrality(nodes, edges, degrees.degrees(edges))


OPEN_DEGREE = f"""
closed AS (SELECT id FROM nodes WHERE closure), opened AS (
  SELECT id, sum(i)::BIGINT AS in_real, sum(x)::BIGINT AS out_exec FROM (
    SELECT dst AS id, ({REAL})::INT AS i, 0 AS x FROM edges WHERE src NOT IN (SELECT id FROM closed)
    UNION ALL SELECT src, 0, ({EXEC})::INT FROM edges WHERE dst NOT IN (SELECT id FROM closed)) GROUP BY id
)
"""


@query(f"""
WITH {OPEN_DEGREE} SELECT id FROM nodes JOIN flags USING (id) LEFT JOIN opened USING (id)
WHERE NOT closure AND kind IN ('class', 'function', 'method', 'constructor', 'property', 'field', 'variable', 'module', 'namespace', 'enum')
  AND (kind NOT IN ('property', 'field') OR out_exec > 0) AND NOT external AND NOT ignored AND line IS NOT NULL AND NOT support
""")
def tour_candidates(spark, sf, nodes, edges):
    return tour.seed_candidates(nodes, degrees.open_degrees(nodes, edges)).select("id")


@query(f"WITH {OPEN_DEGREE} SELECT id, in_real, out_exec FROM opened JOIN nodes USING (id) WHERE in_real >= 12 AND out_exec <= 1")
def shared_utility(spark, sf, nodes, edges):
    return degrees.shared_utilities(nodes, degrees.open_degrees(nodes, edges))


@query("""
SELECT src AS id, count(DISTINCT (kind, line, CASE WHEN line IS NULL THEN dst END, CASE WHEN line IS NOT NULL THEN coalesce(col, 0) END)) AS sites
FROM edges WHERE kind IN ('calls', 'instantiates', 'renders') AND src <> dst AND dst IN (SELECT id FROM production) GROUP BY src
""")
def invocation_sites(spark, sf, nodes, edges):
    return tour.invocation_sites(nodes, edges)


@query("""
WITH near AS (
  SELECT DISTINCT dst AS seed, src AS id, e.kind, len(list_filter(range(1, least(len(string_split(a.file, '/')), len(string_split(b.file, '/')))),
    lambda i: string_split(a.file, '/')[1:i] = string_split(b.file, '/')[1:i])) AS near
  FROM edges e JOIN nodes a ON a.id = dst AND a.kind = 'variable' JOIN nodes b ON b.id = src JOIN flags f ON f.id = src WHERE test
) SELECT seed, id, kind, near::INT AS near FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY near DESC, id, kind) AS r FROM near) WHERE r <= 8
""")
def tour_tests(spark, sf, nodes, edges):
    return tour.test_anchors(nodes.filter("kind = 'variable'").select("id"), nodes, edges)


def _items(spark, sf):
    """Line items as edges in the order of a log, with repeats."""
    li = _t(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return li.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("evidence"), order.alias("ord"),
    )


@query("""
SELECT 'o:' || l_orderkey AS src, 's:' || l_suppkey AS dst, l_returnflag AS kind,
       arg_min(l_linenumber, (l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS line,
       arg_min(l_partkey, (l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS evidence
FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag
""")
def edge_dedupe_first(spark, sf, nodes, edges):
    return assembly.dedupe_edges(_items(spark, sf)).drop("ord")


@query("""
SELECT 'u:' || user_id AS id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY user_id
""")
def node_dedupe_last(spark, sf, nodes, edges):
    rows = _t(spark, sf, "events").select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), "value", F.col("event_id").alias("ord"))
    return assembly.dedupe_nodes(rows).drop("ord")


@query("""
WITH own AS (SELECT * FROM nodes WHERE NOT external), owners AS (SELECT file, coalesce(qualified_name, name) AS o, max(id) AS owner FROM own GROUP BY 1, 2),
held AS (SELECT src, dst FROM edges WHERE kind = 'contains'), made AS (
  SELECT coalesce(owner, own.file) AS src, own.id AS dst FROM own
  LEFT JOIN owners ON owners.file = own.file AND o = CASE WHEN contains(coalesce(qualified_name, name), '.') THEN regexp_extract(coalesce(qualified_name, name), '^(.*)\\.[^.]*$', 1) END
)
SELECT src, dst FROM held UNION ALL SELECT src, dst FROM made WHERE (src, dst) NOT IN (SELECT (src, dst) FROM held)
""")
def containment_synthesis(spark, sf, nodes, edges):
    return assembly.synthesise_containment(nodes, edges).filter("kind = 'contains'").select("src", "dst")


@query("""
WITH own AS (SELECT file AS id, arg_min(language, id) AS language FROM nodes WHERE NOT external GROUP BY file),
bare AS (SELECT src AS id, coalesce(arg_min(n.language, dst), 'unknown') AS language FROM edges e LEFT JOIN nodes n ON n.id = dst
  WHERE src NOT IN (SELECT id FROM nodes) AND src NOT IN (SELECT id FROM own) AND NOT contains(src, '#') GROUP BY src)
SELECT id, language, regexp_extract(id, '[^/]*$') AS name FROM (SELECT * FROM own UNION ALL SELECT * FROM bare)
""")
def file_synthesis(spark, sf, nodes, edges):
    return assembly.synthesise_files(nodes, edges).filter("kind = 'file'").select("id", "language", "name")


@query("""
WITH base AS (SELECT id, CASE WHEN kind = 'method' THEN 'variable' ELSE kind END AS kind, file, name, qualified_name FROM nodes),
owners AS (SELECT file, coalesce(qualified_name, name) AS o, max(kind) AS k FROM base GROUP BY 1, 2),
keyed AS (SELECT *, replace(qualified_name, '.order', chr(9) || 'order') AS q FROM base)
SELECT b.id, CASE WHEN b.kind = 'variable' AND k = 'class' THEN 'property' ELSE b.kind END AS kind
FROM base b LEFT JOIN owners ON owners.file = b.file AND o = regexp_extract(b.qualified_name, '^(.*)\\.[^.]*$', 1)
""")
def kind_normalise(spark, sf, nodes, edges):
    rows = nodes.withColumn("kind", F.when(F.col("kind") == "method", "variable").otherwise(F.col("kind"))).withColumn("ord", F.col("kind"))
    return assembly.normalise_kinds(rows).select("id", "kind")


@query("""
WITH base AS (SELECT id, CASE WHEN kind = 'class' THEN 'function' ELSE kind END AS kind, file, CASE WHEN kind = 'class' THEN name ELSE coalesce(qualified_name, name) END AS q FROM nodes)
SELECT a.id, count(b.id) > 0 AS closure FROM base a LEFT JOIN base b ON b.file = a.file AND b.kind IN ('function', 'method', 'constructor') AND starts_with(a.q, b.q || '.') GROUP BY a.id
""")
def closure_mark(spark, sf, nodes, edges):
    name = F.when(F.col("kind") == "class", F.col("name")).otherwise(F.coalesce("qualified_name", "name"))
    rows = nodes.withColumn("qualified_name", name).withColumn("kind", F.when(F.col("kind") == "class", "function").otherwise(F.col("kind")))
    return assembly.mark_closures(rows).select("id", "closure")


@query("""
WITH own AS (SELECT file, id, name FROM nodes WHERE exported AND kind = 'class'),
forwards AS (SELECT 'index/' || regexp_extract(file, '/(.*)$', 1) AS file, file AS source, NULL::VARCHAR AS name FROM (SELECT DISTINCT file FROM own)
  UNION SELECT 'root.ts', 'index/' || regexp_extract(file, '/(.*)$', 1), NULL FROM (SELECT DISTINCT file FROM own)
  UNION SELECT file, 'root.ts', min(name) FROM own GROUP BY file),
surface(file, id, name) AS (SELECT * FROM own UNION SELECT f.file, s.id, s.name FROM surface s JOIN forwards f ON f.source = s.file WHERE f.name IS NULL OR f.name = s.name)
SELECT DISTINCT file, id FROM surface
""", recursive=True)
def export_surface(spark, sf, nodes, edges):
    own = nodes.filter("exported AND kind = 'class'").select("file", "id", "name")
    index = F.concat(F.lit("index/"), F.regexp_extract("file", "/(.*)$", 1))
    files, null = own.select("file").distinct(), F.lit(None).cast("string").alias("name")
    forwards = files.select(index.alias("f"), F.col("file").alias("source"), null).withColumnRenamed("f", "file")
    forwards = forwards.unionAll(files.select(F.lit("root.ts"), index, null)).unionAll(own.groupBy("file").agg(F.min("name").alias("m")).select("file", F.lit("root.ts"), "m")).distinct()
    return assembly.export_surface(own, forwards)


@query("""
WITH pairs AS (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1),
m AS (SELECT 'c:' || o_custkey AS owner, o_orderstatus || (o_orderkey % 5) AS key, min(o_orderkey) AS id, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) = 1),
b AS (SELECT 's:' || l_suppkey AS owner, l_linestatus || (l_orderkey % 5) AS key, min(l_orderkey * 10 + l_linenumber) AS id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) < 150)
SELECT DISTINCT 'm:' || m.id AS src, 'b:' || b.owner || '/' || b.id || ':' || b.key AS dst, 'implements' AS kind FROM pairs JOIN m ON m.owner = pairs.src JOIN b ON b.owner = pairs.dst AND b.key = m.key
""")
def override_edges(spark, sf, nodes, edges):
    o, li = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    c, s = F.concat(F.lit("c:"), F.col("o_custkey").cast("string")), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string"))
    pairs = o.join(li.filter("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey")).select(c.alias("src"), s.alias("dst"), F.lit("implements").alias("kind"))
    own = o.select(F.concat(F.lit("m:"), F.col("o_orderkey").cast("string")).alias("id"), c.alias("owner"), F.concat("o_orderstatus", (F.col("o_orderkey") % 5).cast("string")).alias("name"))
    base = li.groupBy(s.alias("owner"), F.concat("l_linestatus", (F.col("l_orderkey") % 5).cast("string")).alias("name")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.count("*").alias("n"))
    base = base.filter("n < 150").select(F.concat(F.lit("b:"), F.col("owner"), F.lit("/"), F.col("k").cast("string"), F.lit(":"), F.col("name")).alias("id"), "owner", "name")
    members = own.unionAll(base)
    n = members.select("id", F.lit("method").alias("kind"), "name").unionAll(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.lit("class"), "id"))
    e = pairs.distinct().unionAll(members.select(F.col("owner").alias("src"), F.col("id").alias("dst"), F.lit("contains")))
    return assembly.override_edges(n, e)


@query("SELECT DISTINCT id FROM nodes WHERE exported AND kind IN ('class', 'function') AND id IN (SELECT src FROM edges)")
def merge_overlap(spark, sf, nodes, edges):
    strict = nodes.filter("exported AND kind IN ('class', 'function')")
    return assembly.lane_overlap(strict, edges.select(F.col("src").alias("id")), ["id"])


@query("""
WITH known AS (SELECT id FROM nodes UNION SELECT file FROM nodes)
SELECT 'missing src' AS rule, src || ' ' || dst || ' ' || kind AS subject FROM edges WHERE src NOT IN (SELECT id FROM known)
UNION ALL SELECT 'missing dst', src || ' ' || dst || ' ' || kind FROM edges WHERE dst NOT IN (SELECT id FROM known)
""")
def validate_endpoints(spark, sf, nodes, edges):
    return assembly.violations(nodes, edges)


FAMILIES = ", ".join(f"'{k}'" for k in trust.EDGE_KINDS)


@query(f"""
SELECT 'static' AS provider, language, family, CASE WHEN family IN ('contains', 'calls', 'exports') THEN 'partial' ELSE 'unsupported' END AS state
FROM (SELECT DISTINCT kind AS language FROM nodes), (SELECT unnest([{FAMILIES}]) AS family)
""")
def coverage_matrix(spark, sf, nodes, edges):
    return assembly.coverage_matrix(nodes.select(F.col("kind").alias("language")), ["contains", "calls", "exports"])


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE user_id % 4 IN (1, 2) GROUP BY event_type")
def trust_reasons(spark, sf, nodes, edges):
    family = F.element_at(F.array(*[F.lit(k) for k in ("contains", "calls", "references", "imports")]), (F.col("user_id") % 4 + 1).cast("int"))
    rows = _t(spark, sf, "events").select(family.alias("family"), F.col("event_type").alias("reason"))
    return trust.unresolved_reasons(rows, "lookup")


REDUCE = """
own AS (SELECT * FROM nodes WHERE NOT external AND NOT ignored),
live AS (SELECT * FROM edges WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)),
deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM live UNION ALL SELECT dst FROM live) GROUP BY id),
top AS (SELECT own.id FROM own LEFT JOIN deg USING (id) ORDER BY coalesce(d, 0) DESC, own.id LIMIT 300),
kept AS (SELECT * FROM live WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top))
"""


@query(f"WITH {REDUCE} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM kept UNION ALL SELECT dst FROM kept) GROUP BY id")
def reduce_topn(spark, sf, nodes, edges):
    return reduce.reduce_graph(nodes, edges, 300)[0].select("id", "degree")


@query(f"""
WITH {REDUCE} SELECT src, dst, CASE WHEN kind IN ('calls', 'instantiates', 'renders', 'accesses') THEN 'value-call' WHEN kind = 'type_ref' THEN 'type-ref'
WHEN kind IN ('extends', 'implements', 'overrides') THEN 'heritage' ELSE kind END AS family FROM kept
""")
def display_kind(spark, sf, nodes, edges):
    return reduce.reduce_graph(nodes, edges, 300)[1].select("src", "dst", "family")


def _topology(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind IN ('namespace', 'module', 'class')").select("id", "name", F.col("qualified_name").alias("coordinate"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("root"))


@query("""
WITH t AS (SELECT id, name, qualified_name AS coordinate FROM nodes WHERE kind IN ('namespace', 'module', 'class')),
e AS (SELECT src, dst, kind FROM edges WHERE kind = 'contains'), hit AS (SELECT id FROM t WHERE name = 'ASIA' OR id = 'ASIA' OR coordinate = 'ASIA' ORDER BY id LIMIT 100),
ids AS (SELECT id, min(h) AS hop FROM (SELECT id, 0 AS h FROM hit UNION ALL SELECT dst, 1 FROM e WHERE src IN (SELECT id FROM hit) UNION ALL SELECT src, 1 FROM e WHERE dst IN (SELECT id FROM hit)) GROUP BY id)
SELECT id, name, hop FROM t JOIN ids USING (id) ORDER BY hop, id LIMIT 100
""")
def topology_expand(spark, sf, nodes, edges):
    kept, _ = topology.inspect(_topology(nodes), edges.filter("kind = 'contains'"), "ASIA")
    return kept.select("id", "name", "hop")


@query("""
WITH t AS (SELECT id FROM nodes WHERE kind IN ('namespace', 'module', 'class')), seeds AS (SELECT id FROM t ORDER BY id LIMIT 30),
e AS (SELECT src, dst, kind FROM edges WHERE kind IN ('contains', 'extends')), used AS (SELECT DISTINCT * FROM e WHERE src IN (SELECT id FROM seeds) OR dst IN (SELECT id FROM seeds)),
ids AS (SELECT id, min(h) AS hop FROM (SELECT id, 0 AS h FROM seeds UNION ALL SELECT src, 1 FROM used UNION ALL SELECT dst, 1 FROM used) GROUP BY id),
kept AS (SELECT id FROM t JOIN ids USING (id) ORDER BY hop, id LIMIT 30)
SELECT * FROM used WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)
""")
def topology_edges(spark, sf, nodes, edges):
    used = edges.filter("kind IN ('contains', 'extends')").select("src", "dst", "kind")
    return topology.inspect(_topology(nodes), used, None, None, 30)[1].select("src", "dst", "kind")


@query("""
WITH files AS (SELECT DISTINCT file FROM nodes), roots AS (SELECT DISTINCT 'dir:' || regexp_extract(file, '^(.*)/[^/]*$', 1) AS id, regexp_extract(file, '^(.*)/[^/]*$', 1) AS root FROM nodes
  UNION SELECT 'top:' || split_part(file, '/', 1), split_part(file, '/', 1) FROM nodes UNION SELECT 'all', '.')
SELECT id, file FROM roots, files WHERE root = '.' OR starts_with(file, root || '/')
""")
def topology_prefix_join(spark, sf, nodes, edges):
    files = nodes.select("file").distinct()
    dirs = files.select(X.dirname(F.col("file")).alias("root")).distinct().select(F.concat(F.lit("dir:"), "root").alias("id"), "root")
    tops = files.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("root")).distinct().select(F.concat(F.lit("top:"), "root").alias("id"), "root")
    roots = dirs.unionAll(tops).unionAll(spark.range(1).select(F.lit("all").alias("id"), F.lit(".").alias("root")))
    return topology.file_joins(roots.withColumn("file", F.lit(None).cast("string")), files)


@query("""
WITH scope AS (SELECT file, line AS s, line + 40 AS e, id AS owner FROM nodes WHERE kind = 'class'), use AS (SELECT file, line AS pos FROM nodes WHERE kind = 'method' GROUP BY ALL)
SELECT use.file, pos, arg_min(owner, (-s, e, owner)) AS owner FROM use JOIN scope ON scope.file = use.file AND s <= pos AND pos <= e GROUP BY use.file, pos
""")
def interval_owner(spark, sf, nodes, edges):
    scopes = nodes.filter("kind = 'class'").select("file", F.col("line").alias("start"), (F.col("line") + 40).alias("end"), F.col("id").alias("owner"))
    return assembly.innermost_owner(nodes.filter("kind = 'method'").select("file", F.col("line").alias("pos")).distinct(), scopes)


@query("""
WITH ref AS (SELECT id AS ref, name, file FROM nodes WHERE kind = 'function'), hit AS (
  SELECT ref, n.id AS target, CASE WHEN n.file = ref.file THEN 0 ELSE 1 END AS tier FROM ref JOIN nodes n ON n.name = ref.name
), least AS (SELECT ref, min(tier) AS tier FROM hit GROUP BY ref)
SELECT ref, min(target) AS target FROM hit JOIN least USING (ref, tier) GROUP BY ref HAVING count(*) = 1
""")
def sole_endpoint(spark, sf, nodes, edges):
    return assembly.sole_endpoint(nodes.filter("kind = 'function'").select(F.col("id").alias("ref"), "name", "file"), nodes)


@query(f"SELECT id, array_to_string({WORDS.format('name')}, ' ') AS words FROM nodes")
def subwords(spark, sf, nodes, edges):
    return nodes.select("id", F.array_join(X.subwords(F.col("name")), " ").alias("words"))


def _stem_sql(w: str) -> str:
    suffixes = ["ation", "ing", "ment", "ence", "ance", "ion", "ity", "ed", "es", "s"]
    cut = " ".join(f"WHEN ends_with({w}, '{s}') AND len({w}) > {len(s) + 3} THEN left({w}, len({w}) - {len(s)})" for s in suffixes)
    return f"CASE {cut} ELSE {w} END"


@query(f"""
WITH w AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS word FROM documents), c AS (SELECT word, {_stem_sql('word')} AS cut FROM w)
SELECT word, CASE WHEN ends_with(cut, 'e') AND len(cut) > 4 THEN left(cut, len(cut) - 1) ELSE cut END AS stem FROM c WHERE regexp_full_match(word, '[a-z]+')
""")
def stems(spark, sf, nodes, edges):
    words = _t(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("word"))
    words = words.filter(F.rlike("word", F.lit("^[a-z]+$")) & ~F.contains("word", F.lit("\n"))).distinct()
    return words.select("word", X.stem_word(F.col("word")).alias("stem"))


@query("""
SELECT user_id AS shard, max(event_id) AS seq, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY user_id
""")
def latest_frame_per_shard(spark, sf, nodes, edges):
    frames = _t(spark, sf, "events").select(F.col("user_id").alias("shard"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), "value")
    return generations.latest_frames(frames)


@query("SELECT l_partkey AS id, arg_min(l_orderkey, (l_suppkey, l_orderkey, l_linenumber, l_quantity)) AS origin, min(l_suppkey) AS shard FROM lineitem GROUP BY l_partkey")
def fold_shards_first(spark, sf, nodes, edges):
    rows = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("origin"), F.col("l_suppkey").alias("shard"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("pos"))
    return generations.fold_first(rows, ["id"]).select("id", "origin", "shard")


@query("SELECT id, sha256(octet_length(encode(id)) || ':' || id || octet_length(encode(kind)) || ':' || kind || octet_length(encode(name)) || ':' || name) AS digest FROM nodes")
def canonical_digest(spark, sf, nodes, edges):
    return nodes.select("id", generations.canonical_digest(F.col("id"), F.col("kind"), F.col("name")).alias("digest"))


@query(f"SELECT DISTINCT id, file || '#' || unnest([{SHOWN}, CASE WHEN kind IN ('function', 'method', 'constructor') THEN split_part({SHOWN}, '(', 1) ELSE {SHOWN} END]) || ':' || kind AS handle FROM nodes")
def legacy_handles(spark, sf, nodes, edges):
    return assembly.legacy_handles(nodes)


@query(f"""
WITH {DISPATCH}, ends AS (SELECT (SELECT min(id) FROM nodes WHERE kind = 'namespace') AS a, (SELECT max(id) FROM nodes WHERE kind = 'interface') AS z),
hop AS (
  SELECT DISTINCT src, dst FROM (
    SELECT src, dst FROM edges WHERE {WALK} UNION ALL SELECT base, impl FROM ups JOIN per USING (base) WHERE n < 12 OR impl = (SELECT z FROM ends)
    UNION ALL SELECT a, (SELECT min(id) FROM nodes WHERE kind = 'method') FROM ends
  ) JOIN flags ON flags.id = dst WHERE NOT outside
), walk(id, depth) AS (SELECT a, 0 FROM ends UNION SELECT dst, depth + 1 FROM walk JOIN hop ON src = walk.id WHERE depth < 12)
SELECT a AS start, z AS goal, coalesce((SELECT min(depth) FROM walk WHERE id = z), -1)::BIGINT AS length FROM ends
""", recursive=True)
def trace_shortest_path_len(spark, sf, nodes, edges):
    """From a region to an interface; an edge from it to a method is added, as regions lead nowhere."""
    start, goal = nodes.filter("kind = 'namespace'").agg(F.min("id")).first()[0], nodes.filter("kind = 'interface'").agg(F.max("id")).first()[0]
    more = nodes.filter("kind = 'method'").agg(F.min("id").alias("dst")).select(F.lit(start).alias("src"), "dst", F.lit("references").alias("kind"), F.lit(1).alias("line"), F.lit(1).alias("col"))
    path = trace.shortest_path(nodes, edges.unionByName(more), start, goal)
    return spark.range(1).select(F.lit(start).alias("start"), F.lit(goal).alias("goal"), F.lit(len(path) - 1).cast("long").alias("length"))


@query()
def trace_bounded(spark, sf, nodes, edges):
    start = nodes.filter("kind = 'method' AND NOT external").agg(F.min("id")).first()[0]
    found = trace.trace(nodes, edges, start, max_depth=3, max_nodes=12)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(d).alias("depth")) for i, d in found.reached])).alias("r")
    return spark.range(1).select(rows).select("r.*")


TERMS = ["supplier", "customer", "3"]


def _matched_sql(words: str) -> str:
    """How many of the terms, none of which has an ending to lose, a list of words matches."""
    alike = "len(list_filter({0}, lambda w: w = '{1}' OR {2} = '{1}' OR (len('{1}') >= 6 AND len({2}) >= 6 AND left({2}, 6) = left('{1}', 6)))) > 0"
    stem = lambda w: f"regexp_replace({_stem_sql(w)}, '^(....+)e$', '\\1')"
    return " + ".join(f"({alike.format(words, t, stem('w'))})::INT" for t in TERMS)


def _scores(nodes, edges):
    own = tour.seed_candidates(nodes, degrees.open_degrees(nodes, edges))
    return tour.seed_scores(own, tour.centrality(nodes, edges, degrees.degrees(edges)), TERMS)


@query(f"""
WITH {CENTRAL}, {OPEN_DEGREE}, own AS (
  SELECT nodes.*, list_concat({WORDS.format('name')}, {WORDS.format("coalesce(qualified_name, '')")}) AS words, {WORDS.format('file')} AS path FROM nodes JOIN flags USING (id) LEFT JOIN opened USING (id)
  WHERE NOT closure AND kind IN ('class', 'function', 'method', 'constructor', 'property', 'field', 'variable', 'module', 'namespace', 'enum')
    AND (kind NOT IN ('property', 'field') OR out_exec > 0) AND NOT external AND NOT ignored AND line IS NOT NULL AND NOT support
), matched AS (SELECT *, 8 * ({_matched_sql('words')}) + 2 * ({_matched_sql('path')}) AS m FROM own),
scored AS (SELECT id, round((coalesce(centrality, 0) + m) * CASE WHEN m >= 24 THEN 1.45 WHEN m >= 8 THEN 1.15 ELSE 0.45 END
  * CASE WHEN starts_with({SHOWN}, '_') OR contains({SHOWN}, '._') THEN 0.25 ELSE 1 END, 6) AS score FROM matched LEFT JOIN central USING (id))
SELECT id, score FROM scored WHERE score > 0
""")
def tour_scores(spark, sf, nodes, edges):
    return _scores(nodes, edges).select("id", "score")


@query()
def tour_diverse(spark, sf, nodes, edges):
    seeds = tour.pick_diverse(_scores(nodes, edges), terms=TERMS)
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, seeds)).cast("array<string>")).alias("rank", "id"))


FIELD = "octet_length(encode({0})) || ':' || {0}"


@query(f"""
WITH d AS (SELECT id, kind, language, {SHOWN} AS shown, sha256({' || '.join(FIELD.format(f) for f in ("'v2'", "language", "'declaration'", "name", "file"))} || '0:0:0:0:') AS digest,
  sha256({' || '.join(FIELD.format(f) for f in ("'g2'", "language", "'declaration'", "name", "file"))} || '0:0:0:0:' || {' || '.join(FIELD.format(f) for f in ("'g1'", "kind", SHOWN))}) AS scoped FROM nodes),
n AS (SELECT digest, count(DISTINCT (kind, shown)) AS n FROM d GROUP BY digest)
SELECT id, CASE WHEN n = 1 THEN '@v2' ELSE '@g2' END || '/' || language || '/' || CASE WHEN n = 1 THEN digest ELSE scoped END || '#' || replace(replace(replace(url_encode(shown), '%28', '('), '%29', ')'), '+', '%20') || ':' || kind AS semantic_id
FROM d JOIN n USING (digest)
""")
def semantic_id(spark, sf, nodes, edges):
    null = F.lit(None).cast("string")
    facts = nodes.select("id", "kind", F.coalesce("qualified_name", "name").alias("display"), "language", F.lit("declaration").alias("role"), F.col("name").alias("symbol"), F.col("file").alias("module"), *[null.alias(c) for c in ("target", "unit", "document", "overload")])
    return identity.semantic_ids(facts, "g1").select("id", "semantic_id")


def _sources(nodes):
    """A source of each part and supplier, in three languages."""
    name = F.regexp_replace("name", "[^A-Za-z0-9]", "")
    base = F.concat(F.lit("B"), F.col("line").cast("string"))
    ts = F.concat(F.lit("import { "), base, F.lit(" } from './base';\n/** One. */\nexport class "), name, F.lit(" extends "), base, F.lit(" {\n  trade(n) {\n    return helper(n);\n  }\n}\nfunction helper(n) {\n  return n;\n}\n"))
    py = F.concat(F.lit("import os\n\nclass "), name, F.lit("("), base, F.lit("):\n    def trade(self):\n        return helper()\n\ndef helper():\n    return 1\n"))
    go = F.concat(F.lit('package main\nimport (\n  "fmt"\n)\ntype '), name, F.lit(" struct {\n  n int\n}\nfunc helper() int {\n  return 1\n}\n"))
    pick = lambda *values: F.element_at(F.array(*values), F.col("line") % 3 + 1)
    wanted = nodes.filter("kind IN ('function', 'class') AND NOT external")
    file = F.concat(F.lit("src/"), F.regexp_replace("id", ":", "/"), pick(F.lit(".ts"), F.lit(".py"), F.lit(".go")))
    return wanted.select(file.alias("file"), pick(F.lit("typescript"), F.lit("python"), F.lit("go")).alias("language"), pick(ts, py, go).alias("text"), name.alias("made"))


@query("""
WITH made AS (SELECT 'src/' || replace(id, ':', '/') || (['.ts', '.py', '.go'])[line % 3 + 1] AS file, line % 3 AS l, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') AS name FROM nodes WHERE kind IN ('function', 'class') AND NOT external)
SELECT file, name, 'class' AS kind FROM made UNION ALL SELECT file, 'helper', 'function' FROM made UNION ALL SELECT file, 'trade', 'method' FROM made WHERE l < 2
""")
def static_declarations(spark, sf, nodes, edges):
    """Declarations of a generated source for each part and supplier."""
    facts = tables.extract_facts(_sources(nodes).drop("made"))
    return facts.filter("fact = 'declaration'").select("file", "name", "kind")


@query()
def static_facts(spark, sf, nodes, edges):
    """All facts of these sources."""
    return tables.extract_facts(_sources(nodes).drop("made"))


@query(f"""
WITH rel AS (SELECT 'o:' || l_orderkey AS s, 's:' || l_suppkey AS o, (l_partkey * 2654435761 + l_linenumber * 40503) % 1048576 AS roles FROM lineitem)
SELECT DISTINCT src, dst, kind FROM (
  SELECT o AS src, s AS dst, 'contains' AS kind FROM rel WHERE roles & {1 << 10} > 0 OR roles & {1 << 17} > 0
  UNION ALL SELECT o, s, 'extends' FROM rel WHERE roles & {1 << 11} > 0 OR roles & {1 << 15} > 0
  UNION ALL SELECT s, o, 'overrides' FROM rel WHERE roles & {1 << 12} > 0
  UNION ALL SELECT o, s, 'calls' FROM rel WHERE roles & {1 << 14} > 0
  UNION ALL SELECT s, o, 'accesses' FROM rel WHERE roles & {1 << 16} > 0
  UNION ALL SELECT s, o, 'instantiates' FROM rel WHERE roles & {1 << 19} > 0)
""")
def native_relations(spark, sf, nodes, edges):
    li = _t(spark, sf, "lineitem")
    roles = (F.col("l_partkey") * 2654435761 + F.col("l_linenumber") * 40503) % 1048576
    return artifacts.native_relations(li.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("subject"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("object"), roles.alias("roles")))


@query(f"""
WITH occ AS (SELECT 'o:' || l_orderkey AS s, 's:' || l_suppkey AS o, l_linenumber AS line, l_partkey % 33 AS k,
  (l_partkey * 2654435761 + l_linenumber * 40503) % 128 + CASE WHEN l_partkey % 5 = 0 THEN {1 << 20} ELSE 0 END AS roles FROM lineitem)
SELECT s AS src, o AS dst, 'calls' AS kind, line FROM occ WHERE roles & 32 > 0 UNION ALL SELECT s, o, 'instantiates', line FROM occ WHERE roles & 32 > 0 AND k = 23
UNION ALL SELECT s, o, 'accesses', line FROM occ WHERE roles & 8 > 0 OR roles & 16 > 0 UNION ALL SELECT s, o, 'references', line FROM occ WHERE roles & 4 > 0
UNION ALL SELECT s, o, 'type_ref', line FROM occ WHERE (roles & 4 > 0 OR roles & {1 << 20} > 0) AND k IN (6, 7, 8, 9, 10, 11, 12, 28, 29, 31)
""")
def native_occurrences(spark, sf, nodes, edges):
    li = _t(spark, sf, "lineitem")
    roles = (F.col("l_partkey") * 2654435761 + F.col("l_linenumber") * 40503) % 128 + F.when(F.col("l_partkey") % 5 == 0, 1 << 20).otherwise(0)
    occ = li.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("owner"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("symbol"), (F.col("l_partkey") % 33).alias("target_kind"), roles.alias("roles"), F.col("l_linenumber").alias("line"))
    return artifacts.native_occurrences(occ, nodes)[0]


@query("""
WITH asked AS (SELECT DISTINCT id AS file, regexp_extract(file, '^(.*)\\.ts$', 1) AS path FROM nodes UNION SELECT id, 'none/' || id FROM nodes)
SELECT file, path, path || '.ts' AS target FROM asked WHERE path || '.ts' IN (SELECT file FROM nodes)
""")
def resolve_modules(spark, sf, nodes, edges):
    asked = nodes.select(F.col("id").alias("file"), F.regexp_extract("file", r"^(.*)\.ts$", 1).alias("path")).unionAll(nodes.select("id", F.concat(F.lit("none/"), "id")))
    return assembly.resolve_modules(asked, nodes.select("file").distinct(), ["", ".ts", ".tsx", "/index.ts"])


def _native(spark, sf):
    """A native snapshot of the tables: suppliers and parts are symbols, orders include nations' headers, line items use parts."""
    s, p, li = _t(spark, sf, "supplier"), _t(spark, sf, "part"), _t(spark, sf, "lineitem")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    owners = s.select(text("s", "s_suppkey").alias("id"), F.lit("").alias("owner"), F.col("s_name").alias("name"), F.lit(7).alias("code"), F.concat(text("src/n", "s_nationkey"), F.lit(".h")).alias("file"), (F.col("s_suppkey") % 50 + 1).alias("line"), (F.col("s_acctbal") > 0).alias("exported"))
    n = s.count()
    parts = p.select(text("p", "p_partkey").alias("id"), F.concat(F.lit("s"), (F.col("p_partkey") % n).cast("string")).alias("owner"), F.col("p_name").alias("name"), (F.col("p_partkey") % 35).cast("int").alias("code"), F.concat(text("src/b", "p_size"), F.lit(".cc")).alias("file"), (F.col("p_partkey") % 90 + 1).alias("line"), F.lit(False).alias("exported"))
    includes = p.select(F.concat(text("src/b", "p_size"), F.lit(".cc")).alias("source"), F.concat(F.lit("src/n"), (F.col("p_partkey") % 25).cast("string"), F.lit(".h")).alias("target"), F.lit(1).alias("line"))
    modules = _t(spark, sf, "region").select(F.col("r_name").alias("name"), F.concat(text("src/n", "r_regionkey"), F.lit(".h")).alias("file"), F.lit(2).alias("line"))
    uses = li.select(text("s", "l_suppkey").alias("owner"), text("p", "l_partkey").alias("symbol"), (F.col("l_partkey") % 35).cast("int").alias("target_kind"), F.when(F.col("l_returnflag") == "R", 32).when(F.col("l_returnflag") == "A", 4).otherwise(8).alias("roles"), F.col("l_linenumber").cast("int").alias("line"))
    relations = li.select(text("p", "l_partkey").alias("subject"), text("s", "l_suppkey").alias("object"), F.when(F.col("l_linestatus") == "O", 1 << 14).otherwise(1 << 16).alias("roles"))
    macros = _t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, 4).otherwise(6).alias("roles"), F.concat(text("src/b", "n_nationkey"), F.lit(".cc")).alias("file"), F.concat(text("src/n", "n_nationkey"), F.lit(".h")).alias("definition"), F.lit(3).alias("line"))
    return {"symbols": owners.unionByName(parts), "includes": includes, "modules": modules, "occurrences": uses, "relations": relations, "macros": macros}


@query("""
WITH n AS (SELECT count(*) AS n FROM supplier), lanes AS (
  SELECT 0 AS lane, 'src/n' || s_nationkey || '.h' AS src, 's' || s_suppkey AS dst, 'contains' AS kind, s_suppkey % 50 + 1 AS line FROM supplier
  UNION ALL SELECT 0, 'src/n' || s_nationkey || '.h', 's' || s_suppkey, 'exports', s_suppkey % 50 + 1 FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 0, 's' || (p_partkey % n), 'p' || p_partkey, 'contains', p_partkey % 90 + 1 FROM part, n
  UNION ALL SELECT 1, 'src/b' || p_size || '.cc', 'src/n' || (p_partkey % 25) || '.h', 'imports', 1 FROM part
  UNION ALL SELECT 2, 'src/n' || r_regionkey || '.h', 'module:' || r_name, 'imports', 2 FROM region
  UNION ALL SELECT 3, 's' || l_suppkey, 'p' || l_partkey, unnest(list_filter([
      CASE WHEN l_returnflag = 'R' THEN 'calls' END, CASE WHEN l_returnflag = 'R' AND l_partkey % 35 = 23 THEN 'instantiates' END, CASE WHEN l_returnflag = 'N' THEN 'accesses' END,
      CASE WHEN l_returnflag = 'A' THEN 'references' END, CASE WHEN l_returnflag = 'A' AND l_partkey % 35 IN (6, 7, 8, 9, 10, 11, 12, 28, 29, 31) THEN 'type_ref' END], lambda k: k IS NOT NULL)), l_linenumber FROM lineitem
  UNION ALL SELECT 4, 's' || l_suppkey, 'p' || l_partkey, 'calls', NULL FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 4, 'p' || l_partkey, 's' || l_suppkey, 'accesses', NULL FROM lineitem WHERE l_linestatus <> 'O'
  UNION ALL SELECT 5, 'src/b' || n_nationkey || '.cc', 'macro:' || n_name, 'references', 3 FROM nation
  UNION ALL SELECT 5, 'src/n' || n_nationkey || '.h', 'macro:' || n_name, 'contains', 3 FROM nation WHERE n_nationkey % 2 = 1
) SELECT src, dst, kind, arg_min(line, lane * 100000 + coalesce(line, 99999)) AS line FROM lanes GROUP BY src, dst, kind
""")
def native_edges(spark, sf, nodes, edges):
    return snapshots.native_graph(_native(spark, sf))[1]


KINDS = "{1: 'module', 2: 'namespace', 3: 'namespace', 4: 'variable', 5: 'file', 6: 'enum', 7: 'class', 8: 'class', 9: 'interface', 10: 'type', 11: 'type', 12: 'type', 13: 'function', 14: 'variable', 15: 'field', 16: 'field', 17: 'method', 18: 'method', 19: 'method', 20: 'property', 21: 'property', 22: 'property', 23: 'constructor', 24: 'method', 25: 'method', 26: 'parameter', 27: 'type', 28: 'type', 29: 'type', 30: 'parameter', 31: 'interface'}"


@query(f"""
SELECT 's' || s_suppkey AS id, 'class' AS kind FROM supplier UNION ALL SELECT 'p' || p_partkey, coalesce(MAP {KINDS}[p_partkey % 35], 'external_symbol') FROM part
UNION ALL SELECT 'module:' || r_name, 'module' FROM region UNION ALL SELECT 'macro:' || n_name, 'variable' FROM nation
UNION ALL SELECT DISTINCT f, 'file' FROM (SELECT 'src/n' || s_nationkey || '.h' AS f FROM supplier UNION ALL SELECT 'src/b' || p_size || '.cc' FROM part UNION ALL SELECT 'src/n' || (p_partkey % 25) || '.h' FROM part
  UNION ALL SELECT 'src/n' || r_regionkey || '.h' FROM region UNION ALL SELECT unnest(['src/b' || n_nationkey || '.cc', 'src/n' || n_nationkey || '.h']) FROM nation)
""")
def native_nodes(spark, sf, nodes, edges):
    return snapshots.native_graph(_native(spark, sf))[0].select("id", "kind")


@query("""
WITH m AS (SELECT CASE WHEN kind IN ('module', 'class') THEN file ELSE id END AS f, id FROM nodes), moved AS (SELECT coalesce(f, src) AS src, dst, kind FROM edges LEFT JOIN m ON m.id = src)
SELECT src, dst, kind, count(*) AS n FROM moved GROUP BY src, dst, kind
""")
def fold_module_edges(spark, sf, nodes, edges):
    """Edges with modules and classes as the files they are in."""
    rows = nodes.withColumn("kind", F.when(F.col("kind") == "class", "module").otherwise(F.col("kind")))
    return snapshots.fold_modules(rows, edges)[1].groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT 't' || (l_suppkey % 40) AS type, 'm' || (l_partkey % 12) AS name FROM lineitem WHERE l_orderkey % 97 = 0 AND l_suppkey % 40 > 5),
i AS (SELECT DISTINCT 'i' || (l_suppkey % 40) AS type, 'm' || (l_partkey % 12) AS name FROM lineitem WHERE l_orderkey % 211 = 0 AND l_suppkey % 40 <= 5),
size AS (SELECT type, count(*) AS n FROM i GROUP BY type), met AS (SELECT m.type AS impl, i.type AS base, name FROM m JOIN i USING (name)),
fits AS (SELECT impl, base FROM met GROUP BY impl, base HAVING count(*) = (SELECT n FROM size WHERE size.type = base))
SELECT impl AS src, base AS dst, 'implements' AS kind FROM fits UNION ALL SELECT base || '.' || name, impl || '.' || name, 'dispatches' FROM met JOIN fits USING (impl, base)
""")
def go_method_sets(spark, sf, nodes, edges):
    li, low = _t(spark, sf, "lineitem"), F.col("l_suppkey") % 40 <= 5
    name = F.concat(F.lit("m"), (F.col("l_partkey") % 12).cast("string"))
    rows = li.filter(F.when(low, F.col("l_orderkey") % 211 == 0).otherwise(F.col("l_orderkey") % 97 == 0))
    rows = rows.select(F.concat(F.when(low, "i").otherwise("t"), (F.col("l_suppkey") % 40).cast("string")).alias("type"), low.alias("abstract"), name.alias("name"), F.lit("func()").alias("signature")).distinct()
    return snapshots.go_dispatches(rows.withColumn("id", F.concat("type", F.lit("."), "name")))


@query("""
WITH own AS (SELECT 'c:' || c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'N' || (c_nationkey % 3) || '.(anonymous namespace).T' || (c_custkey % 60) ELSE 'N' || (c_nationkey % 3) || '.T' || (c_custkey % 60) END AS fullname,
    c_acctbal > 5000 AS body, c_acctbal > 2000 AS exported, CASE WHEN c_custkey % 5 = 0 THEN 'swift' ELSE 'cpp' END AS language FROM customer),
keys AS (SELECT fullname AS k, 0 AS tier, * FROM own WHERE language = 'cpp' UNION ALL SELECT replace(fullname, '.(anonymous namespace)', ''), 1, * FROM own WHERE language = 'cpp' AND contains(fullname, '(anonymous')),
best AS (SELECT k, arg_min(id, (tier, NOT body, NOT exported, id)) AS src FROM keys GROUP BY k), sole AS (SELECT fullname AS k, min(id) AS src FROM own WHERE language = 'swift' GROUP BY fullname HAVING count(*) = 1),
loose AS (SELECT 'o:' || o_orderkey AS dst, 'N' || (o_custkey % 3) || '.T' || (o_orderkey % 60) AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'swift' ELSE 'cpp' END AS language FROM orders)
SELECT src, dst, 'contains' AS kind FROM loose JOIN best USING (k) WHERE language = 'cpp' UNION ALL SELECT src, dst, 'contains' FROM loose JOIN sole USING (k) WHERE language = 'swift'
""")
def distant_owners(spark, sf, nodes, edges):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    text = lambda prefix, e: F.concat(F.lit(prefix), e.cast("string"))
    middle = F.when(F.col("c_custkey") % 7 == 0, ".(anonymous namespace).T").otherwise(".T")
    null = F.lit(None).cast("string")
    types = c.select(text("c:", F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 5 == 0, "swift").otherwise("cpp").alias("language"), F.lit("class").alias("kind"), F.concat(text("N", F.col("c_nationkey") % 3), middle, (F.col("c_custkey") % 60).cast("string")).alias("full"), null.alias("owner_id"), null.alias("owner_name"), (F.col("c_acctbal") > 5000).alias("has_body"), (F.col("c_acctbal") > 2000).alias("exported"))
    owner = F.concat(text("N", F.col("o_custkey") % 3), text(".T", F.col("o_orderkey") % 60))
    loose = o.select(text("o:", F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "swift").otherwise("cpp").alias("language"), F.lit("method").alias("kind"), text("m", F.col("o_orderkey")).alias("full"), null.alias("owner_id"), owner.alias("owner_name"), F.lit(True).alias("has_body"), F.lit(False).alias("exported"))
    return assembly.distant_owners(types.unionByName(loose))


@query("""
WITH a AS (SELECT 'x' || (s_suppkey % 60) AS id, min(s_name) AS name FROM supplier GROUP BY 1), b AS (SELECT 'x' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey < 90)
SELECT id, name FROM a UNION ALL SELECT id, name FROM b WHERE id NOT IN (SELECT id FROM a)
""")
def topology_assemble(spark, sf, nodes, edges):
    """Nodes of two providers, the first one's first."""
    s, c = _t(spark, sf, "supplier"), _t(spark, sf, "customer").filter("c_custkey < 90")
    one = s.select(F.concat(F.lit("x"), (F.col("s_suppkey") % 60).cast("string")).alias("id"), F.col("s_name").alias("name"))
    two = c.select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    none = spark.createDataFrame([], "src string, dst string, kind string, authority string")
    return topology.assemble({"a": {"nodes": one, "edges": none}, "b": {"nodes": two, "edges": none}}, {"c": ("cargo", "gone")}, spark)["nodes"].select("id", "name")


@query("""
SELECT id FROM nodes WHERE NOT (CASE line % 4 WHEN 0 THEN true WHEN 1 THEN kind = 'class' WHEN 2 THEN coalesce(qualified_name, name) = name ELSE language = 'cpp' END)
""")
def semantic_mismatches(spark, sf, nodes, edges):
    """Ids made with another kind, name or language than the node has."""
    shown, four = F.coalesce("qualified_name", "name"), F.col("line") % 4
    display = docs.encode_component(F.when(four == 2, F.col("name")).otherwise(shown))
    made = F.concat(F.lit("@v2/"), F.when(four == 3, "cpp").otherwise(F.col("language")), F.lit("/"), F.sha2("id", 256), F.lit("#"), display, F.lit(":"), F.when(four == 1, "class").otherwise(F.col("kind")))
    rows = nodes.select(F.col("id").alias("old"), made.alias("id"), "language", "kind", "name", "qualified_name")
    return contract.semantic_violations(rows).join(rows.select("id", "old").distinct(), "id").select(F.col("old").alias("id"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
