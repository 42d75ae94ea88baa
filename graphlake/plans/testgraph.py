"""A property graph of the standard tables, on which the graph queries are run.

Regions, nations, suppliers, customers, orders and parts are declarations in
files; keys and line items are the relationships between them. Among the files are
tests, fixtures, vendored and internal ones; among the declarations closures,
overloads with their arguments, state, and types without a body that others
implement; edges have lines and columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.sources.shared import shared_dir


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _case(*cases, other):
    out = other
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


_written: dict[tuple[str, str], list[str]] = {}


def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` as a snapshot: written to the shared folder once in an application, and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    paths = _written.get(key)
    if paths is None or not all(_exists(spark, p) for p in paths):
        at = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        paths = [f"{at}/nodes", f"{at}/edges"]
        for df, path in zip(derive(spark, sf_dir), paths, strict=True):
            df.write.parquet(path)
        _written[key] = paths
    return spark.read.parquet(paths[0]), spark.read.parquet(paths[1])


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def derive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` as they come from a reader: no file nodes yet."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in "region nation supplier customer part orders lineitem".split()}
    no, null, ts = F.lit(False), F.lit(None).cast("string"), F.lit("typescript")

    def node(df, id_, kind, name, qualified, file, external=no, ignored=no, exported=no, line=F.lit(1), closure=no, language=ts):
        return df.select(
            id_.alias("id"),
            kind.alias("kind"),
            language.alias("language"),
            name.alias("name"),
            qualified.alias("qualified_name"),
            file.alias("file"),
            external.alias("external"),
            ignored.alias("ignored"),
            exported.alias("exported"),
            closure.alias("closure"),
            line.cast("int").alias("line"),
        )

    mod = lambda c, n, r: F.col(c) % n == r
    at = lambda c, n, prefix="", end=".ts": F.concat(F.lit(prefix), (F.col(c) % n).cast("string"), F.lit(end))
    nation = F.broadcast(t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows
    supplier = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    seg = lambda *rest: F.concat(F.lit("customer/"), F.col("c_mktsegment"), *rest)
    c_file = _case(
        (mod("c_custkey", 10, 9), seg(F.lit("/test_c9.ts"))), (mod("c_custkey", 10, 8), seg(F.lit("/c8.spec.ts"))),
        (mod("c_custkey", 10, 7), seg(F.lit("/tests/c7.ts"))), other=seg(at("c_custkey", 10, "/c")),
    )
    own = lambda top, *rest: F.concat(F.lit(top), F.col("n_name"), *rest)
    s_file = _case(
        (mod("s_suppkey", 10, 9), own("supplier/", F.lit("/__fixtures__/s9.ts"))), (mod("s_suppkey", 10, 8), own("vendor/", F.lit("/s8.ts"))),
        (mod("s_suppkey", 10, 7), own("supplier/", F.lit("/internal/s7.ts"))), other=own("supplier/", at("s_suppkey", 10, "/s")),
    )
    geo = F.concat(F.lit("geo/"), F.col("r_name"), F.lit(".ts"))
    p_file = F.concat(F.lit("part/"), F.col("p_brand"), F.when(mod("p_partkey", 19, 0), F.lit("_test.ts")).otherwise(F.lit(".ts")))
    p_name = F.when(mod("p_partkey", 23, 0), F.concat(F.lit("_"), F.col("p_name"))).otherwise(F.col("p_name"))
    p_kind = _case((mod("p_partkey", 11, 0), F.lit("variable")), (mod("p_partkey", 13, 0), F.lit("interface")), (mod("p_partkey", 17, 0), F.lit("property")), other=F.lit("function"))
    cpp = mod("p_partkey", 29, 0)
    o_name = F.concat(_id("order", "o_orderkey"), F.when(mod("o_orderkey", 3, 0), F.lit("(Order)")).otherwise(F.lit("")))
    kind = F.lit
    nodes = [
        node(t["region"], _id("r:", "r_regionkey"), kind("namespace"), F.col("r_name"), null, geo),
        node(nation, _id("n:", "n_nationkey"), kind("module"), F.col("n_name"), F.concat_ws(".", "r_name", "n_name"), geo, line=F.col("n_nationkey") + 1),
        node(supplier, _id("s:", "s_suppkey"), kind("class"), F.col("s_name"), F.concat_ws(".", "n_name", "s_name"), s_file, exported=F.col("s_acctbal") > 0, line=F.col("s_suppkey") % 1000 + 1),
        node(customer, _id("c:", "c_custkey"), kind("class"), F.col("c_name"), F.concat_ws(".", "n_name", "c_name"), c_file, external=F.col("c_mktsegment") == "FURNITURE", exported=F.col("c_acctbal") > 0, line=F.col("c_custkey") % 1000 + 1),
        node(orders, _id("o:", "o_orderkey"), kind("method"), o_name, F.concat(F.col("c_name"), F.lit("."), o_name), c_file, line=F.col("o_orderkey") % 1000 + 1, closure=mod("o_orderkey", 97, 0)),
        node(t["part"], _id("p:", "p_partkey"), p_kind, p_name, F.when(cpp, F.concat(F.col("p_brand"), F.lit("::"), F.col("p_name"))), p_file, ignored=F.col("p_type") == "PROMO", exported=F.col("p_size") < 10, line=F.col("p_partkey") % 1000 + 1, language=F.when(cpp, F.lit("cpp")).otherwise(ts)),
    ]

    def edge(df, src, dst, kind, line=F.lit(1), col=F.lit(None)):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), line.cast("int").alias("line"), col.cast("int").alias("col"))

    items = t["lineitem"]
    pairs = lambda a, b, df: df.groupBy(a, b).agg(F.min("l_linenumber").alias("line"))
    op = pairs("l_orderkey", "l_partkey", items)
    ps = pairs("l_partkey", "l_suppkey", items)
    of = lambda flag: items.filter(F.col("l_returnflag") == flag)
    o, p, s, c = _id("o:", "l_orderkey"), _id("p:", "l_partkey"), _id("s:", "l_suppkey"), _id("c:", "c_custkey")
    seventh, some = mod("l_partkey", 7, 0), (F.col("l_partkey") + F.col("l_suppkey")) % 20 == 0
    parts, of_part = t["part"], t["part"].select(F.col("p_partkey").alias("k"))
    suppliers = t["supplier"].select(F.col("s_suppkey").alias("k"))
    to = lambda df, key, other: df.join(other, key == F.col("k"), "left_semi")
    edges = [
        edge(t["nation"], _id("r:", "n_regionkey"), _id("n:", "n_nationkey"), "contains"),
        edge(t["supplier"], _id("n:", "s_nationkey"), _id("s:", "s_suppkey"), "contains"),
        edge(t["customer"], _id("n:", "c_nationkey"), c, "contains"),
        edge(t["orders"], _id("c:", "o_custkey"), _id("o:", "o_orderkey"), "contains"),
        edge(op, o, p, "calls", F.col("line"), F.col("l_partkey") % 80),
        edge(ps.filter(~seventh), p, s, "instantiates", F.col("line"), F.col("l_suppkey") % 80),
        edge(ps.filter(seventh & some), p, s, "overrides", F.col("line"), F.col("l_suppkey") % 80),
        edge(ps.filter(seventh & ~some), p, s, "type_ref", F.col("line"), F.col("l_suppkey") % 80),
        edge(pairs("l_orderkey", "l_suppkey", of("R")), o, s, "accesses", F.col("line"), F.col("l_suppkey") % 80),
        edge(pairs("l_orderkey", "l_suppkey", of("A").filter(mod("l_partkey", 2, 0))), o, s, "type_ref", F.col("line")),
        edge(pairs("l_orderkey", "l_partkey", of("N").filter(mod("l_orderkey", 5, 0))), o, p, "tests", F.col("line")),
        edge(to(parts.filter(mod("p_partkey", 7, 0)), F.col("p_partkey") + 1, of_part), _id("p:", "p_partkey"), F.concat(F.lit("p:"), (F.col("p_partkey") + 1).cast("string")), "accesses", F.lit(3)),
        edge(to(parts.filter(mod("p_partkey", 5, 0)), F.col("p_partkey") + 2, of_part), _id("p:", "p_partkey"), F.concat(F.lit("p:"), (F.col("p_partkey") + 2).cast("string")), "references", F.lit(4), F.lit(2)),
        edge(to(t["customer"].filter(mod("c_custkey", 4, 0)), F.col("c_custkey") % 40 + 1, suppliers), c, F.concat(F.lit("s:"), (F.col("c_custkey") % 40 + 1).cast("string")), "implements", F.lit(2)),
        edge(to(t["customer"].filter(mod("c_custkey", 4, 0)), F.col("c_custkey") % 50 + 1, of_part), c, F.concat(F.lit("p:"), (F.col("c_custkey") % 50 + 1).cast("string")), "calls", F.lit(5), F.lit(1)),
        edge(to(t["customer"].filter(mod("c_custkey", 6, 1)), F.col("c_custkey") + 5, t["customer"].select(F.col("c_custkey").alias("k"))), c, F.concat(F.lit("c:"), (F.col("c_custkey") + 5).cast("string")), "extends", F.lit(1), F.lit(20)),
        edge(t["supplier"].filter(mod("s_suppkey", 3, 0)), _id("n:", "s_nationkey"), _id("s:", "s_suppkey"), "decorates", F.col("s_suppkey") % 9 + 1),
        edge(parts.filter(F.col("p_size") < 10), p_file, _id("p:", "p_partkey"), "exports"),
        edge(supplier.filter(F.col("s_acctbal") > 0), s_file, _id("s:", "s_suppkey"), "exports"),
        edge(t["supplier"].filter((F.col("s_acctbal") > 0) & mod("s_suppkey", 2, 0)), F.lit("index.ts"), _id("s:", "s_suppkey"), "exports"),
        edge(t["customer"].filter(F.col("c_acctbal") > 0), c_file, c, "exports"),
    ]
    out_n, out_e = nodes[0], edges[0]
    for n in nodes[1:]:
        out_n = out_n.unionByName(n)
    for e in edges[1:]:
        out_e = out_e.unionByName(e)
    return out_n, out_e


_S_FILE = """CASE s_suppkey % 10 WHEN 9 THEN 'supplier/' || n_name || '/__fixtures__/s9.ts' WHEN 8 THEN 'vendor/' || n_name || '/s8.ts'
  WHEN 7 THEN 'supplier/' || n_name || '/internal/s7.ts' ELSE 'supplier/' || n_name || '/s' || (s_suppkey % 10) || '.ts' END"""
_C_FILE = """'customer/' || c_mktsegment || CASE c_custkey % 10 WHEN 9 THEN '/test_c9.ts' WHEN 8 THEN '/c8.spec.ts' WHEN 7 THEN '/tests/c7.ts' ELSE '/c' || (c_custkey % 10) || '.ts' END"""
_P_FILE = "'part/' || p_brand || CASE WHEN p_partkey % 19 = 0 THEN '_test.ts' ELSE '.ts' END"
_O_NAME = "'order' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '(Order)' ELSE '' END"
#: The same tables in SQL, as common table expressions; ``flags`` says of each node whether it is a test, support, and outside the project.
SQL = rf"""
nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'namespace' AS kind, 'typescript' AS language, r_name AS name, NULL::VARCHAR AS qualified_name,
         'geo/' || r_name || '.ts' AS file, false AS external, false AS ignored, false AS exported, false AS closure, 1 AS line FROM region
  UNION ALL
  SELECT 'n:' || n_nationkey, 'module', 'typescript', n_name, r_name || '.' || n_name, 'geo/' || r_name || '.ts', false, false, false, false, n_nationkey + 1
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 's:' || s_suppkey, 'class', 'typescript', s_name, n_name || '.' || s_name, {_S_FILE}, false, false, s_acctbal > 0, false, s_suppkey % 1000 + 1
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'c:' || c_custkey, 'class', 'typescript', c_name, n_name || '.' || c_name, {_C_FILE}, c_mktsegment = 'FURNITURE', false, c_acctbal > 0, false, c_custkey % 1000 + 1
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'o:' || o_orderkey, 'method', 'typescript', {_O_NAME}, c_name || '.' || {_O_NAME}, {_C_FILE}, false, false, false, o_orderkey % 97 = 0, o_orderkey % 1000 + 1
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'p:' || p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'variable' WHEN p_partkey % 13 = 0 THEN 'interface' WHEN p_partkey % 17 = 0 THEN 'property' ELSE 'function' END,
         CASE WHEN p_partkey % 29 = 0 THEN 'cpp' ELSE 'typescript' END, CASE WHEN p_partkey % 23 = 0 THEN '_' ELSE '' END || p_name,
         CASE WHEN p_partkey % 29 = 0 THEN p_brand || '::' || p_name END, {_P_FILE}, false, p_type = 'PROMO', p_size < 10, false, p_partkey % 1000 + 1 FROM part
), flags AS (
  SELECT id, regexp_matches(file, '(^|/)(test|tests|__tests__|spec)/|(^|/)[A-Za-z0-9_]*Test/|\.(test|spec)\.[^/]+$|(^|/)test[-_][^/]+\.[^/]+$|_test\.[^/]+$') AS test,
         file = '' OR regexp_matches(file, '^bundled://|(^|/)(deps|node_modules|vendor|site-packages)/|(^|/)(test|tests|__tests__|spec|samples?|fixtures?|__fixtures__|examples?)/|\.(test|spec)\.[^/]+$|_test\.[^/]+$|(^|/)typings\.[cm]?ts$|\.d\.[cm]?ts$|(^|/)(dist|build|coverage|generated|__generated__|gen)/') AS support,
         external OR regexp_matches(file, '^bundled://|(^|/)(node_modules|vendor|site-packages)/') AS outside
  FROM nodes
), production AS (
  SELECT id FROM nodes JOIN flags USING (id) WHERE NOT external AND NOT ignored AND NOT test AND NOT support
), edges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'contains' AS kind, 1 AS line, NULL::INT AS col FROM nation
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'contains', 1, NULL FROM supplier
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains', 1, NULL FROM customer
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'contains', 1, NULL FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'calls', min(l_linenumber), l_partkey % 80 FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, CASE WHEN l_partkey % 7 <> 0 THEN 'instantiates' WHEN (l_partkey + l_suppkey) % 20 = 0 THEN 'overrides' ELSE 'type_ref' END,
    min(l_linenumber), l_suppkey % 80 FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'accesses', min(l_linenumber), l_suppkey % 80 FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'type_ref', min(l_linenumber), NULL FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 2 = 0 GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'tests', min(l_linenumber), NULL FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey % 5 = 0 GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'p:' || p_partkey, 'p:' || (p_partkey + 1), 'accesses', 3, NULL FROM part WHERE p_partkey % 7 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'p:' || p_partkey, 'p:' || (p_partkey + 2), 'references', 4, 2 FROM part WHERE p_partkey % 5 = 0 AND p_partkey + 2 IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'c:' || c_custkey, 's:' || (c_custkey % 40 + 1), 'implements', 2, NULL FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 40 + 1 IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'c:' || c_custkey, 'p:' || (c_custkey % 50 + 1), 'calls', 5, 1 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 50 + 1 IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'c:' || c_custkey, 'c:' || (c_custkey + 5), 'extends', 1, 20 FROM customer WHERE c_custkey % 6 = 1 AND c_custkey + 5 IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'decorates', s_suppkey % 9 + 1, NULL FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT {_P_FILE}, 'p:' || p_partkey, 'exports', 1, NULL FROM part WHERE p_size < 10
  UNION ALL SELECT {_S_FILE}, 's:' || s_suppkey, 'exports', 1, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0
  UNION ALL SELECT 'index.ts', 's:' || s_suppkey, 'exports', 1, NULL FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 2 = 0
  UNION ALL SELECT {_C_FILE}, 'c:' || c_custkey, 'exports', 1, NULL FROM customer WHERE c_acctbal > 0
)
"""
