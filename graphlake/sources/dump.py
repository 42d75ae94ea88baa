"""Graph dumps as JSON, frame logs, and source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.schema import DUMP, EDGE, NODE

# Extension and languages of a source file.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "py": "python", "go": "go", "rs": "rust",
    "c": "c", "h": "c cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "cs": "csharp", "rb": "ruby", "php": "php", "lua": "lua", "dart": "dart", "swift": "swift", "scala": "scala", "zig": "zig",
}
IGNORED = r"(^|/)(node_modules|\.git|dist|build|target|vendor|coverage|__pycache__|\.venv|bin|obj|out)(/|$)"


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump: nodes and edges with their order, and the trust tables. A malformed dump fails."""
    doc = spark.read.schema(DUMP).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*").withColumnRenamed("qualifiedName", "qualified_name")
    nodes = nodes.withColumn("evidence", _own_file(F.col("evidence"), F.col("file"))).withColumn("line", F.col("evidence.startLine"))
    for flag in ("external", "ignored", "exported", "closure"):
        nodes = nodes.withColumn(flag, F.coalesce(flag, F.lit(False)))
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select(
        "ord", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind", "e.evidence", F.col("e.evidence.startLine").alias("line")
    )
    # A span without a file is in its source node's file.
    files = nodes.select(F.col("id").alias("src"), F.col("file").alias("__f"))
    edges = edges.join(files, "src", "left").withColumn("evidence", _own_file(F.col("evidence"), F.col("__f"))).drop("__f")
    out = {"nodes": nodes, "edges": edges}
    for name in ("coverage", "unresolved", "diagnostics"):
        out[name] = doc.select(F.explode(name).alias("x")).select("x.*")
    out["warnings"] = doc.select(F.posexplode("warnings").alias("ord", "text"))
    return out


def _own_file(span, file):
    return F.when(span.isNotNull(), span.withField("file", F.coalesce(span["file"], file)))


def wire_spans(nodes: DataFrame) -> DataFrame:
    """Spans without the file where the row says it."""
    return nodes.withColumn("evidence", F.when(F.col("evidence.file") == F.col("file"), F.col("evidence").dropFields("file")).otherwise(F.col("evidence").dropFields("file")))


def wire_edge_spans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spans of edges without the file where it is their source node's, or the source is a file itself."""
    files = nodes.select(F.col("id").alias("src"), F.col("file").alias("__f"))
    own = F.coalesce("__f", "src")
    bare = F.when(F.col("evidence.file") == own, F.col("evidence").withField("file", F.lit(None).cast("string"))).otherwise(F.col("evidence"))
    return edges.join(files, "src", "left").withColumn("evidence", bare).select(*edges.columns)


def write_dump(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a dump (as ``read_dump`` gives them) as JSON lines, each in a folder of its own; ``read_lines`` reads them back."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("ignoreNullFields", True).json(f"{path}/{name}")


def read_lines(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables that ``write_dump`` wrote, by name and schema; a malformed line fails."""
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in schemas.items()}


#: What a Go exporter writes, as one document.
GO = (
    f"schemaVersion int, projectRoot string, languages array<string>, tool struct<name:string,version:string,compilerVersion:string,protocolVersion:int>, universe string, "
    f"capabilities array<string>, sources array<struct<file:string,checkerDigest:string,diskDigest:string>>, nodes array<{NODE}>, edges array<{EDGE}>, "
    "diagnostics array<struct<file:string,line:int,column:int,code:string,message:string,severity:string>>, warnings array<string>"
)


def read_go_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a Go snapshot: nodes and edges with their order, sources, diagnostics, and the header."""
    doc = spark.read.schema(GO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*").withColumnRenamed("qualifiedName", "qualified_name")
    nodes = nodes.withColumn("line", F.col("evidence.startLine"))
    for flag in ("external", "ignored", "exported", "closure"):
        nodes = nodes.withColumn(flag, F.coalesce(flag, F.lit(False)))
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select("ord", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind", "e.evidence", F.col("e.evidence.startLine").alias("line"))
    out = {"nodes": nodes, "edges": edges, "header": doc.select("schemaVersion", "projectRoot", "languages", "tool", "universe", "capabilities")}
    return out | {t: doc.select(F.explode(t).alias("x")).select("x.*") for t in ("sources", "diagnostics")}


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A frame log: a JSON object in each line; a blank or malformed line is an error when it is read."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", "kind string, seq long, shard string, digest string, payload string")
    rows = lines.withColumn("f", parsed)
    ok = F.when((F.trim("value") == "") | F.col("f.kind").isNull(), F.raise_error(F.concat(F.lit("not a frame: "), "value"))).otherwise(F.col("f"))
    return rows.select(ok.alias("f")).select("f.*")


def walk_sources(spark: SparkSession, root: str, ignored: str = IGNORED) -> DataFrame:
    """``file``, ``language``, ``text`` of the source files under a folder; a file of two languages has two rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    name = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    rel = F.substring(name, len(base) + 2, 1 << 20)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    named = files.withColumn("file", rel).filter(~F.rlike("file", F.lit(ignored)))
    language = F.explode(F.split(F.element_at(known, F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1))), " "))
    return named.select("file", F.decode("content", "UTF-8").alias("text"), language.alias("language"))


def consistent_sources(sources: DataFrame) -> DataFrame:
    """Texts that are what was indexed: the recorded digest is theirs; others have no lines to show."""
    return sources.filter(F.sha2(F.col("text").cast("binary"), 256) == F.col("checker_digest"))


def source_lines(sources: DataFrame) -> DataFrame:
    """``file``, ``line`` (from 1), ``text``."""
    return sources.select("file", F.posexplode(F.split("text", r"\r?\n", -1)).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")
