"""Walks over a graph: bounded traces, reached nodes, shortest paths, junctions.

``trace`` and ``shortest_path`` answer one request: their limits are a few dozen
nodes, and their order is part of the answer, so each level is one join whose
result is collected (the edges of at most ``max_nodes`` nodes that the limits let
in). ``reach`` is the form without limits: frontier and visited nodes stay
tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.functions.text import is_external, is_test_path
from graphlake.operators.degrees import HUB, dispatch_edges
from graphlake.operators.details import TRACE_RANK, kind_rank, place_rank
from graphlake.schema import EXECUTION, STRUCTURAL, TYPE_FOCUS
from graphlake.sources.shared import materialize


def traversable(kind: Column, focus: str) -> Column:
    if focus == "execution":
        return kind.isin(*EXECUTION, "dispatches")
    if focus == "types":
        return kind.isin(TYPE_FOCUS)
    return ~kind.isin(STRUCTURAL)


def endpoint_rank() -> Column:
    """Where a walk goes first among edges of a kind: code that runs, then state, then types, and tests last."""
    kind = F.col("kind")
    rank = F.when(kind.isin("function", "method", "constructor", "class"), 0).when(kind == "variable", 1)
    rank = rank.when(kind.isin("property", "field"), 2).when(kind.isin("interface", "type"), 4).otherwise(3)
    return F.when(is_test_path(F.col("file")), 6).otherwise(rank)


def impact_rank() -> Column:
    """Where a walk of impact goes first: tests, then what is exported, and what is not the project's own last."""
    own = F.when(F.col("external") | F.coalesce("ignored", F.lit(False)), 4).otherwise(2)
    return F.when(is_test_path(F.col("file")), 0).when(F.col("exported"), 1).otherwise(own)


def walkable(nodes: DataFrame, edges: DataFrame, focus: str = "all", include_external: bool = False, forward: bool = True, impact: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Edges that a walk may take, with their order (``rank``), and the edges to what hubs of dispatch leave out.

    An edge counts if the end that it leads to does: that is no file, and not
    external unless asked for.
    """
    far = "dst" if forward else "src"
    base = edges.select("src", "dst", "kind", "line", place_rank(edges).alias("place"))
    omitted = None
    if focus != "types" and forward:
        made, omitted = dispatch_edges(nodes, edges)
        base = base.unionByName(made.withColumn("place", place_rank(made)).select(*base.columns))
    base = base.filter(traversable(F.col("kind"), focus))
    ok = nodes.filter("kind <> 'file'")
    if not include_external:
        ok = ok.filter(~is_external(F.col("external"), F.col("file")))
    ok = ok.select(F.col("id").alias(far), endpoint_rank().alias("__end"), impact_rank().alias("__impact"))
    kind = kind_rank(F.col("kind"), TRACE_RANK)
    # Three parts in one number: a place is under 10 ** 9, the other two are one digit or two.
    order = (F.col("__impact") * 100 + kind) if impact else (kind * 100 + F.col("__end"))
    base = base.join(ok, far).withColumn("rank", order.cast("long") * 10**10 + F.col("place")).select("src", "dst", "kind", "line", "rank")
    return base, None if omitted is None else omitted.join(ok.select(far), far, "left_semi")


#: Nodes in one row of what a node reaches, and of what starts reach in one task of the last step.
CHUNK, TASK_ROWS = 1_000, 1_500_000


def _chunks(rows: DataFrame) -> DataFrame:
    """``id``, ``depth``, ``ids`` of rows (id, to, depth): what a node reaches at each depth, in rows of bounded length."""
    least = rows.repartition("id").groupBy("id", "to").agg(F.min("depth").alias("depth"))
    place = F.row_number().over(W.partitionBy("id").orderBy("depth", "to"))
    return least.withColumn("chunk", F.floor(place / CHUNK)).groupBy("id", "depth", "chunk").agg(F.collect_list("to").alias("ids")).drop("chunk")


def reach(starts: DataFrame, edges: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """``seed``, ``id``, ``depth``: all nodes within ``depth`` edges of each start (``seed``), starts included.

    What a node reaches goes, from the last step to the first, to the nodes that
    lead to it: it is found once, however many starts pass it. Only the last step
    has rows for each start, which meet in one shuffle.
    """
    own, far = ("src", "dst") if forward else ("dst", "src")
    hop = materialize(edges.select(F.col(own).alias("id"), F.col(far).alias("to")).distinct(), "hop")
    seeds = materialize(starts.select("seed").distinct(), "seeds")
    rounds, ids = [], seeds.select(F.col("seed").alias("id"))
    for _ in range(depth):
        rounds.append(materialize(hop.join(ids, "id", "left_semi"), "round"))
        ids = rounds[-1].select(F.col("to").alias("id")).distinct()
    near = None
    for step in reversed(rounds[1:]):
        rows = step.withColumn("depth", F.lit(1))
        if near is not None:
            further = step.join(near.withColumnRenamed("id", "to"), "to").select("id", F.explode("ids").alias("to"), (F.col("depth") + 1).alias("depth"))
            rows = rows.unionByName(further)
        near = materialize(_chunks(rows), "near")
    found = seeds.select("seed", F.array("seed").alias("ids"), F.lit(0).alias("depth"))
    for step in rounds[:1]:
        found = found.unionByName(step.select(F.col("id").alias("seed"), F.array("to").alias("ids"), F.lit(1).alias("depth")))
        if near is not None:
            further = step.join(near.withColumnRenamed("id", "to"), "to").select(F.col("id").alias("seed"), "ids", (F.col("depth") + 1).alias("depth"))
            found = found.unionByName(further)
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if near is not None:  # so many tasks that the rows of each fit its memory
        size = near.groupBy(F.col("id").alias("to")).agg(F.sum(F.size("ids")).alias("n"))
        parts = max(parts, (rounds[0].join(size, "to").agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)
    rows = found.repartition(parts, "seed").select("seed", F.explode("ids").alias("id"), "depth")
    return rows.groupBy("seed", "id").agg(F.min("depth").alias("depth"))


@dataclass
class Trace:
    """Nodes in the order they were reached with their depth, hops as edges in order, and whether a limit left an edge out."""

    reached: list[tuple[str, int]] = field(default_factory=list)
    hops: list[tuple[str, str, str, int | None]] = field(default_factory=list)
    truncated: bool = False


def _level(walk: DataFrame, own: str, far: str, frontier: list[str], seen: set[str], most: int) -> dict[str, list]:
    """The edges of a frontier that the limits can use, in order.

    Those are, of each node, the first ``most`` that lead to nodes not seen yet,
    and all that lead to a seen node or to one that this level may reach.
    """
    here = walk.filter(F.col(own).isin(frontier))
    order = W.partitionBy(own).orderBy("rank", far, "kind")
    first = here.filter(~F.col(far).isin(list(seen))).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r").collect()
    known = seen | {r[far] for r in first}
    rows = {(r["src"], r["dst"], r["kind"], r["rank"]): r for r in [*first, *here.filter(F.col(far).isin(list(known))).collect()]}
    by: dict[str, list] = {f: [] for f in frontier}
    for r in sorted(rows.values(), key=lambda r: (r["rank"], r[far], r["kind"])):
        by[r[own]].append(r)
    return by


def trace(nodes: DataFrame, edges: DataFrame, start: str, direction: str = "forward", focus: str = "all", max_depth: int = 3, max_nodes: int = 12, include_external: bool = False) -> Trace:
    """A bounded breadth-first walk; ``reverse`` and ``impact`` walk back, the latter with tighter limits and tests first.

    ``reached`` does not hold the start, nor do the limits count it.
    """
    impact, forward = direction == "impact", direction == "forward"
    max_depth = max(1, min(4 if impact else 8, max_depth))
    max_nodes = max(1, min(16 if impact else 32, max_nodes))
    max_hops = 2 * max_nodes
    walk, omitted = walkable(nodes, edges, focus, include_external, forward, impact)
    walk = materialize(walk, "walk")  # every level reads it
    omitted = None if omitted is None else materialize(omitted, "omitted")
    own, far = ("src", "dst") if forward else ("dst", "src")
    out, seen, frontier = Trace(), {start}, [start]
    for depth in range(max_depth + 1):
        if not frontier:
            break
        if omitted is not None and not out.truncated:
            out.truncated = not omitted.filter(F.col("src").isin(frontier)).isEmpty()
        if depth == max_depth:
            out.truncated = out.truncated or not walk.filter(F.col(own).isin(frontier)).isEmpty()
            break
        by, nxt = _level(walk, own, far, frontier, seen, max_hops + 1), []
        for node in frontier:
            for e in by[node]:
                other = e[far]
                if len(out.hops) >= max_hops or other not in seen and len(out.reached) >= max_nodes:
                    out.truncated = True
                    continue
                out.hops.append((e["src"], e["dst"], e["kind"], e["line"]))
                if other not in seen:
                    seen.add(other)
                    out.reached.append((other, depth + 1))
                    nxt.append(other)
        frontier = nxt
    return out


def roles(nodes: DataFrame) -> DataFrame:
    """``id``, ``roles`` (of exported and test) of what a walk of impact reaches."""
    both = F.array_compact(F.array(F.when(F.col("exported"), F.lit("exported")), F.when(is_test_path(F.col("file")), F.lit("test"))))
    return nodes.select("id", both.alias("roles"))


@dataclass
class Path:
    """Ids of a shortest path, the ends included, or none; then whether a limit may be why there is none."""

    ids: list[str]
    truncated: bool = False


def find_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, focus: str = "all", max_depth: int = 12, include_external: bool = False) -> Path:
    """A shortest path of at most ``max_depth`` edges.

    Levels stay tables, with the smallest parent of each node; only the path is
    collected. A hub of dispatch is crossed if the goal itself is behind it.
    """
    if start == goal:
        return Path([start])
    walk, omitted = walkable(nodes, edges, focus, include_external)
    hop = walk.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    if omitted is not None:
        omitted = materialize(omitted.select(F.col("src").alias("id"), F.col("dst").alias("to")), "omitted")
        hop = hop.unionByName(omitted.filter(F.col("to") == goal))
    hop = materialize(hop.distinct(), "walk")
    level = edges.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(None).cast("string").alias("parent"))
    levels, seen = [], level.select("id")
    for _ in range(max(1, min(12, max_depth))):
        nxt = level.join(hop, "id").groupBy(F.col("to").alias("node")).agg(F.min("id").alias("parent"))
        nxt = nxt.select(F.col("node").alias("id"), "parent").join(seen, "id", "left_anti")
        level = materialize(nxt, "level")
        levels.append(level)
        seen = seen.unionAll(level.select("id"))
        if level.filter(F.col("id") == goal).limit(1).count():
            path = [goal]
            for done in reversed(levels):
                path.append(done.filter(F.col("id") == path[-1]).select("parent").first()[0])
            return Path(path[::-1])
        if level.isEmpty():
            break
    left = level.join(hop, "id").select("to")
    if omitted is not None:
        left = left.unionAll(omitted.join(seen, "id", "left_semi").select("to"))
    return Path([], not left.join(seen.select(F.col("id").alias("to")), "to", "left_anti").isEmpty())


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, focus: str = "all", max_depth: int = 12, include_external: bool = False) -> list[str]:
    """Ids of a shortest path, the ends included; empty if there is none within ``max_depth`` edges."""
    return find_path(nodes, edges, start, goal, focus, max_depth, include_external).ids


def junctions(nodes: DataFrame, edges: DataFrame, a: str, b: str, limit: int = 4, focus: str = "all") -> DataFrame:
    """Nodes of the project that both ends touch, in either direction: state first, then those that are read or written.

    Of several edges between an end and a node, the first that goes out counts,
    else the first that comes in, by place.
    """
    real = edges.filter(traversable(F.col("kind"), focus)).select("src", "dst", "kind", place_rank(edges).alias("place"))

    def near(of: str, name: str) -> DataFrame:
        out = real.filter(F.col("src") == of).select(F.col("dst").alias("id"), "kind", "place", F.lit(0).alias("way"))
        back = real.filter(F.col("dst") == of).select(F.col("src").alias("id"), "kind", "place", F.lit(1).alias("way"))
        return out.unionAll(back).groupBy("id").agg(F.min(F.struct("way", "place", "kind")).alias(name))

    own = nodes.filter((F.col("kind") != "file") & ~is_external(F.col("external"), F.col("file")))
    both = near(a, "x").join(near(b, "y"), "id").join(own.select("id", F.col("kind").alias("node_kind")), "id")
    state = F.when(F.col("node_kind").isin("variable", "property", "field"), 3).otherwise(0)
    use = sum((F.when(F.col(f"{c}.kind") == "accesses", 2).otherwise(0) for c in ("x", "y")), F.lit(0))
    ranked = both.select("id", F.col("x.kind").alias("from_kind"), F.col("y.kind").alias("to_kind"), (state + use).alias("score"))
    return ranked.orderBy(F.desc("score"), "id").limit(limit)


def steps(hops: list[tuple[str, str, str, int | None]], files: dict[str, str], names: dict[str, str] | None = None, most: int = 12) -> list[str]:
    """Hops as text: names of both ends, the kind, and the place if it is known."""
    names = names or {}
    at = lambda a, line: "" if line is None else f" at {files.get(a, '')}:{line}"
    return [f"{names.get(a, a)} -[{kind}{at(a, line)}]-> {names.get(b, b)}" for a, b, kind, line in hops[:most]]


__all__ = ["HUB", "Path", "Trace", "find_path", "junctions", "reach", "roles", "shortest_path", "steps", "trace", "traversable", "walkable"]
