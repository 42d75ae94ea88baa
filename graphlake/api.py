"""One call for every request on a graph."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.functions import docs
from graphlake.functions.text import is_support_path
from graphlake.operators import degrees, details, handles, lookup, overview, topology, tour, trace, trust
from graphlake.sources.shared import materialize


@dataclass
class Graph:
    """Tables of one snapshot."""

    nodes: DataFrame
    edges: DataFrame
    coverage: DataFrame | None = None
    unresolved: DataFrame | None = None
    topo_nodes: DataFrame | None = None
    topo_edges: DataFrame | None = None
    #: Texts that are what was indexed (file, text); without them, signatures are those that a provider gave.
    sources: DataFrame | None = None
    project: str = ""
    #: What the code was indexed from, what the topology was read from, and the projects of both.
    generation: str | None = None
    topology_generation: str | None = None
    topology_project: str = ""

    def __post_init__(self) -> None:
        self.degree = degrees.degrees(self.edges)
        self.open_degree = degrees.open_degrees(self.nodes, self.edges)


#: Most that a details request returns of a container's members, whatever it asks for.
MAX_MEMBERS = 1_000


def bound(value: Any, fallback: int, low: int, high: int) -> int:
    """A request's number as a whole number between two limits; what is no finite number is the fallback."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        value = fallback
    return max(low, min(high, math.floor(value)))


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a result that its operation has limited."""
    return [r.asDict(recursive=True) for r in df.collect()]


def inspect(graph: Graph | None, request: dict[str, Any]) -> dict[str, Any]:
    """Answer a request: its ``type``, and the fields of that type.

    ``escape`` reads no table. Lists in the answer are cut by the limits of the
    request, which are clamped.
    """
    kind = request["type"]
    if kind == "escape":
        return {"next": "outside", "result": {"reason": request.get("reason"), "nextStep": request.get("nextStep")}}
    if graph is None:
        return {"next": "outside", "result": {}, "audit": trust.audit(kind, "")}
    result = {"lookup": _lookup, "entrypoints": _entrypoints, "trace": _trace, "details": _details, "overview": _overview, "tour": _tour, "topology": _topology}[kind](graph, request)
    action = result.pop("next", None) or trust.next_action(kind, result.pop("n", 1), result.get("truncated", False))
    result.pop("n", None)
    out = {"next": action, "result": result, "audit": trust.audit(kind, graph.project)}
    if graph.coverage is not None and kind in trust.FAMILIES:
        out["coverage"] = _rows(trust.coverage_of(graph.coverage, kind))
    if graph.unresolved is not None and kind in trust.FAMILIES:
        out["unresolved"] = _rows(trust.unresolved_reasons(graph.unresolved, kind))
    return out


def _named(graph: Graph, ids: DataFrame) -> DataFrame:
    return ids.join(graph.nodes.select("id", F.coalesce("qualified_name", "name").alias("name"), "kind", "line"), "id")


def _signatures(graph: Graph, rows: list[dict[str, Any]]) -> None:
    """Add what is known of the heads and decorators of a few declarations."""
    own = graph.nodes.filter(F.col("id").isin([r["id"] for r in rows]))
    if rows and "decorators" in graph.nodes.columns:
        decorated = {r["id"]: r["d"] for r in _rows(own.select("id", docs.decorators_of(F.col("decorators")).alias("d")))}
        for r in rows:
            if decorated.get(r["id"]):
                r["decorators"] = decorated[r["id"]]
    if not rows or "signature" not in graph.nodes.columns:
        return
    if graph.sources is None:
        known = {r["id"]: r["signature"] for r in own.select("id", "signature").collect()}
    else:
        known = {r["id"]: r["signature"] for r in docs.describe(own, graph.sources).collect()}
    for r in rows:
        if known.get(r["id"]):
            r["signature"] = known[r["id"]]


def _lookup(graph: Graph, q: dict, most: int = 6) -> dict:
    limit = bound(q.get("limit"), 5, 1, most)
    hits = lookup.lookup(graph.nodes, graph.degree, q["query"], limit, q.get("includeExternal") is True)
    rows = sorted(_rows(_named(graph, hits)), key=lambda r: (-r["score"], r["id"]))
    _signatures(graph, rows)
    return {"hits": rows, "n": len(rows)}


def _resolved(graph: Graph, wanted: list[str]) -> dict[str, list[str]]:
    """The ids that handles name, the best first; few handles, twelve ids each."""
    if not wanted:
        return {}
    asked = graph.nodes.sparkSession.createDataFrame([(h,) for h in wanted], "handle string")
    ranked = handles.rank_candidates(handles.candidates(asked, graph.nodes), graph.nodes, graph.degree)
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["handle"], r["rank"])):
        out.setdefault(r["handle"], []).append(r["id"])
    return out


def _mentions(graph: Graph, query: str) -> list[dict[str, Any]]:
    ids, names = lookup.mentions(query)
    known = {r["id"] for r in graph.nodes.filter(F.col("id").isin(ids)).select("id").collect()} if ids else set()
    asked = list(dict.fromkeys([i for i in ids if i in known] + names))
    found = _resolved(graph, asked)
    return [{"handle": h, "candidates": found.get(h, [])[:6]} for h in asked]


def _entrypoints(graph: Graph, q: dict) -> dict:
    hits = _lookup(graph, {"query": q["query"], "limit": bound(q.get("limit"), 4, 1, 8)})["hits"]
    n = bound(q.get("neighbors"), 0, 0, 2)
    named = _mentions(graph, q["query"])
    seeds = list(dict.fromkeys([m["candidates"][0] for m in named if len(m["candidates"]) == 1] + [h["id"] for h in hits]))
    out: dict[str, Any] = {"entrypoints": hits, "mentions": named, "truncated": len(seeds) > 3, "n": len(seeds)}
    if n and seeds:
        wanted = graph.nodes.filter(F.col("id").isin(seeds[:3])).select("id")
        for name, forward in (("uses", True), ("usedBy", False)):
            out[name] = _rows(details.entry_neighbours(wanted, graph.nodes, graph.edges, forward, n))
            out["truncated"] = out["truncated"] or any(r["available"] > n for r in out[name])
    out["next"] = "inspect" if seeds else "outside"
    return out


def _one(graph: Graph, handle: str) -> tuple[str | None, list[str]]:
    found = _resolved(graph, [handle]).get(handle, [])
    return (found[0] if len(found) == 1 else None), found


def _trace(graph: Graph, q: dict) -> dict:
    start, several = _one(graph, q["from"])
    if start is None:
        return {"next": "clarify" if several else "outside", "unknown": q["from"], "candidates": several, "reached": [], "hops": [], "truncated": False}
    focus, external = q.get("focus", "all"), q.get("includeExternal") is True
    if q.get("to"):
        goal, several = _one(graph, q["to"])
        if goal is None:
            return {"next": "inspect" if several else "outside", "start": start, "unknown": q["to"], "candidates": several}
        path = trace.find_path(graph.nodes, graph.edges, start, goal, focus, bound(q.get("maxDepth"), 12, 1, 12), external)
        near = [] if path.ids or path.truncated else _rows(trace.junctions(graph.nodes, graph.edges, start, goal, focus=focus))
        action = "answer" if path.ids else "inspect" if path.truncated or near else "outside"
        return {"next": action, "start": start, "path": path.ids, "truncated": path.truncated, "junctions": near}
    direction = q.get("direction", "forward")
    t = trace.trace(graph.nodes, graph.edges, start, direction, focus, bound(q.get("maxDepth"), 3, 1, 8), bound(q.get("maxNodes"), 12, 1, 32), external)
    ids = [start, *(i for i, _ in t.reached)]
    known = {r["id"]: r for r in graph.nodes.filter(F.col("id").isin(ids)).select("id", "file", F.coalesce("qualified_name", "name").alias("name")).collect()}
    files, names = {i: r["file"] for i, r in known.items()}, {i: r["name"] for i, r in known.items()}
    out = {"next": "answer", "start": start, "reached": t.reached, "hops": t.hops, "steps": trace.steps(t.hops, files, names), "truncated": t.truncated}
    if direction == "impact":
        of = {r["id"]: r["roles"] for r in trace.roles(graph.nodes.filter(F.col("id").isin(ids))).collect()}
        out["roles"] = {i: of[i] for i, _ in t.reached if of.get(i)}
    return out


def _details(graph: Graph, q: dict) -> dict:
    found = _resolved(graph, list(dict.fromkeys(q["handles"])))
    ids = [found[h][0] for h in q["handles"] if len(found.get(h, [])) == 1]
    wanted = graph.nodes.filter(F.col("id").isin(ids)).select("id")
    n, d, external = bound(q.get("neighborLimit"), 2, 1, 3), bound(q.get("dependencyLimit"), 2, 1, 4), q.get("includeExternal") is True
    most = bound(q.get("memberLimit"), MAX_MEMBERS, 1, MAX_MEMBERS)
    shown = _rows(_named(graph, wanted.join(graph.nodes.select("id", "file"), "id")))
    _signatures(graph, shown)
    inner = details.members(wanted, graph.nodes, graph.edges)
    if {"object_members", "enum_members"} <= set(graph.nodes.columns):
        own = details.literal_members(wanted, graph.nodes)
        inner = inner.unionByName(own.select("id", F.lit(None).cast("string").alias("member"), "name", "kind", "line"))
    order = F.row_number().over(W.partitionBy("id").orderBy("line", "member", "name"))
    out = {
        "nodes": shown,
        "ambiguous": {h: c for h, c in found.items() if len(c) > 1},
        "unknown": sorted(set(q["handles"]) - set(found)),
        "members": _rows(inner.withColumn("r", order).filter(F.col("r") <= most).drop("r")),
        "calls": _rows(details.calls(wanted, graph.nodes, graph.edges, d, external)),
        "types": _rows(details.types(wanted, graph.nodes, graph.edges, d, external)),
        "implementedBy": _rows(details.implemented_by(wanted, graph.nodes, graph.edges, d, external)),
        "next": "answer" if ids else "inspect" if any(len(c) > 1 for c in found.values()) else "outside",
    }
    if q.get("neighbors") is True:
        out["dependsOn"] = _rows(details.depends_on(wanted, graph.nodes, graph.edges, n, external))
        out["dependedOnBy"] = _rows(details.depended_on_by(wanted, graph.nodes, graph.edges, n, external))
    return out


def _overview(graph: Graph, q: dict) -> dict:
    aspect, out = q.get("aspect", "all"), {"counts": _rows(overview.counts(graph.nodes)), "totals": _rows(overview.totals(graph.nodes, graph.edges))[0]}
    if aspect in ("all", "layers"):
        out["layers"] = _rows(overview.layers(graph.nodes))
    if aspect in ("all", "hotspots"):
        out["hotspots"] = _rows(overview.hotspots(graph.nodes, graph.degree))
    if aspect in ("all", "publicApi"):
        out["publicApi"] = _rows(overview.public_api(graph.nodes, graph.degree))
    return out


def _named_nodes(graph: Graph, names: list[str]) -> list[str]:
    """What the caller's names stand for, if that is one declaration; a name with blanks does so only outside TypeScript.

    Of several in C and C++, where a declaration and its definition are two nodes,
    the sole one that invokes something counts.
    """
    asked = list(dict.fromkeys(n.strip() for n in names if n.strip()))
    found = _resolved(graph, asked)
    every = sorted({i for c in found.values() for i in c})
    if not every:
        return []
    language = {r["id"]: r["language"] for r in graph.nodes.filter(F.col("id").isin(every)).select("id", "language").collect()}
    sites = {r["id"] for r in tour.invocation_sites(graph.nodes, graph.edges.filter(F.col("src").isin(every))).collect()}
    out = []
    for name in asked:
        own = found.get(name, [])
        if len(own) > 1 and not any(c.isspace() for c in name):
            own = [i for i in own if language.get(i) in ("c", "cpp") and i in sites]
        if len(own) == 1 and not (any(c.isspace() for c in name) and language.get(own[0]) == "typescript"):
            out.append(own[0])
    return out


def _tour(graph: Graph, q: dict) -> dict:
    question, names = q.get("question", ""), list(q.get("reinterpretations", []))
    limit, terms = bound(q.get("limit"), 5, 1, 5), tour.query_terms(names, graph.project)
    central = tour.centrality(graph.nodes, graph.edges, graph.degree)
    candidates = materialize(tour.seed_candidates(graph.nodes, graph.open_degree), "candidates")
    scored = materialize(tour.seed_scores(candidates, central, terms), "scored")
    mentioned = [m["candidates"][0] for m in _mentions(graph, question) if m["candidates"]] if question else []
    hits = [h["id"] for h in _lookup(graph, {"query": question, "limit": limit})["hits"]] if question else []
    named = _named_nodes(graph, names)
    share = tour.pick_diverse(scored.filter(F.col("id").isin(named)), limit, terms) if named else []
    ranked = tour.pick_diverse(scored, limit * 4, terms)
    few = list(dict.fromkeys([*mentioned, *hits, *share, *ranked]))
    kinds = {r["id"]: r["kind"] for r in candidates.filter(F.col("id").isin(few)).select("id", "kind").collect()}
    mix = lambda n: tour.mix_seeds(mentioned, hits, share, ranked[:n], lookup.spells_out(question), set(kinds), n)
    seeds = mix(limit)
    walks = [i for i in mix(limit * 4) if kinds[i] in tour.FLOW_KINDS] or mix(limit * 4)
    flows, told = [], []
    for seed in walks:
        if len(flows) == 4:
            break
        t = trace.trace(graph.nodes, graph.edges, seed, "forward", "execution", 6, 18)
        ends = list({i for h in t.hops for i in h[:2]})
        hidden = {r["id"] for r in _hidden(graph, ends).collect()} if ends else set()
        hops = tour.flow_hops(t.hops, hidden - {seed})
        landed = {i for i, _ in t.reached} - hidden
        if hops and tour.tells_anew(landed, told):
            flows.append({"seed": seed, "hops": hops[:8], "reached": [i for i, _ in t.reached if i in landed], "truncated": t.truncated})
            told.append(landed)
    wanted = graph.nodes.filter(F.col("id").isin(seeds)).select("id")
    near = [f(wanted, graph.nodes, graph.edges) for f in (details.depended_on_by, details.calls, details.implemented_by, details.depends_on, details.types)]
    subjects = list(dict.fromkeys([*seeds[:3], *(i for f in flows for i in f["reached"])]))
    tests = []
    if q.get("includeTests") is not False and subjects:
        direct = _rows(tour.test_anchors(graph.nodes.filter(F.col("id").isin(subjects)).select("id"), graph.nodes, graph.edges))
        for s in subjects:
            tests += [r["id"] for r in sorted((r for r in direct if r["seed"] == s), key=lambda r: (-r["near"], r["id"]))]
        for s in seeds[:3]:
            back = [i for i, _ in trace.trace(graph.nodes, graph.edges, s, "impact", max_depth=4, max_nodes=16).reached]
            tests += [r["id"] for r in trace.roles(graph.nodes.filter(F.col("id").isin(back))).filter(F.array_contains("roles", "test")).orderBy("id").collect()] if back else []
    nearby, tests = tour.nearby(seeds, near), list(dict.fromkeys(tests))
    spots = {r["id"]: r for r in _rows(_named(graph, graph.nodes.filter(F.col("id").isin([*seeds, *nearby, *tests])).select("id", "file")))}
    reasons = [("central entrypoint", seeds), ("nearby", nearby), ("test coverage", tests)]
    anchors = tour.unique_anchors([{**spots[i], "reason": why} for why, ids in reasons for i in ids if i in spots])
    truncated = any(f["truncated"] for f in flows) or len(tests) > 8
    return {"next": "answer", "seeds": seeds, "flows": flows, "nearby": nearby, "tests": tests[:8], "answerAnchors": anchors, "truncated": truncated}


def _hidden(graph: Graph, ids: list[str]) -> DataFrame:
    """Of a few nodes those that a flow leaves out: closures, support code, and utilities that everything shares."""
    own = graph.nodes.filter(F.col("id").isin(ids))
    closed = F.coalesce("closure", F.lit(False)) if "closure" in graph.nodes.columns else F.lit(False)
    noise = own.filter(closed | is_support_path(F.col("file"))).select("id")
    return noise.unionAll(degrees.shared_utilities(own, graph.open_degree).select("id")).distinct()


def _topology(graph: Graph, q: dict) -> dict:
    """Topology of the repository; its files are tied to the code only if both are of one project and the code stood still."""
    if graph.topo_nodes is None or graph.topo_edges is None:
        return {"next": "outside", "nodes": [], "edges": [], "join": topology.fence(graph.project, graph.topology_project, None, None, False)}
    published = not graph.topo_nodes.isEmpty()
    join = topology.fence(graph.project, graph.topology_project, graph.generation, q.get("confirmedGeneration", graph.generation), published)
    join["topologyInputGeneration"] = graph.topology_generation
    kept, edges = topology.inspect(graph.topo_nodes, graph.topo_edges, q.get("query"), q.get("relations"), bound(q.get("limit"), 100, 1, 500))
    kept = materialize(kept, "kept")
    rows = _rows(kept)
    files = []
    if join["state"] == "compatible":
        files = _rows(topology.file_joins(kept, graph.nodes.select("file"), bound(q.get("joinLimit"), 50, 1, 500)))
    return {"nodes": rows, "edges": _rows(edges), "files": files, "join": join, "next": "answer" if rows else "clarify" if published else "outside"}
