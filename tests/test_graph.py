"""Graph operators against plain Python on random graphs, and on small fixtures."""

import base64
import hashlib
import json
import random
import re
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graphlake.api import Graph, inspect
from graphlake.functions import docs, text
from graphlake.operators import assembly, contract, degrees, details, handles, identity, lookup, reduce, topology, tour, trace
from graphlake.plans import registry
from graphlake.sources import artifacts, dump, snapshots
from graphlake.sources.static import extract, masking, reexports, tables
from graphlake.streaming import generations, protocol

NODE = "id string, kind string, language string, name string, qualified_name string, file string, external boolean, ignored boolean, exported boolean, line int"
EDGE = "src string, dst string, kind string, line int"


def node(id_, kind="function", name=None, q=None, file="src/a.ts", external=False, ignored=False, exported=False, line=1):
    return (id_, kind, "typescript", name or id_, q, file, external, ignored, exported, line)


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(1)
    ids = [f"n{i}" for i in range(60)]
    nodes = [node(i, rng.choice(["function", "class", "method"]), file=f"src/{rng.randrange(9)}.ts", external=rng.random() < 0.1) for i in ids]
    kinds = ["calls", "calls", "accesses", "overrides", "type_ref", "contains", "instantiates"]
    edges = list({(a, b, k): (a, b, k, rng.randrange(1, 30)) for a, b, k in ((rng.choice(ids), rng.choice(ids), rng.choice(kinds)) for _ in range(220)) if a != b}.values())
    return nodes, edges, spark.createDataFrame(nodes, NODE).cache(), spark.createDataFrame(edges, EDGE).cache()


def test_degrees(random_graph):
    _, edges, _, e = random_graph
    got = {r.id: (r.in_all, r.out_all, r.in_real, r.out_exec) for r in degrees.degrees(e).collect()}
    for i, v in got.items():
        ins, outs = [x for x in edges if x[1] == i], [x for x in edges if x[0] == i]
        assert v == (len(ins), len(outs), sum(x[2] != "contains" for x in ins), sum(x[2] in ("calls", "accesses", "instantiates") for x in outs))


def test_reach_and_shortest_path(random_graph, spark):
    nodes, edges, n, e = random_graph
    walk, _ = trace.walkable(n, e)
    hops = defaultdict(set)
    for r in walk.collect():
        hops[r.src].add(r.dst)
    seen, queue = {"n0": 0}, deque(["n0"])
    while queue:
        a = queue.popleft()
        for b in hops[a]:
            if b not in seen:
                seen[b] = seen[a] + 1
                queue.append(b)
    got = trace.reach(spark.createDataFrame([("n0",)], "seed string"), walk, 3)
    assert {r.id: r.depth for r in got.collect()} == {k: v for k, v in seen.items() if v <= 3}
    far = max((k for k in seen if seen[k] <= 4), key=lambda k: (seen[k], k))
    path = trace.shortest_path(n, e, "n0", far)
    assert len(path) == seen[far] + 1 and path[0] == "n0" and path[-1] == far
    assert all(b in hops[a] for a, b in zip(path, path[1:]))
    assert trace.shortest_path(n, e, "n0", "nowhere") == []


def test_reach_writes_what_a_node_reaches_once(spark, monkeypatch):
    edges = [*((f"s{i}", "hub", "calls", 1) for i in range(60)), *(("hub", f"n{i}", "calls", 1) for i in range(1500)), ("n7", "s3", "calls", 1)]
    written, write = [], trace.materialize

    def count(df, label="step"):
        out = write(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(trace, "materialize", count)
    starts = spark.createDataFrame([(f"s{i}",) for i in range(60)], "seed string")
    got = trace.reach(starts, spark.createDataFrame(edges, EDGE), 3)
    want = {(f"s{i}", x, d) for i in range(60) for x, d in [(f"s{i}", 0), ("hub", 1), *((f"n{k}", 2) for k in range(1500)), *([("s3", 3)] if i != 3 else [])]}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert sum(written) < 4 * len(edges) < len(want)


def test_registered_walks_start_from_all_nodes_of_a_kind(random_graph, spark, monkeypatch):
    nodes, edges, n, e = random_graph
    nodes = nodes + [node(f"m{i}", "method") for i in range(25)]
    edges = edges + [(f"m{i}", f"n{i}", "calls", 1) for i in range(25)] + [(f"n{i}", f"i{i % 8}", "type_ref", 1) for i in range(25)]
    n, e = spark.createDataFrame(nodes + [node(f"i{i}", "interface") for i in range(8)], NODE), spark.createDataFrame(edges, EDGE)
    monkeypatch.setattr(registry.testgraph, "build", lambda *_: (n, e))

    def within(pairs, start, depth):
        seen, level = {start: 0}, {start}
        for d in range(1, depth + 1):
            level = {b for a, b in pairs if a in level} - set(seen)
            seen.update(dict.fromkeys(level, d))
        return seen

    got = __spark_entry__.queries()
    walk = {(a, b) for a, b, k, _ in edges if k not in ("contains", "exports", "imports")}
    nodes += [node(f"i{i}", "interface") for i in range(8)]
    for name, kind, pairs in (("trace_forward_d3", "method", walk), ("trace_reverse_d3", "interface", {(b, a) for a, b in walk})):
        want = {(x[0], i, d) for x in nodes if x[1] == kind for i, d in within(pairs, x[0], 3).items()}
        rows = [(r.seed, r.id, r.depth) for r in got[name](spark, "").collect()]
        assert len(rows) == len(want) and set(rows) == want and len({r[0] for r in rows}) > 5
    outside = {x[0] for x in nodes if x[6]}
    invoke = {(a, b) for a, b, k, _ in edges if k in ("calls", "instantiates", "renders")}
    pairs = invoke | {(b, a) for a, b, k, _ in edges if k in ("overrides", "implements") and b not in {x for x, _ in invoke}}
    pairs, file = {(a, b) for a, b in pairs if b not in outside}, {x[0]: x[5] for x in nodes}
    want = {x[0]: len({file[i] for i in within(pairs, x[0], 4) if i != x[0]}) for x in nodes if x[1] == "method"}
    assert len(want) > 20 and {r.seed: r.files for r in got["reach_files_d4"](spark, "").collect()} == want


def test_files_reached_is_a_walk_from_each_seed_with_and_without_a_budget(spark):
    rng = random.Random(3)
    for ids, hops, files, budget in ((30, 45, 4, 6), (60, 100, 9, 8), (25, 30, 3, 3)):
        nodes = [node(f"n{i}", file=f"src/{rng.randrange(files)}.ts", external=rng.random() < 0.1) for i in range(ids)]
        edges = list({(a, b, "calls", 1) for a, b in ((f"n{rng.randrange(ids)}", f"n{rng.randrange(ids)}") for _ in range(hops))})
        file, out = {x[0]: x[5] for x in nodes}, {x[0] for x in nodes if x[6]}

        def walk(seed, most):
            seen, level = {seed}, {seed}
            for _ in range(4):
                if len(seen) >= most:
                    break
                level = {b for a, b, *_ in edges if a in level and b not in out} - seen
                seen |= level
            return len({file[i] for i in seen - {seed}})

        n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
        for most in (None, budget):
            got = {r.seed: r.files for r in tour.files_reached(n.select("id"), n, e, budget=most).collect()}
            assert got == {i: walk(i, most or 10**9) for i in file}


def test_registered_reach_goes_on_behind_many_nodes(spark, monkeypatch):
    nodes = [node("m", "method"), node("last", file="src/last.ts"), *(node(f"a{i:03}", file="src/many.ts") for i in range(450))]
    edges = [*(("m", f"a{i:03}", "calls", 1) for i in range(450)), ("a449", "last", "calls", 1)]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    monkeypatch.setattr(registry.testgraph, "build", lambda *_: (n, e))
    assert [(r.seed, r.files) for r in __spark_entry__.queries()["reach_files_d4"](spark, "").collect()] == [("m", 2)]
    assert [r.files for r in tour.files_reached(n.filter("id = 'm'"), n, e, budget=400).collect()] == [1]


def test_tour_looks_past_candidates_that_are_alike(spark):
    rows = [(f"a{i:03}", f"order{'Item%d' % i if i else str()}", "f.ts", ["order"], 1000.0 - i) for i in range(260)] + [("z", "other", "g.ts", ["order"], 1.0)]
    rows += [(f"q{i:03}", f"q{i}", "q.ts", [], 50.0) for i in range(4)] + [("late", "late", "h.ts", [], 49.0)]
    scored = spark.createDataFrame(rows, "id string, name string, file string, terms array<string>, score double")
    own = scored.filter("id < 'b' OR id = 'z'")
    assert tour.pick_diverse(own) == ["a000", "z"]
    assert tour.pick_diverse(scored) == ["a000", "q000", "q001", "q002", "q003"]
    assert tour.pick_diverse(scored.filter("false")) == []
    assert tour.pick_diverse(scored, 3, []) == ["a000", "a001", "a002"]


def test_a_longer_name_is_restated_by_a_shorter_one_too(spark):
    rows = [("1", "moveInMode", "f.ts", ["move"], 9.0), ("2", "moves", "f.ts", ["move"], 8.0), ("3", "modeMove", "f.ts", ["move"], 7.0), ("4", "move", "g.ts", [], 1.0)]
    scored = spark.createDataFrame(rows, "id string, name string, file string, terms array<string>, score double")
    assert tour.pick_diverse(scored, 4, ["move"]) == ["1", "3", "4"]
    assert tour.mix_seeds(["m", "no"], ["h"], ["n1", "n2", "n3"], ["c1", "n1", "c2"], False, {"m", "h", "n1", "n2", "n3", "c1", "c2"}, 4) == ["m", "n1", "n2", "c1"]
    assert tour.mix_seeds([], ["h"], [], ["x"], False, {"h"}, 4) == ["h"]
    assert tour.tells_anew({"a", "b"}, [{"a", "c", "d"}]) and not tour.tells_anew({"a"}, [{"a", "c", "d"}])
    assert tour.query_terms(["typeOrderItem", "at Order"], "type-orm") == ["order", "item"]


def test_trace_dispatches_and_reports_what_it_leaves_out(spark):
    nodes = [node(x) for x in ("caller", "start", "base", "i1", "i2", "l1", "l2")]
    edges = [("caller", "start", "calls", 1), ("start", "base", "calls", 2), ("i1", "base", "overrides", 1), ("i2", "base", "overrides", 1), ("i1", "l1", "calls", 1), ("i2", "l2", "calls", 1)]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    t = trace.trace(n, e, "start", max_depth=4)
    assert [i for i, _ in t.reached] == ["base", "i1", "i2", "l1", "l2"] and not t.truncated
    assert ("base", "i1", "dispatches", 1) in t.hops
    assert trace.trace(n, e, "start", max_nodes=3).truncated
    assert trace.trace(n, e, "start", max_depth=1).truncated
    back = trace.trace(n, e, "start", direction="impact")
    assert [i for i, _ in back.reached] == ["caller"] and back.hops == [("caller", "start", "calls", 1)]
    many = [node(f"x{i}") for i in range(12)]
    more = [(f"x{i}", "base", "overrides", 1) for i in range(12)] + [(f"x{i}", "l1", "calls", 1) for i in range(12)]
    hub = trace.trace(spark.createDataFrame(nodes + many, NODE), spark.createDataFrame(edges + more, EDGE), "start", max_depth=4)
    assert hub.truncated and [i for i, _ in hub.reached] == ["base"]
    wide, wider = spark.createDataFrame(nodes + many, NODE), spark.createDataFrame(edges + more, EDGE)
    assert trace.find_path(wide, wider, "start", "x3").ids == ["start", "base", "x3"]
    assert trace.find_path(wide, wider, "start", "l1") == trace.Path([], True)
    assert trace.find_path(wide, wider, "l1", "start") == trace.Path([], False)
    assert trace.find_path(n, e, "start", "l1", max_depth=2) == trace.Path([], True)


def walked(nodes, edges, start, direction, max_depth, max_nodes):
    """A bounded walk in plain Python: edges of each node in order, limits on nodes and hops."""
    info, impact, forward = {n[0]: n for n in nodes}, direction == "impact", direction == "forward"
    runs = {a for a, _, k, _ in edges if k in ("calls", "instantiates", "accesses", "renders")}
    kind = {"calls": 0, "dispatches": 1, "instantiates": 1, "accesses": 3, "overrides": 5, "type_ref": 7}

    def out(i):
        own = [(b if forward else a, a, b, k, line) for a, b, k, line in edges if (a if forward else b) == i and k != "contains"]
        up = {}
        for a, b, k, line in edges:
            if forward and b == i and k == "overrides" and i not in runs and a in runs:
                up[a] = min(line, up.get(a, line))
        own += [(a, i, a, "dispatches", line) for a, line in up.items()] if len(up) < 12 else []
        own = [x for x in own if x[0] in info and not info[x[0]][6]]
        end = lambda j: (0 if info[j][1] in ("function", "class", "method") else 3)
        mark = lambda j: 1 if info[j][8] else 4 if info[j][7] else 2
        key = (lambda x: (mark(x[0]), kind[x[3]], x[4], x[0], x[3])) if impact else (lambda x: (kind[x[3]], end(x[0]), x[4], x[0], x[3]))
        return sorted(own, key=key), len(up) >= 12 and any(not info[a][6] for a in up)

    reached, hops, seen, queue, cut = [], [], {start}, [start], False
    for depth in range(max_depth + 1):
        nxt = []
        for i in queue:
            own, hub = out(i)
            cut = cut or hub or depth == max_depth and bool(own)
            for other, a, b, k, line in own if depth < max_depth else []:
                if len(hops) >= 2 * max_nodes or other not in seen and len(reached) >= max_nodes:
                    cut = True
                    continue
                hops.append((a, b, k, line))
                if other not in seen:
                    seen.add(other)
                    reached.append((other, depth + 1))
                    nxt.append(other)
        queue = nxt
    return reached, hops, cut


@pytest.mark.parametrize("direction, max_depth, max_nodes", [("forward", 3, 12), ("forward", 8, 32), ("reverse", 2, 5), ("impact", 4, 16), ("impact", 1, 2)])
def test_bounded_walks_match_plain_ones(random_graph, direction, max_depth, max_nodes):
    nodes, edges, n, e = random_graph
    for start in ("n0", "n7", "n23"):
        t = trace.trace(n, e, start, direction, max_depth=max_depth, max_nodes=max_nodes)
        assert (t.reached, t.hops, t.truncated) == walked(nodes, edges, start, direction, max_depth, max_nodes)


def test_junctions(spark):
    n = spark.createDataFrame([node("h"), node("e"), node("state", "property"), node("log")], NODE)
    e = spark.createDataFrame([("h", "state", "accesses", 1), ("e", "state", "accesses", 1), ("h", "log", "calls", 1), ("e", "log", "calls", 1)], EDGE)
    assert [(r.id, r.score) for r in trace.junctions(n, e, "h", "e").collect()] == [("state", 7), ("log", 0)]


def test_edges_first_nodes_last(spark):
    e = spark.createDataFrame([("a", "b", "calls", 9, 2), ("a", "b", "calls", 3, 1), ("a", "b", "reads", 1, 3)], EDGE + ", ord int")
    assert {(r.kind, r.line) for r in assembly.dedupe_edges(e).collect()} == {("calls", 3), ("reads", 1)}
    n = spark.createDataFrame([(*node("a", line=1), 1), (*node("a", line=2), 2)], NODE + ", ord int")
    assert [r.line for r in assembly.dedupe_nodes(n).collect()] == [2]


def test_assembly_rules(spark):
    rows = [node("C", "class", "C"), node("C.x", "variable", "x", "C.x"), node("f"), node("f.g", "function", "g", "f.g"), node("f.g.v", "variable", "v", "f.g.v")]
    n = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], NODE + ", ord int")
    assert {r.id: r.kind for r in assembly.normalise_kinds(n).collect()}["C.x"] == "property"
    assert {r.id for r in assembly.mark_closures(n).filter("closure").collect()} == {"f.g", "f.g.v"}
    plain = spark.createDataFrame(rows, NODE)
    none = spark.createDataFrame([], EDGE)
    files = assembly.synthesise_files(plain, none)
    assert {r.id for r in files.filter("kind = 'file'").collect()} == {"src/a.ts"}
    got = {(r.src, r.dst) for r in assembly.synthesise_containment(plain, none).collect()}
    assert got == {("src/a.ts", "C"), ("C", "C.x"), ("src/a.ts", "f"), ("f", "f.g"), ("f.g", "f.g.v")}
    bad = spark.createDataFrame([("C", "gone", "calls", 1), ("C", "f", "invents", 0), ("C", "f", "calls", 1), ("C", "f", "calls", 1)], EDGE)
    rules = Counter(r.rule for r in assembly.violations(plain, bad).collect())
    assert rules == {"missing dst": 1, "unknown edge kind": 1, "line is not positive": 1, "duplicate edge": 1}
    with pytest.raises(ValueError):
        assembly.merge_lanes(plain, plain, ["id"])


def test_export_surface_follows_cycles(spark):
    own = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "file string, id string, name string")
    f = spark.createDataFrame([("b", "a", None), ("a", "b", "y"), ("c", "b", "x")], "file string, source string, name string")
    got = {(r.file, r.id) for r in assembly.export_surface(own, f).collect()}
    assert got == {("a", "1"), ("b", "2"), ("b", "1"), ("a", "2"), ("c", "1")}


def test_overrides_take_unique_members(spark):
    n = spark.createDataFrame([node("A", "class"), node("B", "interface"), node("A.m", "method", "m( x)"), node("A.m2", "method", "m"), node("B.m", "method", "m(  x)"), node("A.d", "method", "d"), node("A.d2", "method", "d"), node("B.d", "method", "d")], NODE)
    e = spark.createDataFrame([("A", "B", "implements", 1), *[(m[0], m, "contains", 1) for m in ("A.m", "A.m2", "B.m", "A.d", "A.d2", "B.d")]], EDGE)
    assert [(r.src, r.dst, r.kind) for r in assembly.override_edges(n, e).collect()] == [("A.m", "B.m", "implements")]


def most_rows(df):
    """The most rows that any operator of a table's plan puts out, when it is read."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            left.append(plan.plan())
            continue
        rows = plan.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


def test_sole_endpoint_counts_names_and_makes_no_pairs(spark):
    rng = random.Random(2)
    refs = [(f"r{i}", rng.choice("abcdefgh"), f"{rng.randrange(4)}.ts") for i in range(60)] + [("r0", "a", "1.ts"), ("none", "zz", "1.ts")]
    names = [(f"n{i}", rng.choice("abcdefg"), f"{rng.randrange(4)}.ts") for i in range(14)] + [("h", "h", "9.ts")]
    want = {}
    for ref in {r[0] for r in refs}:
        hits = [(at != file, i) for r, name, file in refs if r == ref for i, x, at in names if x == name]
        least = [i for tier, i in hits if tier == min(hits)[0]]
        if len(least) == 1:
            want[ref] = least[0]
    got = assembly.sole_endpoint(spark.createDataFrame(refs, "ref string, name string, file string"), spark.createDataFrame(names, "id string, name string, file string"))
    assert len(want) > 5 and {r.ref: r.target for r in got.collect()} == want
    many = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("x").alias("name"), F.lit("a.ts").alias("file"))
    assert most_rows(assembly.sole_endpoint(many.withColumnRenamed("id", "ref"), many)) <= 1000


def test_details_join_their_edges_once(random_graph):
    _, edges, n, e = random_graph
    for made in (details.calls(n, n, e), details.depends_on(n, n, e, 3), details.entry_neighbours(n, n, e, False)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    got = {(r.id, r.r): (r.kind, r.other, r.available) for r in details.entry_neighbours(n, n, e, False).collect()}
    for i in {x[1] for x in edges}:
        refs = {(k, a): details.ENTRY_RANK.get(k, 10) * 100_000 + line * 100 + 999 for a, b, k, line in edges if b == i and k not in ("contains", "exports", "imports")}
        first = sorted(refs, key=lambda x: (refs[x], *x))[:2]
        assert [got.get((i, r + 1)) for r in range(len(first))] == [(*x, len(refs)) for x in first]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(text.subwords(F.lit("HTTPServer.getURLPath_v2x"))) == ["http", "server", "get", "url", "path", "v2x"]
    for word, stem in {"creation": "creat", "runs": "runs", "bees": "bees", "indexing": "index", "store": "stor", "named": "named", "walks": "walk"}.items():
        assert value(text.stem_word(F.lit(word))) in (stem, stem.rstrip("e") if len(stem) > 4 else stem), word
    for path, is_test in {"src/test/a.ts": True, "a.spec.ts": True, "src/latest/a.ts": False, "x_test.go": True, "FooTest/a.java": True, "a/test_foo.py": True, "test-bar.js": True, "attest_x.py": False, "my.spec.d/a.ts": False}.items():
        assert value(text.is_test_path(F.lit(path))) is is_test, path
    assert value(text.is_support_path(F.lit("a.d.ts"))) and not value(text.is_support_path(F.lit("src/a.ts")))
    assert value(text.callable_base(F.lit("m (a)"))) == "m" and value(text.callable_base(F.lit("(x)"))) == "(x)"
    assert value(text.shared_path_depth(F.lit("a/b/c.ts"), F.lit("a/b/d/e.ts"))) == 2
    assert value(text.matched_terms(F.array(F.lit("indexing")), F.array(F.lit("index"), F.lit("other")))) == ["index"]
    for path in ("x/__fixtures__/a.ts", "x/__generated__/a.ts", "x/typings.mts", "x.d.cts", "bundled://x"):
        assert value(text.is_support_path(F.lit(path))), path
    assert docs.parse_id(docs.write_id("a#b.ts", "X.y", "method")) == ("a#b.ts", "X.y", "method")
    assert docs.canonical_json({"b": None, "a": [1, {"d": 2, "c": 3}]}) == '{"a":[1,{"c":3,"d":2}]}'
    assert docs.doc_text(["/**", " * Does it. And more.", " * @param x", " */", "", "function f() {"], 6) == "Does it."


def test_sources_of_one_partition_are_read_in_many(spark):
    rows = spark.range(400, numPartitions=1).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("file"), F.lit("python").alias("language"), F.lit("def f():\n    return 1\n").alias("text"))
    facts = tables.extract_facts(rows).filter("fact = 'declaration'")
    assert facts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert facts.count() == 400


def test_texts_are_masked_once_and_between_openers_nothing_is_looked_at():
    text = "plain words, " * 20_000 + "'a b' // c\n"
    assert masking.mask(text, "typescript").endswith("'   '     \n") and masking.mask(text, "typescript") is masking.mask(text, "typescript")


def test_handles_and_lookup(random_graph, spark):
    n = spark.createDataFrame([node("1", "class", "Store", "app.Store"), node("2", "method", "save(x)", "app.Store.save(x)"), node("3", "function", "save", file="lib/util.ts", exported=True)], NODE)
    n = n.unionByName(spark.createDataFrame([("4", "method", "cpp", "Get", "db.Impl::Get", "db.cc", False, False, False, 1)], NODE))
    asked = spark.createDataFrame([(h,) for h in ("1", "Store", "app::Store", "Store.save(x)", "Store.save", "UTIL.save", "db.Impl.Get", "Impl::Get", "schema.save(x)", "x#Store:class", "nothing", "no.thing")], "handle string")
    got = {r.handle: (r.status, r.id) for r in handles.resolve(asked, n).collect()}
    want = {"1": "1", "Store": "1", "app::Store": "1", "Store.save(x)": "2", "Store.save": "2", "UTIL.save": "3", "db.Impl.Get": "4", "Impl::Get": "4", "schema.save(x)": "2", "x#Store:class": "1"}
    assert got == {h: ("node", i) for h, i in want.items()}
    d = degrees.degrees(spark.createDataFrame([("2", "3", "calls", 1), ("lib/util.ts", "3", "exports", 1)], EDGE))
    assert [r.id for r in lookup.lookup(n, d, "save function").collect()][0] == "3"
    assert lookup.lookup(n, d, "  ").count() == 0


def test_reduction_and_topology(random_graph, spark):
    nodes, edges, n, e = random_graph
    kept, live = reduce.reduce_graph(n, e, 10)
    ids = {r.id for r in kept.collect()}
    assert len(ids) <= 10 and all(r.src in ids and r.dst in ids for r in live.collect())
    moved = reduce.reroot(spark.createDataFrame([node("a", file="/w/p/src/a.ts"), node("b", file="/w/p/b.ts")], NODE))
    assert {r.file for r in moved.collect()} == {"src/a.ts", "b.ts"}
    t = spark.createDataFrame([("p", None, "src"), ("all", None, "."), ("own", "b.ts", None)], "id string, file string, root string")
    files = spark.createDataFrame([("src/x/a.ts",), ("b.ts",), ("srcs/c.ts",)], "file string")
    assert {(r.id, r.file) for r in topology.file_joins(t, files).collect()} == {("p", "src/x/a.ts"), ("all", "src/x/a.ts"), ("all", "b.ts"), ("all", "srcs/c.ts"), ("own", "b.ts")}


def test_generations(spark, tmp_path):
    frames = spark.createDataFrame([(1, "upsert", "a", "x"), (2, "upsert", "b", "y"), (3, "delete", "a", None), (4, "upsert", "b", "z")], "seq long, op string, shard string, payload string")
    assert [(r.shard, r.payload) for r in generations.live_shards(frames).collect()] == [("b", "z")]
    assert generations.transaction_errors(frames, "g", "h", 1) == ["the base is not the current generation", "the sequence does not advance", "a shard is there twice"]
    snaps = generations.Snapshots(spark, f"file://{tmp_path}/snap")
    first = snaps.publish({"nodes": frames}, None)
    assert snaps.current()["generation"] == first and snaps.read("nodes").count() == 4
    with pytest.raises(ValueError):
        snaps.publish({"nodes": frames}, None)
    second = snaps.publish({"nodes": frames.limit(1)}, first)
    assert snaps.read("nodes").count() == 1 and snaps.read("nodes", first).count() == 4 and second != first
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "1.json").write_text("\n".join(json.dumps({"seq": i, "op": "upsert", "shard": f"s{i % 2}"}) for i in range(4)))
    got = []
    q = generations.watch_frames(spark, f"file://{tmp_path}/frames", lambda df, _: got.extend(r.seq for r in generations.latest_frames(df).collect()))
    q.awaitTermination(60)
    assert sorted(got) == [2, 3]


def test_dump_reader(spark, tmp_path):
    doc = {"project": "p", "languages": ["typescript"], "indexer": "static", "nodes": [{"id": "a", "kind": "function", "language": "typescript", "name": "a", "file": "a.ts", "external": False, "evidence": {"startLine": 3}}], "edges": [{"from": "a", "to": "a", "kind": "calls", "evidence": {"startLine": 4}}], "warnings": ["w"]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    t = dump.read_dump(spark, f"file://{tmp_path}/d.json")
    n, e = t["nodes"].first(), t["edges"].first()
    assert (n.ord, n.line, n.evidence.file, n.exported) == (0, 3, "a.ts", False) and (e.src, e.evidence.file, e.line) == ("a", "a.ts", 4)
    assert t["warnings"].first().text == "w"
    slim = dump.wire_edge_spans(t["edges"], t["nodes"])
    assert slim.first().evidence.file is None and slim.first().evidence.startLine == 4
    dump.write_dump({"nodes": t["nodes"], "edges": t["edges"]}, f"file://{tmp_path}/lines")
    back = dump.read_lines(spark, f"file://{tmp_path}/lines", {"nodes": t["nodes"].schema, "edges": t["edges"].schema})
    assert back["nodes"].collect() == t["nodes"].collect() and back["edges"].collect() == t["edges"].collect()
    (tmp_path / "go.json").write_text(json.dumps({"schemaVersion": 1, "languages": ["go"], "tool": {"name": "g"}, "sources": [{"file": "a.go", "checkerDigest": "x"}], "nodes": doc["nodes"], "edges": doc["edges"]}))
    go = dump.read_go_snapshot(spark, f"file://{tmp_path}/go.json")
    assert (go["nodes"].count(), go["edges"].first().kind, go["sources"].first().file, go["header"].first().languages, go["diagnostics"].count()) == (1, "calls", "a.go", ["go"], 0)
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception):
        dump.read_dump(spark, f"file://{tmp_path}/bad.json")["nodes"].collect()


SOURCES = {
    "service.ts": ("typescript", "import { x } from './base';\n// class Hidden {}\nexport interface Store { save(): void }\n@Inject()\nexport class Orders extends Base implements Store {\n  save() {\n    helper(1);\n    return new Item('class Fake');\n  }\n}\nclass Item {}\nexport function helper(n) {\n  return n;\n}\n"),
    "base.ts": ("typescript", "export class Base {}\n"),
    "main.go": ("go", 'package main\nimport (\n  f "fmt"\n)\ntype Box struct {\n  n int\n}\nfunc (b Box) Open() int {\n  return size(b)\n}\nfunc size(b Box) int {\n  return 1\n}\n'),
    "m.py": ("python", "import os\nfrom a.b import c\n\nclass A(B, metaclass=M):\n    def run(self):\n        return _help()\n\ndef _help():\n    '''def not_this(): pass'''\n    return 1\n"),
    "T.java": ("java", "import java.util.List;\npublic class T extends U {\n  public int go(int a) {\n    return 1;\n  }\n}\n"),
    "l.rs": ("rust", "use std::fmt;\npub trait Draw {\n}\npub struct Dot {\n}\npub fn draw() {\n}\n"),
    "k.kt": ("kotlin", "import a.b\nclass K : Base() {\n  fun go() {\n  }\n}\n"), "s.swift": ("swift", "import UIKit\nstruct S: View {\n  func body() {\n  }\n}\n"),
    "r.rb": ("ruby", "require 'set'\nclass R < Base\n  def go\n    1\n  end\nend\n"), "p.php": ("php", "<?php\nuse A\\B;\nclass P extends Q {\n  public function go() {\n  }\n}\n"),
    "l.lua": ("lua", "local m = require('x')\nfunction m.go()\n  return 1\nend\n"), "z.zig": ("zig", 'const s = @import("std");\npub fn go() void {\n}\n'),
    "c.c": ("c", "#include <stdio.h>\nstruct point {\n  int x;\n};\nint main(int argc) {\n  return 0;\n}\n"), "c.cpp": ("cpp", "#include \"a.h\"\nnamespace n {\nclass D : public E {\n};\n}\n"),
    "c.cs": ("csharp", "using System;\nnamespace N {\n  public class C : D {\n    public int Go(int a) {\n      return 1;\n    }\n  }\n}\n"), "d.dart": ("dart", "import 'a.dart';\nclass D extends E {\n}\n"),
    "s.scala": ("scala", "import a.b\ntrait T {\n  def go(): Int = {\n    1\n  }\n}\n"),
}
EXPECTED = {
    "service.ts": {("Store", "interface"), ("Orders", "class"), ("save", "method"), ("Item", "class"), ("helper", "function")}, "base.ts": {("Base", "class")},
    "main.go": {("Box", "class"), ("Open", "method"), ("size", "function")}, "m.py": {("A", "class"), ("run", "method"), ("_help", "function")}, "T.java": {("T", "class"), ("go", "method")},
    "l.rs": {("Draw", "interface"), ("Dot", "class"), ("draw", "function")}, "k.kt": {("K", "class"), ("go", "method")}, "s.swift": {("S", "class"), ("body", "method")},
    "r.rb": {("R", "class"), ("go", "method")}, "p.php": {("P", "class"), ("go", "method")}, "l.lua": {("m", "variable"), ("go", "function")}, "z.zig": {("s", "variable"), ("go", "function")},
    "c.c": {("point", "class"), ("main", "function")}, "c.cpp": {("n", "namespace"), ("D", "class")}, "c.cs": {("N", "namespace"), ("C", "class"), ("Go", "method")}, "d.dart": {("D", "class")}, "s.scala": {("T", "interface"), ("go", "method")},
}


@pytest.mark.parametrize("file", list(SOURCES))
def test_declarations_of_each_language(file):
    language, body = SOURCES[file]
    assert {(d.name, d.kind) for d in extract.declarations(body, language)} == EXPECTED[file]
    assert len(masking.mask(body, language)) == len(body)
    if file not in ("base.ts",):
        assert extract.imports(body, language)


MASKED = [
    ("typescript", "a = `x ${f(`in ${g} it`)} y`; b = /no[/]t'/.test(c); d = 1 / e / h;", {"a", "f", "g", "b", "test", "c", "d", "e", "h"}),
    ("typescript", "return /x\\/y/g // z", {"return", "g"}),
    ("lua", "a = [==[ no ]] no ]==] b --[=[ not\n here ]=] c\n-- d\ne", {"a", "b", "c", "e"}),
    ("ruby", "a = <<~ONE + b\n  not this\n  ONE\nc = %w(not (these) either) + d % e; f =~ /not #x/", {"a", "b", "c", "d", "e", "f", "ONE"}),
    ("php", "$a = <<<'EOT'\nnot this\n  EOT;\n$b = 1;", {"a", "b", "EOT"}),
    ("python", "a = \'\'\'not\nthis\'\'\' + b # not", {"a", "b"}),
]


@pytest.mark.parametrize("language, body, names", MASKED)
def test_literals_and_comments_are_blank(language, body, names):
    got = masking.mask(body, language)
    assert len(got) == len(body) and got.count("\n") == body.count("\n")
    assert set(re.findall(r"[A-Za-z]+", got)) - {"w"} == names


def test_imports_name_each_module_once():
    assert extract.imports("import os, sys as s, a.b  # c, d\nimport os\nfrom x import y\n", "python") == ["os", "sys", "a.b", "x"]
    assert len(extract.imports("\n".join(f"import m{i}" for i in range(2_000)), "python")) == 1_500


def test_of_several_types_the_first_counts(spark):
    texts = [("b.cs", "csharp", "namespace N {\n  public interface I {\n  }\n  public class A : I {\n  }\n  public interface J : I {\n  }\n}\n"), ("a.cs", "csharp", "public class I {\n}\npublic class Z : B {\n}\n"), ("c.cs", "csharp", "public class B {\n}\n"), ("d.cs", "csharp", "public class B {\n}\n")]
    nodes, edges = tables.static_graph(spark.createDataFrame(texts, "file string, language string, text string"))
    got = {(r.src.split("#")[0], r.src.split("#")[1], r.kind, r.dst.split("#")[0]) for r in edges.filter("kind IN ('extends', 'implements')").collect()}
    assert got == {("b.cs", "N.A:class", "implements", "b.cs"), ("b.cs", "N.J:interface", "extends", "b.cs"), ("a.cs", "Z:class", "extends", "c.cs")}


def test_static_graph(spark):
    rows = [(f, lang, body) for f, (lang, body) in SOURCES.items()]
    nodes, edges = tables.static_graph(spark.createDataFrame(rows, "file string, language string, text string"))
    name = {r.id: r.name for r in nodes.collect()}
    got = {(name.get(r.src, r.src), r.kind, name.get(r.dst, r.dst)) for r in edges.collect()}
    for edge in [("Orders", "extends", "Base"), ("Orders", "implements", "Store"), ("save", "calls", "helper"), ("save", "instantiates", "Item"), ("Orders", "contains", "save"), ("service.ts", "exports", "Orders"), ("service.ts", "imports", "external:typescript:./base"), ("Open", "calls", "size"), ("run", "calls", "_help")]:
        assert edge in got, edge
    assert not {e for e in got if "Hidden" in e or "Fake" in e or "not_this" in e}


def test_artifacts(spark, tmp_path):
    doc = {"documents": [{"relativePath": "a.ts", "language": "TypeScript", "occurrences": [
        {"range": [0, 9, 12], "symbol": "f", "symbolRoles": 1, "enclosingRange": [0, 0, 4, 1]}, {"range": [6, 9, 12], "symbol": "g", "symbolRoles": 1, "enclosingRange": [6, 0, 8, 1]},
        {"range": [2, 2, 3], "symbol": "g", "symbolRoles": 8}, {"range": [7, 2, 3], "symbol": "out", "symbolRoles": 0}],
        "symbols": [{"symbol": "f", "displayName": "f", "kind": "Function"}, {"symbol": "g", "displayName": "g", "kind": "Function", "enclosingSymbol": "f"}]}], "externalSymbols": [{"symbol": "out", "displayName": "Out"}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    nodes, edges = artifacts.symbol_index_graph(artifacts.read_symbol_index(spark, f"file://{tmp_path}/i.json"), ["typescript"])
    assert {(r.id, r.kind, r.line) for r in nodes.collect()} == {("f", "function", 1), ("g", "function", 7), ("out", "external_symbol", None)}
    assert {(r.src, r.dst, r.kind) for r in edges.collect()} == {("f", "g", "references"), ("g", "out", "references"), ("f", "g", "contains")}
    cases = [("x = new ", "(1)", "class", "instantiates"), ("", "(1)", "function", "calls"), ("", "?.(1)", "method", "calls"), ("f(", ", 2)", "function", "accesses"), ("a: ", " = 1", "type", "type_ref"), ("<", " />", "function", "renders"), ("a.", ";", "function", "accesses"), ("", ";", "function", "references")]
    df = spark.createDataFrame(cases, "b string, a string, t string, want string")
    assert all(r.want == r.got for r in df.select("want", artifacts.reference_kind(F.col("b"), F.col("a"), F.col("t")).alias("got")).collect())
    occ = spark.createDataFrame([("m", "c", 23, (1 << 5) | (1 << 2), 4), ("m", "v", 13, 1 << 3, 5), ("m", "v", 13, 1 << 6, 6), ("m", "t", 7, 1 << 20, 7), ("m", "u", 7, 1 << 2, 8)], "owner string, symbol string, target_kind int, roles int, line int")
    e, dyn = artifacts.native_occurrences(occ, spark.createDataFrame([("c",), ("v",), ("t",), ("u",)], "id string"))
    assert {(r.dst, r.kind) for r in e.collect()} == {("c", "calls"), ("c", "instantiates"), ("c", "references"), ("v", "accesses"), ("t", "type_ref"), ("u", "references"), ("u", "type_ref")} and dyn.count() == 1
    rel = spark.createDataFrame([("s", "o", 1 << b) for b in (10, 11, 12, 14, 15, 16, 17, 19)], "subject string, object string, roles int")
    assert {(r.src, r.kind) for r in artifacts.native_relations(rel).collect()} == {("o", "contains"), ("o", "extends"), ("s", "overrides"), ("o", "calls"), ("s", "accesses"), ("s", "instantiates")}
    pk = spark.createDataFrame([("a", "1", "packages/a", {"b": "^1"}, {"build": "x"}, "./index.js", None), ("b", "1", "packages/b", {}, {}, None, None)], "name string, version string, path string, dependencies map<string,string>, scripts map<string,string>, main string, bin string")
    tn, te = artifacts.package_topology(pk, "w")
    assert {r.kind for r in te.collect()} == {"contains", "depends-on", "entrypoint-of"} and tn.filter("file = 'packages/a/index.js'").count() == 1


def test_identities(spark):
    cols = "id string, kind string, display string, language string, role string, symbol string, module string, target string, unit string, document string, overload string, line int, end_line int"
    n = spark.createDataFrame([("a", "class", "A b", "ts", "decl", "A", "m", None, None, None, None, 1, 9), ("b", "method", "x", "ts", "decl", "B", "m", None, None, None, None, 2, 3), ("b", "method", "y", "ts", "decl", "B", "m", None, None, None, None, 5, 8)], cols)
    ids = identity.semantic_ids(n, "g1")
    got = {(r.id, r.display): r.semantic_id for r in ids.collect()}
    assert got["a", "A b"].startswith("@v2/ts/") and got["a", "A b"].endswith("#A%20b:class") and got["b", "x"].startswith("@g2/") and len(set(got.values())) == 3
    kept, lost = identity.remap_edges(spark.createDataFrame([("b", "a", "calls", 6), ("a", "b", "calls", 1)], EDGE), ids)
    assert [r.src for r in kept.collect()] == [got["b", "y"]] and lost.count() == 1


def test_requests(random_graph):
    _, _, n, e = random_graph
    assert inspect(None, {"type": "escape", "reason": "x"})["next"] == "outside"
    g = Graph(n, e)
    assert inspect(g, {"type": "overview"})["result"]["counts"]
    assert inspect(g, {"type": "lookup", "query": "n1"})["next"] == "answer"
    assert inspect(g, {"type": "lookup", "query": "zzz"})["next"] == "clarify"
    d = inspect(g, {"type": "details", "handles": ["n1", "missing"], "neighbors": True})["result"]
    assert d["unknown"] == ["missing"] and len(d["nodes"]) == 1
    t = inspect(g, {"type": "trace", "from": "n1"})["result"]
    assert t["start"] == "n1" and t["reached"] == walked(random_graph[0], random_graph[1], "n1", "forward", 3, 12)[0]
    assert inspect(g, {"type": "trace", "from": "nobody"})["next"] == "outside"
    e2 = inspect(g, {"type": "entrypoints", "query": "what does `n2` do", "neighbors": 2})
    assert e2["result"]["mentions"] == [{"handle": "n2", "candidates": ["n2"]}] and e2["next"] == "inspect"
    told = inspect(g, {"type": "tour", "question": "`n3`", "reinterpretations": ["n5"], "limit": 4})["result"]
    assert "n3" in told["seeds"] and len(told["answerAnchors"]) <= 14
    assert "entrypoints" in inspect(g, {"type": "entrypoints", "query": "n2", "neighbors": 2})["result"]
    assert inspect(g, {"type": "topology"})["next"] == "outside"
    assert len(details.DETAIL_RANK) == 10


def test_topology_is_fenced_by_the_code_generation(spark, random_graph):
    n = spark.createDataFrame([node("a.ts", "file", file="a.ts")], NODE)
    e = random_graph[3].limit(0)
    topo = spark.createDataFrame([("p", "p", "p", None, ".")], "id string, name string, coordinate string, file string, root string")
    edges = spark.createDataFrame([], "src string, dst string, kind string")
    g = Graph(n, e, topo_nodes=topo, topo_edges=edges, project="x", topology_project="x", generation="1")
    good = inspect(g, {"type": "topology"})
    assert good["next"] == "answer" and good["result"]["join"]["state"] == "compatible" and good["result"]["files"] == [{"id": "p", "file": "a.ts"}]
    moved = inspect(g, {"type": "topology", "confirmedGeneration": "2"})["result"]
    assert moved["join"]["state"] == "unavailable" and moved["files"] == []
    other = Graph(n, e, topo_nodes=topo, topo_edges=edges, project="x", topology_project="y", generation="1")
    assert inspect(other, {"type": "topology"})["result"]["join"]["reason"] == "the code and the topology are of different projects"
    assert inspect(g, {"type": "topology", "query": "nothing"})["next"] == "clarify"


def test_an_edge_between_two_neighbours_is_no_part_of_a_topology(spark):
    t = spark.createDataFrame([(x, x, x) for x in "abcd"], "id string, name string, coordinate string")
    e = spark.createDataFrame([("a", "b", "contains"), ("c", "a", "contains"), ("b", "c", "contains"), ("c", "d", "contains")], "src string, dst string, kind string")
    kept, used = topology.inspect(t, e, "a")
    assert {r.id for r in kept.collect()} == {"a", "b", "c"} and {(r.src, r.dst) for r in used.collect()} == {("a", "b"), ("c", "a")}
    kept, used = topology.inspect(t, e, None, None, 2)
    assert [r.id for r in kept.collect()] == ["a", "b"] and {(r.src, r.dst) for r in used.collect()} == {("a", "b")}


HELLO = {"provider": "p", "language": "lua", "schemaVersion": 1, "protocolVersion": 1, "tool": "t", "toolVersion": "1"}


def frames(tmp_path, name, begin, shards, commit_shards, **commit):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [{"type": "hello"} | HELLO, {"type": "begin"} | begin]
    rows += [{"type": "upsertShard", "key": k, "payload": v, "digest": digest(v)} if v is not None else {"type": "deleteShard", "key": k} for k, v in shards]
    rows += [{"type": "commit", "sequence": begin["sequence"], "generation": begin["generation"], "shards": [{"key": k, "digest": digest(v)} for k, v in commit_shards]} | commit]
    (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    return f"file://{tmp_path}/{name}"


def test_transactions_are_applied_whole_or_not_at_all(spark, tmp_path):
    first = {"sequence": 1, "generation": "g1", "universe": "u", "targets": ["a"], "manifest": "m1"}
    read = lambda *a, **b: protocol.read_transaction(spark, frames(tmp_path, *a, **b))
    held = protocol.apply_transaction(read("1", first, [("a", "x"), ("b", "y")], [("a", "x"), ("b", "y")]), None)
    assert {(r.key, r.payload) for r in held.shards.collect()} == {("a", "x"), ("b", "y")}
    delta = first | {"sequence": 2, "generation": "g2", "baseSequence": 1, "baseGeneration": "g1", "manifest": "m2"}
    new = protocol.apply_transaction(read("2", delta, [("a", "z"), ("b", None), ("c", "w")], [("a", "z"), ("c", "w")]), held)
    assert {(r.key, r.payload) for r in new.shards.collect()} == {("a", "z"), ("c", "w")}
    cases = {
        "the base is not the current generation": (delta | {"baseGeneration": "g0"}, [("a", "z")], [("a", "z"), ("b", "y")], {}),
        "the sequence does not advance": (delta | {"sequence": 1}, [("a", "z")], [("a", "z"), ("b", "y")], {}),
        "commit is not of the generation": (delta, [("a", "z")], [("a", "z"), ("b", "y")], {"generation": "other"}),
        "a shard is there twice": (delta, [("a", "z"), ("a", "z")], [("a", "z"), ("b", "y")], {}),
        "a shard to delete is not there": (delta, [("q", None), ("a", "z")], [("a", "z"), ("b", "y")], {}),
        "a shard is not in the commit": (delta, [("a", "z")], [("a", "z")], {}),
        "the commit names a shard that is not there": (delta, [("a", "z")], [("a", "z"), ("b", "y"), ("n", "n")], {}),
        "the inputs moved and no shard did": (delta, [("a", "x")], [("a", "x"), ("b", "y")], {}),
        "the targets moved and a shard stayed": (delta | {"targets": ["b"]}, [("a", "z")], [("a", "z"), ("b", "y")], {}),
    }
    for i, (why, (begin, shards, said, more)) in enumerate(cases.items()):
        with pytest.raises(ValueError, match=why):
            protocol.apply_transaction(read(f"bad{i}", begin, shards, said, **more), held)
    with pytest.raises(ValueError, match="facts"):
        protocol.apply_transaction(read("f", first, [("a", "x")], [("a", "x")], factDigest="no"), None, generations.fact_digest(held.shards, ["key"]))
    broken = read("1", first, [("a", "x")], [("a", "x")])
    broken.shards = broken.shards.withColumn("payload", F.lit("other"))
    with pytest.raises(ValueError, match="not what its digest says"):
        protocol.apply_transaction(broken, None)
    (tmp_path / "junk").write_text('{"nope": 1}')
    with pytest.raises(Exception):
        protocol.read_transaction(spark, f"file://{tmp_path}/junk")


def test_of_two_publishers_one_fails(spark, tmp_path):
    a, b = (generations.Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    t = spark.range(3)
    first = a.publish({"t": t}, None)
    b.current = lambda: {"generation": first, "number": 1}  # has not seen what a publishes now
    a.publish({"t": t.limit(1)}, first)
    with pytest.raises(ValueError):
        b.publish({"t": t}, first)
    assert a.read("t").count() == 1


def test_fact_digest_knows_rows_and_not_their_order(spark):
    rows = spark.range(3000).withColumn("x", F.col("id") * 7)
    one = lambda df, part=50_000: generations.fact_digest(df, ["id", "x"], part).first().digest
    assert one(rows) == one(rows.orderBy(F.desc("id")).repartition(5)) != one(rows.filter("id > 0"))
    assert one(rows, 4) == one(rows.repartition(7), 4) and one(rows.limit(0))


def test_export_surface_follows_the_barrels_of_a_project(spark):
    texts = {
        "src/order.ts": "export class Order {}\nexport function helper() {}\n", "src/index.ts": "export * from './order';\nexport { type Item as Thing } from \"./lib/item\";\nexport * as ns from './hidden';\n",
        "src/lib/item.ts": "export class Item {}\nexport class Other {}\n", "src/hidden.ts": "export class Hidden {}\n", "main.ts": "x;\n  export { Order, helper as h } from './src/index.js'\nexport * from './src'\nexport * from 'pkg'\n",
        "pkg/__init__.py": "from .order import (Order, make as m)\nfrom ..top import *  # all\n", "pkg/order.py": "class Order:\n    pass\n", "top.py": "class Top:\n    pass\n", "pkg/mod.py": "from .order import Order\n",
        "c/src/lib.rs": "pub use crate::order::{Order as O, Line};\npub use self::deep::thing::*;\nuse crate::order::No;\n", "c/src/order.rs": "", "c/src/deep/thing/mod.rs": "",
    }
    language = {"ts": "typescript", "py": "python", "rs": "rust"}
    sources = spark.createDataFrame([(f, language[f.rsplit(".", 1)[1]], t) for f, t in texts.items()], "file string, language string, text string")
    got = {(r.file, r.source, r.name) for r in reexports.forwards(sources).collect()}
    assert got == {
        ("src/index.ts", "src/order.ts", None), ("src/index.ts", "src/lib/item.ts", "Item"), ("main.ts", "src/index.ts", None),
        ("pkg/__init__.py", "pkg/order.py", "Order"), ("pkg/__init__.py", "pkg/order.py", "make"), ("pkg/__init__.py", "top.py", None),
        ("c/src/lib.rs", "c/src/order.rs", "Order"), ("c/src/lib.rs", "c/src/order.rs", "Line"), ("c/src/lib.rs", "c/src/deep/thing/mod.rs", None),
    }
    rows = [node("src/order.ts#Order:class", "class", "Order", file="src/order.ts", exported=True), node("src/lib/item.ts#Item:class", "class", "Item", file="src/lib/item.ts", exported=True), node("src/lib/item.ts#Other:class", "class", "Other", file="src/lib/item.ts", exported=True), node("pkg/order.py#Order:class", "class", "Order", file="pkg/order.py", exported=True)]
    own = spark.createDataFrame(rows, NODE)
    n, e = assembly.finalise(own, spark.createDataFrame([], EDGE), reexports.forwards(sources), spark.createDataFrame([("pkg/order.py",)], "file string"))
    wire = {(r.src, r.dst.split("#")[1]) for r in e.filter("kind = 'exports'").collect()}
    assert wire == {("src/order.ts", "Order:class"), ("src/lib/item.ts", "Item:class"), ("src/lib/item.ts", "Other:class"), ("src/index.ts", "Order:class"), ("src/index.ts", "Item:class"), ("main.ts", "Order:class"), ("main.ts", "Item:class"), ("pkg/order.py", "Order:class"), ("pkg/__init__.py", "Order:class")}
    assert {r.id for r in n.filter("ignored").collect()} == {"pkg/order.py#Order:class"}
    again = assembly.finalise(n, e, reexports.forwards(sources))
    assert again[1].count() == e.count() and assembly.violations(n, e.filter("src LIKE 'src/%' OR src LIKE 'pkg/o%'").filter("src <> 'src/index.ts'")).count() == 0


def test_validation_names_every_breach(spark):
    bad = [node("a.ts#a:class", "function", "a", file="a.ts"), node("b", "function", "b", file="../b.ts"), node("c", "function", "c", file="/abs.ts"), node("", "function", "x"), node("d\0", "function", "d"), ("e", "external_symbol", "go", "e", None, "", True, False, False, None), node("f", "file", "f", file=""), ("g", "class", "go", "g", "", "g.go", False, False, False, 0)]
    n = spark.createDataFrame(bad, NODE)
    prov = spark.createDataFrame([("p", ["typescript", "zig"], ["f"], ["universe"], "t", 1, 0, "a" * 64, "b" * 64, "c"), ("q", [], [], [], "", 0, -1, "a" * 64, "b" * 64, "c" * 64)], "provider string, languages array<string>, facts array<string>, capabilities array<string>, tool string, schema_version int, protocol_version int, universe string, manifest string, content string")
    cover = spark.createDataFrame([("p", "typescript", "x", "calls", "partial"), ("p", "typescript", "x", "calls", "partial")], "provider string, language string, target string, family string, state string")
    left = spark.createDataFrame([("p", "typescript", "x", "calls", "d" * 64), ("p", "typescript", "x", "imports", "a" * 64)], "provider string, language string, target string, family string, universe string")
    got = Counter(r.rule for r in assembly.violations(n, spark.createDataFrame([("b", "zz", "calls", 1)], EDGE), cover, left, ["typescript"], prov).collect())
    assert got == Counter({
        "id does not match its file and kind": 1, "path is not canonical": 3, "identity or name is empty": 3, "missing dst": 1, "line is not positive": 1, "language is not of the dump": 2, "provider claims an absent language": 1,
        "content is no SHA-256": 1, "the producer's envelope is invalid": 1, "coverage is not exhaustive": 1, "duplicate coverage": 1, "coverage is missing": 1, "unresolved without partial coverage": 1, "unresolved of another universe": 1,
    })


def test_lua_reports_become_edges_between_declarations(spark, tmp_path):
    at = lambda l, c, l2=None, c2=None: {"file": "a.lua", "startLine": l, "startColumn": c, "endLine": l if l2 is None else l2, "endColumn": c + 1 if c2 is None else c2}  # noqa: E731, E741
    report = {"schemaVersion": 2, "files": ["a.lua"], "warnings": [], "nodes": [
        {"name": "outer", "kind": "function", "location": at(0, 0), "body": at(0, 0, 9, 3)}, {"name": "inner", "kind": "local", "location": at(2, 2), "body": at(2, 2, 5, 5)},
        {"name": "v", "kind": "local", "location": at(1, 2)}, {"name": "odd", "kind": "thing", "location": at(1, 9)}, {"name": "v", "kind": "local", "location": at(1, 2)}],
        "edges": [{"from": 3, "kind": "r", "location": at(1, 2)}, {"from": 3, "kind": "r", "location": at(3, 3)}, {"from": 3, "kind": "r", "location": at(4, 3)}, {"from": 3, "kind": "r", "location": at(7, 1)},
                  {"from": 2, "kind": "r", "location": at(8, 1)}, {"from": 2, "kind": "r", "location": at(3, 1)}, {"from": 3, "kind": "r", "location": at(20, 0)}, {"from": 4, "kind": "r", "location": at(3, 1)}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    n, e = artifacts.lua_graph(artifacts.read_lua_export(spark, f"file://{tmp_path}/r.json"))
    assert {(r.id, r.kind, r.line, r.col) for r in n.collect()} == {("a.lua#outer@1:1:function", "function", 1, 1), ("a.lua#inner@3:3:variable", "variable", 3, 3), ("a.lua#v@2:3:variable", "variable", 2, 3)}
    assert {(r.src.split("#")[1], r.dst.split("#")[1], r.line) for r in e.collect()} == {("inner@3:3:variable", "v@2:3:variable", 4), ("outer@1:1:function", "v@2:3:variable", 8), ("outer@1:1:function", "inner@3:3:variable", 9)}
    (tmp_path / "old.json").write_text(json.dumps(report | {"schemaVersion": 1}))
    with pytest.raises(Exception):
        artifacts.lua_graph(artifacts.read_lua_export(spark, f"file://{tmp_path}/old.json"))[0].collect()


def test_dump_rules_and_folded_modules(spark):
    rows = [("m", "module", "typescript", "m", "a.ts", False, None, None), ("m2", "module", "typescript", "m2", "a.ts", False, None, None), ("f", "function", "typescript", "f", "a.ts", False, ["x"], None), ("e", "enum", "typescript", "e", "b.ts", False, ["x"], ["y"])]
    n = spark.createDataFrame(rows, "id string, kind string, language string, name string, file string, external boolean, literals array<string>, enum_members array<string>")
    e = spark.createDataFrame([("m", "f", "contains"), ("m2", "f", "contains"), ("f", "m", "calls"), ("gone", "f", "calls")], "src string, dst string, kind string")
    folded, moved = snapshots.fold_modules(n, e)
    assert {(r.id, r.kind) for r in folded.collect()} == {("a.ts", "file"), ("f", "function"), ("e", "enum")} and {r.src for r in moved.collect()} == {"a.ts", "f", "gone"}
    got = Counter(r.rule for r in snapshots.dump_violations(n, e, spark.createDataFrame([("a.ts",)], "file string")).collect())
    assert got == {"literals of another kind": 1, "duplicate edge after folding": 1, "unknown or folded target": 1, "unknown source": 1, "facts of a file that was not loaded": 1}


def test_rust_shards_and_go_tests(spark):
    n = spark.createDataFrame([("1", "f", False), ("2", "g", False), ("3", "std", True)], "id string, name string, external boolean")
    ids = spark.createDataFrame([("1", "a#f:function"), ("2", "a#g:function")], "native string, id string")
    e = spark.createDataFrame([("1", "2", "calls", 3), ("1", "9", "calls", 4)], "src string, dst string, kind string, line int")
    u = spark.createDataFrame([("calls", "dynamic", ["9", "2"]), ("dispatches", "dynamic", [])], "family string, reason string, candidates array<string>")
    own, kept, sites, bad = snapshots.rust_shard(n, e, u, ids)
    assert {r.id for r in own.collect()} == {"a#f:function", "a#g:function"} and [(r.src, r.dst, r.line) for r in kept.collect()] == [("a#f:function", "a#g:function", 3)]
    assert {(r.family, tuple(r.candidates)) for r in sites.collect()} == {("calls", ("9", "a#g:function")), ("dispatches", ())} and [r.end for r in bad.collect()] == ["9"]
    cases = [("a_test.go", "TestX", "func(t *testing.T)", True), ("a_test.go", "Testx", "func(t *testing.T)", False), ("a.go", "TestX", "func(t *testing.T)", False), ("a_test.go", "ExampleRun", "func()", True), ("a_test.go", "Helper", "func()", False)]
    df = spark.createDataFrame(cases, "f string, n string, s string, want boolean")
    assert all(r.want == r.got for r in df.select("want", snapshots.is_go_test(F.col("f"), F.col("n"), F.col("s")).alias("got")).collect())


def test_contracts_and_the_choice_of_providers(spark):
    p = contract.Provider("p", "compiler", ("go",), ("calls",))
    n = spark.createDataFrame([("a", "go", "a.go"), ("b", "zig", "b.zig")], "id string, language string, file string")
    e = spark.createDataFrame([("a", "a.go", "calls"), ("a", "x", "imports")], "src string, dst string, kind string")
    got = Counter(r.rule for r in contract.contract_violations(p, n, e, {"provider": "q", "authority": "compiler", "facts": ["calls", "tests"]}, ["go", "lua"]).collect())
    assert got == {"a language that it does not own": 1, "provenance has another provider": 1, "provenance claims other facts": 1, "an edge of a family that it cannot prove": 1, "a node of a language that the slice does not name": 1, "an absent end": 1}
    fall = contract.Provider("c2", "index", ("c", "cpp"), ("calls",))
    registry_ = [p, contract.Provider("c1", "compiler", ("c", "cpp"), ("calls",), (fall,))]
    chosen, warned = contract.select_providers(registry_, ["c", "go"], {"p": "go is off"}, {"c2", "p"})
    assert chosen == [{"provider": "c2", "languages": ["c"], "fallbacks": []}] and warned == ["go is off", "c: c1 was not found"]
    assert contract.select_providers(registry_, ["c"], {}, {"c1"}, strict=False)[0] == []
    assert contract.registry_errors([p, contract.Provider("p", "x", ("go",), ("a", "a")), contract.Provider("z", "x", (), ())]) == ["p is registered twice", "p repeats a family", "p and p both own go", "z owns no language"]
    with pytest.raises(ValueError):
        contract.select_providers([p, p], ["go"], {}, set())
    seen = {"tool": "t", "toolVersion": "1", "universe": "u"}
    assert [contract.refresh_mode(*a) for a in ((None, seen, 1, 0), (seen, seen | {"universe": "v"}, 1, 0), (seen, seen, 0, 3), (seen, seen, 1, 2), (seen, seen, 3, 0))] == ["initial", "reload", "unchanged", "incremental", "rebuild"]


def test_cargo_and_the_topology_of_several_providers(spark):
    target = "array<struct<name:string,kind:array<string>,file:string>>"
    pk = spark.createDataFrame([("i1", "app", "1.0", ".", [("app", ["bin"], "src/main.rs"), ("t", ["test"], "tests/t.rs")]), ("i2", "dep", "2.0", "/home/dep", [("dep", ["lib"], "/home/dep/lib.rs")])], f"id string, name string, version string, path string, targets {target}")
    resolved = spark.createDataFrame([("i1", ["b", "a"], ["i2"]), ("i2", [], [])], "id string, features array<string>, dependencies array<string>")
    n, e = topology.cargo(pk, spark.createDataFrame([("i1",)], "id string"), resolved, "w")
    kinds, edges = Counter(r.kind for r in n.collect()), Counter(r.kind for r in e.collect())
    assert kinds == {"workspace": 1, "package": 2, "build-target": 3, "source-set": 3, "entrypoint": 2} and n.filter("external").count() == 3
    assert edges == {"contains": 1 + 3 + 3 + 2, "source-of": 3, "joins-file": 5, "test-of": 1, "entrypoint-of": 2, "depends-on": 1}
    assert n.filter("kind = 'package' AND name = 'app'").first().id == "repository://cargo/features%3Da%2Cb/package/app%401.0%3A."
    shards = spark.createDataFrame([("s", "d")], "key string, digest string")
    cover = spark.createDataFrame([("cargo", "cargo", "x", "contains", "complete")], "provider string, ecosystem string, target string, family string, state string")
    out = topology.assemble({"cargo": {"nodes": n, "edges": e, "shards": shards, "coverage": cover}, "npm": {"nodes": n.limit(2), "edges": e, "shards": shards}}, {"gradle": ("gradle", "no tool")}, spark)
    assert out["nodes"].count() == n.count() and out["edges"].count() == e.count() and {r.key for r in out["shards"].collect()} == {"cargo/s", "npm/s"}
    assert out["coverage"].filter("state = 'unsupported'").count() == 8 and [r.text for r in out["warnings"].collect()] == ["repository context unavailable: gradle: no tool"]


def test_gradle_models(spark, tmp_path):
    line = lambda k, *f: "\t".join([k, *(base64.urlsafe_b64encode(x.encode()).decode().rstrip("=") for x in f)])
    lines = [line("V", "8.1"), line("M", ":app", "app", "/w/app"), line("M", ":lib", "lib", "/w/lib"), line("M", ":x:lib2", "dup", "/w/x"), line("M", ":y:lib2", "dup", "/w/y"), line("T", ":app", ":app:run", "run"),
             line("S", ":app", "source", "/w/app/src/größe", "false"), line("S", ":app", "test", "/w/app/test", "false"), line("S", ":lib", "source", "/out/gen", "true"), line("D", ":app", "lib"), line("D", ":app", "dup"), line("D", ":lib", ":x:lib2"), line("D", ":lib", "gone")]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    n, e, left = topology.gradle(topology.read_gradle(spark, f"file://{tmp_path}/m.txt"), "w", "/w")
    assert Counter(r.kind for r in n.collect()) == {"workspace": 1, "project": 4, "build-target": 4, "source-root": 2, "generated-root": 1, "task": 1} and left == 2
    assert Counter(r.kind for r in e.collect()) == {"contains": 4 + 4 + 3 + 1, "source-of": 3, "test-of": 1, "depends-on": 2}
    assert {(r.root, r.external) for r in n.filter("root IS NOT NULL").collect()} == {("app/src/größe", False), ("app/test", False), ("/out/gen", True)}
    assert n.filter("name = 'größe'").first().id == "repository://gradle/default/source-root/%3Aapp%3Aapp%2Fsrc%2Fgr%C3%B6%C3%9Fe"


def test_topology_transactions_have_no_gaps(spark, tmp_path):
    read = lambda *a: protocol.read_transaction(spark, frames(tmp_path, *a))
    first = {"sequence": 1, "generation": "g1", "manifest": "m"}
    held = protocol.apply_transaction(read("t1", first, [("a", "x")], [("a", "x")]), None, gapless=True)
    delta = {"sequence": 2, "generation": "g2", "baseSequence": 1, "baseGeneration": "g1", "manifest": "m"}
    assert protocol.apply_transaction(read("t2", delta, [("b", "y")], [("a", "x"), ("b", "y")]), held, gapless=True).shards.count() == 2
    for i, bad in enumerate((delta | {"sequence": 3}, first | {"sequence": 2})):
        with pytest.raises(ValueError, match="gap|base"):
            protocol.apply_transaction(read(f"t3{i}", bad, [("b", "y")], [("a", "x"), ("b", "y")]), held, gapless=True)
    with pytest.raises(ValueError, match="gap"):
        protocol.apply_transaction(read("t4", first | {"sequence": 2}, [("a", "x")], [("a", "x")]), None, gapless=True)


def test_entry_registers_queries():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(q) >= 45 and set(sql) <= set(q)
