"""The guided tour: what is central, which flows tell the story, what lies near."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.functions.text import is_private_like, is_production, is_support_path, is_test_path, matched_terms, shared_path_depth, stem_word, subwords
from graphlake.operators.lookup import query_words
from graphlake.schema import DISPATCH_SOURCE, INVOKE, STRUCTURAL
from graphlake.sources.shared import materialize

REACH_DEPTH, REACH_NODES = 4, 400
#: Of the seeds of a tour, the share of those that the caller named.
NAMED_SHARE = 0.5
#: Of a flow, the share that an earlier flow has told, from which on it is the same story.
OVERLAP = 0.6
# Kinds of declarations that a tour may begin at, those of them that must run something, and those that a flow starts from.
SEED_KINDS = "class function method constructor property field variable module namespace enum".split()
DATA_KINDS = "property field".split()
FLOW_KINDS = "function method constructor property field variable".split()


def public_fan_in(nodes: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """``id``, ``public_fan_in``: a node's own export fan-in or its owner's, whichever is greater."""
    fan = degree.select("id", "export_fan_in")
    owner = (
        edges.filter("kind = 'contains'")
        .join(nodes.filter("kind NOT IN ('file', 'module')").select(F.col("id").alias("src")), "src", "left_semi")
        .groupBy(F.col("dst").alias("id"))
        .agg(F.min("src").alias("owner"))
        .join(fan.select(F.col("id").alias("owner"), F.col("export_fan_in").alias("of_owner")), "owner", "left")
    )
    joined = nodes.select("id").join(fan, "id", "left").join(owner.select("id", "of_owner"), "id", "left")
    return joined.select("id", F.greatest(F.coalesce("export_fan_in", F.lit(0)), F.coalesce("of_owner", F.lit(0))).alias("public_fan_in"))


def _production(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_production(F.col("external"), F.col("ignored"), F.col("file")))


def invocations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src``, ``dst``: what makes what run, among production code.

    A declaration that invokes nothing leads to what overrides or implements it.
    """
    invoke = edges.filter(F.col("kind").isin(INVOKE)).select("src", "dst")
    up = edges.filter(F.col("kind").isin(DISPATCH_SOURCE)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = invoke.unionAll(up.join(invoke.select("src").distinct(), "src", "left_anti")).distinct()
    return every.join(_production(nodes).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


#: Files of one row of a set of files: so many bits, in longs.
BLOCK, LONG = 256, 64
_BITS = [f"b{i}" for i in range(BLOCK // LONG)]


def _either(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(*[F.bit_or(b).alias(b) for b in _BITS])


def _file_bits(hop: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``block`` and bits of the file of everything that a hop leads to; files next to each other by path share blocks."""
    own = hop.select(F.col("dst").alias("id")).distinct().join(nodes.select("id", "file"), "id")
    number = own.select("file").distinct().repartitionByRange("file").sortWithinPartitions("file").withColumn("no", F.monotonically_increasing_id())
    number = materialize(number, "files")
    at = F.col("no") % BLOCK
    bit = F.expr(f"shiftleft(1L, CAST(no % {LONG} AS INT))")
    bits = [F.when(F.floor(at / LONG) == i, bit).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(_BITS)]
    return materialize(own.join(number, "file").select("id", F.floor(F.col("no") / BLOCK).alias("block"), *bits), "files")


def _from(hop: DataFrame, ids: DataFrame) -> DataFrame:
    return hop.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def _rounds(hop: DataFrame, seeds: DataFrame, n: int) -> list[DataFrame]:
    """The hops from the seeds, those from what these lead to, and so on, ``n`` times."""
    out = [materialize(_from(hop, seeds), "round")]
    for _ in range(n - 1):
        out.append(materialize(_from(hop, out[-1].select(F.col("dst").alias("id"))), "round"))
    return out


def _walked(seeds: DataFrame, hop: DataFrame, depth: int, budget: int) -> DataFrame:
    """``id``, ``r`` of the seeds (id, last) that have seen ``budget`` nodes at a level ``r``, up to their ``last``.

    Only whether there are so many is asked, so ``budget`` of what a node leads
    to, or of what it sees in some levels, tell as much as all of them.
    """
    first = lambda df, key, order: df.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("n") <= budget).drop("n")
    left = seeds.select(F.col("id").alias("src"), "last")
    rounds = _rounds(materialize(first(hop, "src", "dst"), "hop"), seeds, depth - 1)
    seen, spent = None, None
    for level in range(1, depth):

        def sees(hops: DataFrame) -> DataFrame:
            far = hops.select("src", F.col("dst").alias("id")) if seen is None else hops.join(seen.withColumnRenamed("src", "dst"), "dst").select("src", "id")  # noqa: B023
            return far.unionByName(hops.select("src", F.col("src").alias("id"))).distinct()

        asked = rounds[0].join(left.filter(F.col("last") >= level), "src", "left_semi")
        if spent is not None:
            asked = asked.join(spent.select(F.col("id").alias("src")), "src", "left_anti")
        over = sees(asked).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= budget)
        over = materialize(over.select("id", F.lit(level).alias("r")), "spent")
        spent = over if spent is None else spent.unionByName(over)
        if level < depth - 1:
            inner = reduce(DataFrame.unionByName, rounds[1 : depth - level]).distinct()
            ends = reduce(DataFrame.unionByName, rounds[: depth - 1 - level]).select(F.col("dst").alias("src"))
            if level == depth - 2:  # only the seeds themselves ask once more
                ends = _from(rounds[0], left.filter(F.col("last") > level).select(F.col("src").alias("id")).join(spent, "id", "left_anti")).select(F.col("dst").alias("src"))
                inner = inner.join(ends.distinct(), "src", "left_semi")
            alone = ends.distinct().select("src", F.col("src").alias("id"))  # also of what leads nowhere
            seen = materialize(first(sees(inner).unionByName(alone).distinct(), "src", "id"), "seen")
    return spent


def _ends_of_circles(seeds: DataFrame, hop: DataFrame) -> DataFrame:
    """Those seeds that may reach themselves: what is left when ends are taken off, round by round."""
    core, n = hop, None
    while True:
        core = core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        core = materialize(core.select("src", "dst"), "core")
        n, before = core.count(), n
        if n == 0 or n == before:
            return materialize(seeds.join(core.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id"), "circle")


def _alone(seeds: DataFrame, hop: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``id`` of seeds (id, r) that reach themselves and no other node of their file in ``r`` hops.

    What is asked is passed on by node and file, not by seed; the answer is the first and the last node of the file.
    """
    file = nodes.select("id", "file")
    asked = [materialize(seeds.join(file, "id").select("id", "file", "r").distinct(), "asked")]
    out = lambda a: a.join(hop.withColumnRenamed("src", "id"), "id")
    for _ in range(depth - 1):
        asked.append(materialize(out(asked[-1].filter("r > 1")).select(F.col("dst").alias("id"), "file", (F.col("r") - 1).alias("r")).distinct(), "asked"))
    met = None
    for a in reversed(asked):
        rows = out(a).join(file.withColumnRenamed("id", "dst"), ["dst", "file"]).select("id", "file", "r", F.col("dst").alias("lo"), F.col("dst").alias("hi"))
        if met is not None:
            further = met.select(F.col("id").alias("dst"), "file", (F.col("r") + 1).alias("r"), "lo", "hi")
            rows = rows.unionByName(out(a).join(further, ["dst", "file", "r"]).select("id", "file", "r", "lo", "hi"))
        met = materialize(rows.groupBy("id", "file", "r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "met")
    return met.filter((F.col("lo") == F.col("id")) & (F.col("hi") == F.col("id"))).select("id")


def files_reached(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = REACH_DEPTH, budget: int | None = None) -> DataFrame:
    """``seed``, ``files``: distinct files of what lies within ``depth`` invocations, the seed itself left out; with a ``budget`` a seed that has seen so many nodes goes no further.

    Sets of files go from what is reached to what reaches it, as bits: a hub's
    set is made once, however many seeds lead to it, and no seed meets the nodes.
    """
    hop = materialize(invocations(nodes, edges), "hop")  # every level reads it
    seeds = materialize(seeds.select("id").distinct(), "seeds")
    rounds = _rounds(hop, seeds, depth)
    ends = _file_bits(hop, nodes)
    # Bits of a node itself, of what it reaches in one hop, and so on; all of them of what a seed leads to if seeds stop at different levels.
    levels = [ends]
    for k in range(depth - 1, 0, -1):
        inner = rounds[k] if budget is None else reduce(DataFrame.unionByName, rounds[1 : k + 1]).distinct()
        further = inner.join(levels[-1].withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "block", *_BITS)
        levels.append(materialize(_either(further.unionByName(ends), "id", "block"), "level"))
    levels = levels if budget is not None else levels[-1:]
    wide = None
    for i, x in reversed(list(enumerate(levels))):  # a level holds those before it
        x = x.select(F.col("id").alias("dst"), "block", *[F.col(b).alias(f"{b}_{i}") for b in _BITS])
        wide = x if wide is None else wide.join(x, ["dst", "block"], "left")
    every = [f"{b}_{i}" for i in range(len(levels)) for b in _BITS]
    reached = rounds[0].join(wide, "dst").groupBy(F.col("src").alias("id"), "block").agg(*[F.bit_or(b).alias(b) for b in every])
    size = [F.sum(sum((F.bit_count(F.coalesce(f"{b}_{i}", F.lit(0).cast("long"))) for b in _BITS), F.lit(0))).alias(f"n_{i}") for i in range(len(levels))]
    sizes = [f"n_{i}" for i in range(len(levels))]
    n = materialize(seeds.join(reached.groupBy("id").agg(*size), "id", "left").fillna(0, sizes), "sizes")
    circle = _ends_of_circles(seeds, hop)
    if budget is None:
        n = n.withColumn("r", F.lit(depth))
    else:
        # Where a seed stops is asked only if it tells: if a level has fewer files than the last one, or the seed itself may be among them.
        last = reduce(lambda later, i: F.when(F.col(f"n_{i}") < F.col(sizes[-1]), i + 1).otherwise(later), range(depth - 1), F.lit(0))
        own = n.join(circle.withColumn("on", F.lit(depth - 1)), "id", "left").select("id", F.coalesce("on", last).alias("last")).filter("last > 0")
        n = n.join(_walked(materialize(own, "asked"), hop, depth, budget), "id", "left").fillna(depth, ["r"])
    files = F.element_at(F.array(*sizes), F.col("r") if budget is not None else F.lit(1))
    if circle.isEmpty():
        return n.select(F.col("id").alias("seed"), files.alias("files"))
    alone = _alone(n.select("id", "r").join(circle, "id", "left_semi"), hop, nodes, depth).withColumn("less", F.lit(1))
    return n.join(alone, "id", "left").select(F.col("id").alias("seed"), (files - F.coalesce("less", F.lit(0))).alias("files"))


def centrality(nodes: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """``id``, ``centrality`` (0 to 100) of public production declarations: how public, times how far they reach or how often they are invoked."""
    own = _production(nodes).select("id")
    callers = edges.filter(F.col("kind").isin(INVOKE)).join(own.withColumnRenamed("id", "src"), "src", "left_semi")
    fan_in = callers.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    surface = public_fan_in(nodes, edges, degree).filter("public_fan_in > 0")
    seeds = materialize(own.join(surface, "id").join(fan_in, "id", "left").fillna(0, ["fan_in"]), "seeds")
    far = files_reached(seeds, nodes, edges, budget=REACH_NODES)
    joined = materialize(seeds.join(far.withColumnRenamed("seed", "id"), "id", "left").fillna(0, ["files"]), "load")
    most = joined.agg(F.greatest(F.lit(1), F.max("files")).alias("f"), F.greatest(F.lit(1), F.max("fan_in")).alias("e"))
    raw = joined.crossJoin(F.broadcast(most)).select(  # one row
        "id", (F.log2(1 + F.col("public_fan_in")) * F.greatest(F.col("files") / F.col("f"), F.col("fan_in") / F.col("e"))).alias("raw")
    )
    top = raw.agg(F.max("raw").alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.round(100 * F.col("raw") / F.col("top"), 4)).otherwise(0.0).alias("centrality"))


def seed_candidates(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """The nodes that a tour may begin at: with a place, of production code, no closures, and data only if it runs something."""
    own = nodes.filter(F.col("kind").isin(SEED_KINDS) & ~F.col("external") & ~F.col("ignored") & F.col("line").isNotNull() & ~is_support_path(F.col("file")))
    if "closure" in nodes.columns:
        own = own.filter(~F.coalesce("closure", F.lit(False)))
    runs = degree.filter("out_exec > 0").select("id").withColumn("__runs", F.lit(True))
    return own.join(runs, "id", "left").filter(~F.col("kind").isin(DATA_KINDS) | F.col("__runs")).drop("__runs")


def query_terms(texts: list[str], project: str = "") -> list[str]:
    """The words of the names that a caller gave: over two letters, none that the project's own name holds, each once."""
    words = [w for text in texts for w in query_words(text) if len(w) > 2 and w not in project.lower()]
    return list(dict.fromkeys(words))


def seed_scores(nodes: DataFrame, central: DataFrame, terms: list[str]) -> DataFrame:
    """``id``, ``name``, ``file``, ``score``, ``terms`` of the declarations a tour could begin at."""
    array = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    full = F.coalesce("qualified_name", "name")
    words = F.concat(subwords(F.col("name")), subwords(F.coalesce("qualified_name", F.lit(""))))
    own = nodes.join(central, "id", "left").fillna(0.0, ["centrality"]).withColumn("terms", matched_terms(words, array))
    match = 8.0 * F.size("terms") + 2.0 * F.size(matched_terms(subwords(F.col("file")), array))
    align = F.when(match >= 24, 1.45).when(match >= 8, 1.15).otherwise(0.45) if terms else F.lit(1.0)
    damp = F.when(is_private_like(full), 0.25).otherwise(1.0)
    return own.select("id", "name", "file", "terms", F.round((F.col("centrality") + match) * align * damp, 6).alias("score")).filter("score > 0")


def pick_diverse(scored: DataFrame, limit: int = 5, terms: list[str] | None = None) -> list[str]:
    """Greedy choice: newly covered terms first, then score; none that restates a chosen one.

    A name restates another of its file if the stems of one are the beginning of
    the other's. Without ``terms`` (by default all that anything matches) the
    choice is the order of scores alone.

    The choice is sequential by nature: each step is a look through all
    candidates that are left, of which one row comes to the driver.
    """
    if terms is not None and not terms:
        return [r["id"] for r in scored.orderBy(F.desc("score"), "id").limit(limit).collect()]
    stems = F.transform(subwords(F.col("name")), stem_word)
    left = materialize(scored.select("id", "file", "terms", "score", stems.alias("stems")), "candidates")
    chosen, covered = [], set()
    while len(chosen) < limit:
        new = F.size(F.array_except("terms", F.array(*map(F.lit, sorted(covered))).cast("array<string>")))
        best = left.orderBy(F.desc(120 * new + F.col("score")), F.desc("score"), "id").first()
        if best is None:
            break
        chosen.append(best["id"])
        covered |= set(best["terms"])
        own = F.array(*map(F.lit, best["stems"])).cast("array<string>")
        n = F.least(F.size("stems"), F.lit(len(best["stems"])))
        restates = (F.col("file") == best["file"]) & (n > 0) & (F.slice("stems", 1, n) == F.slice(own, 1, n))
        left = left.filter((F.col("id") != best["id"]) & ~F.coalesce(restates, F.lit(False)))
    return chosen


def mix_seeds(mentioned: list[str], hits: list[str], named: list[str], central: list[str], explicit: bool, allowed: set[str], limit: int) -> list[str]:
    """The seeds of a tour: what the question mentions, what it spells out, a share of what the caller named, then what is central.

    Only those in ``allowed`` are taken; without any, the hits are tried.
    """
    share = int(limit * NAMED_SHARE)
    order = [*mentioned, *(hits if explicit else []), *named[:share], *central]
    seeds = list(dict.fromkeys(i for i in order if i in allowed)) or list(dict.fromkeys(i for i in hits if i in allowed))
    return seeds[:limit]


def tells_anew(landed: set[str], told: list[set[str]]) -> bool:
    """Whether a flow lands elsewhere than each told one, by the share of the smaller of the two."""
    return bool(landed) and all(o and len(landed & o) / min(len(landed), len(o)) < OVERLAP for o in told)


def flow_hops(hops: list[tuple], hidden: set[str]) -> list[tuple]:
    """The hops of a flow that a tour shows: not structural, no end that is hidden, and none into a shared utility (also hidden as an end)."""
    return [h for h in hops if h[2] not in STRUCTURAL and h[0] not in hidden and h[1] not in hidden]


def nearby(seeds: list[str], tables: list[DataFrame], limit: int = 10) -> list[str]:
    """Neighbours of the seeds in turn: the first of each, then the second of each, and so on."""
    out: dict[str, None] = {}
    by = {s: [] for s in seeds}
    for t in tables:
        for r in t.filter(F.col("id").isin(seeds)).orderBy("id", "r").collect():
            by[r["id"]].append(r["other"])
    for i in range(max(map(len, by.values()), default=0)):
        for s in seeds:
            if i < len(by[s]) and by[s][i] not in seeds:
                out.setdefault(by[s][i])
    return list(out)[:limit]


def test_anchors(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """``seed``, ``id``, ``kind``, ``near`` of what test files hold of edges to the seeds, of each seed the nearest by path first."""
    n = nodes.select("id", "file")
    own = seeds.select(F.col("id").alias("dst")).distinct().join(n.withColumnRenamed("id", "dst"), "dst")
    tests = nodes.filter(is_test_path(F.col("file"))).select(F.col("id").alias("src"), F.col("file").alias("test"))
    joined = edges.join(own, "dst").join(tests, "src")
    near = joined.select(F.col("dst").alias("seed"), F.col("src").alias("id"), "kind", shared_path_depth(F.col("file"), F.col("test")).alias("near")).distinct()
    order = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("near"), "id", "kind"))
    return near.withColumn("r", order).filter(F.col("r") <= limit).drop("r")


def unique_anchors(anchors: list[dict], limit: int = 14) -> list[dict]:
    """Anchors in order, one of each file, line, name and reason."""
    by = {(a.get("file"), a.get("line"), a.get("name"), a.get("reason")): a for a in reversed(anchors)}
    first = {id(a) for a in by.values()}
    return [a for a in anchors if id(a) in first][:limit]


def invocation_sites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``sites``: at how many places each node invokes production code other than itself.

    Edges of one kind at one place are one site; an edge without a place is one for each target.
    """
    own = _production(nodes).select(F.col("id").alias("dst"))
    e = edges.filter(F.col("kind").isin(INVOKE) & (F.col("src") != F.col("dst"))).join(own, "dst", "left_semi")
    column = F.coalesce(F.col("col") if "col" in edges.columns else F.lit(None).cast("int"), F.lit(0))
    site = F.struct("kind", "line", F.when(F.col("line").isNull(), F.col("dst")).alias("to"), F.when(F.col("line").isNotNull(), column).alias("col"))
    return e.groupBy(F.col("src").alias("id")).agg(F.count_distinct(site).alias("sites"))


__all__ = ["centrality", "files_reached", "invocation_sites", "mix_seeds", "nearby", "pick_diverse", "public_fan_in", "query_terms", "seed_candidates", "seed_scores", "test_anchors", "unique_anchors"]
