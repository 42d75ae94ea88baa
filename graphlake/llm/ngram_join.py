"""Exact Jaccard self-join of documents on word shingles, with a count-vector R-tree.

1. Each document becomes the set of its hashed shingles. Documents with equal
   sets are one from here on, whatever their number.
2. Sets are dealt into groups such that no link runs between two groups. Shingles
   are ordered globally, rare before frequent; two sets that link share one of
   the first n - ceil(t n) + 1 shingles of either. Where few sets share such a
   shingle their pairs are counted, and pairs whose count shows that the rest
   cannot make up a link are dropped; where many do, they are chained, which
   takes as many rows as there are sets. What is connected is a group.
3. In a group, each set is a point: its shingles are hashed to 64 coordinates,
   which hold how many fall on each. Points are packed into an R-tree. Two sets
   share at most the sum of their coordinates' minima, and two nodes at most that
   of their upper corners, so pairs of nodes, then of points, under the
   overlap that a link takes are never compared. What survives is verified on
   the sets. Large groups are cut into blocks, and a task joins two blocks.
4. Links and equal sets give the components.

Frequent shingles only decide the order, so that a passage that a third of the
documents hold comes last in all of them and brings no two of them together; the
table of them is cut at a fixed number, which changes the order and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import bound_batches, materialize, text_key
from graphlake.llm.components import connected_components
from graphlake.llm.shingles import forget, shingle_set

#: Frequent shingles that are told to all tasks at most (16 bytes each).
FREQUENT = 300_000
#: Sets that share a rare shingle are paired up to this number, and chained above.
PAIRED = 256
#: Shingles counted at once in a task.
COUNTED = 3_000_000
DIMS = 64
LEAF = 32
#: Sets and shingles that one side of a task of the join holds at most.
BLOCK_SETS, BLOCK_SHINGLES = 4_000, 4_000_000
#: Representatives are broadcast up to this number of rows (72 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 250_000


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m at which 100 * overlap >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first shingles meet those of any set it links with."""
    return n - (-((-percent * n) // 100)) + 1


def _set_id(own: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64)))


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches and the shingle sets of their last column."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part, [shingle_set(t, width) for t in part[part.num_columns - 1].cast(pa.binary()).to_pylist()]
    finally:
        forget()


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names.split())


class Forest:
    """Union-find over any hashable names."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _sets_and_counts(width: int):
    """Rows of kind 0: a document's keys, id, set id and size; of kind 1: a shingle and how many sets of the task hold it."""
    names = "kind key_id key_text doc_id has_id sid n"

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count > 1
            token, count = token[keep].astype(np.int64), count[keep]
            zero = np.zeros(len(token))
            yield _batch(names, zero + 1, zero, zero, zero, zero, token, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [], 0, set()
        for part, sets in _read(batches, width):
            sids = [_set_id(s) for s in sets]
            keys = [part[i].to_numpy(zero_copy_only=False) for i in range(2)]
            has = part[2].is_valid().to_numpy(zero_copy_only=False)
            ids = part[2].fill_null(0).to_numpy(zero_copy_only=False)
            yield _batch(names, np.zeros(len(sets)), *keys, ids, has, sids, [len(s) for s in sets])
            for sid, s in zip(sids, sets, strict=True):
                if sid not in seen:
                    seen.add(sid)
                    held.append(s)
                    n_held += len(s)
            if n_held > COUNTED:
                yield from counted(held)
                held, n_held, seen = [], 0, set()
        yield from counted(held)

    return run, ", ".join(f"{c} long" for c in names.split())


def _prefixes(width: int, percent: int, frequent):
    """Rows of kind 0: shingle, set id, size; kind 1: the same of a frequent shingle, once a task; kind 2: two sets to chain."""
    names = "kind token sid n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value
        last: dict[int, int] = {}
        done: set[int] = set()
        forest = Forest()
        for _, sets in _read(batches, width):
            rare, sid_of, n_of, more = [], [], [], []
            for own in sets:
                if not len(own) or (sid := _set_id(own)) in done:
                    continue
                done.add(sid)
                n = len(own)
                first = int(prefix_length(np.int64(n), percent))
                head, tail = own, own[:0]
                if len(known):
                    at = np.searchsorted(known, own)
                    at[at == len(known)] = 0
                    hit = known[at] == own
                    head = own[~hit]
                    if len(head) < first:
                        tail, count = own[hit], often[at[hit]]
                        tail = tail[np.lexsort((tail, count))][: first - len(head)]
                head = head[:first]
                rare.append(head)
                sid_of.append(np.full(len(head), sid))
                n_of.append(np.full(len(head), n))
                for token in tail.astype(np.int64).tolist():
                    if token in last:
                        if forest.join(last[token], sid):
                            more.append((2, last[token], sid, 0))
                    else:
                        more.append((1, token, sid, n))
                        last[token] = sid
            if rare:
                head = np.concatenate(rare).astype(np.int64)
                yield _batch(names, np.zeros(len(head)), head, np.concatenate(sid_of), np.concatenate(n_of))
            if more:
                yield _batch(names, *zip(*more, strict=True))

    return run, ", ".join(f"{c} long" for c in names.split())


def _paired(percent: int):
    """From rows sorted by shingle and set: pairs of sets (kind 0, with sizes), and chained sets (kind 2)."""
    names = "kind a b na nb"

    def pairs(sid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j = np.triu_indices(len(sid), 1)
        ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[ok], j[ok]
        return sid[i], sid[j], n[i], n[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((4, 0), np.int64)  # the rows of the last shingle, which may go on

        def flush(block: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            ready, size, chain = [], 0, []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                kind, _, sid, n = block[:, lo:hi]
                new = np.append(True, sid[1:] != sid[:-1])
                kind, sid, n = kind[new], sid[new], n[new]
                if len(sid) < 2:
                    continue
                if len(sid) > PAIRED or kind.max():
                    chain.append((sid[:-1], sid[1:]))
                else:
                    ready.append(pairs(sid, n))
                    size += len(ready[-1][0])
                if size > 200_000:
                    cols = [np.concatenate(c) for c in zip(*ready, strict=True)]
                    yield _batch(names, np.zeros(len(cols[0])), *cols)
                    ready, size = [], 0
            if ready:
                cols = [np.concatenate(c) for c in zip(*ready, strict=True)]
                yield _batch(names, np.zeros(len(cols[0])), *cols)
            if chain:
                a, b = (np.concatenate(c) for c in zip(*chain, strict=True))
                yield _batch(names, np.full(len(a), 2), a, b, np.zeros(len(a)), np.zeros(len(a)))

        for batch in batches:
            block = np.vstack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            block = np.hstack([rest, block])
            if not block.shape[1]:
                continue
            token = block[1]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            yield from flush(block, starts)
            rest = block[:, starts[-1] :]
            if rest.shape[1] > 4 * PAIRED:  # a long run: chain what is here and go on from its last set
                a, b = rest[2, :-1], rest[2, 1:]
                yield _batch(names, np.full(len(a), 2), a, b, np.zeros(len(a)), np.zeros(len(a)))
                rest = rest[:, -1:].copy()
                rest[0] = 1
        if rest.shape[1]:
            yield from flush(rest, np.array([0, rest.shape[1]]))

    return run, ", ".join(f"{c} long" for c in names.split())


class RTree:
    """A packed R-tree over count vectors; nodes are ranges of points, leaf level first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        spread = points.std(0).argsort()[::-1]
        slabs = max(1, round(np.sqrt(len(points) / LEAF)))
        by_size = np.argsort(sizes, kind="stable")
        order = [slab[np.lexsort((points[slab, spread[1 % DIMS]], points[slab, spread[0]]))] for slab in np.array_split(by_size, slabs)]
        self.order = np.concatenate(order)
        self.points, self.sizes = points[self.order], sizes[self.order]
        bounds = np.append(np.arange(0, len(points), LEAF), len(points))
        self.levels = [self._level(bounds, self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > 2:
            bounds, high, least, most = self.levels[-1]
            every = np.append(np.arange(0, len(bounds) - 1, 8), len(bounds) - 1)
            _, high, least, most = self._level(every, high, least, most)
            self.levels.append((every, high, least, most))

    @staticmethod
    def _level(bounds: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple:
        at = bounds[:-1]
        return bounds, np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)


def _possible(high_a, least_a, most_a, high_b, least_b, most_b, percent: int) -> np.ndarray:
    """Which nodes (or points) of two lists can hold a link: by the sum of coordinate minima, and by size."""
    shared = np.minimum(high_a[:, None, :], high_b[None, :, :]).sum(-1, dtype=np.int64)
    enough = shared >= required(least_a[:, None], least_b[None, :], percent)
    return enough & (100 * most_a[:, None] >= percent * least_b[None, :]) & (100 * most_b[None, :] >= percent * least_a[:, None])


def tree_links(sids: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that links connect; with ``side``, links between its two values only.

    Nodes whose sets are all in one component already are not opened.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([np.bincount((s % np.uint64(DIMS)).astype(np.int64), minlength=DIMS) for s in sets]).astype(np.int32)
    tree = RTree(points, sizes)
    order = tree.order
    _, compact = np.unique(np.concatenate(sets), return_inverse=True)
    compact = np.split(compact, np.cumsum(sizes)[:-1])
    forest, out = Forest(), []
    roots = np.arange(len(sets))

    def leaf_pair(i: int, j: int) -> None:
        bounds = tree.levels[0][0]
        a, b = np.arange(bounds[i], bounds[i + 1]), np.arange(bounds[j], bounds[j + 1])
        ok = _possible(tree.points[a], tree.sizes[a], tree.sizes[a], tree.points[b], tree.sizes[b], tree.sizes[b], percent)
        a, b = order[a], order[b]
        if i == j:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        if side is not None:
            ok &= side[a][:, None] != side[b][None, :]
        ok &= roots[a][:, None] != roots[b][None, :]
        x, y = np.nonzero(ok)
        if not len(x):
            return
        ua, ub = np.unique(x), np.unique(y)
        if len(x) > 24:  # overlaps of all survivors at once
            ids = np.concatenate([compact[k] for k in a[ua]] + [compact[k] for k in b[ub]])
            names, inverse = np.unique(ids, return_inverse=True)
            lengths = np.concatenate([sizes[a[ua]], sizes[b[ub]]])
            rows = np.repeat(np.arange(len(lengths)), lengths)
            shared = np.zeros((len(ua), len(ub)), np.int64)
            for lo in range(0, len(names), 20_000):
                use = (inverse >= lo) & (inverse < lo + 20_000)
                dense = np.zeros((len(lengths), min(20_000, len(names) - lo)), np.float32)
                dense[rows[use], inverse[use] - lo] = 1
                shared += np.rint(dense[: len(ua)] @ dense[len(ua) :].T).astype(np.int64)
            overlap = shared[np.searchsorted(ua, x), np.searchsorted(ub, y)]
        else:
            overlap = np.array([len(np.intersect1d(compact[a[p]], compact[b[q]], assume_unique=True)) for p, q in zip(x, y, strict=True)])
        linked = overlap >= required(sizes[a[x]], sizes[b[y]], percent)
        changed = False
        for p, q in zip(a[x[linked]].tolist(), b[y[linked]].tolist(), strict=True):
            if forest.join(p, q):
                out.append((int(sids[p]), int(sids[q])))
                changed = True
        if changed:
            for k in {*a.tolist(), *b.tolist()}:
                roots[k] = forest.root(k)

    def visit(level: int, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        bounds, high, least, most = tree.levels[level]
        ok = _possible(high[left], least[left], most[left], high[right], least[right], most[right], percent)
        for p, q in zip(*np.nonzero(ok), strict=True):
            i, j = int(left[p]), int(right[q])
            if same and i > j:
                continue
            if level:
                visit(level - 1, np.arange(bounds[i], bounds[i + 1]), np.arange(bounds[j], bounds[j + 1]), i == j)
            else:
                leaf_pair(i, j)

    top = len(tree.levels) - 1
    every = np.arange(len(tree.levels[top][1]))
    visit(top, every, every, True)
    return out


def _joined(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, group in part.groupby("grp", sort=True):
            group = group.sort_values("sid", kind="stable")
            if len(group) > 1:
                sets = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
                side = group["side"].to_numpy() if part["cross"].iloc[0] else None
                out += tree_links(group["sid"].to_numpy(), sets, percent, side)
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return run


def shingle_components(
    docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns a row for each row of ``docs``: the id, ``n_shingles`` (the set's
    size), ``component_id`` (the smallest id reachable), ``component`` (a long
    that names the component) and the columns of ``text_key``.

    * Null or empty text, and text without words, has no shingles and is in a
      component of its own.
    * Null ids are allowed: they take part, and a component of none but null ids
      has a null ``component_id``. Repeated rows are exact copies.
    * Other columns are not read, whatever their names.  An empty table gives an
      empty table.
    * A text of any length is one set; a task holds the texts of 1,000 rows, and
      those of the sets that it joins.  No order among equals is used.

    Sets are told apart by 64-bit hashes of shingles and of sets.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    read = docs.select(*text_key(id_, text), id_.alias("doc_id"), text.alias("text"))
    run, schema = _sets_and_counts(width)
    first = materialize(read.mapInArrow(run, schema), "sets")
    meta = first.filter("kind = 0").drop("kind")
    often = (
        first.filter("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).filter("n >= 16").orderBy(F.desc("n"), "sid").limit(FREQUENT).toArrow()
    )
    token = often["sid"].to_numpy().astype(np.uint64)
    order = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[order], often["n"].to_numpy()[order]))

    run, schema = _prefixes(width, percent, frequent)
    heads = docs.select(text.alias("text")).mapInArrow(run, schema)
    run, schema = _paired(percent)
    found = materialize(_pair_rows(heads, run, schema), "pairs")
    shared = (
        found.filter("kind = 0")
        .groupBy("a", "b")
        .agg(F.count("*").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    )
    beyond = lambda n: F.floor(n - (n - F.ceil(n * percent / 100) + 1))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    likely = shared.filter(F.col("c") + F.greatest(beyond(F.col("na")), beyond(F.col("nb"))) >= need)
    edges = likely.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(found.filter("kind = 2").select("a", "b"))
    groups = connected_components(edges).withColumnRenamed("node", "sid").withColumnRenamed("component", "grp")

    # The sets of the groups' members, read again from one document of each.
    of_set = meta.filter("n > 0").groupBy("sid").agg(F.min(F.struct("key_id", "key_text")).alias("k"), F.max("n").alias("n"))
    members = materialize(groups.join(of_set, "sid").select("sid", "grp", "n", "k.key_id", "k.key_text"), "members")
    totals = members.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    all_ = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
    bundles = max(spark.sparkContext.defaultParallelism * 2, all_["n"] // (BLOCK_SHINGLES // 4), all_["c"] // max(1, BLOCK_SETS // 4))
    members = members.join(totals.select("grp", blocks.alias("blocks")), "grp").select(
        F.col("key_id").alias("__key_id"), F.col("key_text").alias("__key_text"), "sid", "grp", "blocks"
    )
    if all_["c"] <= BROADCAST_ROWS:
        members = F.broadcast(members)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _read(batches, width):
            yield pa.RecordBatch.from_arrays(
                [part[0], part[1], part[2], pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "grp", "blocks", "tokens"]
            )

    keyed = docs.select(*text_key(id_, text), text.alias("text")).join(members, ["__key_id", "__key_text"])
    sets = keyed.select("sid", "grp", "blocks", "text").mapInArrow(tokens, "sid long, grp long, blocks int, tokens binary")
    side = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    units = (
        sets.withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "sid",
            "grp",
            "tokens",
            "side",
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(bundles))).otherwise(F.xxhash64("grp")).alias("unit"),
            F.when(F.col("blocks") == 1, -1).otherwise(F.least("side", "other")).alias("i"),
            F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("side", "other")).alias("j"),
        )
        .withColumn("cross", F.col("i") != F.col("j"))
    )
    links = units.groupBy("unit", "i", "j").applyInPandas(_joined(percent), "src long, dst long")
    linked = connected_components(links).withColumnRenamed("node", "sid")

    # Of each set the smallest id, of each component the smallest of its sets.
    real = F.when(F.col("has_id") == 1, F.col("doc_id"))
    least = meta.filter("n > 0").groupBy("sid").agg(F.min(real).alias("least"))
    least = materialize(least.join(linked, "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component")), "least")
    of_component = least.groupBy("component").agg(F.min("least").alias("component_id"))
    least = least.join(of_component, "component").select("sid", "component", "component_id")
    return (
        meta.join(least, "sid", "left")
        .withColumn("__none", F.col("n") == 0)
        .select(
            real.alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("__none"), real).otherwise(F.col("component_id")).alias("component_id"),
            F.when(~F.col("__none"), F.col("component")).alias("component"),
            F.col("key_id").alias("__key_id"),
            F.col("key_text").alias("__key_text"),
        )
    )


def _pair_rows(heads: DataFrame, run, schema: str) -> DataFrame:
    """Pairs and chains of sets from the rows of ``_prefixes``; those that are chained already pass through."""
    heads = materialize(heads, "heads")
    chained = heads.filter("kind = 2").select("kind", F.col("token").alias("a"), F.col("sid").alias("b"), F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"))
    dealt = heads.filter("kind < 2").repartition("token").sortWithinPartitions("token", "sid", "kind")
    return dealt.mapInArrow(run, schema).unionAll(chained)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; all columns as they were.

    Of repeated rows one stays.  Documents without shingles all stay, but for
    repeated rows.  Of different rows with one id the one with the smallest hash
    of its text stays.  Columns may have any names that do not begin with two
    underscores.  No rows give no rows; long texts are kept whole.
    """
    found = shingle_components(docs, width, percent, id_col, text_col)
    best = F.min(F.struct(F.col(f"`{id_col}`").isNull().alias("x"), F.col(f"`{id_col}`").alias("i"), "__key_id", "__key_text")).alias("best")
    grouped = found.filter(F.col("component").isNotNull()).groupBy("component").agg(best).select("best.__key_id", "best.__key_text")
    alone = found.filter(F.col("component").isNull()).select("__key_id", "__key_text")
    stay = grouped.unionAll(alone).distinct()
    key: list[Column] = text_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keyed = docs.withColumns({c: k for c, k in zip(("__key_id", "__key_text"), key, strict=True)})
    kept = keyed.join(stay.hint("shuffle_hash"), ["__key_id", "__key_text"], "left_semi")
    repeated = found.groupBy("__key_id", "__key_text").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["__key_id", "__key_text"])
    return kept.select(*docs.columns)
