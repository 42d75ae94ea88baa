"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's fingerprints are the smallest hashes of its ``GRAM``-word runs in every
window of ``span - GRAM + 1`` such runs.  A span of ``span`` words that a
document and an item share holds one such window in both, so they share its
fingerprint: no shared span of that length is missed.  Fingerprints of both
sides are joined, and each document that meets an item is extended: the shared
runs give the offsets at which item and document are laid over each other, and
along each offset the words are compared.

Items shorter than ``span`` words are one window as a whole and have no
fingerprint of that length; for each such length that the benchmark has, the
document's runs of that length are hashed and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import let, materialize, text_key, words_of

GRAM = 4
#: Up to this many fingerprints of the benchmark (40 bytes each), and words of its items, are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS, BROADCAST_WORDS = 500_000, 1_000_000


def _later(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _gram_hashes(words: Column) -> Column:
    """Hashes of all runs of GRAM (4) words, by doubling; null entries stand for runs past the end."""
    pair = lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))
    twos = lambda w: F.zip_with(w, _later(w, 1), pair)
    fours = lambda t: F.zip_with(t, _later(t, 2), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), twos), fours)


def fingerprints(words: Column, span: int) -> Column:
    """The distinct winnowed hashes of an array of words; empty below ``span`` words."""
    width = span - GRAM + 1

    def smaller(step: int) -> Callable[[Column], Column]:
        return lambda o: F.zip_with(o, _later(o, step), lambda a, b: F.when(b < a, b).otherwise(a))

    def minima(grams: Column) -> Column:
        out, have = grams, 1
        while have < width:
            step = min(have, width - have)
            out = let(out, smaller(step))
            have += step
        return out

    grams = let(_gram_hashes(words), lambda g: F.slice(g, 1, F.greatest(F.size(g) - (GRAM - 1), F.lit(0))))
    lowest = let(let(grams, minima), lambda m: F.slice(m, 1, F.greatest(F.size(m) - (width - 1), F.lit(0))))
    return F.array_distinct(lowest)


def _runs(words: Column, n: int) -> Column:
    """The distinct hashes of all runs of n words."""
    return let(
        words,
        lambda w: F.array_distinct(
            F.when(
                F.size(w) >= n,
                F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])),
            ).otherwise(F.array().cast("array<bigint>"))
        ),
    )


def _up_to(last: Column) -> Column:
    """0, 1, ... last; empty for a negative last."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _offsets(doc: Column, grams: Column, item: Column) -> Column:
    """Where word 0 of an item lies in the document for each of their shared runs."""
    words, shared = item["__words"], item["__shared"]
    by_grams = F.flatten(
        F.transform(
            shared,
            lambda s: F.transform(
                F.filter(F.transform(grams, lambda g, i: F.when(g == s["__value"], i)), lambda i: i.isNotNull()),
                lambda i: i - s["__at"],
            ),
        )
    )
    by_first_word = F.filter(F.transform(doc, lambda w, i: F.when(w == F.get(words, F.lit(0)), i)), lambda i: i.isNotNull())
    return F.array_distinct(F.when(item["__long"], by_grams).otherwise(by_first_word))


def _extended(doc: Column, offsets: Column, words: Column, span: int) -> Column:
    """The document's words inside windows of the item that occur at these offsets."""
    n = F.least(F.size(words), F.lit(span))

    def along(d: Column) -> Column:
        starts = F.filter(
            _up_to(F.size(words) - n),
            lambda j: (d + j >= 0) & (F.slice(doc, F.greatest(d + j, F.lit(0)) + 1, n) == F.slice(words, j + 1, n)),
        )
        return F.flatten(F.transform(starts, lambda j: F.sequence(d + j, d + j + n - 1)))

    return F.array_distinct(F.flatten(F.transform(offsets, along)))


def scan_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Which words of each document lie in spans of ``span`` words shared with the benchmark.

    Returns a row for each row of ``docs``: the id, ``n_words``, ``hits`` (an
    array of item id and the positions of the document's words, counted from 0,
    inside occurrences of that item's windows, for items that occur) and the two
    columns of ``text_key``.  Other columns of either table are not read.

    * Null and empty texts have no words and no hits; items without words never
      occur; items of fewer than ``span`` words are one window.
    * An item id that is there twice, or null, is one item with the windows of
      all its rows.
    * Rows of ``docs`` that are equal get equal results.
    * Empty tables on either side give no hits.
    * A text of any length is read whole; a task holds its words and their hashes.
      Items that tie in every way are all reported.
    """
    if span < GRAM:
        raise ValueError(f"span is at least {GRAM}")
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    items = (
        benchmark.select(F.col(f"`{item_col}`").alias("__item"), words_of(F.col(f"`{item_text_col}`")).alias("__words"))
        .distinct()
        .filter(F.size("__words") > 0)
    )
    # Of equal rows one is left, so two hashes of a row tell items apart.
    named = [F.xxhash64("__item", "__words").alias("__row"), F.hash("__words").alias("__row2")]
    items = materialize(items.select(*named, "__item", "__words", (F.size("__words") >= span).alias("__long")), "items")
    lengths = sorted(r[0] for r in items.filter(~F.col("__long")).select(F.size("__words")).distinct().collect())
    long_prints = (
        items.filter("__long")
        .select("*", fingerprints(F.col("__words"), span).alias("__prints"), _gram_hashes(F.col("__words")).alias("__grams"))
        .select("__row", "__row2", "__prints", F.posexplode("__grams").alias("__at", "__value"))
        .filter(F.array_contains("__prints", F.col("__value")))
        .select("__row", "__row2", "__at", "__value")
    )
    prints = long_prints
    for n in lengths:
        prints = prints.unionByName(
            items.filter(~F.col("__long") & (F.size("__words") == n)).select(
                "__row", "__row2", F.lit(0).alias("__at"), F.get(_runs(F.col("__words"), n), F.lit(0)).alias("__value")
            )
        )
    prints = materialize(prints, "prints")
    values = prints.select("__value").distinct()
    if prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        values, prints = F.broadcast(values), F.broadcast(prints)
    told = items.agg(F.sum(F.size("__words") + 8)).first()[0] or 0
    texts = F.broadcast(items) if told <= BROADCAST_WORDS else items

    every = docs.select(*text_key(id_, text), id_.alias("__id"), text.alias("__text"))

    def marks(words: Column) -> Column:
        own = fingerprints(words, span)
        for n in lengths:
            own = F.concat(own, _runs(words, n))
        return F.struct(F.size(words).cast("long").alias("n"), own.alias("p"))

    # One scan: a row for each fingerprint that the benchmark has, and one for the document itself.
    seen = (
        every.select("__key_id", "__key_text", "__id", let(words_of(F.col("__text")), marks).alias("__m"))
        .select(
            "__key_id",
            "__key_text",
            "__id",
            F.col("__m.n").alias("__n"),
            F.explode(F.array_append(F.col("__m.p"), F.lit(None).cast("bigint"))).alias("__value"),
        )
        .join(values.withColumn("__known", F.lit(True)), "__value", "left")
        .filter(F.col("__value").isNull() | F.col("__known"))
        .drop("__known")
    )
    seen = materialize(seen, "seen")
    shared = (
        seen.filter(F.col("__value").isNotNull())
        .select("__key_id", "__key_text", "__value")
        .distinct()
        .join(prints, "__value")
        .groupBy("__key_id", "__key_text", "__row", "__row2")
        .agg(F.collect_set(F.struct("__value", "__at")).alias("__shared"))
        .join(texts, ["__row", "__row2"])
        .groupBy("__key_id", "__key_text")
        .agg(F.collect_list(F.struct("__item", "__words", "__long", "__shared")).alias("__items"))
    )
    met = every.join(shared.hint("shuffle_hash"), ["__key_id", "__key_text"])

    def extended(row: Column) -> Column:
        doc, grams = row["w"], row["g"]
        each = F.transform(
            row["items"],
            lambda item: F.struct(
                item["__item"].alias("item"),
                let(_offsets(doc, grams, item), lambda o: _extended(doc, o, item["__words"], span)).alias("at"),
            ),
        )
        return F.filter(each, lambda x: F.size(x["at"]) > 0)

    bound = let(
        words_of(F.col("__text")),
        lambda w: F.struct(w.alias("w"), _gram_hashes(w).alias("g"), F.col("__items").alias("items")),
    )
    hits = met.select("__key_id", "__key_text", let(bound, extended).alias("hits")).filter(F.size("hits") > 0)
    hits = hits.groupBy("__key_id", "__key_text").agg(F.first("hits").alias("hits"))
    none = F.array().cast(hits.schema["hits"].dataType)
    return (
        seen.filter(F.col("__value").isNull())
        .join(hits, ["__key_id", "__key_text"], "left")
        .select(F.col("__id").alias(id_col), F.col("__n").alias("n_words"), F.coalesce("hits", none).alias("hits"), "__key_id", "__key_text")
    )


def hit_words(hits: Column) -> Column:
    """How many of a document's words are hit, whatever the item."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["at"])))).cast("long")


def hit_items(hits: Column) -> Column:
    """The ids of the items that occur, as sorted strings."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item"].cast("string"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, span: int = 8, **names: str) -> DataFrame:
    """The documents in which windows of fewer than ``min_items`` items occur, all columns as they were."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    found = scan_contamination(docs, benchmark, span, **names)
    bad = found.filter(F.size(hit_items(F.col("hits"))) >= min_items).select("__key_id", "__key_text").distinct()
    key = text_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keyed = docs.withColumns({c: k for c, k in zip(("__key_id", "__key_text"), key, strict=True)})
    return keyed.join(bad.hint("shuffle_hash"), ["__key_id", "__key_text"], "left_anti").select(*docs.columns)
