"""Line deduplication: lines that many documents share are dropped everywhere.

Built from DataFrame functions alone.  Lines are exploded, their normalised
text is hashed, documents are counted per hash, and the positions to drop come
back to each document, which is then put together again in line order.

Only hashes and positions are shuffled with the lines.  The text itself moves
once, to meet its list of dropped positions.  A line that every document holds
is counted through a distinct (line, document) step first, so its rows are dealt
over all tasks, and the count that follows is combined before it is shuffled.
Lines that many documents hold are known by then: the fewer than HOT_KEYS keys
that hold more than their share of rows are told to all tasks, and only the
others are dealt by their key when lines meet what is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import BLANK, ascii_lower, hot_keys, join_spread, let, materialize, text_key


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents.

    Returns all columns of ``docs`` with the remaining text, and ``n_lines``
    (before dropping) and ``n_dropped``; columns of these names are replaced.

    * Null or empty text is one empty line; a text of which no line stays is
      empty.
    * Keys shorter than ``min_chars`` code points are never dropped.
    * A document is a distinct (id, text): a row that is there twice counts
      once, and both rows get the same result.  Ids may be null.
    * An empty table gives an empty table.  Columns may have any names but those
      two and names that begin with two underscores; they are passed on.
    * A text of any length is split as a whole: a task holds its lines.
    """
    docs = docs.drop("n_lines", "n_dropped")
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = text_key(id_, text)
    lines = docs.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("__pos", "__line"))
    keyed = lines.select("__key_id", "__key_text", "__pos", line_key(F.col("__line")).alias("__line"))
    keyed = keyed.filter(F.length("__line") >= min_chars).select(
        "__key_id", "__key_text", "__pos", F.xxhash64("__line").alias("__h1"), F.hash("__line").alias("__h2")
    )
    common = (
        keyed.select("__h1", "__h2", "__key_id", "__key_text")
        .distinct()
        .groupBy("__h1", "__h2")
        .agg(F.count("*").alias("__n"))
        .filter(F.col("__n") >= min_docs)
    )
    common = materialize(common, "common")
    dropped = (
        join_spread(keyed, common, hot_keys(common, "__n"), ["__h1", "__h2"])
        .filter(F.col("__n").isNotNull())
        .groupBy("__key_id", "__key_text")
        .agg(F.collect_set("__pos").alias("__drop"))
    )
    joined = docs.withColumns({c: k for c, k in zip(("__key_id", "__key_text"), key, strict=True)}).join(
        dropped.hint("shuffle_hash"), ["__key_id", "__key_text"], "left"
    )
    joined = joined.withColumn("__lines", F.split(F.coalesce(text, F.lit("")), "\n", -1))
    n_dropped = F.coalesce(F.size(F.coalesce("__drop", F.array().cast("array<int>"))), F.lit(0))

    def without(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return joined.select(
        *[
            F.when(F.col("__drop").isNull(), F.coalesce(text, F.lit("")))
            .otherwise(let(F.col("__lines"), without))
            .alias(text_col)
            if c == text_col
            else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.size("__lines").cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )
