"""Conversations in reply order, without the quotes that tie them together.

Lines that begin with ``>`` are quoted, once for each ``>``. Neighbouring lines
of one level are a passage; its text without marks, case and repeated blanks is
hashed and joined with the hashes of what messages say themselves: all of it,
every paragraph, and every run of lines. Runs are hashed only where a line begins
a passage of as many lines. A passage of level 1 ties a message to the one it
answers, deeper ones tie that one to what it answers.

Of the messages that say the same, each conversation's first and the first of
all stand for the rest, so a first turn that a third of all conversations share
joins one row, however often it is quoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphlake.llm.common import let, materialize
from graphlake.llm.components import connected_components

MARKS = r"^[\x20\t]*(>[\x20\t>]*)"


def normalised(text: Column) -> Column:
    """Lower case, with every run of blanks as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """The lines of a text that are not blank, normalised."""
    return F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda x: x != "")


def _runs(said: DataFrame, quotes: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``c0``, ``t0``: the runs of two lines or more of messages (``c0``, ``t0``, ``said``) that are quoted.

    Of equal messages one is looked through; a run is hashed where its first line
    and number of lines are those of a passage (``lines``).
    """
    wanted = quotes.filter(F.size("lines") > 1).select(F.xxhash64(F.get("lines", F.lit(0))).alias("f"), F.size("lines").alias("m")).distinct()
    key = [F.xxhash64("said").alias("k1"), F.hash("said").alias("k2")]
    texts = said.filter(F.contains("said", F.lit("\n"))).select(*key, "said", "c0", "t0")
    lines = texts.select("k1", "k2", _lines(F.col("said")).alias("lines"))
    firsts = lines.select("k1", "k2", F.size("lines").alias("n"), F.posexplode(F.transform("lines", lambda x: F.xxhash64(x))).alias("i", "f"))
    at = firsts.join(materialize(wanted, "wanted"), "f").filter(F.col("i") + F.col("m") <= F.col("n"))
    # Written, so that few texts to look through are known to be few and no other text is shuffled.
    at = materialize(at.groupBy("k1", "k2").agg(F.collect_set(F.struct("i", "m")).alias("at")), "starts")
    texts = texts.join(at.select("k1", "k2"), ["k1", "k2"], "left_semi")
    once = texts.groupBy("k1", "k2").agg(F.first("said").alias("said")).select("k1", "k2", _lines(F.col("said")).alias("lines"))
    hashed = lambda a: F.array_join(F.slice("lines", a["i"] + 1, a["m"]), " ")
    runs = once.join(at, ["k1", "k2"]).select("k1", "k2", F.explode(F.transform("at", hashed)).alias("n"))
    runs = runs.select("k1", "k2", F.xxhash64("n").alias("h1"), F.hash("n").alias("h2")).distinct()
    runs = runs.join(quotes.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    return texts.groupBy("k1", "k2", "c0").agg(F.min("t0").alias("t0")).join(runs, ["k1", "k2"]).select("h1", "h2", "c0", "t0")


def _implied(tied: DataFrame) -> DataFrame:
    """``c``, ``src``, ``dst``: of a conversation's messages, those that passages of level 2 and deeper show to answer another.

    The passage of one level less that follows (or else comes before) a passage
    is from the message that answers it.
    """
    known = tied.filter(F.col("c").isNotNull() & F.col("t").isNotNull() & (F.col("to.c") == F.col("c")))
    found = known.select("c", "t", "x", "place", "level", F.col("to.t").alias("at"))
    # Every passage as one that answers those a level deeper, and as one that is answered by those a level up; unknown ones answer, too.
    up = tied.filter("c IS NOT NULL AND t IS NOT NULL").select("c", "t", "x", "place", F.col("level").alias("g"), F.struct(F.when(F.col("to.c") == F.col("c"), F.col("to.t")).alias("at")).alias("up"), F.lit(None).cast(found.schema["at"].dataType).alias("at"))
    down = found.filter("level > 1").select("c", "t", "x", "place", (F.col("level") - 1).alias("g"), F.lit(None).cast(up.schema["up"].dataType).alias("up"), "at")
    by = W.partitionBy("c", "t", "x", "g").orderBy("place")
    after = F.first("up", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))
    before = F.last("up", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    pairs = up.unionByName(down).withColumn("by", F.coalesce(after, before)).filter("at IS NOT NULL")
    return pairs.select("c", F.col("by.at").alias("src"), F.col("at").alias("dst")).filter("dst < src")


def _passages(text: Column) -> Column:
    """Runs of neighbouring lines of one quote level, with the level and the text without marks; linear in the lines."""
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("text"),
    )
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line)
    begins = lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i)["level"] != F.get(own, i - 1)["level"]))

    def passages(own: Column, starts: Column) -> Column:
        def passage(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(own))
            return F.struct(F.get(own, start)["level"].alias("level"), F.transform(F.slice(own, start + 1, end - start), lambda x: x["text"]).alias("lines"))

        return F.transform(starts, passage)

    both = let(lines, lambda own: F.struct(own.alias("own"), begins(own).alias("starts")))
    return let(both, lambda x: passages(x["own"], x["starts"]))


def link_quotes(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """Messages without quotes, tied to the ones they quote.

    Returns all columns of ``messages``, ``text`` without quoted lines, and

    * ``reply_conv``, ``reply_turn``: the message that the first quoted passage
      of level 1 which is known comes from: the first message of the same
      conversation before this one that says it, else the first of all others;
      if there is none, the last message of the same conversation that deeper
      passages of other messages show it to answer; else null
    * ``n_quotes``, ``n_linked``: quoted passages, and those found anywhere
    * ``thread``: the smallest turn reachable by replies inside the conversation

    Rows are in reply order: by conversation, thread and turn, so a reply comes
    after what it answers.  Columns of these names are replaced.

    * Null text is empty; a message of quotes alone becomes empty.
    * Null conversations or turns are kept and tied to nothing.
    * Repeated rows are kept and tied alike.  An empty table gives an empty table.
    * Of several messages that say a passage alike, the first counts (see above).
    * A text of any length is parsed whole; part of a line links nothing.
    * Other columns are passed on, but for names that begin with two underscores.
    """
    made = ("reply_conv", "reply_turn", "n_quotes", "n_linked", "thread")
    conv, turn, text = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`"), F.col(f"`{text_col}`")
    own = messages.drop(*[m for m in made if m not in (conv_col, turn_col, text_col)])
    key = [conv.alias("c"), turn.alias("t"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("x")]
    # Only texts with a mark at the beginning of a line are parsed line by line.
    quoting = F.coalesce(F.rlike(text, F.lit(r"(?m)" + MARKS)), F.lit(False))
    parsed = own.filter(quoting).select(*key, F.posexplode(_passages(text)).alias("place", "p"))
    parsed = materialize(parsed.select("c", "t", "x", "place", "p.level", F.array_join("p.lines", "\n").alias("text")), "passages")
    bare = parsed.filter("level = 0").groupBy("c", "t", "x").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "\n").alias("bare"))
    quotes = (
        parsed.filter("level > 0")
        .withColumn("n", normalised(F.col("text")))
        .filter("n <> ''")
        .select("c", "t", "x", "place", "level", F.xxhash64("n").alias("h1"), F.hash("n").alias("h2"), _lines(F.col("text")).alias("lines"))
    )
    bare_text = F.when(quoting, F.coalesce("__bare", F.lit(""))).otherwise(F.coalesce(text, F.lit("")))
    keyed = own.withColumns({"__c": conv, "__t": turn, "__x": F.xxhash64(F.coalesce(text, F.lit("")))})
    keyed = keyed.join(
        bare.select(F.col("c").alias("__bc"), F.col("t").alias("__bt"), F.col("x").alias("__bx"), F.col("bare").alias("__bare")).distinct(),
        F.col("__c").eqNullSafe(F.col("__bc")) & F.col("__t").eqNullSafe(F.col("__bt")) & (F.col("__x") == F.col("__bx")),
        "left",
    ).withColumn("__said", bare_text)
    units = [F.split("__said", r"\n[\x20\t]*\n", -1), F.split("__said", "\n", -1), F.array("__said")]
    own_said = keyed.filter(F.col("__c").isNotNull() & F.col("__t").isNotNull()).select(F.col("__c").alias("c0"), F.col("__t").alias("t0"), F.col("__said").alias("said"), F.array_distinct(F.concat(*units)).alias("units"))
    said = (
        own_said.select("c0", "t0", F.explode("units").alias("p"))
        .withColumn("n", normalised(F.col("p")))
        .filter("n <> ''")
        .select(F.xxhash64("n").alias("h1"), F.hash("n").alias("h2"), "c0", "t0")
    )
    # Only what is quoted somewhere is of interest: quotes are few, and their distinct hashes fewer.
    said = said.join(quotes.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").unionByName(_runs(own_said.select("c0", "t0", "said"), quotes))
    said = materialize(said.groupBy("h1", "h2", "c0").agg(F.min("t0").alias("t0")), "said")
    here = said.withColumnRenamed("c0", "c").withColumnRenamed("t0", "near")
    anywhere = said.groupBy("h1", "h2").agg(F.min(F.struct("c0", "t0")).alias("first"))
    tied = quotes.drop("lines").join(here, ["h1", "h2", "c"], "left").join(anywhere, ["h1", "h2"], "left")
    before = F.col("near") < F.col("t")
    other = F.col("first").isNotNull() & (F.col("first.c0") != F.col("c"))
    tied = tied.withColumn(
        "to",
        F.when(before, F.struct(F.col("c").alias("c"), F.col("near").alias("t"))).when(
            other, F.struct(F.col("first.c0").alias("c"), F.col("first.t0").alias("t"))
        ),
    )
    tied = materialize(tied.select("c", "t", "x", "place", "level", "to"), "tied")
    links = materialize(
        tied.groupBy("c", "t", "x").agg(
            F.min(F.when((F.col("level") == 1) & F.col("to").isNotNull(), F.struct("place", "to"))).alias("reply"),
            F.count("*").alias("n_quotes"),
            F.count("to").alias("n_linked"),
        ),
        "links",
    )
    inside = links.filter(F.col("reply.to.c") == F.col("c"))
    node = lambda c, t: F.struct(F.col(c).alias("c"), F.col(t).alias("t"))
    implied = materialize(_implied(tied), "implied")
    deep = tied.filter((F.col("level") > 1) & (F.col("to.c") == F.col("c")))
    edges = inside.select(node("c", "t").alias("src"), node("c", "reply.to.t").alias("dst"))
    edges = edges.unionAll(deep.select(node("c", "t"), node("c", "to.t"))).unionAll(implied.select(node("c", "src"), node("c", "dst")))
    threads = connected_components(edges).select(
        F.col("node.c").alias("__tc"), F.col("node.t").alias("__tt"), F.col("component.t").alias("__thread")
    )
    links = links.select(F.col("c").alias("__lc"), F.col("t").alias("__lt"), F.col("x").alias("__lx"), "reply", F.col("n_quotes").alias("__q"), F.col("n_linked").alias("__l"))
    answers = implied.groupBy(F.col("c").alias("__ac"), F.col("src").alias("__at")).agg(F.max("dst").alias("__answers"))
    full = keyed.join(
        links, F.col("__c").eqNullSafe(F.col("__lc")) & F.col("__t").eqNullSafe(F.col("__lt")) & (F.col("__x") == F.col("__lx")), "left"
    ).join(threads, (F.col("__c") == F.col("__tc")) & (F.col("__t") == F.col("__tt")), "left")
    full = full.join(answers, (F.col("__c") == F.col("__ac")) & (F.col("__t") == F.col("__at")), "left")
    return (
        full.select(
            *[F.col("__said").alias(c) if c == text_col else F.col(f"`{c}`") for c in own.columns],
            F.coalesce("reply.to.c", F.when(F.col("__answers").isNotNull(), F.col("__c"))).alias("reply_conv"),
            F.coalesce("reply.to.t", "__answers").alias("reply_turn"),
            F.coalesce("__q", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("__l", F.lit(0)).cast("long").alias("n_linked"),
            F.coalesce("__thread", F.col("__t")).alias("thread"),
        )
        .repartitionByRange(conv, "thread", turn)
        .sortWithinPartitions(conv, "thread", turn)
    )
