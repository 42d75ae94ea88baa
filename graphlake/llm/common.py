"""Shared pieces: the shared folder, lineage cuts, word patterns, document keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What stands between words made of ASCII letters, digits and all of non-ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII white space, as it is stripped and split at.
BLANK = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch on its way to Python, so that whole texts of any number of rows are never in one batch.
BATCH_BYTES = 4 << 20
#: Entries that a worker remembers of one function.
REMEMBERED = 60_000


class Remembered(dict):
    """A function's results, remembered up to ``limit`` in each of two generations; the older one goes when the younger is full.

    Workers are used again by later stages, so what fills one of these empties it
    when its task ends.
    """

    def __init__(self, find: Callable[[Any], Any], limit: int = REMEMBERED) -> None:
        self.find, self.limit, self.old = find, limit, {}

    def __missing__(self, key: Any) -> Any:
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            super().clear()
        self[key] = found
        return found

    def clear(self) -> None:
        self.old = {}
        super().clear()


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session does so itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone: other letters keep their case."""
    return F.translate(col, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(col: Column) -> Column:
    """The words of a text, lower-cased; none for a null or a text without words."""
    parts = F.split(ascii_lower(F.coalesce(col, F.lit(""))), NON_WORD)
    return F.filter(parts, lambda w: w != "")


def text_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that stand for a row where its id may be null or repeated.

    Rows that agree in both hold the same id and text, so whatever is derived
    from them is the same as well.
    """
    filled = F.coalesce(text, F.lit(""))
    return [
        F.coalesce(doc_id.cast("long"), F.lit(-(2**62))).alias("__key_id"),
        F.xxhash64(filled, F.length(filled)).alias("__key_text"),
    ]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` decides.  Where it is unset on one
    machine, as in tests, a folder is made and set; on a cluster that is an error,
    as every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, and a later
    step never recomputes an earlier one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Keys that hold more than one in so many rows; there are no more of them than that, so a table of them may be told to all tasks.
HOT_KEYS = 10_000


def hot_keys(counts: DataFrame, n: str, total: int | None = None) -> DataFrame:
    """The rows of a table of keys whose number ``n`` is over 1 / HOT_KEYS of the sum (``total``, if it is known): fewer than HOT_KEYS rows, whatever the table."""
    if total is None:
        total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.filter(F.col(n) * HOT_KEYS > total)


def join_spread(rows: DataFrame, values: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """A left join with a table that has a row for each key, where single keys may hold any share of the rows.

    ``hot`` are the rows of ``values`` whose keys ``hot_keys`` found; they are
    broadcast. Rows that meet one, and rows with a null key, are dealt evenly over
    the tasks of the join that the others take, in place of by their key.
    """
    names = [c for c in values.columns if c not in keys]
    often = hot.select(*keys, F.struct(*names).alias("__hot"))
    met = rows.join(F.broadcast(often), keys, "left")
    usual_key = F.col("__hot").isNull()
    for k in keys:
        usual_key = usual_key & F.col(k).isNotNull()
    own = F.when(usual_key, 0).otherwise(1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(1 << 20)))
    usual = values.select(*keys, F.lit(0).cast("bigint").alias("__own"), F.struct(*names).alias("__usual"))
    met = met.withColumn("__own", own.cast("bigint")).join(usual, [*keys, "__own"], "left")
    return met.select(*rows.columns, *[F.coalesce(f"__hot.{c}", f"__usual.{c}").alias(c) for c in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
