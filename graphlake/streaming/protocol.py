"""Transactions of shards: a header, upserts and deletes, and a commit that says what must come out.

A log is a line of JSON for each frame. The three frames that are not shards are
read by the driver; shards stay a table, and every rule about them is a query.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = "key string, digest string, payload string"
FRAME = (
    "type string, provider string, language string, schemaVersion int, protocolVersion int, tool string, toolVersion string, sequence long, generation string, "
    "baseSequence long, baseGeneration string, universe string, targets array<string>, manifest string, factDigest string, key string, digest string, "
    "payload string, shards array<struct<key:string,digest:string>>"
)
# Fields of a header that make up its producer's identity.
IDENTITY = ("provider", "language", "schemaVersion", "protocolVersion", "tool", "toolVersion")


@dataclass
class Transaction:
    """The header, the beginning and the commit as rows, and the shards between them as a table (pos, op, key, digest, payload)."""

    hello: dict[str, Any]
    begin: dict[str, Any]
    commit: dict[str, Any]
    shards: DataFrame
    order: list[str] = field(default_factory=list)


@dataclass
class Published:
    """What a store holds: the begin and the header of its last transaction, and its shards (key, digest, payload)."""

    hello: dict[str, Any]
    begin: dict[str, Any]
    shards: DataFrame


def shard_digest(payload="payload"):
    return F.sha2(F.col(payload).cast("binary"), 256)


def read_transaction(spark: SparkSession, path: str) -> Transaction:
    """A transaction's frames (``pos`` is their order in the file); a line that is no frame fails when it is read."""
    lines = spark.read.option("lineSep", "\n").text(path)
    frames = lines.withColumn("pos", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = F.from_json("value", FRAME)
    ok = F.when(F.col("f.type").isNull(), F.raise_error(F.concat(F.lit("not a frame: "), "value"))).otherwise(F.col("f"))
    frames = frames.withColumn("f", parsed).select("pos", ok.alias("f")).select("pos", "f.*")
    heads = {r["type"]: r for r in frames.filter(F.col("type").isin("hello", "begin", "commit")).orderBy("pos").limit(4).collect()}
    ends = frames.orderBy("pos").select("type").limit(2).collect() + frames.orderBy(F.desc("pos")).select("type").limit(1).collect()
    ops = F.when(F.col("type") == "upsertShard", "upsert").when(F.col("type") == "deleteShard", "delete").otherwise(F.col("type"))
    shards = frames.filter(~F.col("type").isin("hello", "begin", "commit")).select("pos", ops.alias("op"), "key", "digest", "payload")
    row = lambda t: heads[t].asDict(recursive=True) if t in heads else {}
    return Transaction(row("hello"), row("begin"), row("commit"), shards, [r["type"] for r in ends])


def next_shards(t: Transaction, held: Published | None) -> DataFrame:
    """The shards after a transaction: those of its own, and with a base those it did not touch."""
    fresh = t.shards.filter("op = 'upsert'").select("key", "digest", "payload")
    if held is None or t.begin.get("baseGeneration") is None:
        return fresh
    return held.shards.select("key", "digest", "payload").join(t.shards.select("key"), "key", "left_anti").unionByName(fresh)


def header_errors(t: Transaction, held: Published | None, gapless: bool = False) -> list[str]:
    """What is wrong with the frames around the shards.

    ``gapless`` is how topology is told: the first transaction is number 1 and has
    no base, every other is the next one on top of the last.
    """
    errors = []
    if t.order and t.order != ["hello", "begin", "commit"]:
        errors.append("a transaction is hello, begin, shards and commit")
    if not t.hello or not t.begin or not t.commit:
        return [*errors, "a frame is missing"] if not errors else errors
    if any(t.hello.get(f) in (None, "") for f in IDENTITY):
        errors.append("hello does not say who speaks")
    if t.commit.get("sequence") != t.begin.get("sequence") or t.commit.get("generation") != t.begin.get("generation"):
        errors.append("commit is not of the generation that began")
    based, before = t.begin.get("baseGeneration") is not None, held.begin if held else {}
    if based and (t.begin.get("baseGeneration") != before.get("generation") or t.begin.get("baseSequence") != before.get("sequence")):
        errors.append("the base is not the current generation")
    if held is not None and t.begin["sequence"] <= before["sequence"]:
        errors.append("the sequence does not advance")
    if gapless and t.begin.get("sequence") != (before.get("sequence") or 0) + 1:
        errors.append("the sequence has a gap")
    if gapless and based != (held is not None):
        errors.append("the first transaction has no base, and every other has one")
    if (based or gapless) and held is not None and any(t.hello.get(f) != held.hello.get(f) for f in IDENTITY):
        errors.append("the producer changed across a delta")
    return errors


def shard_errors(t: Transaction, held: Published | None) -> DataFrame:
    """``rule``, ``subject`` of what is wrong with the shards."""
    spark, based = t.shards.sparkSession, t.begin.get("baseGeneration") is not None
    none = spark.createDataFrame([], SHARD)
    before = held.shards.select("key", "digest", "payload") if held is not None and based else none
    committed = held.shards.select("key", "digest") if held is not None else none.select("key", "digest")
    said = spark.createDataFrame([(s["key"], s["digest"]) for s in t.commit.get("shards") or []], "key string, digest string")
    after = next_shards(t, held).select("key", "digest")
    rule = lambda df, text, subject="key": df.select(F.lit(text).alias("rule"), F.col(subject).alias("subject"))
    ups, downs = t.shards.filter("op = 'upsert'"), t.shards.filter("op = 'delete'")
    moved = ups.join(committed, ["key", "digest"], "left_anti").select("key").unionAll(downs.select("key"))
    found = [
        rule(t.shards.filter(~F.col("op").isin("upsert", "delete")), "a frame inside is no shard", "op"),
        rule(t.shards.filter(F.col("key").isNull() | (F.col("key") == "")), "a shard has no key", "op"),
        rule(t.shards.groupBy("key").count().filter("count > 1"), "a shard is there twice"),
        rule(ups.filter(F.coalesce(F.col("digest"), F.lit("")) != F.coalesce(shard_digest(), F.lit("?"))), "a shard is not what its digest says"),
        rule(downs.join(before, "key", "left_anti"), "a shard to delete is not there"),
        rule(after.join(said, ["key", "digest"], "left_anti"), "a shard is not in the commit"),
        rule(said.join(after, ["key", "digest"], "left_anti"), "the commit names a shard that is not there"),
        rule(said.groupBy("key").count().filter("count > 1"), "the commit names a shard twice"),
    ]
    if based and held is not None:
        if t.begin.get("manifest") != held.begin.get("manifest"):
            one = spark.range(1).select(F.lit("manifest").alias("key"), F.lit(1).alias("one"))
            still = one.join(moved.limit(1).select(F.lit(1).alias("one")), "one", "left_anti")
            found.append(rule(still, "the inputs moved and no shard did"))
        if t.begin.get("universe") != held.begin.get("universe") or t.begin.get("targets") != held.begin.get("targets"):
            found.append(rule(before.join(moved, "key", "left_anti"), "the targets moved and a shard stayed"))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def apply_transaction(t: Transaction, held: Published | None, facts: DataFrame | None = None, gapless: bool = False) -> Published:
    """What is published after a transaction, whole or not at all: with any error nothing is.

    ``facts`` (``digest``) is the digest of the assembled rows, to be held against
    the one that the commit says.
    """
    errors = header_errors(t, held, gapless)
    if not errors:
        errors = [f"{r['rule']}: {r['subject']}" for r in shard_errors(t, held).orderBy("rule", "subject").limit(20).collect()]
    if not errors and facts is not None and facts.first()["digest"] != t.commit.get("factDigest"):
        errors.append("the facts are not those of the commit")
    if errors:
        raise ValueError("; ".join(errors))
    return Published(t.hello, t.begin, next_shards(t, held))
