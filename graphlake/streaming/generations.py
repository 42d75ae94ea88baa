"""Generations of a graph: transactions of shards, folded and published at once.

A log of frames (``seq``, ``op``, ``shard``, ...) says which shards a provider
upserts and deletes. What is valid is decided on the whole transaction, what it
leaves is the latest frame of each shard, and readers follow a pointer that is
written last.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.sources.shared import materialize, shared_dir


def latest_frames(frames: DataFrame) -> DataFrame:
    """The last upsert or delete of each shard; one aggregate, combined before the shuffle."""
    rest = [c for c in frames.columns if c not in ("shard", "seq")]
    got = frames.groupBy("shard").agg(F.max_by(F.struct(*rest), "seq").alias("__l"), F.max("seq").alias("seq"))
    return got.select("shard", "seq", *[F.col(f"__l.{c}").alias(c) for c in rest])


def live_shards(frames: DataFrame) -> DataFrame:
    return latest_frames(frames).filter("op = 'upsert'")


def transaction_errors(frames: DataFrame, base: str | None, current: str | None, last_seq: int) -> list[str]:
    """Why a transaction cannot be applied; empty if it can."""
    errors = []
    if base != current:
        errors.append("the base is not the current generation")
    row = frames.agg(F.min("seq").alias("lo"), F.count_if(~F.col("op").isin("upsert", "delete")).alias("odd")).first()
    if row["lo"] is not None and row["lo"] <= last_seq:
        errors.append("the sequence does not advance")
    if row["odd"]:
        errors.append("an operation is unknown")
    if frames.groupBy("shard").count().filter("count > 1").limit(1).count():
        errors.append("a shard is there twice")
    return errors


def canonical_digest(*cols: Column) -> Column:
    """SHA-256 over length-prefixed fields, in order."""
    parts = []
    for c in cols:
        text = F.coalesce(c.cast("string"), F.lit(""))
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.sha2(F.concat(*parts), 256)


def fact_digest(rows: DataFrame, keys: list[str], part_rows: int = 50_000) -> DataFrame:
    """One digest of a table, whatever the order of its rows (``digest``).

    Rows' digests are sorted and joined within parts that share a beginning, the
    parts' digests within those that share a shorter one, and so on: no part holds
    more than about ``part_rows`` of them, whatever the table's size.
    """
    level = materialize(rows.select(canonical_digest(*[F.col(k) for k in keys]).alias("d")), "digests")
    n, digits = level.count(), 0
    while 16**digits * part_rows < n:
        digits += 1
    level = level.withColumn("p", F.col("d"))
    while True:
        grouped = level.groupBy(F.substring("p", 1, digits).alias("p")) if digits else level.groupBy(F.lit("").alias("p"))
        level = grouped.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda s: s["d"]), ""), 256).alias("d"))
        if not digits:
            break
        digits = max(0, digits - 3)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return level.agg(F.coalesce(F.max("d"), empty).alias("digest"))


def fold_first(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of all shards with one of each key: the first by shard and position."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("shard", "pos")).alias("__f"))
    return got.select(*key, *[F.col(f"__f.{c}").alias(c) for c in rest])


class Snapshots:
    """Published generations under a folder: tables are written first, then a numbered pointer that no other may have written.

    A pointer is written aside and moved to its number, which fails if the number
    is taken, so of two writers with one base one fails, and readers, who follow
    the highest number, see either generation whole.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _highest(self) -> int:
        """The number of the last pointer; 0 if there is none."""
        folder = self._at("pointers")
        fs = self._files()
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0) if fs.exists(folder) else 0

    def current(self) -> dict | None:
        last = self._highest()
        if not last:
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/pointers/{last:020}").collect())) | {"number": last}

    def publish(self, tables: dict[str, DataFrame], base: str | None, inputs: dict | None = None) -> str:
        """Write the tables of a generation and make it current, if ``base`` still is."""
        now = self.current() or {}
        if now.get("generation") != base:
            raise ValueError("another generation has been published since")
        name = uuid.uuid4().hex
        for t, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{t}")
        fs, draft = self._files(), self._at(f"{name}/pointer")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"generation": name, "base": base, "inputs": inputs or {}}).encode()))
        out.close()
        fs.mkdirs(self._at("pointers"))
        self._move(draft, self._at(f"pointers/{now.get('number', 0) + 1:020}"))
        return name

    def _move(self, source, target) -> None:
        """Rename without overwriting: the file system decides who is first."""
        options = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, none)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                raise ValueError("another generation has been published since") from error
            raise

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        """A table of a generation; the current one is looked up once, so tables of one request agree."""
        generation = generation or (self.current() or {})["generation"]
        return self.spark.read.parquet(f"{self.root}/{generation}/{table}")


def replace_language(old: DataFrame, new: DataFrame, language: str) -> DataFrame:
    """A language's rows replaced whole."""
    return old.filter(F.col("language") != language).unionByName(new.filter(F.col("language") == language))


def watch_frames(spark: SparkSession, folder: str, apply, schema: str = "seq long, op string, shard string, digest string, payload string", checkpoint: str | None = None):
    """A stream over a folder of NDJSON frames; ``apply(frames, batch_id)`` gets each batch and publishes it.

    Batches come at least once: ``apply`` compares the sequence with what is
    published, which makes a repeated batch a failed transaction.
    """
    stream = spark.readStream.schema(schema).json(folder)
    at = checkpoint or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", at).trigger(availableNow=True).start()
