"""Line dedup over batches of documents, against levelled sorted runs of line hashes.

A run is a table of line keys (128 bits of hash), each with the number of documents that hold it and the largest
of their ids; it is bucketed and sorted by the hash. A new batch is counted by itself, what the runs say already is
anti-joined away by a merge (a key that they find common, in an id no smaller), and the rest becomes a run of the
lowest level. Where a level has `fan` runs they are merged into one of the next, so a batch meets few runs and a key
is rewritten once a level. The sum over all runs then decides.

Runs are partitions of one table of the warehouse (`LineRuns`), so batches may come hours apart in one session. The query deals
one table into batches, highest ids first: a common key's keeper is then known as soon as the key is common.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
FAN = 4
BATCHES = 8
HEAVY_KEYS = 50_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """Blanks at both ends go, A-Z become a-z. Lines of single bytes take the quick way of `lower`."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, h, g: a row for each line whose key has 40 code points or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a key is no longer than its line, so short lines needn't be looked at
    keyed = lines.where(F.char_length("line") >= LEAST_CHARS).select("doc_id", "text_hash", "pos", key_of(F.col("line")).alias("key"))
    keyed = keyed.where(F.char_length("key") >= LEAST_CHARS)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("g"))


class LineRuns:
    """The runs of one corpus: the partitions of one table of the session's catalog, bucketed and sorted by the hash."""

    def __init__(self, spark: SparkSession, name: str, fan: int = FAN, buckets: int | None = None, least: int = LEAST_DOCUMENTS):
        self.spark, self.name, self.fan, self.least = spark, name, fan, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[int]] = []
        self.made = 0

    def _write(self, keys: DataFrame, level: int) -> None:
        run, self.made = self.made, self.made + 1
        placed = keys.repartition(self.buckets, "h", "g").select("h", "g", "n", "top", F.lit(run).alias("run"))
        placed.write.partitionBy("run").bucketBy(self.buckets, "h", "g").sortBy("h", "g").mode("append").saveAsTable(self.name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)

    def _sum(self, runs: list[int]) -> DataFrame:
        """The runs merged bucket by bucket: one scan, no shuffle."""
        return self.spark.table(self.name).where(F.col("run").isin(runs)).groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def common(self) -> DataFrame:
        """h, g, n, top of the keys that enough documents hold; n is a lower bound once it is enough."""
        return self._sum([r for level in self.levels for r in level]).where(F.col("n") >= self.least)

    def add(self, lines: DataFrame) -> None:
        """A batch of `hashed_lines`; all rows of one doc_id have to be in one batch."""
        fresh = lines.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one"))
        fresh = fresh.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        if self.levels:
            known = self.common().withColumnsRenamed({"h": "h0", "g": "g0", "n": "n0", "top": "top0"})
            said = F.coalesce(F.col("top0") >= F.col("top"), F.col("top").isNull())
            fresh = fresh.join(known.hint("merge"), (F.col("h") == F.col("h0")) & (F.col("g") == F.col("g0")) & said, "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            self._write(self._sum(old), level + 1)
            for run in old:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run = {run})")
            level += 1

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.levels = []


def dropped_positions(lines: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, text_hash, gone (places of the lines to drop), for documents that lose any.

    Keys in more than a 50,000th of all (key, document) pairs that `common` counts are 50,000 at most and broadcast;
    any other key has few rows by comparison and goes by a shuffle.
    """
    total = common.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(common.where(F.col("n") * HEAVY_KEYS >= total))
    light = common.where(F.col("n") * HEAVY_KEYS < total)
    loses = ~F.col("doc_id").eqNullSafe(F.col("top"))
    hit = lines.join(heavy, ["h", "g"]).where(loses).select("doc_id", "text_hash", "pos")
    rest = lines.join(heavy, ["h", "g"], "left_anti").join(light.hint("merge"), ["h", "g"]).where(loses).select("doc_id", "text_hash", "pos")
    return hit.unionByName(rest).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, text (the lines kept), n_lines, n_dropped of every row.

    Documents are told apart by doc_id: rows of one id are one document, each with its own text, and rows without an id
    are one document whose id is below all others. A null or empty text is one empty line, which stays. The
    largest id that holds a common key keeps all its lines of that key. Other columns are ignored; an empty table
    gives no rows. A task holds the lines of one document at a time.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = [1 - i / batches for i in range(1, batches)]
    edges = src.agg(F.percentile_approx("doc_id", at, 10_000).alias("q")).first()["q"] or []
    batch = F.lit(0)
    for edge in sorted(set(edges), reverse=True):
        batch = batch + F.coalesce(F.col("doc_id") < F.lit(edge), F.lit(True)).cast("int")
    name = f"lines_{uuid.uuid4().hex}"
    runs = LineRuns(spark, f"{name}_run")
    try:
        hashed_lines(src).withColumn("batch", batch).write.partitionBy("batch").saveAsTable(name)
        lines = spark.table(name)
        for i in range(len(set(edges)) + 1):
            runs.add(lines.where(F.col("batch") == i).drop("batch"))
        common = cut(runs.common())
        gone = cut(dropped_positions(lines.drop("batch"), common))
    finally:
        runs.drop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    keyed = src.withColumn("text_hash", F.xxhash64("text")).alias("d")
    g = gone.alias("g")
    both = keyed.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash")), "left")
    both = both.select("d.doc_id", "text", F.split("text", "\n").alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return both.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def digests(rows: DataFrame) -> DataFrame:
    """What `dedup_lines` returns, with a hash in place of the text."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
