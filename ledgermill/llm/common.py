"""What the corpus operators share: reading a table, cutting lineage, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BROADCAST_GROUPS = 100_000
EDGES_PER_PARTITION = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXTS_PER_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time: ten thousand, as is usual, are some tens of MB in each of two
    processes. A session that asks for fewer keeps its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, TEXTS_PER_BATCH)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names; set one only where none is (local tests)."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "ledgermill-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(rows: DataFrame) -> DataFrame:
    """A table with a row a group: broadcast while it has few rows by count, else joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else rows


HEAVY_KEYS = 10_000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to `classes`, which has one row a key at most; `rows` is read three times.

    Keys that hold a ten-thousandth of the rows or more, ten thousand at most, are broadcast; so no key that goes by the
    shuffle has more rows than that, however large a class is.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    heavy = cut(counts.where(F.col("_n") * HEAVY_KEYS >= total).select(key).join(classes, key, how))
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(classes, key, how))


def hashed_first(rows: DataFrame, group: str, most: Column | int) -> DataFrame:
    """(group, doc_id): at most `most` distinct ids of each value of `group`, in order of a hash of the id. However many
    rows repeat an id, it is drawn once.

    Distinct ids are counted first, by a sketch that errs by a twentieth; ids whose hash lies beyond twice the share
    that a group may keep are dropped where they are read, so what is ranked stays near the bound however large a group
    or the table is.
    """
    limit = F.lit(most) if isinstance(most, int) else most
    n = bounded(rows.groupBy(group).agg(F.approx_count_distinct("doc_id", 0.05).alias("_n")))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    likely = rows.join(n, group).withColumn("_u", drawn).where(F.col("_u") * F.col("_n") <= 2 * limit + 8 * F.sqrt(limit.cast("double")) + 64)
    w = Window.partitionBy(group).orderBy("_u", "doc_id")
    return likely.select(group, "doc_id", "_u").distinct().withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= limit).select(group, "doc_id")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function whose worker gives its freed memory back when the task ends: workers live on, and the
    next stage's share the executor with them."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"),
    ).first()
    return (r["n"], r["x"], r["s"])


def _minimum(pairs: DataFrame) -> DataFrame:
    """min neighbour of each node (the node itself included); combined before the shuffle."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b: long) -> (node, root), root = least node.

    Alternating large-star and small-star rounds. Each round is two aggregations of minima and
    two joins; the edges are checkpointed once a round. Nodes without an edge aren't returned.
    Self loops, repeated and null edges are ignored.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    e = cut(e)
    before = _signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # few edges in few partitions: else every task of every round writes files for all the others
        few = 1 + before[0] // EDGES_PER_PARTITION
        e = e.coalesce(few)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minimum(both), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = _minimum(large)
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        e = cut(small.coalesce(few))
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    star = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
