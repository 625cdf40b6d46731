"""Derived states kept up to date: only survivors whose evidence changed are derived again, only their partitions rewritten.

Both the log and the states are folders in partitions by a hash of the subject. A change names subjects: those of new
events, those whose sign-up changed, both sides of a merge or its undoing. Their survivors (now and before) are derived
anew from the partitions of the log that hold their members, the other rows of the same partitions are carried over,
and all other partitions stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stored
from .events import derive_states
from .identity import checkpointed

BUCKETS = 64


def bucket_of(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def by_membership(chains: DataFrame, subjects: DataFrame, events: DataFrame, types: list[str], log_start: Column) -> DataFrame:
    """L2: states of survivors over the events of all their members (chains: id, survivor; subjects: subject, signup).

    A survivor's sign-up is the earliest of its members', and unknown if any member's is.
    """
    member = chains.select(F.col("id").alias("subject"), "survivor")
    s = subjects.join(member, "subject").groupBy("survivor").agg(F.when(~F.bool_or(F.col("signup").isNull()), F.min("signup")).alias("signup"))
    e = events.join(member, "subject").select(F.col("survivor").alias("subject"), "type", "action", "at", "id")
    return derive_states(s.withColumnRenamed("survivor", "subject"), e, types, log_start)


class DerivedStates:
    """States (subject, type, state, from_event) in a folder, beside the log that they are derived from."""

    def __init__(self, spark: SparkSession, path: str, types: list[str], log_start: Column, buckets: int = BUCKETS):
        self.spark, self.path, self.types, self.log_start, self.buckets = spark, path, types, log_start, buckets

    def _put(self, rows: DataFrame, name: str, mode: str, which: str = "static") -> None:
        w = rows.withColumn("bucket", bucket_of(F.col("subject"), self.buckets)).repartition("bucket").write.mode(mode)
        w.option("partitionOverwriteMode", which).partitionBy("bucket").parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log")

    def states(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/states").drop("bucket")

    def append(self, events: DataFrame) -> None:
        """Events (subject, type, action, at, id) are only ever added."""
        self._put(events.select("subject", "type", "action", "at", "id"), "log", "append")

    def derive_all(self, chains: DataFrame, subjects: DataFrame) -> None:
        """The full run; it replaces whatever is stored."""
        rows = by_membership(chains, subjects, self.log().drop("bucket"), self.types, self.log_start)
        self._put(rows.select("subject", "type", "state", "from_event"), "states", "overwrite")

    def _only(self, rows: DataFrame, subjects: DataFrame) -> DataFrame:
        """Rows of the partitions that hold any of the subjects: their numbers, at most `buckets`, are looked up first."""
        some = [r[0] for r in subjects.select(bucket_of(F.col("subject"), self.buckets)).distinct().collect()]
        return rows.where(F.col("bucket").isin(some))

    def evidence(self, members: DataFrame) -> DataFrame:
        """The events of `members` (subject, survivor): a scan of their partitions alone."""
        return self._only(self.log(), members).drop("bucket").join(members.select("subject"), "subject", "left_semi")

    def refresh(self, before: DataFrame, after: DataFrame, subjects: DataFrame, changed: DataFrame) -> DataFrame:
        """Derive again what `changed` (subject) touches; before and after: (id, survivor) then and now. Returns the
        survivors derived (subject). Survivors that no longer survive lose their rows. A second call changes nothing."""
        c = changed.select(F.col("subject").alias("id")).distinct()
        touched = before.join(c, "id").select("survivor").unionByName(after.join(c, "id").select("survivor"))
        # whoever stood with a touched subject, then or now, may stand for itself now
        again = before.join(touched.distinct(), "survivor", "left_semi").select("id").unionByName(touched.select(F.col("survivor").alias("id")))
        now = after.join(again.distinct(), "id").select("survivor").distinct()
        goals = checkpointed(touched.unionByName(now).distinct().withColumnRenamed("survivor", "subject"))
        members = checkpointed(after.join(goals.withColumnRenamed("subject", "survivor"), "survivor", "left_semi").select(F.col("id").alias("subject"), "survivor"))
        own = subjects.join(members.select("subject"), "subject", "left_semi")
        made = by_membership(members.withColumnRenamed("subject", "id"), own, self.evidence(members), self.types, self.log_start)
        old = self._only(self.spark.read.parquet(f"{self.path}/states"), goals)
        others = old.drop("bucket").join(goals, "subject", "left_anti")
        whole = checkpointed(made.select("subject", "type", "state", "from_event").unionByName(others.select("subject", "type", "state", "from_event")))
        emptied = [r[0] for r in old.select("bucket").distinct().join(whole.select(bucket_of(F.col("subject"), self.buckets).alias("bucket")).distinct(), "bucket", "left_anti").collect()]
        self._put(whole, "states", "overwrite", "dynamic")
        for b in emptied:  # a partition without a row left isn't overwritten
            stored.remove(self.spark, f"{self.path}/states/bucket={b}")
        return goals
