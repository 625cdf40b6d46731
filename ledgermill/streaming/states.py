"""The event-to-state derivation over a stream, its state stored in a folder; the batch form is its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import ends
from ..sources import stored


def stream_states(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running first and last action per key of a streaming (key..., action, at, id) table, for update mode.

    Minima and maxima over a total order don't depend on arrival, so late events need no watermark here; the
    state is one row per key.
    """
    return ends(events, keys)


def start(events: DataFrame, keys: list[str], sink: str, checkpoint: str):
    """Write each batch's changed keys to a memory table (tests) under the shared checkpoint folder."""
    return stream_states(events, keys).writeStream.outputMode("update").format("memory").queryName(sink).option("checkpointLocation", checkpoint).start()


class EndsStore:
    """First and last event of every key, as a base and a folder of additions for each batch.

    A batch's additions are what its own events say of each key, written under the batch's number. The same batch given
    again writes the same folder anew, and one that is in the base already is passed over, so a batch counts once
    however often a stream is stopped and started. Keys are never looked up when a batch comes; `read` merges base and
    additions, and every `most` batches they are merged into a new base. A folder counts only when its write has ended, so a
    job that dies between two steps leaves either the old base with its additions or the new one. One writer at a time;
    what `read` returned has to be used before the next `write`.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], most: int = 16):
        self.spark, self.path, self.keys, self.most = spark, path, keys, most

    def _base(self) -> int:
        return max(stored.complete(self.spark, f"{self.path}/base", "upto"), default=-1)

    def _batches(self) -> list[int]:
        base = self._base()
        return [n for n in stored.complete(self.spark, f"{self.path}/batches", "batch") if n > base]

    def committed(self) -> int:
        """The number of the last batch that counts, -1 before the first."""
        return max([self._base(), *self._batches()])

    def write(self, events: DataFrame, number: int) -> None:
        """Take in batch `number`: rows (key..., action, at, id)."""
        if number <= self._base():
            return
        one = F.struct(F.col("at"), F.when(F.col("action") == "revoked", 1).otherwise(0).alias("rank"), F.col("id"), F.col("action"))
        said = events.groupBy(*self.keys).agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").alias("n"))
        said.write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        if len(self._batches()) >= self.most:
            self.compact()

    def _merged(self) -> DataFrame | None:
        base, batches = self._base(), self._batches()
        paths = [f"{self.path}/base/upto={base}"] * (base >= 0) + [f"{self.path}/batches/batch={n}" for n in batches]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths).select(*self.keys, "first", "last", "n")
        return rows.groupBy(*self.keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))

    def compact(self) -> None:
        """Merge all that counts into one base; a stop at any point loses nothing and counts nothing twice."""
        old, batches = self._base(), self._batches()
        if not batches:
            return
        self._merged().write.mode("overwrite").parquet(f"{self.path}/base/upto={batches[-1]}")
        for n in batches:
            stored.remove(self.spark, f"{self.path}/batches/batch={n}")
        if old >= 0:
            stored.remove(self.spark, f"{self.path}/base/upto={old}")

    def read(self) -> DataFrame | None:
        """What `ends` says of all events taken in; None before the first batch."""
        rows = self._merged()
        return rows and rows.select(
            *self.keys, F.col("first.action").alias("first_action"), F.col("last.action").alias("last_action"), F.col("first.at").alias("first_at"), F.col("last.at").alias("last_at"),
            F.col("last.id").alias("last_id"), F.col("n").alias("n_events"))


def keep(events: DataFrame, store: EndsStore, checkpoint: str):
    """Take all that a streaming (key..., action, at, id) table has now into the store, batch by batch, and stop; started
    again with the same checkpoint folder it goes on where it was. Late events need no watermark."""
    return events.writeStream.foreachBatch(store.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
