"""Event log to current state, and ordered analytics over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(at: str, action: str, tie: str) -> Column:
    """time, then revoked after granted, then id: a total order."""
    return F.struct(F.col(at), F.when(F.col(action) == "revoked", 1).otherwise(0), F.col(tie))


def ends(events: DataFrame, keys: list[str], at="at", action="action", tie="id") -> DataFrame:
    """First and last action per key, their times, the last event's id; combined before the shuffle."""
    o = _order(at, action, tie)
    return events.groupBy(*keys).agg(
        F.min_by(action, o).alias("first_action"), F.max_by(action, o).alias("last_action"), F.min(at).alias("first_at"),
        F.max(at).alias("last_at"), F.max_by(tie, o).alias("last_id"), F.count("*").alias("n_events"))


def derive_states(subjects: DataFrame, events: DataFrame, types: list[str], log_start: Column, key="subject", signup="signup") -> DataFrame:
    """L1: a row for every subject and declared type, from its events."""
    return states_from_ends(subjects, ends(events.select(key, "type", "action", "at", "id"), [key, "type"]), types, log_start, key, signup)


def states_from_ends(subjects: DataFrame, seen: DataFrame, types: list[str], log_start: Column, key="subject", signup="signup") -> DataFrame:
    """L1: a row for every subject and declared type, from the `ends` of (subject, type), however they were gathered.

    No event: unknown_pre_log if the subject signed up before the log began, else no_record. First event a
    revocation: conflict. Else what the last event says.
    """
    wanted = subjects.select(key, signup, F.explode(F.array(*map(F.lit, types))).alias("type"))
    s = wanted.join(seen, [key, "type"], "left")
    state = (
        F.when(F.col("n_events").isNull(), F.when(F.col(signup) < log_start, "unknown_pre_log").otherwise("no_record"))
        .when(F.col("first_action") == "revoked", "conflict").otherwise(F.col("last_action"))
    )
    return s.select(key, "type", state.alias("state"), F.col("last_id").alias("from_event"))


def recompute(derived: DataFrame, decided: DataFrame, key="subject") -> DataFrame:
    """A person's decision (subject, type, state, from_event) stands while the latest event is the same."""
    d = decided.select(key, "type", F.col("state").alias("_s"), F.col("from_event").alias("_f"), F.lit(True).alias("_d"))
    j = derived.join(d, [key, "type"], "left")
    keep = F.col("_d") & F.col("_f").eqNullSafe(F.col("from_event"))
    return j.select(key, "type", F.when(keep, F.col("_s")).otherwise(F.col("state")).alias("state"), "from_event", F.coalesce(keep, F.lit(False)).alias("decided"))


def state_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, before, after) where the state differs."""
    b, a = before.select(*key, F.col("state").alias("before")), after.select(*key, F.col("state").alias("after"))
    return b.join(a, key).where(~F.col("before").eqNullSafe(F.col("after")))


def before_first(rows: DataFrame, grants: DataFrame, key: str, day: str, at: str) -> DataFrame:
    """Rows dated before their subject's first grant day."""
    first = grants.groupBy(key).agg(F.to_date(F.min(at)).alias("first_day"))
    return rows.join(first, key).where(F.col(day) < F.col("first_day"))


def still_revoked(events: DataFrame, key: str) -> DataFrame:
    """Subjects whose last revocation no grant follows, with its time (one aggregate, no theta join)."""
    g = events.groupBy(key).agg(
        F.max(F.when(F.col("action") == "granted", F.col("at"))).alias("grant"), F.max(F.when(F.col("action") == "revoked", F.col("at"))).alias("last_revoke"))
    return g.where(F.col("last_revoke").isNotNull() & (F.col("grant").isNull() | (F.col("grant") <= F.col("last_revoke")))).select(key, "last_revoke")


def after_revocation(rows: DataFrame, events: DataFrame, key: str, day: str) -> DataFrame:
    """L5, D12."""
    return rows.join(still_revoked(events, key), key).where(F.col(day) > F.to_date("last_revoke"))


def stragglers(events: DataFrame, new: str, old: str) -> DataFrame:
    """Events of the old kind after the new kind's first; the cut-over is read from the data."""
    cut = events.where(F.col("event_type") == new).agg(F.min("ts").alias("cut_over"))
    return events.where(F.col("event_type") == old).crossJoin(F.broadcast(cut)).where("ts > cut_over")  # one row joined


def governing(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """the first rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_and_repeats(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """every row with its place among the rows of its key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def repeated_actions(events: DataFrame, key: str, action: str, order: list[Column]) -> DataFrame:
    """events whose action equals the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("previous", F.lag(action).over(w)).where(F.col("previous") == F.col(action))


def out_of_order(events: DataFrame, key: str, by: Column, then: Column) -> DataFrame:
    """Keys whose events, ordered by `by`, don't come in the order of `then`.

    Adjacent rows are compared, so that no list of a key's events is built."""
    w = Window.partitionBy(key).orderBy(by, then)
    e = events.select(key, by.alias("_by"), then.alias("_then"))
    w = Window.partitionBy(key).orderBy("_by", "_then")
    return e.withColumn("_p", F.lag("_then").over(w)).groupBy(key).agg(F.max(F.col("_p") > F.col("_then")).alias("_bad")).where("_bad").select(key)


def islands(rows: DataFrame, key: str, day: str, gap_days: int) -> DataFrame:
    """Runs of days without a gap over `gap_days`: key, island, first, last, n."""
    w = Window.partitionBy(key).orderBy(day)
    gap = F.coalesce((F.datediff(day, F.lag(day).over(w)) > gap_days).cast("int"), F.lit(0))
    numbered = rows.select(key, day).distinct().withColumn("_g", gap).withColumn("island", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def sequence_pattern(events: DataFrame, key: str, action: str, order: list[Column]) -> DataFrame:
    """(key, pattern): what a key's actions in order say: single a, n x a, granted then revoked, revoked then granted,
    or mixed (all of them). Only mixed keys have their actions listed."""
    o = F.struct(*order, action)
    whole = events.groupBy(key).agg(F.count("*").alias("_n"), F.min(action).alias("_low"), F.max(action).alias("_high"), F.min_by(action, o).alias("_a"), F.max_by(action, o).alias("_z"))
    plain = (
        F.when(F.col("_n") == 1, F.concat(F.lit("single "), "_a")).when(F.col("_low") == F.col("_high"), F.concat(F.col("_n").cast("string"), F.lit(" x "), "_a"))
        .when((F.col("_a") == "granted") & (F.col("_z") == "revoked"), "granted then revoked").when((F.col("_a") == "revoked") & (F.col("_z") == "granted"), "revoked then granted")
    )
    whole = whole.withColumn("_plain", plain)
    mixed = events.join(whole.where("_plain is null").select(key), key, "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(o)), lambda x: x[action])
    said = mixed.groupBy(key).agg(F.concat(F.lit("mixed ("), F.array_join(listed, " > "), F.lit(")")).alias("pattern"))
    return whole.where("_plain is not null").select(key, F.col("_plain").alias("pattern")).unionByName(said)


def state_map(states: DataFrame, key: str) -> DataFrame:
    """Per subject a map type -> state."""
    return states.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "state")))).alias("states"))


def timeline(*sources: DataFrame) -> DataFrame:
    """Several evidence tables (at, seq, kind, detail) as one, newest first."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy(F.desc("at"), F.desc("seq"), "kind")
