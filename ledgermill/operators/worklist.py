"""The work list of reviewers: rows joined to their survivors, filters read from untrusted query strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the closed words of the filters and the view before anybody has chosen
TYPES = ("identity_conflict", "orphan_intake", "duplicate_intake", "consent", "data_quality", "vocabulary", "clinical_history")
STATES = ("auto_flagged", "auto_rejected", "auto_cleared", "in_review", "approved", "rejected", "legacy_pending", "legacy_approved", "legacy_rejected", "legacy_expired", "draft", "submitted")
STATUSES = ("open", "resolved", "dismissed")
AGES = ("today", "week", "older")
DEFAULT_STATES = ("auto_flagged", "auto_rejected", "auto_cleared", "in_review")


def _words(xs: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


def filters_of(query: Column) -> Column:
    """struct(chosen, types, states, status, age) of a query string such as `?type=consent&state=draft&age=week`.

    Unknown words are dropped, so nothing from outside reaches a predicate. Without any `type` and `state` it is the default
    view; naming either one is a choice, and the other is then empty. The first known status and age count; status is
    open and age is any unless said. A null or empty string is the default view; a part that can't be decoded is no word.
    """
    bare = F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", "")
    decoded = lambda c: F.coalesce(F.try_url_decode(c), F.lit("\0"))
    parts = F.transform(F.filter(F.split(bare, "&"), lambda p: p != ""), lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    named = lambda key: F.filter(parts, lambda p: p["k"] == key)
    known = lambda key, words: F.array_distinct(F.transform(F.filter(named(key), lambda p: p["v"].isin(*words)), lambda p: p["v"]))
    chosen = (F.size(named("type")) > 0) | (F.size(named("state")) > 0)
    return F.struct(
        chosen.alias("chosen"), F.when(chosen, known("type", TYPES)).otherwise(_words(TYPES)).alias("types"), F.when(chosen, known("state", STATES)).otherwise(_words(DEFAULT_STATES)).alias("states"),
        F.coalesce(F.get(known("status", STATUSES), F.lit(0)), F.lit("open")).alias("status"), F.get(known("age", AGES), F.lit(0)).alias("age"))


def toggled(filters: Column, key: str, value: Column) -> Column:
    """The query string with one kind (`type` or `state`) switched on or off; empty for the default view.

    The default view is no selection: the first choice shows that kind alone, and taking the last one away goes back.
    """
    none = F.array().cast("array<string>")
    held = lambda name: F.when(filters["chosen"], filters[name]).otherwise(none)
    mine, other = (held("types"), held("states")) if key == "type" else (held("states"), held("types"))
    now = F.when(F.array_contains(mine, value), F.array_remove(mine, value)).otherwise(F.array_append(mine, value))
    said = lambda k, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{k}="), x))
    rest = F.array_compact(F.array(F.when(filters["status"] != "open", F.concat(F.lit("status="), filters["status"])), F.when(filters["age"].isNotNull(), F.concat(F.lit("age="), filters["age"]))))
    whole = F.concat(said(key, now), said("state" if key == "type" else "type", other), rest)
    return F.when((F.size(now) == 0) & (F.size(other) == 0), "").otherwise(F.concat(F.lit("?"), F.array_join(whole, "&")))


def work(items: DataFrame, intakes: DataFrame, chains: DataFrame, patients: DataFrame) -> DataFrame:
    """Review items (id, type, title, status, patient, at) and intakes (id, state, title, patient, at) as one list, each with
    the id and name of the record that its own was merged into; null where it names none or one that isn't there.

    chains: id, survivor; patients: patient_id, full_name.
    """
    rows = items.select(F.lit("review_item").alias("kind"), F.col("id").cast("string").alias("id"), "type", "title", "patient", "at", "status").unionByName(
        intakes.select(F.lit("intake").alias("kind"), F.col("id").cast("string").alias("id"), F.col("state").alias("type"), "title", "patient", "at", F.col("state").alias("status")))
    named = chains.select(F.col("id").alias("patient"), "survivor").join(patients.select(F.col("patient_id").alias("survivor"), F.col("full_name").alias("patient_name")), "survivor")
    return rows.join(named, "patient", "left").select("kind", "id", "type", "title", F.col("survivor").alias("patient_id"), "patient_name", "at", "status")


def filtered_counts(rows: DataFrame, filters: DataFrame, key: str, band: Column) -> DataFrame:
    """(key, n) of work rows under each of many stored filters (key, filters as `filters_of` gives them).

    band: today, week or older of a row, null for none. Rows are counted by their closed words first, at most 132
    combinations, and filters meet those counts, never the rows. An empty selection counts nothing.
    """
    counts = rows.groupBy("kind", "type", F.when(F.col("kind") == "review_item", F.col("status")).alias("status"), band.alias("band")).agg(F.count("*").alias("n"))
    counts = counts.where(F.col("type").isin(*TYPES, *STATES)).select("kind", "type", F.struct("status", "band", "n").alias("c"))
    f = filters.select(key, F.col("filters.status").alias("status"), F.col("filters.age").alias("age"), F.explode_outer(F.concat(
        F.transform("filters.types", lambda t: F.struct(F.lit("review_item").alias("kind"), t.alias("type"))), F.transform("filters.states", lambda s: F.struct(F.lit("intake").alias("kind"), s.alias("type"))))).alias("w"))
    met = f.select(key, "status", "age", "w.kind", "w.type").join(F.broadcast(counts), ["kind", "type"], "left")
    good = (F.col("age").isNull() | F.col("age").eqNullSafe(F.col("c.band"))) & (F.col("c.status").isNull() | (F.col("c.status") == F.col("status")))
    return met.groupBy(key).agg(F.coalesce(F.sum(F.when(good, F.col("c.n"))), F.lit(0)).alias("n"))
