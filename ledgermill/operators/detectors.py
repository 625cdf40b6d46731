"""Detectors: queries that find rows for a person to decide on, and the sinks for what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import age_at, read_by_separator, swapped
from ..functions.text import dedupe_key
from .items import item

NUMBER_FIELDS = ("alcohol_units_week", "weight_kg", "height_cm")  # fixed values


def unseen_values(flags: DataFrame, key: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """M2: (one item per field and raw value that is in no vocabulary or no number, all of its rows as (dedupe_key, key)).

    The rows stay a table beside the items: a value may stand on any number of them."""
    own = flags.where("kind in ('vocabulary_unseen', 'non_numeric')").withColumn("_number", F.col("field").isin(*NUMBER_FIELDS))
    rule = F.when(F.col("_number"), "NON_NUMERIC_TO_NULL").otherwise("VOCAB_UNKNOWN")
    ident = [F.lit("vocabulary"), F.lit(entity), F.col("field"), rule, F.col("raw")]
    rows = own.select(dedupe_key(F.lit("vocabulary"), *ident).alias("dedupe_key"), key)
    groups = own.groupBy("field", "raw", "_number").agg(F.count("*").alias("n"), F.min(key).alias("first_row"))
    said = F.concat(F.lit("`"), F.col("raw"), F.lit("` on "), F.col("n").cast("string"), F.lit(" rows"))
    title = F.when(F.col("_number"), F.concat(F.col("field"), F.lit(": "), said, F.lit(" is not a number: zero or not answered?"))).otherwise(F.concat(F.col("field"), F.lit(": unseen value "), said))
    payload = {"entity": F.lit(entity), "field": F.col("field"), "raw": F.col("raw"), "n": F.col("n"), "first_row": F.col("first_row").cast("string")}
    return item(groups, "vocabulary", title, None, payload, F.col("field"), ident[1:], scope="vocabulary"), rows


def field_diff(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, from_value, to_value) of every column that differs, nulls compared safely."""
    s = stored.select(key, *[F.col(f).cast("string").alias(f"s_{f}") for f in fields])
    i = incoming.select(key, *[F.col(f).cast("string").alias(f"i_{f}") for f in fields])
    one = lambda f: F.when(~F.col(f"s_{f}").eqNullSafe(F.col(f"i_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"s_{f}").alias("from_value"), F.col(f"i_{f}").alias("to_value")))
    return s.join(i, key).select(key, F.explode(F.array_compact(F.array(*map(one, fields)))).alias("c")).select(key, "c.*")


def repeated_keys(rows: DataFrame, key: str, order: str, content: Column) -> DataFrame:
    """M5: later rows of a key whose content isn't the first's."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("_c", content).withColumn("nth", F.row_number().over(w)).withColumn("_f", F.first("_c").over(w))
    return r.where((F.col("nth") > 1) & ~F.col("_c").eqNullSafe(F.col("_f"))).drop("_c", "_f")


def human_owned(audit: DataFrame, actors: list[str]) -> DataFrame:
    """Per entity and field the first change by a person: audit(entity_id, actor, at, seq, field, to_value)."""
    own = audit.where(~F.col("actor").isin(actors))
    return own.groupBy("entity_id", "field").agg(F.min_by("to_value", F.struct("at", "seq")).alias("value"), F.min("at").alias("since"))


def human_conflicts(diff: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """M6: incoming changes to fields that a person owns."""
    o = owned.select(F.col("entity_id").alias(key), "field", F.col("value").alias("owned_value"))
    return diff.join(o, [key, "field"]).where(~F.col("to_value").eqNullSafe(F.col("owned_value")))


def age_flips(rows: DataFrame, raw: str, at: Column, limit: int = 18) -> DataFrame:
    """M7: rows whose subject is a minor under one reading of the birth date and an adult under the other."""
    # bound once by lambdas: a filter on plain columns would be pushed down with every reading written out again
    pair = lambda d, o: F.struct(age_at(d, at).alias("a"), age_at(o, at).alias("b"))
    both = F.transform(F.array(read_by_separator(F.col(raw))), lambda d: F.get(F.transform(F.array(swapped(d)), lambda o: pair(d, o)), F.lit(0)))
    r = rows.withColumn("_ages", F.get(both, F.lit(0)))
    r = r.where((F.col("_ages.a") < limit) != (F.col("_ages.b") < limit))
    return r.withColumns({"age_read": F.col("_ages.a"), "age_other": F.col("_ages.b")}).drop("_ages")


def shifted(rows: DataFrame, born: str, signup: str, related: DataFrame, key: str) -> DataFrame:
    """M8: subjects born after they signed up, with the number of their related rows."""
    n = related.groupBy(key).agg(F.count("*").alias("related"))
    return rows.where(F.col(born) > F.col(signup)).join(n, key, "left").withColumn("related", F.coalesce("related", F.lit(0)))


def orphans(rows: DataFrame, owners: DataFrame, key: str, owner_key: str) -> DataFrame:
    """Rows without an owner."""
    return rows.join(owners.select(F.col(owner_key).alias(key)).distinct(), key, "left_anti")


def plausibility(values: DataFrame, owner: str, field: str, value: str, low: float, high: float) -> DataFrame:
    """Per owner and field the values outside the bounds, with the shifted reading where one fits."""
    from ..functions.text import decimal_shift

    out = values.where(~F.col(value).between(low, high))
    return out.groupBy(owner, field).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), F.count(decimal_shift(F.col(value), low, high)).alias("shiftable"))


def divergence(pairs: DataFrame, owner: str, ratio: Column, low: float, high: float) -> DataFrame:
    """Owners all of whose comparable rows lie outside the tolerance."""
    r = pairs.select(owner, ratio.alias("_r"))
    g = r.groupBy(owner).agg(F.count("_r").alias("comparable"), F.count_if(~F.col("_r").between(low, high)).alias("outside"))
    return g.where("comparable > 0 and outside = comparable")


def reconciliation(pairs: DataFrame, owner: str, ratio: Column, factor: float, low: float, high: float) -> DataFrame:
    """Rows and owners in tolerance as they are, after one conversion, and in neither reading."""
    r = pairs.select(owner, ratio.alias("_r"))
    plain, scaled = F.col("_r").between(low, high), (F.col("_r") * factor).between(low, high)
    kind = F.when(plain, "plain").when(scaled, "converted").when(F.col("_r").isNotNull(), "neither").otherwise("missing")
    return r.groupBy(kind.alias("reading")).agg(F.count("*").alias("rows"), F.countDistinct(owner).alias("owners"))


def same_day(rows: DataFrame, owner: str, day: str, row: str) -> DataFrame:
    """Owners with more than one row on a day."""
    return rows.groupBy(owner, day).agg(F.count("*").alias("n"), F.min(row).alias("first_row")).where("n > 1")


def state_items(states: DataFrame, subjects: DataFrame, key: str, status: str) -> DataFrame:
    """What each state asks for, by the subject's status."""
    ask = (
        F.when(F.col("state") == "conflict", "settle the conflict").when((F.col("state") == "revoked") & (F.col(status) == "active"), "stop processing")
        .when(F.col("state").isin("no_record", "unknown_pre_log") & (F.col(status) == "active"), "ask again")
    )
    return states.join(subjects.select(key, status), key).withColumn("ask", ask).where("ask is not null")


def future_rows(rows: DataFrame, at: str, as_of_end) -> DataFrame:
    """Rows after the run's day; they are counted, not dropped."""
    return rows.where(F.col(at) > as_of_end)


def clinical_items(evaluated: DataFrame, key: str) -> DataFrame:
    """One row per matched rule of an evaluated row."""
    return evaluated.select(key, "outcome", F.explode("matched").alias("rule"))


def possible_existing(submission: DataFrame, existing: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(submission, kind, holders, existing): per kind of key that stored rows share with a submission, their number
    and the least of them. Stored rows are counted per value first, so a value that many rows hold stays one row."""
    out = None
    for k in keys:
        held = existing.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("holders"), F.min(key).alias("existing"))
        one = submission.select(F.col(key).alias("submission"), F.col(k)).join(held, k).select("submission", F.lit(k).alias("kind"), "holders", "existing")
        out = one if out is None else out.unionByName(one)
    return out


def unit_missing(rows: DataFrame, raw: str, cm: Column) -> DataFrame:
    """Both readings of a number without a unit, and the index of each."""
    n = F.col(raw).try_cast("decimal(9,1)")
    lbs = F.round(n * F.lit("0.45359237").cast("decimal(9,8)"), 1)
    index = lambda kg: F.round(kg.cast("double") * 10000 / (cm * cm), 1)
    return rows.withColumns({"as_kg": n, "as_lbs": lbs, "index_kg": index(n), "index_lbs": index(lbs)})
