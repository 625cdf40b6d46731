"""Queries that combine operators: readings, histories, candidates, confirmations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import detectors as X
from ..operators import events as E
from ..operators import identity as I
from .identity import _C, placed
from .normalising import _RAW, _READ, raw_dates
from .registry import query, table


@query(f"""WITH {_RAW}, {_READ}, a AS (SELECT o_orderkey, d, CASE WHEN day(d) <> month(d) THEN try_strptime(strftime(d, '%Y-%d-%m'), '%Y-%m-%d')::DATE END AS o, (DATE '1992-01-01' + INTERVAL 18 YEAR + ((o_orderkey % 2500)::INT) * INTERVAL 1 DAY)::DATE AS seen FROM rd),
y AS (SELECT *, year(seen) - year(d) - CASE WHEN (month(seen), day(seen)) < (month(d), day(d)) THEN 1 ELSE 0 END AS a1, year(seen) - year(o) - CASE WHEN (month(seen), day(seen)) < (month(o), day(o)) THEN 1 ELSE 0 END AS a2 FROM a WHERE seen >= d AND seen >= o)
SELECT o_orderkey, a1::INTEGER AS age_read, a2::INTEGER AS age_other FROM y WHERE (a1 < 18) <> (a2 < 18)""")
def m7_age_flips(spark, sf):
    """M7: minors under one reading of the day and month, adults under the other."""
    seen = F.date_add(D.shift_years(F.lit("1992-01-01").cast("date"), 18), (F.col("o_orderkey") % 2500).cast("int"))
    return X.age_flips(raw_dates(spark, sf), "raw", seen).select("o_orderkey", F.col("age_read").cast("int"), F.col("age_other").cast("int"))


@query("""SELECT p_partkey, round(p_size::DOUBLE, 1) AS as_kg, round((p_size::DECIMAL(9,1) * 0.45359237::DECIMAL(9,8))::DECIMAL(18,1)::DOUBLE, 1) AS as_lbs, round(p_size * 10000.0 / (170 * 170), 1) AS index_kg FROM part""")
def m14_both_readings(spark, sf):
    """A number without a unit, read both ways."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("raw"))
    u = X.unit_missing(p, "raw", F.lit(170))
    return u.select("p_partkey", F.round(F.col("as_kg").cast("double"), 1).alias("as_kg"), F.round(F.col("as_lbs").cast("double"), 1).alias("as_lbs"), "index_kg")


@query(f"""WITH RECURSIVE {_C}, m AS (SELECT * FROM c JOIN p USING (doc_id)),
d AS (SELECT root, concat_ws(',', CASE WHEN count(DISTINCT lang) > 1 THEN 'lang' END, CASE WHEN count(DISTINCT source) > 1 THEN 'source' END, CASE WHEN count(DISTINCT n_chars) > 1 THEN 'n_chars' END) AS differing FROM m GROUP BY root)
SELECT root, doc_id, lang, source, n_chars, differing FROM m JOIN d USING (root)""")
def k10_side_by_side(spark, sf):
    """Candidates of each group side by side, and what differs."""
    s = I.side_by_side(placed(spark, sf), "doc_id", ["lang", "source", "n_chars"])
    return s.withColumn("differing", F.array_join("differing", ","))


@query("SELECT c_nationkey AS patient, min(c_custkey) AS lowest, count(*) AS n FROM customer GROUP BY 1")
def f10_lowest_id(spark, sf):
    """The lowest key of each owner's members."""
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("patient")).agg(F.min("c_custkey").alias("lowest"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_custkey AS legacy_id, CASE WHEN c_custkey % 6 = 0 AND c_custkey > 0 THEN c_custkey - 1 ELSE c_custkey END AS patient_id FROM customer)
SELECT o_orderkey, patient_id, patient_id = o_custkey AS created_here FROM orders LEFT JOIN a ON legacy_id = o_custkey""")
def k12_aliases(spark, sf):
    """Rows resolved through the alias map."""
    k = F.col("c_custkey")
    a = table(spark, sf, "customer").select(k.alias("legacy_id"), F.when((k % 6 == 0) & (k > 0), k - 1).otherwise(k).alias("patient_id"))
    r = I.resolve_aliases(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), a, "o_custkey")
    return r.select("o_orderkey", "patient_id", (F.col("patient_id") == F.col("o_custkey")).alias("created_here"))


@query("""WITH s AS (SELECT c_custkey AS k, DATE '1990-01-01' + (c_custkey % 4000)::INT AS born, DATE '1993-06-01' AS signup FROM customer)
SELECT k, (SELECT count(*) FROM orders WHERE o_custkey = k) AS related FROM s WHERE born > signup""")
def m8_shifted(spark, sf):
    """M8: subjects born after they signed up, with their rows."""
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 4000).cast("int")).alias("born"), F.lit("1993-06-01").cast("date").alias("signup"))
    return X.shifted(s, "born", "signup", table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k").select("k", "related")


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_action, arg_max(event_type, (ts, event_id)) AS last_action, count(*) AS n_events FROM events GROUP BY 1""")
def f2_ends(spark, sf):
    """first and last action of each subject."""
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return E.ends(e, ["user_id"]).select("user_id", "first_action", "last_action", "n_events")
