"""Profiles and detectors: percentiles, shapes, bands, tolerances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import detectors as X
from .registry import query, table

_D = lambda p: f"quantile_disc(l_extendedprice, {p})"


@query(f"SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS largest, {_D(0.05)} AS p5, {_D(0.5)} AS median, {_D(0.95)} AS p95 FROM lineitem GROUP BY 1")
def e13_percentiles(spark, sf):
    """Nearest rank."""
    return A.nearest_rank(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], {"p5": 0.05, "median": 0.5, "p95": 0.95})


_RATIO = "l_extendedprice / (l_quantity * p_retailprice)"


def ratios(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    r = F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_partkey", r.alias("ratio"))


@query(f"""SELECT CASE WHEN r < 0.5 THEN '<0.5' WHEN r < 0.9 THEN '0.5-0.9' WHEN r < 1.1 THEN '0.9-1.1' WHEN r < 2 THEN '1.1-2' WHEN r < 10 THEN '2-10' ELSE '>=10' END AS band, count(*) AS n
FROM (SELECT {_RATIO} AS r FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def b26_band_counts(spark, sf):
    """Bands of the price ratio."""
    return ratios(spark, sf).groupBy(T.band(F.col("ratio"), [0.5, 0.9, 1.1, 2, 10]).alias("band")).agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, count(*) AS comparable, count(*) FILTER (WHERE r < 0.9 OR r > 1.1) AS outside FROM (SELECT l_orderkey, {_RATIO} AS r FROM lineitem JOIN part ON p_partkey = l_partkey)
GROUP BY 1 HAVING count(*) FILTER (WHERE r < 0.9 OR r > 1.1) = count(*)""")
def m12_divergence(spark, sf):
    """Orders all of whose lines are out of tolerance."""
    return X.divergence(ratios(spark, sf), "l_orderkey", F.col("ratio"), 0.9, 1.1)


@query(f"""SELECT CASE WHEN r BETWEEN 0.9 AND 1.1 THEN 'plain' WHEN r * 0.45359237 BETWEEN 0.9 AND 1.1 THEN 'converted' ELSE 'neither' END AS reading, count(*) AS rows, count(DISTINCT l_partkey) AS owners
FROM (SELECT l_partkey, {_RATIO} AS r FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def m13_reconcile(spark, sf):
    """Rows explained by one conversion."""
    return X.reconciliation(ratios(spark, sf), "l_partkey", F.col("ratio"), 0.45359237, 0.9, 1.1)


@query("""SELECT c_nationkey AS owner, 'balance' AS field, count(*) AS n, round(min(b), 4) AS least, round(max(b), 4) AS largest,
 count(*) FILTER (WHERE (b * 10 BETWEEN 500 AND 9000)::INT + (b * 100 BETWEEN 500 AND 9000)::INT = 1) AS shiftable FROM (SELECT c_nationkey, c_acctbal AS b FROM customer) WHERE b < 500 OR b > 9000 GROUP BY 1""")
def m11_plausibility(spark, sf):
    """Values outside the bounds, and those that a moved decimal point explains."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("owner"), F.lit("balance").alias("field"), F.col("c_acctbal").alias("b"))
    p = X.plausibility(c, "owner", "field", "b", 500, 9000)
    return p.withColumns({"least": F.round("least", 4), "largest": F.round("largest", 4)})


@query("SELECT o_custkey, o_orderdate::DATE::VARCHAR AS day, count(*) AS n, min(o_orderkey) AS first_row FROM orders GROUP BY o_custkey, o_orderdate::DATE HAVING count(*) > 1")
def m15_same_day(spark, sf):
    """Several orders of one customer on a day."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return X.same_day(o, "o_custkey", "day", "o_orderkey").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 23:59:59.999' GROUP BY 1")
def m8_future_rows(spark, sf):
    """Rows after the day of the run."""
    end = F.lit("2024-01-20 23:59:59.999").cast("timestamp_ntz")
    return A.tally(X.future_rows(table(spark, sf, "events"), "ts", end), "event_type")


def _odd_statuses(spark, sf):
    from ..operators import normalise as N

    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 9 == 2, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    mapped = {"status": N.map_vocabulary(F.col("raw"), "status", {"F": "F", "O": "O", "P": "P"}), "weight_kg": N.map_weight(F.col("kg"), None, 30, 300)}
    kg = F.when(F.col("o_orderkey") % 11 == 4, F.concat(F.lit("about "), F.col("o_orderkey") % 5)).otherwise("80")
    rows = N.map_rows(o.select("o_orderkey", raw.alias("raw"), kg.alias("kg")), "o_orderkey", mapped)
    return X.unseen_values(N.evidence(rows, "o_orderkey", "flags"), "o_orderkey", "legacy_intake")


_ODD = """f AS (SELECT o_orderkey, 'status' AS field, lower(o_orderstatus) AS raw FROM orders WHERE o_orderkey % 9 = 2 UNION ALL SELECT o_orderkey, 'weight_kg', 'about ' || (o_orderkey % 5) FROM orders WHERE o_orderkey % 11 = 4),
k AS (SELECT *, 'vocabulary|vocabulary|legacy_intake|' || field || CASE WHEN field = 'weight_kg' THEN '|NON_NUMERIC_TO_NULL|' ELSE '|VOCAB_UNKNOWN|' END || raw AS dedupe_key FROM f)"""


@query(f"""WITH {_ODD} SELECT dedupe_key, field, field || CASE WHEN field = 'weight_kg' THEN ': `' ELSE ': unseen value `' END || raw || '` on ' || count(*) || ' rows' || CASE WHEN field = 'weight_kg' THEN ' is not a number: zero or not answered?' ELSE '' END AS title,
 '{{"entity":"legacy_intake","field":"' || field || '","raw":"' || raw || '","n":' || count(*) || ',"first_row":"' || min(o_orderkey) || '"}}' AS payload FROM k GROUP BY dedupe_key, field, raw""")
def m2_unseen_values(spark, sf):
    """M2: an item per unseen spelling and per word where a number should be."""
    return _odd_statuses(spark, sf)[0].select("dedupe_key", "field", "title", "payload")


@query(f"WITH {_ODD} SELECT dedupe_key, o_orderkey FROM k")
def m2_unseen_rows(spark, sf):
    """M2: all rows of each of those items."""
    return _odd_statuses(spark, sf)[1]


@query("""WITH f AS (SELECT l_shipmode, p, min(k) AS o FROM (SELECT l_returnflag AS l_shipmode, (l_partkey % 50)::VARCHAR AS p, l_orderkey AS k FROM lineitem) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_shipmode ORDER BY o, p) AS n FROM f)
SELECT l_shipmode AS g, (SELECT count(*) FROM lineitem WHERE l_returnflag = l_shipmode) AS n, string_agg(p, ',' ORDER BY r.n) FILTER (WHERE r.n <= 3) AS examples FROM r GROUP BY l_shipmode""")
def e14_examples(spark, sf):
    """Counts with the first three examples."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_partkey") % 50).cast("string").alias("p"), "l_orderkey")
    return A.with_examples(li, "g", "p", "l_orderkey").select("g", "n", F.array_join("examples", ",").alias("examples"))


@query("SELECT term, count(*) FILTER (WHERE contains(lower(text), term)) AS n FROM documents, (SELECT unnest(['idiot', 'license', 'the ', 'zzzz']) AS term) GROUP BY 1")
def e24_term_counts(spark, sf):
    """Terms anywhere in whole texts."""
    return A.term_counts(table(spark, sf, "documents"), "text", ["idiot", "license", "the ", "zzzz"])


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY 1")
def e25_token_inventory(spark, sf):
    """E25."""
    return A.inventory(table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("token")), "token")


@query("SELECT length(p_name)::INTEGER AS chars, count(*) AS n FROM part GROUP BY 1")
def e19_lengths(spark, sf):
    """E19."""
    return A.lengths(table(spark, sf, "part"), "p_name")


@query("SELECT n AS rows, count(*) AS keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def e23_rows_per_key(spark, sf):
    """E23."""
    return A.count_distribution(table(spark, sf, "orders"), "o_custkey")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a > 12 AND b <= 12 THEN 'day-month' WHEN a <= 12 AND b > 12 THEN 'month-day' WHEN a = b THEN 'same' ELSE 'either' END AS kind
 FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) ELSE month(o_orderdate) END AS a, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE day(o_orderdate) END AS b FROM orders)) GROUP BY 1""")
def b27_date_order(spark, sf):
    """What order the parts of a date allow."""
    from ..functions import dates as D

    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "MM-dd-yyyy"))
    return table(spark, sf, "orders").select(D.classify_order(raw).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT 'negative balance' AS failed, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'low key', count(*) FROM customer WHERE c_custkey < 10 HAVING count(*) > 0
UNION ALL SELECT 'no nation', count(*) FROM customer WHERE c_nationkey IS NULL HAVING count(*) > 0""")
def c8_violations(spark, sf):
    """Rows that break a table's checks, by check."""
    from ..operators.normalise import failed_checks

    checks = {"negative balance": F.col("c_acctbal") >= 0, "low key": F.col("c_custkey") >= 10, "no nation": F.col("c_nationkey").isNotNull()}
    return failed_checks(table(spark, sf, "customer"), checks).select(F.explode("failed").alias("failed")).groupBy("failed").agg(F.count("*").alias("n"))
