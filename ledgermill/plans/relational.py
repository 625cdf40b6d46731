"""Joins, counts, tables, sets, order and search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import detectors as X
from ..sources import files as S
from .registry import query, table


@query("SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 20 = 0 THEN 10000000 ELSE 0 END AS cust FROM orders WHERE o_orderkey % 20 = 0")
def d4_orphans(spark, sf):
    """Orders whose customer isn't there (every 20th is pointed past the keys)."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 20 == 0, 10000000).otherwise(0)).alias("cust"))
    return X.orphans(o, table(spark, sf, "customer"), "cust", "c_custkey").select("o_orderkey", "cust")


@query("SELECT c_custkey, (SELECT min(ts) FROM events WHERE user_id = c_custkey)::VARCHAR AS first_seen FROM customer")
def d16_first_audit(spark, sf):
    """A correlated minimum as a group join."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    c = table(spark, sf, "customer")
    return c.join(e, c.c_custkey == e.user_id, "left").select("c_custkey", F.col("first_seen").cast("string"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey * 100 + (c_custkey % 90) AS e, floor(c_acctbal / 10)::BIGINT AS b FROM customer WHERE c_acctbal >= 0)
SELECT x.c_custkey AS a, min(y.c_custkey) AS b, count(*) FILTER (WHERE x.e = y.e) AS by_e, count(*) FILTER (WHERE x.b = y.b) AS by_q FROM c x JOIN c y ON x.e = y.e OR x.b = y.b WHERE x.c_custkey % 7 = 3 AND y.c_custkey % 7 <> 3 GROUP BY 1""")
def d17_or_match(spark, sf):
    """Rows (a seventh of them, the submissions) that agree with others in either of two columns, as two equi joins."""
    c = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey", (F.col("c_nationkey") * 100 + F.col("c_custkey") % 90).cast("long").alias("e"), F.floor(F.col("c_acctbal") / 10).alias("b"))
    x, y = c.select(F.col("c_custkey").alias("a"), "e", F.col("b").alias("q")), c.select(F.col("c_custkey").alias("b"), F.col("e").alias("e2"), F.col("b").alias("q2"))
    return A.either_match(x.where("a % 7 = 3"), y.where("b % 7 <> 3"), [("e", "e2"), ("q", "q2")], ("a", "b"))


@query("""SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 HAVING count(*) > 50""")
def d19_unnest(spark, sf):
    """Tokens of whole texts, unnested and counted."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    per = d.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where("n > 50")


@query("""WITH m AS (SELECT o_orderkey, o_orderstatus, count(*) AS lines, sum(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderstatus, count(*) AS n, sum(lines)::BIGINT AS lines, round(sum(qty), 1) AS qty FROM m GROUP BY 1""")
def d2_group_join(spark, sf):
    """Rows grouped per owner, then joined."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"), F.round(F.sum("qty"), 1).alias("qty"))


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND ts >= TIMESTAMP '2024-01-01')
AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND event_type = 'error' AND ts < TIMESTAMP '2024-01-05')""")
def d10_semi_anti(spark, sf):
    """D10, D15."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey")
    c = table(spark, sf, "customer").select("c_custkey")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return c.join(e.where(F.col("ts") >= start), "c_custkey", "left_semi").join(e.where((F.col("event_type") == "error") & (F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"))), "c_custkey", "left_anti")


@query("""SELECT * FROM (SELECT 'customers' AS name, count(*) AS n FROM customer UNION ALL SELECT 'negative', count(*) FILTER (WHERE c_acctbal < 0) FROM customer
UNION ALL SELECT 'building', count(*) FILTER (WHERE c_mktsegment = 'BUILDING') FROM customer)""")
def e4_scalar_counts(spark, sf):
    """Many measures in one pass."""
    return A.scalar_counts(table(spark, sf, "customer"), {"customers": F.lit(True), "negative": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING"})


@query("SELECT text_hash, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english FROM (SELECT sha256(text) AS text_hash, lang FROM documents) GROUP BY 1 HAVING count(*) > 1")
def e7_shared_value(spark, sf):
    """Values of more than one row."""
    d = table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "lang")
    return A.shared_values(d, "text_hash", {"english": F.col("lang") == "en"})


@query("WITH s AS (SELECT text, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM s")
def e8_duplicate_stats(spark, sf):
    """E8, E18."""
    return A.duplicate_stats(table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h")), "h")


@query("""WITH v AS (SELECT * FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(status)), p AS (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) t(priority))
SELECT status, priority, count(o_orderkey) AS n FROM v CROSS JOIN p LEFT JOIN orders ON o_orderstatus = status AND o_orderpriority = priority GROUP BY 1, 2""")
def e10_outcome_matrix(spark, sf):
    """Closed vocabularies against each other, zeros included."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    words = lambda c, w: spark.createDataFrame([(x,) for x in w], f"{c} string")
    return A.matrix(o, "status", "priority", words("status", ["F", "O", "P", "X"]), words("priority", ["1-URGENT", "2-HIGH", "9-NONE"]))


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types, round(min(p_retailprice), 2) AS least, round(max(p_retailprice), 2) AS largest FROM part GROUP BY 1")
def e5_count_distinct(spark, sf):
    """E1, E5, E6, E12."""
    return table(spark, sf, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.countDistinct("p_type").alias("types"), F.round(F.min("p_retailprice"), 2).alias("least"), F.round(F.max("p_retailprice"), 2).alias("largest"))


@query("""SELECT coalesce(o_orderstatus, 'total') AS o_orderstatus, coalesce(o_orderpriority, 'total') AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def e15_crosstab(spark, sf):
    """A table with totals."""
    return A.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT a.p_brand, b.size FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_size AS size FROM part) b EXCEPT SELECT p_brand, p_size FROM part")
def e21_variation(spark, sf):
    """Brands and sizes that never occur together."""
    return A.variation(table(spark, sf, "part").select("p_brand", F.col("p_size").alias("size")), "p_brand", "size")


@query("SELECT user_id FROM events UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def h2_union_distinct(spark, sf):
    """H2."""
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("user_id"))
    return table(spark, sf, "events").select("user_id").union(o).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events")
def h4_set_difference(spark, sf):
    """H4."""
    c, e = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return c.join(e, "c_custkey", "left_anti").distinct()


@query("""SELECT kind, age, id FROM (SELECT 'item' AS kind, CASE WHEN o_orderkey % 10 <> 0 THEN (DATE '2002-01-01' - o_orderdate::DATE)::BIGINT END AS age, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'event', (DATE '2025-01-01' - ts::DATE)::BIGINT, event_id FROM events WHERE event_type = 'error') ORDER BY CASE kind WHEN 'item' THEN 0 ELSE 1 END, age NULLS LAST, id LIMIT 501""")
def g1_queue(spark, sf):
    """One work list of a page and one row more."""
    days = lambda end, c: F.datediff(F.lit(end).cast("date"), F.to_date(c)).cast("long")
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.lit("item").alias("kind"), F.when(F.col("o_orderkey") % 10 != 0, days("2002-01-01", "o_orderdate")).alias("age"), F.col("o_orderkey").alias("id"))
    e = table(spark, sf, "events").where("event_type = 'error'").select(F.lit("event").alias("kind"), days("2025-01-01", "ts").alias("age"), F.col("event_id").alias("id"))
    return A.queue([o, e], ["item", "event"], 500)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%' OR p_partkey::VARCHAR = 'ring' ORDER BY lower(p_name), p_partkey LIMIT 10")
def c3_search(spark, sf):
    """Search by part of a name or by key (a top-ten list)."""
    return A.search(table(spark, sf, "part"), "ring", ["p_name"], "p_partkey", "p_name").select("p_partkey", "p_name")


@query("""SELECT w, count(*) AS n FROM (SELECT CASE WHEN ts >= TIMESTAMP '2024-01-19 23:00:00' THEN 'today' WHEN ts >= TIMESTAMP '2024-01-13 23:00:00' THEN 'week' ELSE 'older' END AS w FROM events) GROUP BY 1""")
def c2_age_window(spark, sf):
    """By clinic midnights before 2024-01-20 (an hour ahead of UTC)."""
    e = table(spark, sf, "events")
    w = F.lit(None).cast("string")
    for k in ("older", "week", "today"):
        w = F.when(A.age_window(F.col("ts"), "2024-01-20", k), k).otherwise(w)
    return e.groupBy(w.alias("w")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0)")
def m20_dedupe_append(spark, sf):
    """A second run adds nothing; keys already stored are left out."""
    new = table(spark, sf, "customer").select("c_custkey", "c_name")
    have = new.where("c_custkey % 3 = 0")
    first = S.append_new(new, have, ["c_custkey"])
    return first.unionByName(S.append_new(new, have.unionByName(first), ["c_custkey"]))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer""")
def a11_upsert(spark, sf):
    """The next snapshot."""
    have = table(spark, sf, "customer").select("c_custkey", "c_name")
    return S.upsert(have, have.where("c_custkey % 4 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("""SELECT o_orderkey, CASE WHEN s LIKE '%"%' OR s LIKE '%,%' THEN '"' || replace(s, '"', '""') || '"' ELSE s END || ',' || o_orderkey AS line FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a,"b"' ELSE o_orderstatus END AS s FROM orders)""")
def a2_csv_record(spark, sf):
    """A2: minimal quoting."""
    s = F.when(F.col("o_orderkey") % 3 == 0, 'a,"b"').otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", S.csv_record(s, F.col("o_orderkey")).alias("line"))


@query(r"""SELECT 'raw' AS section, 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'raw', 'orders', count(*) FROM orders UNION ALL SELECT 'raw', 'events', count(*) FROM events""")
def report_came_in(spark, sf):
    """Q, E4, A9, G5: what came in."""
    out = None
    for t in ("documents", "orders", "events"):
        one = table(spark, sf, t).agg(F.lit("raw").alias("section"), F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'unlabelled' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
SELECT 'negative balance', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def report_quarantined(spark, sf):
    """Q, D4: what was put aside."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").agg(F.lit("unlabelled").alias("name"), F.count("*").alias("n"))
    c = table(spark, sf, "customer")
    neg = c.where("c_acctbal < 0").agg(F.lit("negative balance").alias("name"), F.count("*").alias("n"))
    lone = c.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.lit("no orders").alias("name"), F.count("*").alias("n"))
    return d.unionByName(neg).unionByName(lone)


@query("""SELECT field, count(*) AS n, count(*) FILTER (WHERE trimmed) AS trimmed FROM (SELECT 'p_name' AS field, p_name <> trim(p_name) AS trimmed FROM part UNION ALL SELECT 'c_name', c_name <> trim(c_name) FROM customer) GROUP BY 1""")
def report_cleaned(spark, sf):
    """Q, B1: fields looked at and values trimmed."""
    one = lambda t, c: table(spark, sf, t).select(F.lit(c).alias("field"), T.has_edge_space(F.col(c)).alias("x"))
    return one("part", "p_name").unionByName(one("customer", "c_name")).groupBy("field").agg(F.count("*").alias("n"), F.count_if("x").alias("trimmed"))


@query("SELECT o_orderpriority AS kind, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1, 2")
def p8_queue_counts(spark, sf):
    """Counts by kind and state."""
    return A.tally(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("state")), "kind", "state")


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def g4_latest_run(spark, sf):
    """The latest row (a list of one)."""
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", F.col("o_orderdate").cast("string").alias("at"))
