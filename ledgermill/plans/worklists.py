"""Queries over the reviewers' work list, made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import worklist as W
from ..operators.aggregates import age_window
from .events import _CHAIN, forest
from .registry import query, table

AS_OF = "2024-01-20"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: Query strings of each kind; a customer's key picks one.
_ASKED = ["", "?type=consent", "?type=consent&type=vocabulary&state=draft", "?status=resolved", "?status=none&age=week", "?type=", "?state=in_review&age=today", "?type=drop%20table&state=legacy_pending", "?type=data%5Fquality&status=dismissed&status=open&age=older", "?age=older", "?x=1&&type"]
_WORK = f"""w AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'review_item' ELSE 'intake' END AS kind, CASE WHEN event_id % 2 = 0 THEN {_LIST(W.TYPES)}[1 + event_id % 7] ELSE {_LIST(W.STATES)}[1 + event_id % 12] END AS type,
 CASE WHEN event_id % 2 = 0 THEN {_LIST(W.STATUSES)}[1 + event_id // 2 % 3] END AS status, user_id AS patient,
 CASE WHEN ts >= TIMESTAMP '2024-01-19 23:00:00' THEN 'today' WHEN ts >= TIMESTAMP '2024-01-13 23:00:00' THEN 'week' ELSE 'older' END AS band FROM events)"""
_READ = [
    (W.TYPES, W.DEFAULT_STATES, "open", None), (("consent",), (), "open", None), (("consent", "vocabulary"), ("draft",), "open", None), (W.TYPES, W.DEFAULT_STATES, "resolved", None), (W.TYPES, W.DEFAULT_STATES, "open", "week"), ((), (), "open", None),
    ((), ("in_review",), "open", "today"), ((), ("legacy_pending",), "open", None), (("data_quality",), (), "dismissed", "older"), (W.TYPES, W.DEFAULT_STATES, "open", "older"), ((), (), "open", None)]
_READ_SQL = ", ".join(f"({i}, {_LIST(t)}::VARCHAR[], {_LIST(s)}::VARCHAR[], '{st}', {repr(a) if a else 'NULL'})" for i, (t, s, st, a) in enumerate(_READ))


@query(f"""WITH {_WORK}, f AS (SELECT * FROM (VALUES {_READ_SQL}) t(i, types, states, st, age)), n AS (SELECT i, (SELECT count(*) FROM w WHERE (age IS NULL OR band = age) AND ((kind = 'review_item' AND list_contains(types, type) AND status = st) OR (kind = 'intake' AND list_contains(states, type)))) AS n FROM f)
SELECT c_custkey, n FROM customer JOIN n ON i = c_custkey % {len(_ASKED)}""")
def p8_queue_filters(spark, sf):
    """How many rows of the work list each customer's stored query string asks for."""
    asked = F.get(F.array(*map(F.lit, _ASKED)), (F.col("c_custkey") % len(_ASKED)).cast("int"))
    stored = table(spark, sf, "customer").select("c_custkey", W.filters_of(asked).alias("filters"))
    band = F.lit(None).cast("string")
    for k in ("older", "week", "today"):
        band = F.when(age_window(F.col("at"), AS_OF, k), k).otherwise(band)
    return W.filtered_counts(_work(spark, sf), stored, "c_custkey", band)


@query(f"""WITH RECURSIVE {_CHAIN}, {_WORK} SELECT w.kind, w.id::VARCHAR AS id, w.type, c_custkey AS patient_id, c_name AS patient_name FROM w LEFT JOIN surv ON surv.id = patient AND patient % 5 <> 0 LEFT JOIN customer ON c_custkey = survivor""")
def d7_work_rows(spark, sf):
    """The rows of the work list with the record that theirs was merged into; every fifth names none."""
    return _work(spark, sf).select("kind", "id", "type", "patient_id", "patient_name")


def _work(spark, sf):
    i = F.col("event_id")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), n.cast("int"))
    e = table(spark, sf, "events").select(i.alias("id"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("patient"), F.col("ts").alias("at"), F.lit("work").alias("title"), pick(W.TYPES, i % 7).alias("type"),
                                          pick(W.STATES, i % 12).alias("state"), pick(W.STATUSES, F.expr("event_id div 2") % 3).alias("status"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("full_name"))
    items, intakes = e.where("id % 2 = 0").drop("state"), e.where("id % 2 = 1").drop("type", "status")
    return W.work(items, intakes, I.survivor_of(forest(spark, sf)), people)
