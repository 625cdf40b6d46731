"""Report sections over the results of other operators: what was assumed, merged, derived, judged and asked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import events as E
from ..operators import identity as I
from ..operators import items as M
from ..operators import normalise as N
from .events import _EV, _S1, _VERDICT, consent_events, states, verdicts
from .identity import _C, FIELDS, keys, people
from .normalising import _CHAINX, _MAIL, _RECS, mails
from .registry import query, table


@query(f"""WITH {_MAIL}, {_CHAINX}, {_RECS}, whole AS (SELECT count(*) AS n FROM customer)
SELECT rule_code, count(*) AS records, count(*) FILTER (WHERE blank) AS blanked, round(count(*) * 100.0 / whole.n, 2) AS share FROM r, whole GROUP BY rule_code, whole.n""")
def report_assumptions(spark, sf):
    """Q, E2: per rule the records it left, the values it blanked, and its share of all rows."""
    rows = N.map_rows(mails(spark, sf), "c_custkey", {"email": N.map_email(F.col("raw"))})
    per = N.rule_counts(N.evidence(rows, "c_custkey"))
    whole = rows.agg(F.count("*").alias("all"))
    out = per.groupBy("rule_code").agg(F.sum("n").alias("records"), F.sum("blanked").alias("blanked")).crossJoin(F.broadcast(whole))  # one row joined
    return out.select("rule_code", "records", "blanked", F.round(F.col("records") * 100.0 / F.col("all"), 2).alias("share"))


@query(f"""WITH RECURSIVE {_C}, m AS (SELECT root, count(*) AS size, count(DISTINCT lang) AS l, count(DISTINCT source) AS s, count(DISTINCT n_chars) AS n, count(DISTINCT email) AS t FROM c JOIN p USING (doc_id) GROUP BY 1),
tiers AS (SELECT CASE WHEN l > 1 THEN 3 WHEN t = 1 AND s <= 1 AND n <= 1 THEN 1 ELSE 2 END AS tier, size FROM m)
SELECT 'tier ' || tier AS name, count(*) AS groups, sum(size)::BIGINT AS records, max(size) AS largest FROM tiers GROUP BY tier""")
def report_identity(spark, sf):
    """Q, K4: candidate groups and their records by tier."""
    p = people(spark, sf)
    m = p.join(I.groups(keys(spark, sf, p), "doc_id"), "doc_id")
    t = I.classify(m, {**{f: F.col(f) for f in FIELDS}, "email": F.col("email")}, ["lang"], ["email"])
    return t.groupBy(F.concat(F.lit("tier "), F.col("tier").cast("string")).alias("name")).agg(F.count("*").alias("groups"), F.sum("size").alias("records"), F.max("size").alias("largest"))


@query(f"""WITH {_S1}, v AS (SELECT s.x AS state, g.x AS segment FROM (SELECT unnest(['granted', 'revoked', 'no_record', 'unknown_pre_log', 'conflict']) AS x) s, (SELECT DISTINCT c_mktsegment AS x FROM customer) g),
n AS (SELECT state, c_mktsegment AS segment, count(*) AS n FROM st JOIN customer ON c_custkey = subject GROUP BY 1, 2)
SELECT v.state, v.segment, coalesce(n, 0) AS n FROM v LEFT JOIN n USING (state, segment)""")
def report_consent(spark, sf):
    """Q, L1, E10, E11: states by segment, zeros included."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment"))
    s = states(spark, sf).join(c, "subject")
    words = spark.createDataFrame([(x,) for x in ("granted", "revoked", "no_record", "unknown_pre_log", "conflict")], "state string")
    return A.matrix(s, "state", "segment", words, c.select("segment").distinct())


@query(f"""WITH {_EV}, o AS (SELECT user_id, arg_max(action, (ts, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS last, arg_min(action, (ts, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS first, count(*) AS n FROM ev GROUP BY 1)
SELECT 'subjects with events' AS name, count(*) AS n FROM o UNION ALL SELECT 'first event revokes', count(*) FILTER (WHERE first = 'revoked') FROM o UNION ALL SELECT 'last event revokes', count(*) FILTER (WHERE last = 'revoked') FROM o
UNION ALL SELECT 'more than two events', count(*) FILTER (WHERE n > 2) FROM o UNION ALL SELECT 'customers without events', count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ev)""")
def report_sequences(spark, sf):
    """Q, E4, F1, L1: what the subjects' sequences of events look like."""
    ends = E.ends(consent_events(spark, sf), ["subject"])
    said = A.scalar_counts(ends, {"subjects with events": F.lit(True), "first event revokes": F.col("first_action") == "revoked", "last event revokes": F.col("last_action") == "revoked", "more than two events": F.col("n_events") > 2})
    lone = table(spark, sf, "customer").join(ends, F.col("c_custkey") == F.col("subject"), "left_anti").agg(F.lit("customers without events").alias("name"), F.count("*").alias("n"))
    return said.unionByName(lone)


@query(f"""{_VERDICT}, r AS (SELECT outcome, unnest(string_split(CASE WHEN matched = '' THEN '(none)' ELSE matched END, ',')) AS rule FROM o)
SELECT coalesce(outcome, 'total') AS outcome, coalesce(rule, 'total') AS rule, count(*) AS n FROM r GROUP BY CUBE (outcome, rule)""")
def report_shadow(spark, sf):
    """Q, J9, E15, E17: verdicts by the rules that matched, with totals of both sides."""
    rule = F.explode(F.when(F.size("matched") > 0, F.col("matched")).otherwise(F.array(F.lit("(none)"))))
    return A.crosstab(verdicts(spark, sf).select("outcome", rule.alias("rule")), "outcome", "rule")


@query("""WITH k AS (SELECT 'orphan_intake' AS type, 'ORPHAN' AS rule FROM events WHERE user_id % 3 = 0 OR user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'data_quality', 'PHONE_UNPARSED_TO_NULL' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'data_quality', 'BSN_MALFORMED_TO_NULL' FROM customer WHERE c_custkey % 4 = 1) SELECT type, rule, count(*) AS n FROM k GROUP BY 1, 2""")
def report_items(spark, sf):
    """Q, B21: open questions by type and rule, the rule read back from the keys."""
    from ..operators import detectors as X

    k = F.col("c_custkey")
    c = table(spark, sf, "customer").where(k % 4 < 2)
    flags = c.select(k.cast("string").alias("id"), F.when(k % 4 == 0, "phone_unparsed").otherwise("bsn_malformed").alias("kind"), F.when(k % 4 == 0, "phone").otherwise("bsn").alias("field"), F.concat(F.lit("a|b"), k).alias("raw"), F.lit(None).cast("string").alias("proposed"))
    lost = X.orphans(table(spark, sf, "events").select("event_id", "user_id"), table(spark, sf, "customer").where(k % 3 != 0), "user_id", "c_custkey")
    every: list[DataFrame] = [M.flag_items(flags, "id", "legacy_patient"), M.orphan_items(lost, "event_id", "user_id")]
    return reduce(DataFrame.unionByName, every).groupBy("type", T.rule_of(F.col("dedupe_key")).alias("rule")).agg(F.count("*").alias("n"))
