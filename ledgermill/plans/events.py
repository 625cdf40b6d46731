"""Queries over the event log and orders: states, order, windows, rules, moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import derived as D
from ..operators import events as E
from ..operators import identity as I
from ..operators import rules as R
from ..sources import ruleset
from .registry import query, table

TYPES = ("signup", "purchase")
LOG_START = "2000-01-01"

_EV = """ev AS (
  SELECT user_id, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'granted' WHEN 'purchase' THEN 'granted' WHEN 'error' THEN 'revoked' END AS action
  FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"""


def consent_events(spark: SparkSession, sf: str, unit: str | None = None) -> DataFrame:
    """The log as grants and revocations; clicks and views say nothing."""
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type").isin(*TYPES), "granted").when(F.col("event_type") == "error", "revoked")
    at = F.col("ts").cast("timestamp")
    at = F.date_trunc(unit, at) if unit else at
    return e.select(F.col("user_id").alias("subject"), F.lit("processing").alias("type"), action.alias("action"), at.alias("at"), F.col("event_id").alias("id")).where("action is not null")


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their first order day."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("signup"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"))
    return c.join(o, c.subject == o.o_custkey, "left").select("subject", "signup")


def states(spark: SparkSession, sf: str, unit: str | None = None) -> DataFrame:
    return E.derive_states(subjects(spark, sf), consent_events(spark, sf, unit), ["processing"], F.lit(LOG_START).cast("date"))


_STATES = f"""{_EV},
sub AS (SELECT c_custkey AS subject, min(o_orderdate)::DATE AS signup FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
agg AS (SELECT user_id, arg_min(action, (TSX, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS first_action,
               arg_max(action, (TSX, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS last_action,
               arg_max(event_id, (TSX, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS from_event FROM ev GROUP BY 1),
st AS (SELECT subject, CASE WHEN last_action IS NULL THEN CASE WHEN signup < DATE '{LOG_START}' THEN 'unknown_pre_log' ELSE 'no_record' END
              WHEN first_action = 'revoked' THEN 'conflict' ELSE last_action END AS state, from_event
       FROM sub LEFT JOIN agg ON user_id = subject)"""
_S1 = _STATES.replace("TSX", "ts")
_SH = _STATES.replace("TSX", "date_trunc('hour', ts)")


@query(f"WITH {_S1} SELECT state, count(*) AS n, count(from_event) AS with_events FROM st GROUP BY 1")
def l1_event_state(spark, sf):
    """Derived states, counted."""
    return states(spark, sf).groupBy("state").agg(F.count("*").alias("n"), F.count("from_event").alias("with_events"))


@query(f"WITH {_SH} SELECT subject, state, from_event FROM st WHERE from_event IS NOT NULL")
def f1_tie_order(spark, sf):
    """ties within an hour settled by action, then id."""
    return states(spark, sf, "hour").where("from_event is not null").select("subject", "state", "from_event")


_PARENT = "CASE WHEN c_custkey % 3 = 0 AND c_custkey > 3 THEN c_custkey // 3 END"
_CHAIN = f"""forest AS (SELECT c_custkey AS id, {_PARENT} AS parent FROM customer),
chain AS (SELECT id, id AS survivor, parent FROM forest UNION SELECT c.id, f.id, f.parent FROM chain c JOIN forest f ON f.id = c.parent),
surv AS (SELECT id, survivor FROM chain WHERE parent IS NULL)"""


def forest(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), F.when((k % 3 == 0) & (k > 3), F.expr("c_custkey div 3")).alias("parent"))


@query(f"WITH RECURSIVE {_CHAIN} SELECT id, survivor FROM surv")
def k8_survivor_of(spark, sf):
    """The end of each parent chain."""
    return I.survivor_of(forest(spark, sf))


_MEMBER = f"""WITH RECURSIVE {_CHAIN}, {_EV},
sub AS (SELECT survivor AS subject, CASE WHEN bool_or(d IS NULL) THEN NULL ELSE min(d) END AS signup FROM surv
        LEFT JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1) ON o_custkey = id GROUP BY 1),
agg AS (SELECT survivor AS user_id, arg_min(action, (ts, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS first_action,
               arg_max(action, (ts, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS last_action,
               arg_max(event_id, (ts, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS from_event
        FROM ev JOIN surv ON id = user_id GROUP BY 1),
st AS (SELECT subject, CASE WHEN last_action IS NULL THEN CASE WHEN signup < DATE '{LOG_START}' THEN 'unknown_pre_log' ELSE 'no_record' END
              WHEN first_action = 'revoked' THEN 'conflict' ELSE last_action END AS state, from_event
       FROM sub LEFT JOIN agg ON user_id = subject)"""


def _member_states(spark: SparkSession, sf: str) -> DataFrame:
    return D.by_membership(I.survivor_of(forest(spark, sf)), subjects(spark, sf), consent_events(spark, sf), ["processing"], F.lit(LOG_START).cast("date"))


@query(f"{_MEMBER} SELECT subject, state, from_event FROM st")
def l2_state_by_membership(spark, sf):
    """L2, K8, K9: states of survivors over the events of all their members."""
    return _member_states(spark, sf).select("subject", "state", "from_event")


@query(
    f"""{_MEMBER},
agg1 AS (SELECT user_id, arg_min(action, (ts, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS first_action,
                arg_max(action, (ts, CASE action WHEN 'revoked' THEN 1 ELSE 0 END, event_id)) AS last_action FROM ev GROUP BY 1),
sub1 AS (SELECT c_custkey AS subject, min(o_orderdate)::DATE AS signup FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
st1 AS (SELECT subject, CASE WHEN last_action IS NULL THEN CASE WHEN signup < DATE '{LOG_START}' THEN 'unknown_pre_log' ELSE 'no_record' END
              WHEN first_action = 'revoked' THEN 'conflict' ELSE last_action END AS state FROM sub1 LEFT JOIN agg1 ON user_id = subject)
SELECT st1.state AS before, st.state AS after, count(*) AS n FROM st JOIN st1 USING (subject) WHERE st.state IS DISTINCT FROM st1.state GROUP BY 1, 2"""
)
def l4_state_diff(spark, sf):
    """States that merging members changed."""
    return E.state_changes(states(spark, sf), _member_states(spark, sf), ["subject"]).groupBy("before", "after").agg(F.count("*").alias("n"))


SHIFT_DAYS = 8700


def dated_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), F.date_add(F.to_date("o_orderdate"), SHIFT_DAYS).alias("day"))


_ORD = f"ord AS (SELECT o_orderkey, o_custkey AS subject, o_orderdate::DATE + {SHIFT_DAYS} AS day FROM orders)"


@query(f"""WITH {_EV}, {_ORD}, g AS (SELECT user_id AS subject, min(ts)::DATE AS first_day FROM ev WHERE action = 'granted' GROUP BY 1)
SELECT o_orderkey, subject, first_day::VARCHAR AS first_day FROM ord JOIN g USING (subject) WHERE day < first_day""")
def l5_before_first_grant(spark, sf):
    """L5, D11, E6."""
    g = consent_events(spark, sf).where("action = 'granted'")
    return E.before_first(dated_orders(spark, sf), g, "subject", "day", "at").select("o_orderkey", "subject", F.col("first_day").cast("string"))


@query(f"""WITH {_EV}, {_ORD}, g AS (SELECT user_id AS subject, max(ts) FILTER (WHERE action = 'granted') AS granted, max(ts) FILTER (WHERE action = 'revoked') AS revoked FROM ev GROUP BY 1)
SELECT count(*) AS n, count(DISTINCT subject) AS subjects FROM ord JOIN g USING (subject) WHERE revoked IS NOT NULL AND (granted IS NULL OR granted <= revoked) AND day > revoked::DATE""")
def l5_after_revocation(spark, sf):
    """Orders after a revocation that no grant follows."""
    r = E.after_revocation(dated_orders(spark, sf), consent_events(spark, sf), "subject", "day")
    return r.agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query("""WITH v AS (SELECT min(ts) AS cut_over FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id FROM events, v WHERE event_type = 'signup' AND ts > cut_over""")
def l6_cutover_stragglers(spark, sf):
    """L6, D13."""
    return E.stragglers(table(spark, sf, "events"), "purchase", "signup").select("event_id", "user_id")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1""")
def f3_governing_row(spark, sf):
    """the latest order of each customer, ties by priority, then key."""
    o = table(spark, sf, "orders")
    return E.governing(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey,
  row_number() OVER w AS nth, first_value(l_suppkey) OVER w AS first_supp FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber))
SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE nth > 1 AND l_suppkey IS DISTINCT FROM first_supp) AS differing FROM r GROUP BY 1""")
def f5_first_per_key(spark, sf):
    """Repeats of a key that differ from its first row."""
    from ..operators.detectors import repeated_keys

    rows = table(spark, sf, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    bad = repeated_keys(rows, "l_partkey", "o", F.col("l_suppkey").cast("string")).groupBy("l_partkey").agg(F.count("*").alias("differing"))
    n = rows.groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.join(bad, "l_partkey", "left").select("l_partkey", "n", F.coalesce("differing", F.lit(0)).alias("differing"))


@query("""SELECT user_id FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS p FROM events)
GROUP BY user_id HAVING max(p > value)""".replace("max(p > value)", "bool_or(p > value)"))
def f7_out_of_order(spark, sf):
    """Users whose values don't rise with time."""
    return E.out_of_order(table(spark, sf, "events"), "user_id", F.col("ts"), F.col("value"))


@query("""SELECT event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p = event_type GROUP BY 1""")
def f7_repeated_actions(spark, sf):
    """the same action twice running."""
    e = E.repeated_actions(table(spark, sf, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")])
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_EV}, p AS (SELECT user_id, count(*) AS n, count(DISTINCT action) AS kinds, arg_min(action, (ts, event_id)) AS a, arg_max(action, (ts, event_id)) AS z, string_agg(action, ' > ' ORDER BY ts, event_id) AS whole FROM ev GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'single ' || a WHEN kinds = 1 THEN n || ' x ' || a WHEN a = 'granted' AND z = 'revoked' THEN 'granted then revoked' WHEN a = 'revoked' AND z = 'granted' THEN 'revoked then granted' ELSE 'mixed (' || whole || ')' END AS pattern, count(*) AS n
FROM p GROUP BY 1""")
def e22_sequence_pattern(spark, sf):
    """What each subject's whole sequence of actions says."""
    return A.tally(E.sequence_pattern(consent_events(spark, sf), "subject", "action", [F.col("at"), F.col("id")]), "pattern")


@query("""WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders),
g AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) > 120 THEN 1 ELSE 0 END AS gap FROM d),
i AS (SELECT *, sum(gap) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM g)
SELECT o_custkey, island::BIGINT AS island, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS n FROM i GROUP BY 1, 2""")
def e20_islands(spark, sf):
    """Runs of order days without a gap over 120 days."""
    o = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    i = E.islands(o, "o_custkey", "day", 120)
    return i.select("o_custkey", F.col("island").cast("long"), F.col("first_day").cast("string"), F.col("last_day").cast("string"), "n")


# the rules in force, with words that occur in the tables of texts
_RULES = ruleset.parse({**ruleset.DEFAULT, "glp1_terms": ["thing", "scum", "trash"], "flag_condition_terms": ["idiot", "worthless", "loser"],
                        "weight_related_condition_terms": ["of the", "und der"]})


def rule_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as patients: age, weight and height from ids (every so often missing); a text's segments by turns as
    medications, conditions and other conditions."""
    d = table(spark, sf, "documents").select("doc_id", R.split_segments(F.coalesce("text", F.lit(""))).alias("seg"))
    k = F.col("doc_id")
    part = lambda n: F.filter("seg", lambda _, i: i % 3 == n)
    return d.select(
        "doc_id", F.when(k % 11 != 0, (15 + k % 50)).cast("int").alias("age"), F.when(k % 13 != 0, (45 + k % 60).cast("decimal(5,1)")).alias("kg"),
        F.when(k % 17 != 0, (150 + k % 45)).cast("int").alias("cm"), (k % 19 == 0).alias("declared"), part(0).alias("medications"),
        part(1).alias("conditions"), part(2).alias("other"))


def _terms_sql(terms: list[str]) -> str:
    return "[" + ", ".join(f"{{'t': '{t}', 'k': ' {t} '}}" for t in terms) + "]"


_TOK = "(' ' || trim(regexp_replace(lower(s), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ')"
_TRIM = "regexp_replace(x, '^[\\t\\n\\x0B\\f\\r\\x20\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+|[\\t\\n\\x0B\\f\\r\\x20\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+$', '', 'g')"


def _segments_sql(text: str) -> str:
    cut = f"string_split_regex(regexp_replace({text}, ',([0-9])', chr(1) || '\\1', 'g'), ';|,')"
    return f"list_filter(list_transform(list_transform({cut}, lambda x: replace(x, chr(1), ',')), lambda x: {_TRIM}), lambda x: x <> '')"


def _match_sql(segments: str, terms: list[str]) -> str:
    return (
        f"list_filter(list_transform({segments}, lambda s: {{'text': s, 'term': (list_filter({_terms_sql(terms)}, lambda t: contains({_TOK}, t.k)))[1].t}}), "
        "lambda m: m.term IS NOT NULL)"
    )


@query(f"""WITH a AS (SELECT doc_id, unnest({_match_sql(_segments_sql("coalesce(text, '')"), _RULES.glp1_terms)}) AS m FROM documents)
SELECT doc_id, m.text AS segment, m.term AS term FROM a""")
def j4_term_match(spark, sf):
    """The first matching term of each segment of whole texts."""
    d = table(spark, sf, "documents")
    m = R.match_terms(R.read_segments(F.array(F.coalesce("text", F.lit("")))), _RULES.glp1_terms)
    return d.select("doc_id", F.explode(m).alias("m")).select("doc_id", F.col("m.text").alias("segment"), F.col("m.term").alias("term"))


_TOKTEXT = _TOK.replace("lower(s)", "lower(coalesce(text, ''))")


@query(f"SELECT doc_id, contains({_TOKTEXT}, ' of the ') AS has_run, contains({_TOKTEXT}, ' in and ') AS has_other FROM documents")
def j3_token_run(spark, sf):
    """Contiguous token runs, never parts of words."""
    t = R.tokens_text(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", R.contains_run(t, F.lit(" of the ")).alias("has_run"), R.contains_run(t, F.lit(" in and ")).alias("has_other"))


_B = "kg * 10000 / (cm * cm)"
_VERDICT = f"""WITH s AS (SELECT doc_id, {_segments_sql("coalesce(text, '')")} AS seg FROM documents),
i AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN 15 + doc_id % 50 END AS age, CASE WHEN doc_id % 13 <> 0 THEN (45 + doc_id % 60)::DOUBLE END AS kg,
  CASE WHEN doc_id % 17 <> 0 THEN (150 + doc_id % 45)::DOUBLE END AS cm, doc_id % 19 = 0 AS declared, list_filter(seg, lambda x, i: i % 3 = 1) AS meds, list_filter(seg, lambda x, i: i % 3 = 2) AS cond, list_filter(seg, lambda x, i: i % 3 = 0) AS other FROM s),
m AS (SELECT *, {_B} AS bmi, {_match_sql("meds", _RULES.glp1_terms)} AS gm, {_match_sql("list_concat(cond, other)", _RULES.flag_condition_terms)} AS fm,
  {_match_sql("cond", _RULES.weight_related_condition_terms)} AS rm FROM i),
b AS (SELECT *, coalesce(age < 18, false) AS young, coalesce(bmi < 27, false) AS low, coalesce(bmi >= 27 AND bmi <= 30, false) AND len(rm) = 0 AS bare,
  declared OR len(gm) > 0 AS treated, len(fm) > 0 AS history FROM m),
o AS (SELECT *, CASE WHEN young THEN 'auto_rejected' WHEN low AND (bare OR treated OR history) THEN 'auto_flagged' WHEN low THEN 'auto_rejected'
  WHEN bare OR treated OR history THEN 'auto_flagged' WHEN age IS NULL OR bmi IS NULL THEN 'not_evaluable' ELSE 'auto_cleared' END AS outcome,
  concat_ws(',', CASE WHEN young THEN 'age_below_minimum' END, CASE WHEN low THEN 'bmi_below_minimum' END, CASE WHEN bare THEN 'bmi_band_without_condition' END,
    CASE WHEN treated THEN 'glp1_medication' END, CASE WHEN history THEN 'flag_condition' END) AS matched FROM b)"""


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return R.evaluate(rule_inputs(spark, sf), _RULES)


@query(f"{_VERDICT} SELECT doc_id, outcome, matched, round(bmi, 6) AS bmi FROM o")
def j5_rules_verdict(spark, sf):
    """All rules on every row."""
    v = verdicts(spark, sf)
    return v.select("doc_id", "outcome", F.array_join("matched", ",").alias("matched"), F.round("bmi", 6).alias("bmi"))


@query(f"{_VERDICT} SELECT outcome, rule, count(*) AS n FROM (SELECT outcome, unnest(string_split(matched, ',')) AS rule FROM o WHERE matched <> '') GROUP BY 1, 2")
def j6_outcome_counts(spark, sf):
    """Matched rules by outcome."""
    from ..operators.detectors import clinical_items

    return clinical_items(verdicts(spark, sf), "doc_id").groupBy("outcome", "rule").agg(F.count("*").alias("n"))


def _shown_sql(holds: str) -> str:
    """The BMI with as few decimals, one to four, as keep a comparison true."""
    return "CASE " + " ".join(f"WHEN ({holds.format(x=f'round(bmi, {d})')}) = ({holds.format(x='bmi')}) THEN printf('%.{d}f', bmi)" for d in range(1, 5)) + " ELSE bmi::VARCHAR END"


_SAID = "array_to_string(list_transform({0}, lambda m: m.text), '; ')"


@query(f"""{_VERDICT}, t AS (SELECT *, 'age ' || age || ' at submission' AS age_text, 'BMI ' || {_shown_sql("{x} < 27")} || ' below 27' AS low_text,
  {_shown_sql("{x} >= 27 AND {x} <= 30")} AS shown, outcome = 'auto_flagged' AND NOT young AND low AS yields FROM o)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN age IS NULL THEN 'age not evaluated: date of birth missing' WHEN young THEN 'rejected: ' || age_text END,
  CASE WHEN bmi IS NULL THEN 'BMI not evaluated: ' || CASE WHEN kg IS NULL AND cm IS NULL THEN 'weight and height' WHEN kg IS NULL THEN 'weight' ELSE 'height' END || ' missing'
       WHEN low THEN 'rejected: ' || low_text WHEN bare THEN 'flagged: BMI ' || shown || ' with no weight-related condition'
       WHEN bmi <= 30 THEN 'note: BMI ' || shown || ' in the 27–30 band, weight-related condition present (' || {_SAID.format("rm")} || ')' END,
  CASE WHEN treated THEN 'flagged: current GLP-1 medication (' || CASE WHEN len(gm) > 0 THEN {_SAID.format("gm")} ELSE 'declared by patient' END || ')' END,
  CASE WHEN history THEN 'flagged: self-reported history of thyroid cancer / pancreatitis (' || {_SAID.format("fm")} || ')' END,
  CASE WHEN yields THEN 'flagged: ' || low_text || ', but a flag rule also matched; a human decides' END,
  CASE WHEN outcome = 'auto_cleared' THEN 'cleared: no rejecting or flagging rule matched' END], lambda r: r IS NOT NULL), chr(10)) AS reasons FROM t""")
def j7_reasons(spark, sf):
    """All reasons of every row, in order."""
    return verdicts(spark, sf).select("doc_id", F.array_join("reasons", "\n").alias("reasons"))


@query("""WITH i AS (SELECT o_orderkey, o_orderstatus AS legacy_outcome, o_orderdate::DATE AS day, DATE '1985-03-01' + (c_custkey * 37 % 14000)::INT AS dob, o_orderkey % 7 = 0 AS related,
    (45 + o_orderkey % 60) * 10000.0 / ((150 + o_orderkey % 45) * (150 + o_orderkey % 45)) AS bmi FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 9 <> 0),
a AS (SELECT *, CASE WHEN dob <= day THEN date_part('year', day) - date_part('year', dob)
    - CASE WHEN (date_part('month', day), date_part('day', day)) < (date_part('month', dob), date_part('day', dob)) THEN 1 ELSE 0 END END AS age FROM i),
v AS (SELECT legacy_outcome, CASE WHEN age < 18 THEN 'auto_rejected' WHEN bmi < 27 THEN 'auto_rejected' WHEN bmi <= 30 AND NOT related THEN 'auto_flagged'
    WHEN age IS NULL THEN 'not_evaluable' ELSE 'auto_cleared' END AS outcome FROM a)
SELECT legacy_outcome, outcome, count(*) AS n FROM v GROUP BY 1, 2""")
def j9_shadow_run(spark, sf):
    """today's rules over all stored intakes, beside their legacy outcome."""
    k = F.col("o_orderkey")
    intakes = table(spark, sf, "orders").select(
        k.alias("intake_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("submitted_at"), (45 + k % 60).cast("double").alias("kg"), (150 + k % 45).cast("int").alias("cm"),
        F.lit(None).cast("string").alias("medications"), F.when(k % 7 == 0, "one of the many").alias("conditions"), F.col("o_orderstatus").alias("outcome"))
    c = F.col("c_custkey")
    patients = table(spark, sf, "customer").where(c % 9 != 0).select(c.alias("patient_id"), F.date_add(F.lit("1985-03-01").cast("date"), (c * 37 % 14000).cast("int")).alias("dob"))
    return R.shadow_run(intakes, patients, _RULES).groupBy("legacy_outcome", "outcome").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AS declared, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS ticked, c_custkey % 4 = 1 AS says, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS conditions, c_custkey % 7 = 2 AS more FROM customer)
SELECT CASE WHEN declared OR ticked = 1 OR says THEN 'reported' ELSE 'none_reported' END AS medication_report, CASE WHEN conditions = 1 OR more THEN 'reported' ELSE 'none_reported' END AS condition_report,
  count(*) AS n, sum(ticked + says::INT)::BIGINT AS medications, sum(more::INT)::BIGINT AS other FROM a GROUP BY 1, 2""")
def b34_eligibility_input(spark, sf):
    """The engine's input and the two reports, of submitted answers."""
    k = F.col("c_custkey")
    one = lambda when, x: F.when(when, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    answers = table(spark, sf, "customer").select(
        F.lit("1980-02-29").cast("date").alias("dob"), F.lit("2024-02-28").cast("date").alias("submitted_at"), F.lit(80.0).alias("weight_kg"), F.lit(180).alias("height_cm"), (k % 5 == 0).alias("glp1_declared"),
        one(k % 3 == 0, "ozempic").alias("glp1"), F.when(k % 4 == 1, " aspirin ").otherwise("  ").alias("other_medications"), one(k % 6 == 0, "pcos").alias("conditions"), F.when(k % 7 == 2, "gout").alias("other_conditions"))
    ready = R.eligibility_input(answers)
    return ready.groupBy("medication_report", "condition_report").agg(F.count("*").alias("n"), F.sum(F.size("medications")).alias("medications"), F.sum(F.size("other")).alias("other"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_linestatus AS b, lag(l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a FROM lineitem)
SELECT a AS from_state, b AS to_state, count(*) AS n FROM p WHERE a IS NOT NULL AND (a, b) NOT IN (('O', 'F'), ('F', 'F')) GROUP BY 1, 2""")
def j10_illegal_transitions(spark, sf):
    """Moves between neighbouring lines that aren't on the list of edges."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf, "lineitem").withColumn("from_state", F.lag("l_linestatus").over(w)).where("from_state is not null")
    moves = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "from_state", F.col("l_linestatus").alias("to_state"),
                         F.lit("process").alias("actor_kind"), F.lit("shipped").alias("reason"), F.lit("v1").alias("ruleset"), F.lit(None).cast("array<string>").alias("matched"))
    legal = R.edges(spark, [("O", "F", "process", False, False), ("F", "F", "process", True, False)])
    return R.refused_moves(moves, legal).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


_TWELVE = """s AS (SELECT * FROM (VALUES (0, 'draft'), (1, 'submitted'), (2, 'auto_cleared'), (3, 'auto_flagged'), (4, 'auto_rejected'), (5, 'in_review'), (6, 'approved'), (7, 'rejected'),
  (8, 'legacy_approved'), (9, 'legacy_rejected'), (10, 'legacy_pending'), (11, 'legacy_expired')) t(i, x)),
edge AS (SELECT * FROM (VALUES ('draft', 'submitted', 'process'), ('submitted', 'auto_cleared', 'process'), ('submitted', 'auto_flagged', 'process'), ('submitted', 'auto_rejected', 'process'),
  ('auto_cleared', 'in_review', 'reviewer'), ('auto_flagged', 'in_review', 'reviewer'), ('auto_rejected', 'in_review', 'reviewer'), ('legacy_pending', 'in_review', 'reviewer'),
  ('in_review', 'approved', 'reviewer'), ('in_review', 'rejected', 'reviewer')) t(a, b, who))"""


@query(f"""WITH {_TWELVE}, m AS (SELECT f.x AS from_state, t.x AS to_state, CASE c_custkey % 2 WHEN 0 THEN 'process' ELSE 'reviewer' END AS actor, CASE c_custkey // 2 % 2 WHEN 0 THEN '' ELSE 'why not' END AS reason,
  CASE c_custkey // 4 % 2 WHEN 1 THEN 'v1' END AS ruleset, ['none', 'clear', 'young', 'low'][1 + c_custkey // 8 % 4] AS eval FROM customer, s f, s t)
SELECT from_state, to_state, CASE WHEN a IS NULL THEN 'no such edge' WHEN who <> actor THEN 'wrong actor' WHEN reason = '' THEN 'reason missing' WHEN from_state = 'submitted' AND ruleset IS NULL THEN 'ruleset missing'
  WHEN to_state = 'approved' AND eval = 'none' THEN 'no evaluation' WHEN to_state = 'approved' AND eval = 'young' THEN 'absolute reject' ELSE 'legal' END AS verdict, count(*) AS n
FROM m LEFT JOIN edge ON a = from_state AND b = to_state GROUP BY 1, 2, 3""")
def j10_state_grid(spark, sf):
    """All 144 ordered pairs of the twelve states for each customer, whose key says by whom and on what grounds."""
    k = F.col("c_custkey")
    pick = lambda i, *xs: F.get(F.array(*xs), (i % len(xs)).cast("int"))
    word = lambda x: F.lit(x).cast("string")
    found = [F.lit(None).cast("array<string>"), F.array().cast("array<string>"), F.array(F.lit("age_below_minimum")), F.array(F.lit("bmi_below_minimum"))]
    states_ = F.array(*map(F.lit, R.STATES))
    case = table(spark, sf, "customer").select(
        k.alias("id"), pick(k, word("process"), word("reviewer")).alias("actor_kind"), pick(F.expr("c_custkey div 2"), word(""), word("why not")).alias("reason"),
        pick(F.expr("c_custkey div 4"), word(None), word("v1")).alias("ruleset"), pick(F.expr("c_custkey div 8"), *found).alias("matched"), F.explode(states_).alias("from_state"))
    grid = case.withColumn("to_state", F.explode(states_))
    return R.judged_moves(grid, R.edges(spark)).groupBy("from_state", "to_state", F.coalesce("why", F.lit("legal")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TWELVE}, c AS (SELECT c_custkey AS k, o.x AS was, n.x AS now, c_custkey % 5 = 0 AS edited FROM customer JOIN s n ON n.i = (c_custkey * 7 + 3) % 12 LEFT JOIN s o ON o.i = c_custkey % 12 AND c_custkey % 10 <> 0),
w AS (SELECT CASE WHEN was IS NULL THEN CASE WHEN now <> 'draft' AND now NOT LIKE 'legacy%' THEN 'starts as draft or a legacy state' END
  WHEN was <> 'draft' AND edited THEN 'answers are evidence' WHEN was <> now AND a IS NULL AND NOT (was LIKE 'legacy%' AND now LIKE 'legacy%') THEN 'no such edge' END AS why FROM c LEFT JOIN edge ON a = was AND b = now)
SELECT why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY 1""")
def j12_refused_changes(spark, sf):
    """Rows of a next snapshot that the stored one can't become."""
    k = F.col("c_custkey")
    name = lambda i: F.get(F.array(*map(F.lit, R.STATES)), i.cast("int"))
    c = table(spark, sf, "customer")
    before = c.where(k % 10 != 0).select(k.alias("id"), name(k % 12).alias("state"), F.col("c_mktsegment").alias("answers"))
    after = c.select(k.alias("id"), name((k * 7 + 3) % 12).alias("state"), F.when(k % 5 == 0, "edited").otherwise(F.col("c_mktsegment")).alias("answers"))
    return R.refused_changes(before, after, R.edges(spark)).groupBy("why").agg(F.count("*").alias("n"))


@query(f"""WITH {_S1} SELECT c_mktsegment AS status, state, CASE WHEN state = 'conflict' THEN 'settle the conflict' WHEN state = 'revoked' THEN 'stop processing' ELSE 'ask again' END AS ask, count(*) AS n
FROM st JOIN customer ON c_custkey = subject WHERE state = 'conflict' OR (c_mktsegment = 'BUILDING' AND state IN ('revoked', 'no_record', 'unknown_pre_log')) GROUP BY 1, 2, 3""")
def m16_state_items(spark, sf):
    """What states ask for, for active (BUILDING) subjects."""
    from ..operators.detectors import state_items

    active = F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise(F.col("c_mktsegment"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), active.alias("status"))
    i = state_items(states(spark, sf), c, "subject", "status")
    seg = F.when(F.col("status") == "active", "BUILDING").otherwise(F.col("status"))
    return i.groupBy(seg.alias("status"), "state", "ask").agg(F.count("*").alias("n"))


@query(f"""WITH {_S1}, dec AS (SELECT subject, 'granted' AS s, CASE WHEN subject % 2 = 0 THEN from_event ELSE -1 END AS f FROM st WHERE subject % 5 = 0)
SELECT st.subject, CASE WHEN s IS NOT NULL AND f IS NOT DISTINCT FROM from_event THEN s ELSE state END AS state, s IS NOT NULL AND f IS NOT DISTINCT FROM from_event AS decided
FROM st LEFT JOIN dec USING (subject)""")
def l3_decided_states(spark, sf):
    """Decisions hold while the latest event is the one they were made on."""
    s = states(spark, sf)
    seen = F.when(F.col("subject") % 2 == 0, F.col("from_event")).otherwise(F.lit(-1).cast("long"))
    d = s.where("subject % 5 = 0").select("subject", "type", F.lit("granted").alias("state"), seen.alias("from_event"))
    return E.recompute(s, d).select("subject", "state", "decided")


@query("""SELECT user_id, list_aggregate(list_sort(list(event_type || '=' || n)), 'string_agg', ',') AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def l7_standing(spark, sf):
    """A map of counts per subject, as sorted text."""
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = E.state_map(n.select("user_id", F.col("event_type").alias("type"), F.col("n").cast("string").alias("state")), "user_id")
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_keys("states")), lambda k: F.concat(k, F.lit("="), F.element_at("states", k))), ",").alias("counts"))


@query("""SELECT * FROM (SELECT 'event' AS kind, ts::VARCHAR AS at, event_id AS seq, user_id AS subject FROM events UNION ALL
SELECT 'order', o_orderdate::VARCHAR, o_orderkey, o_custkey FROM orders)""")
def f8_timeline(spark, sf):
    """Two kinds of evidence about every subject as one timeline."""
    e = table(spark, sf, "events").select("user_id", F.lit("event").alias("kind"), _stamp("ts").alias("at"), F.col("event_id").alias("seq"))
    o = table(spark, sf, "orders").select("o_custkey", F.lit("order").alias("kind"), _stamp("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    return E.timeline(e.withColumnRenamed("user_id", "subject"), o.withColumnRenamed("o_custkey", "subject"))


def _stamp(c: str):
    return F.col(c).cast("string")
