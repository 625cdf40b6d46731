"""Queries that end in review items, each with its key and title in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import detectors as X
from ..operators import identity as I
from ..operators import items as M
from ..operators import normalise as N
from ..operators import rules as R
from .events import _RULES, _S1, states
from .identity import _C, FIELDS, keys, people
from .more import _RAW, _READ, raw_dates
from .normalising import _CHAINX, _MAIL, mails
from .registry import query, table

SHOWN = ("type", "scope", "title", "field", "dedupe_key")


@query(f"""WITH {_MAIL}, {_CHAINX}, b AS (SELECT c_custkey, raw, (ti <> lo AND tight) AS spaced, ti FROM g WHERE NOT good AND raw <> '')
SELECT 'data_quality' AS type, 'row' AS scope, CASE WHEN spaced THEN 'email contains a space' ELSE 'email missing, placeholder typed' END AS title, 'email' AS field,
 'data_quality|row|legacy_patient:' || c_custkey || '|email|' || CASE WHEN spaced THEN 'EMAIL_INTERNAL_SPACE_TO_NULL|' ELSE 'EMAIL_PLACEHOLDER_TO_NULL|' END || raw AS dedupe_key,
 CASE WHEN spaced THEN '{{"field":"email","proposed_value":"' || ti || '","rule":"EMAIL_INTERNAL_SPACE_REMOVED"}}' END AS proposed FROM b""")
def m1_flag_items(spark, sf):
    """Flags of mapped rows as items, with proposals where a value can be made."""
    rows = N.map_rows(mails(spark, sf), "c_custkey", {"email": N.map_email(F.col("raw"))})
    return M.flag_items(N.evidence(rows, "c_custkey", "flags"), "c_custkey", "legacy_patient").select(*SHOWN, "proposed")


@query("""WITH o AS (SELECT o_orderkey % 4 AS k FROM orders), x AS (SELECT count(*) FILTER (WHERE k IN (0, 1)) AS a, count(*) FILTER (WHERE k = 2) AS b FROM o), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 9 = 0) AS bad FROM customer)
SELECT 'vocabulary|vocabulary|rule||DATE_ORDER_FROM_SEPARATOR|confirm' AS dedupe_key, '{"rows_converted":{"dob":' || a || ',"signup_date":0,"submitted_at":' || b || '}}' AS payload FROM x
UNION ALL SELECT 'vocabulary|vocabulary|rule|outcome|OUTCOME_OK_ASSUMED_APPROVED|confirm', '{"rows":0}' UNION ALL SELECT 'vocabulary|vocabulary|rule|questionnaire_version|VERSION_LABEL_ASSUMED_V2|confirm', '{"rows":0}'
UNION ALL SELECT 'vocabulary|vocabulary|rule|bsn|BSN_RETENTION|confirm', '{"rows_with_bsn":' || n || ',"elfproef_failures":' || bad || '}' FROM c""")
def m3_confirmations(spark, sf):
    """M3: the four fixed questions with their counts."""
    k = F.col("o_orderkey") % 4
    records = table(spark, sf, "orders").where(k < 3).select("o_orderkey", F.when(k < 2, "dob").otherwise("submitted_at").alias("field"), F.lit("DATE_ORDER_FROM_SEPARATOR").alias("rule_code"))
    numbers = table(spark, sf, "customer").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey") % 9 == 0).alias("invalid"))
    return M.confirmation_items(records, numbers).select("dedupe_key", "payload")


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    fields = [k, F.col("c_name"), F.col("c_custkey").cast("string").alias("bsn")]
    hashed = lambda df: df.withColumn("row_hash", F.sha2(F.concat_ws(",", "c_custkey", "c_name", "bsn").cast("binary"), 256))
    old = table(spark, sf, "customer").select(*fields)
    return hashed(old), hashed(old.withColumn("c_name", F.when(k % 7 == 0, "renamed").otherwise(F.col("c_name"))).withColumn("bsn", F.when(k % 11 == 0, "123456789").otherwise(F.col("bsn"))))


_MASK = "CASE WHEN length({0}) <= 3 THEN repeat('*', length({0})) ELSE repeat('*', length({0}) - 3) || right({0}, 3) END"


@query(f"""WITH v AS (SELECT c_custkey, c_name, c_custkey::VARCHAR AS bsn, CASE WHEN c_custkey % 7 = 0 THEN 'renamed' ELSE c_name END AS n2, CASE WHEN c_custkey % 11 = 0 THEN '123456789' ELSE c_custkey::VARCHAR END AS b2 FROM customer),
h AS (SELECT *, sha256(c_custkey || ',' || c_name || ',' || bsn) AS was, sha256(c_custkey || ',' || n2 || ',' || b2) AS now FROM v WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0)
SELECT 'data_quality|row|legacy_patients_raw:' || c_custkey || '||SOURCE_ROW_CHANGED|' || now AS dedupe_key, '{{"table":"legacy_patients_raw","key":"' || c_custkey || '","stored_row_hash":"' || was || '","incoming_row_hash":"' || now || '","differences":['
 || concat_ws(',', CASE WHEN c_name <> n2 THEN '{{"field":"c_name","stored":"' || c_name || '","incoming":"renamed"}}' END, CASE WHEN bsn <> b2 THEN '{{"field":"bsn","stored":"' || {_MASK.format("bsn")} || '","incoming":"******789"}}' END) || ']}}' AS payload FROM h""")
def m4_changed_rows(spark, sf):
    """Source rows that changed, numbers masked."""
    old, new = _versions(spark, sf)
    return M.changed_row_items(old, new, "c_custkey", ["c_name", "bsn"], "legacy_patients_raw", "1").select("dedupe_key", "payload")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem),
f AS (SELECT a.*, b.l_partkey AS p1, b.l_linenumber AS n1 FROM r a JOIN r b ON b.l_orderkey = a.l_orderkey AND b.nth = 1 WHERE a.nth > 1 AND a.l_partkey <> b.l_partkey)
SELECT 'data_quality|row|legacy_intake:' || l_orderkey || '||SOURCE_KEY_REPEATED|' || sha256(l_partkey::VARCHAR) AS dedupe_key, 'line ' || n1 || ' is stored and line ' || l_linenumber || ' is not; keep the stored values or replace individual fields through the resolution path' AS reason FROM f""")
def m5_repeated_keys(spark, sf):
    """Later rows of a key with other content."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.col("l_linenumber").alias("line_no"), F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("row_hash"))
    first = li.groupBy("l_orderkey").agg(F.min_by("line_no", "o").alias("stored_line_no"))
    r = X.repeated_keys(li, "l_orderkey", "o", F.col("row_hash")).join(first, "l_orderkey")
    return M.repeated_key_items(r, "l_orderkey", "legacy_intake", "intake id").select("dedupe_key", "reason")


@query("""WITH d AS (SELECT p_partkey, upper(p_brand) || '!' AS nb FROM part WHERE p_partkey % 6 = 0)
SELECT 'data_quality|row|patient:' || p_partkey || '|p_brand|HUMAN_OWNED_FIELD_DIFFERS|"' || nb || '"' AS dedupe_key, 'p_brand was set by a human and the export now maps differently' AS title FROM d""")
def m6_human_conflicts(spark, sf):
    """M6: incoming changes to fields that a person owns."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    new = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_brand"), F.lit("!"))).otherwise(F.col("p_brand")).alias("p_brand"))
    owned = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("entity_id"), F.lit("p_brand").alias("field"), F.lit("kept by hand").alias("value"))
    c = X.human_conflicts(X.field_diff(p, new, "p_partkey", ["p_brand"]), owned, "p_partkey").withColumn("audit_entry_id", F.col("p_partkey"))
    return M.human_conflict_items(c, "p_partkey", "patient").select("dedupe_key", "title")


_FLIPS = f"""{_RAW}, {_READ}, a AS (SELECT o_orderkey, raw, d, CASE WHEN day(d) <> month(d) THEN try_strptime(strftime(d, '%Y-%d-%m'), '%Y-%m-%d')::DATE END AS o, (DATE '1992-01-01' + INTERVAL 18 YEAR + ((o_orderkey % 2500)::INT) * INTERVAL 1 DAY)::DATE AS seen FROM rd),
y AS (SELECT *, year(seen) - year(d) - CASE WHEN (month(seen), day(seen)) < (month(d), day(d)) THEN 1 ELSE 0 END AS a1, year(seen) - year(o) - CASE WHEN (month(seen), day(seen)) < (month(o), day(o)) THEN 1 ELSE 0 END AS a2 FROM a WHERE seen >= d AND seen >= o),
f AS (SELECT * FROM y WHERE (a1 < 18) <> (a2 < 18))"""


@query(f"""WITH {_FLIPS} SELECT 'data_quality|row|legacy_patient:' || o_orderkey || '|dob|DOB_READING_FLIPS_MINOR|' || raw AS dedupe_key, 'under the convention ' || d || ', under the alternative ' || o || '; the age rule is 18' AS reason FROM f""")
def m7_age_flip_items(spark, sf):
    """M7: birth dates whose other reading makes a minor an adult or the reverse, at a row of theirs."""
    seen = F.date_add(D.shift_years(F.lit("1992-01-01").cast("date"), 18), (F.col("o_orderkey") % 2500).cast("int"))
    flips = X.age_flips(raw_dates(spark, sf), "raw", seen).withColumns({"read": D.read_by_separator(F.col("raw")), "alternative": D.alternative_reading(F.col("raw")), "row": F.col("o_orderkey")})
    return M.age_flip_items(flips, "o_orderkey", "row", 18)[0].select("dedupe_key", "reason")


@query("""WITH s AS (SELECT c_custkey AS k, DATE '2020-01-01' + (c_custkey * 7 % 4000)::INT AS signup FROM customer) SELECT 'data_quality|row|legacy_patient:' || k || '|signup_date|DATE_IMPOSSIBLE_TO_NULL|' || signup AS dedupe_key,
 '{"legacy_id":"' || k || '","signup_date":{"raw":"' || signup || '","read":"' || signup || '","canonical":null},"rows":' || (SELECT count(*) FROM orders WHERE o_custkey = k) || '}' AS payload FROM s WHERE signup > DATE '2026-06-01'""")
def m8_shifted_items(spark, sf):
    """M8: records dated in the future as a whole."""
    d = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") * 7 % 4000).cast("int"))
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), d.alias("read"), d.cast("string").alias("raw"), F.lit("2026-06-01").cast("date").alias("as_of"))
    return M.shifted_items(X.shifted(s, "read", "as_of", table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k"), "k").select("dedupe_key", "payload")


@query("""SELECT 'orphan_intake|row|legacy_intake:' || event_id || '|patient_id|ORPHAN|' || user_id AS dedupe_key, 'intake ' || event_id || ' references a patient that does not exist' AS title FROM events WHERE user_id % 3 = 0 OR user_id NOT IN (SELECT c_custkey FROM customer)""")
def m9_orphan_items(spark, sf):
    """Rows whose owner is nowhere."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    return M.orphan_items(X.orphans(e, table(spark, sf, "customer").where("c_custkey % 3 <> 0"), "user_id", "c_custkey"), "event_id", "user_id").select("dedupe_key", "title")


@query(f"""WITH RECURSIVE {_C}, m AS (SELECT root, count(*) AS n, min(doc_id) AS lowest, count(DISTINCT lang) AS l, count(DISTINCT source) AS s, count(DISTINCT n_chars) AS nc, count(DISTINCT email) AS t FROM c JOIN p USING (doc_id) GROUP BY 1)
SELECT CASE WHEN l > 1 THEN 'two patient records share a key but contradict each other' ELSE 'two patient records may be the same person' END AS title, lowest, n FROM m WHERE NOT (l <= 1 AND t = 1 AND s <= 1 AND nc <= 1)""")
def m10_identity_items(spark, sf):
    """Groups for a person to decide, with their members."""
    p = people(spark, sf)
    k = keys(spark, sf, p)
    placed = I.groups(k, "doc_id")
    m = p.join(placed, "doc_id")
    tiers = I.classify(m, {**{f: F.col(f) for f in FIELDS}, "email": F.col("email")}, ["lang"], ["email"])
    items, rows = M.identity_items(tiers, I.matched_keys(k, placed, "doc_id"), m, "doc_id")
    return items.join(rows.groupBy("dedupe_key").agg(F.min("row").alias("lowest"), F.count("*").alias("n")), "dedupe_key").select("title", "lowest", "n")


@query("""WITH v AS (SELECT c_nationkey AS o, CASE WHEN c_custkey % 2 = 0 THEN 'weight_kg' ELSE 'height_cm' END AS field, floor(abs(c_acctbal) / 20) AS b, c_custkey FROM customer),
x AS (SELECT *, CASE field WHEN 'weight_kg' THEN 30 ELSE 100 END AS lo, CASE field WHEN 'weight_kg' THEN 300 ELSE 230 END AS hi FROM v), g AS (SELECT o, field, lo, hi, count(*) AS n FROM x WHERE b < lo OR b > hi GROUP BY ALL)
SELECT field || ' outside the plausible range' AS title, o::VARCHAR AS owner, n || ' value(s) outside ' || lo || '–' || hi || '; each was stored null and the raw row keeps what the export said' AS reason FROM g""")
def m11_plausibility_items(spark, sf):
    """Values outside the bounds, per owner and field."""
    c = table(spark, sf, "customer")
    b = F.floor(F.abs("c_acctbal") / 20)
    v = c.select(F.col("c_nationkey").alias("owner"), F.when(F.col("c_custkey") % 2 == 0, "weight_kg").otherwise("height_cm").alias("field"), b.cast("string").alias("raw"), b.cast("double").alias("value"), (F.col("c_custkey") % 5 == 0).alias("own"))
    i = M.plausibility_items(v, "owner", _RULES.plausibility)
    return i.select("title", F.get_json_object("payload", "$.legacy_id").alias("owner"), "reason")


_PAIRS = """p AS (SELECT o_custkey AS owner, o_orderkey AS row, CASE WHEN o_custkey % 3 = 0 THEN 'kg' ELSE 'lbs' END AS unit, 60.0 + o_custkey % 40 AS signup, 60.0 + o_custkey % 40 + CASE WHEN o_custkey % 5 = 0 THEN 20 ELSE o_orderkey % 9 END AS weight FROM orders),
r AS (SELECT *, weight / signup < 0.9 OR weight / signup > 1.1 AS far FROM p)"""


def _pairs(spark, sf):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    signup = (60.0 + k % 40).cast("double")
    return table(spark, sf, "orders").select(
        k.alias("owner"), o.alias("row"), F.when(k % 3 == 0, "kg").otherwise("lbs").alias("unit"), signup.alias("signup"), (signup + F.when(k % 5 == 0, 20).otherwise(o % 9)).alias("weight"))


@query(f"WITH {_PAIRS} SELECT owner::VARCHAR AS owner, count(*) AS n, min(row)::VARCHAR AS lowest FROM r WHERE unit = 'kg' GROUP BY owner HAVING bool_and(far)")
def m12_divergence_items(spark, sf):
    """Owners all of whose rows are out of tolerance, kilograms only."""
    i = M.divergence_items(_pairs(spark, sf), "owner", "row", _RULES.weight_divergence["tolerance"])
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    return i.select(j("legacy_id").alias("owner"), j("intakes").cast("long").alias("n"), j("first").alias("lowest"))


@query(f"""WITH {_PAIRS}, o AS (SELECT owner, count(*) AS n, count(*) FILTER (WHERE far) AS k FROM r WHERE unit = 'lbs' GROUP BY 1)
SELECT 'weight_unit `lbs`: ' || count(*) FILTER (WHERE n = k) || ' of ' || count(*) || ' patients do not reconcile after conversion' AS title, 'vocabulary|vocabulary|rule|weight_kg|WEIGHT_LBS_DO_NOT_RECONCILE|confirm' AS dedupe_key,
 '{{"intakes_compared":' || sum(n) || ',"intakes_outside":' || sum(k) || ',"patients_compared":' || count(*) || ',"patients_disagreeing":' || count(*) FILTER (WHERE n = k) || '}}' AS payload FROM o""")
def m13_reconciliation_item(spark, sf):
    """One item for all converted weights that don't agree."""
    return M.reconciliation_item(_pairs(spark, sf), "owner", _RULES.weight_divergence["tolerance"]).select("title", "dedupe_key", "payload")


@query("""SELECT 'vocabulary|vocabulary|rule|weight_kg|WEIGHT_UNIT_MISSING_TO_NULL|confirm' AS dedupe_key, p_partkey AS row, round((p_size::DECIMAL(9,1) * 0.45359237::DECIMAL(9,8))::DECIMAL(18,1)::DOUBLE, 1) AS as_lbs,
 'weight_unit is empty on ' || count(*) OVER () || ' rows: are they pounds?' AS title FROM part WHERE p_partkey % 4 = 1""")
def m14_unit_items(spark, sf):
    """One item for all numbers without a unit, both readings of each beside it."""
    p = table(spark, sf, "part").where("p_partkey % 4 = 1").select("p_partkey", F.col("p_size").cast("string").alias("raw"))
    i, rows = M.unit_missing_item(X.unit_missing(p, "raw", F.lit(170)), "p_partkey")
    return rows.join(i.select("dedupe_key", "title"), "dedupe_key").select("dedupe_key", "row", F.round(F.col("as_lbs").cast("double"), 1).alias("as_lbs"), "title")


@query("""WITH r AS (SELECT o_custkey AS o, o_orderkey AS k, o_orderstatus AS s, o_orderdate::DATE AS d, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS d2 FROM orders),
e AS (SELECT DISTINCT o, k, s, unnest([d, d2]) AS day FROM r), g AS (SELECT o, day, count(*) AS n, list_sort(list(k)) AS ks, count(DISTINCT s) AS outcomes FROM e WHERE day IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
f AS (SELECT *, row_number() OVER (PARTITION BY o, ks ORDER BY day) AS nth FROM g)
SELECT n || ' intakes from one patient on ' || day AS title, o::VARCHAR AS owner, ks[1]::VARCHAR AS lowest, CASE WHEN outcomes > 1 THEN 'the outcomes disagree' ELSE 'the outcomes agree; the submissions may still be one visit recorded twice' END AS reason FROM f WHERE nth = 1""")
def m15_duplicate_items(spark, sf):
    """Several rows of one owner on a day, under any reading of the dates."""
    d = F.to_date("o_orderdate")
    r = table(spark, sf, "orders").select("o_custkey", "o_orderkey", d.alias("day"), D.swapped(d).alias("other_day"), F.col("o_orderstatus").alias("outcome"))
    i, _ = M.duplicate_items(r, "o_custkey", "o_orderkey")
    return i.select("title", F.get_json_object("payload", "$.legacy_patient_id").alias("owner"), F.get_json_object("payload", "$.first").alias("lowest"), "reason")


@query(f"""WITH {_S1}, s AS (SELECT subject, state, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'paused' ELSE 'churned' END AS status FROM st JOIN customer ON c_custkey = subject),
r AS (SELECT *, CASE WHEN state = 'conflict' THEN 'CONSENT_CONFLICT' WHEN status IN ('active', 'paused') AND state = 'revoked' THEN 'CONSENT_REVOKED_WHILE_ACTIVE' WHEN status IN ('active', 'paused') AND state IN ('no_record', 'unknown_pre_log') THEN 'CONSENT_NO_RECORD_WHILE_ACTIVE' END AS rule FROM s)
SELECT 'consent|row|legacy_patient:' || subject || '|processing|' || rule || '|' || state AS dedupe_key, CASE WHEN state = 'conflict' THEN 'consent log contradicts itself' WHEN state = 'revoked' THEN 'consent revoked while the patient is ' || status ELSE 'no consent record for a patient who is ' || status END AS title
FROM r WHERE rule IS NOT NULL""")
def m16_consent_items(spark, sf):
    """States that contradict themselves or what is done with the subject."""
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "active").when(F.col("c_mktsegment") == "MACHINERY", "paused").otherwise("churned")
    s = states(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), seg.alias("status")), "subject")
    return M.consent_items(s, "subject").select("dedupe_key", "title")


@query("""SELECT count(*) || ' consent events are dated after 2024-01-20' AS title, count(*) FILTER (WHERE event_type = 'error') || ' revocations and ' || count(*) FILTER (WHERE event_type <> 'error')
 || ' grants lie in the future; the states they produce are left as derived, because a revocation is the safe direction' AS reason FROM events WHERE ts > TIMESTAMP '2024-01-20 23:59:59.999' HAVING count(*) > 0""")
def m17_future_item(spark, sf):
    """One item for all events after the run's day."""
    e = X.future_rows(table(spark, sf, "events"), "ts", F.lit("2024-01-20 23:59:59.999").cast("timestamp_ntz"))
    return M.future_item(e.select(F.when(F.col("event_type") == "error", "revoked").otherwise("granted").alias("action")), "2024-01-20").select("title", "reason")


@query("""WITH i AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS legacy, o_orderdate::DATE AS day, DATE '1978-03-01' + (o_custkey * 37 % 9000)::INT AS dob FROM orders),
a AS (SELECT *, date_part('year', day) - date_part('year', dob) - CASE WHEN (date_part('month', day), date_part('day', day)) < (date_part('month', dob), date_part('day', dob)) THEN 1 ELSE 0 END AS age FROM i WHERE dob <= day)
SELECT 'clinical_history|row|legacy_intake:' || k || '||HISTORY_GLP1_MEDICATION|v1' AS dedupe_key, 'GLP-1 medication reported in free text' AS title, 'flagged: current GLP-1 medication (a thing)' AS reason FROM i WHERE k % 6 = 0
UNION ALL SELECT 'clinical_history|row|legacy_intake:' || k || '||HISTORY_FLAG_CONDITION|v1', 'flag condition reported in free text', 'flagged: self-reported history of thyroid cancer / pancreatitis (loser)' FROM i WHERE k % 8 = 0
UNION ALL SELECT 'clinical_history|row|legacy_intake:' || k || '||HISTORY_MINOR_NOT_REJECTED|v1', 'intake from a patient aged ' || age::BIGINT || ', legacy outcome ' || legacy, 'rejected: age ' || age::BIGINT || ' at submission' FROM a WHERE age < 18 AND legacy <> 'rejected'""")
def m18_history_items(spark, sf):
    """What today's rules say of stored intakes."""
    k = F.col("o_orderkey")
    legacy = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    intakes = table(spark, sf, "orders").select(
        k.alias("intake_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("submitted_at"), F.lit(90.0).alias("kg"), F.lit(180).alias("cm"), F.when(k % 6 == 0, "none; a thing").alias("medications"),
        F.when(k % 8 == 0, "loser").alias("conditions"), legacy.alias("outcome"))
    born = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), F.date_add(F.lit("1978-03-01").cast("date"), (F.col("o_custkey") * 37 % 9000).cast("int")).alias("dob")).distinct()
    return M.history_items(R.shadow_run(intakes, born, _RULES)).select("dedupe_key", "title", "reason")


@query("""SELECT 'vocabulary|vocabulary|ruleset:glp1_terms||NEW_GLP1_DECLARED_UNMATCHED|' || lower(p_type) AS dedupe_key, 'a patient named a GLP-1 medication the ruleset does not know: ' || lower(p_type) AS title FROM part GROUP BY lower(p_type)""")
def m19_unknown_medication(spark, sf):
    """Declared medications that no term knows, one item a folded text."""
    p = table(spark, sf, "part").select(F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))).alias("text"), F.col("p_partkey").alias("intake_id"), F.lit("v1").alias("ruleset"))
    return M.unknown_medication_items(p).select("dedupe_key", "title")


@query("""WITH k AS (SELECT c_custkey AS k, c_nationkey * 1000 + (c_custkey % 90) AS e, floor(c_acctbal / 10)::BIGINT AS b FROM customer WHERE c_acctbal >= 0),
m AS (SELECT x.k, CASE WHEN x.e = y.e THEN 1 END AS by_e, CASE WHEN x.b = y.b THEN 1 END AS by_b FROM k x JOIN k y ON x.e = y.e OR x.b = y.b WHERE x.k % 7 = 3 AND y.k % 7 <> 3)
SELECT 'identity_conflict|row|patient:' || k || '||POSSIBLE_EXISTING_PATIENT|' || concat_ws(',', CASE WHEN count(by_b) > 0 THEN 'b' END, CASE WHEN count(by_e) > 0 THEN 'e' END) AS dedupe_key, (count(by_e) + count(by_b))::VARCHAR AS holders FROM m GROUP BY k""")
def m19_existing_items(spark, sf):
    """Submissions that share keys with stored rows, as items."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey", (F.col("c_nationkey") * 1000 + k % 90).cast("long").alias("e"), F.floor(F.col("c_acctbal") / 10).alias("b"))
    i = M.existing_items(X.possible_existing(c.where(k % 7 == 3), c.where(k % 7 != 3), "c_custkey", ["e", "b"]))
    return i.select("dedupe_key", F.get_json_object("payload", "$.holders").alias("holders"))
