"""Answer documents made from orders, submitted as one step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import submission as S
from ..sources import ruleset, stored
from .registry import query, table

TODAY = "2026-06-01"
#: The parts of a document, as expressions that both engines read: o_orderkey is k, o_custkey is c.
_PARTS = {
    "form": "CASE WHEN k % 31 = 0 THEN 'old' ELSE 'intake-form-v1' END", "name": "CASE WHEN k % 17 = 0 THEN '   ' WHEN k % 3 = 0 THEN concat(' Name ', c) ELSE concat('Name ', c) END",
    "email": "CASE WHEN k % 19 = 0 THEN 'nonsense' WHEN k % 4 = 0 THEN concat('C', c, '@X.nl') ELSE concat('c', c, '@x.nl') END",
    "dob": "CASE WHEN k % 23 = 0 THEN '2030-01-01' WHEN k % 29 = 0 THEN '1990-02-30' WHEN k % 67 = 0 THEN '1900-05-05' ELSE concat(1950 + k % 60, '-0', 1 + k % 9, '-1', k % 10) END",
    "cm": "CASE WHEN k % 37 = 0 THEN 90.0 WHEN k % 41 = 0 THEN 170.5 ELSE 150.0 + k % 50 END", "kg": "CASE WHEN k % 43 = 0 THEN NULL WHEN k % 71 = 0 THEN 301.0 ELSE 60.0 + k % 70 END",
    "declared": "k % 5 = 0 AND k % 20 <> 0", "drug": "CASE WHEN k % 47 = 0 THEN 'aspirin' WHEN k % 10 = 0 THEN 'semaglutide' END", "other": "CASE WHEN k % 15 = 0 THEN 'Slim Quick' ELSE '' END",
    "cond": "CASE WHEN k % 53 = 0 THEN 2 WHEN k % 6 = 0 THEN 1 ELSE 0 END", "granted": "k % 59 <> 0", "version": "CASE WHEN k % 61 = 0 THEN 'v2' ELSE 'v3' END", "state": "CASE WHEN k % 13 = 0 THEN 'submitted' ELSE 'draft' END",
}
_WRONG = {
    f"formVersion: Not a document of {S.FORM_VERSION}.": "form = 'old'", "identity.fullName: Enter your full name.": "trim(name) = ''", "identity.email: Enter an email address in the form name@example.com.": "email = 'nonsense'",
    "identity.dob: Enter your date of birth as YYYY-MM-DD.": "dob = '1990-02-30'", "identity.dob: Your date of birth must be in the past.": "dob = '2030-01-01'", "identity.dob: Enter a date of birth giving an age of at most 100.": "dob = '1900-05-05'",
    "metrics.heightCm: Enter your height in whole centimetres.": "cm = 170.5", "metrics.heightCm: Enter a height in centimetres between 100 and 230.": "cm = 90", f"metrics.weightKg: {S.ABSENT}": "kg IS NULL",
    "metrics.weightKg: Enter a weight in kilograms between 30 and 300.": "kg = 301", "medications.glp1: Unknown option.": "drug = 'aspirin'", "conditions.conditions: A condition was selected twice.": "cond = 2",
    "consent.granted: You have to agree to the consent statement before you can go on.": "NOT granted", "consent.textVersion: The consent text has changed. Read it again and agree to the current version.": "version = 'v2'",
    "medications: You selected a GLP-1 medication but answered that you use none.": "drug = 'semaglutide' AND NOT declared", "medications: Tell us which GLP-1 medication you are using.": "declared AND drug IS NULL AND other = ''",
}
_DOCS = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), d AS (SELECT k, c, {', '.join(f'{e} AS {n}' for n, e in _PARTS.items())} FROM o),
w AS (SELECT *, {', '.join(f'coalesce({e}, false) AS w{i}' for i, e in enumerate(_WRONG.values()))} FROM d), a AS (SELECT *, {' OR '.join(f'w{i}' for i in range(len(_WRONG)))} AS wrong FROM w),
s AS (SELECT *, dob::DATE AS born, kg / ((cm / 100.0) * (cm / 100.0)) AS bmi FROM a WHERE state = 'draft' AND NOT wrong),
j AS (SELECT *, 2026 - year(born) - CASE WHEN (month(born), day(born)) > (6, 1) THEN 1 ELSE 0 END < 18 AS young, bmi < 27 AS low, (bmi >= 27 AND bmi <= 30 AND cond = 0) OR declared OR drug IS NOT NULL AS flagged FROM s),
v AS (SELECT *, CASE WHEN (young OR low) AND NOT (flagged AND NOT young) THEN 'auto_rejected' WHEN flagged THEN 'auto_flagged' ELSE 'auto_cleared' END AS outcome,
 (c % 4 = 0 AND c IN (SELECT c_custkey FROM customer)) AS known FROM j)"""


@query(
    f"WITH {_DOCS} SELECT 'refused' AS what, 'not_found' AS name, count(*) FILTER (WHERE k % 50 = 0) AS n FROM o UNION ALL SELECT 'refused', 'not_draft', count(*) FROM a WHERE state <> 'draft' UNION ALL SELECT 'refused', 'invalid', count(*) FROM a WHERE state = 'draft' AND wrong "
    + " ".join("UNION ALL SELECT 'issue', '" + m.replace("'", "''") + f"', count(*) FROM a WHERE state = 'draft' AND w{i} HAVING count(*) > 0" for i, m in enumerate(_WRONG))
    + """ UNION ALL SELECT 'verdict', outcome, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'move', 'draft > submitted', count(*) FROM v UNION ALL SELECT 'move', 'submitted > ' || outcome, count(*) FROM v GROUP BY 2
 UNION ALL SELECT 'move', 'none', count(*) FROM v UNION ALL SELECT 'consent', 'granted', count(*) FROM v UNION ALL SELECT 'record', 'WHITESPACE_TRIM', count(*) FROM v WHERE k % 3 = 0 UNION ALL SELECT 'record', 'EMAIL_LOWERCASE', count(*) FROM v WHERE k % 4 = 0
 UNION ALL SELECT 'item', 'identity_conflict', count(*) FROM v WHERE known UNION ALL SELECT 'item', 'vocabulary', count(DISTINCT other) FROM v WHERE declared AND drug IS NULL AND other <> ''"""
)
def p7_submission(spark, sf):
    """Every order as a draft, submitted, written as one run and read back, by what it made."""
    out, _ = _submitted(spark, sf)
    with stored.scratch(spark) as path:
        moved = {"audit": {"a reason": F.col("reason") != ""}, "intakes": {"a verdict": F.col("state").startswith("auto_")}}
        S.write_together(out, path, moved)
        read = lambda name: S.read_together(spark, path, name)
        count = lambda what, df, c: df.groupBy(F.lit(what).alias("what"), c.alias("name")).agg(F.count("*").alias("n"))
        wrong = read("refused").select(F.inline("issues"))
        arrow = F.when(F.col("to_state").isNull(), "none").otherwise(F.concat("from_state", F.lit(" > "), "to_state"))
        parts = [
            count("refused", read("refused"), F.col("kind")), count("issue", wrong, F.concat("path", F.lit(": "), "message")), count("verdict", read("evaluations"), F.col("engine_outcome")), count("move", read("audit"), arrow),
            count("consent", read("states"), F.col("state")), count("record", read("records"), F.col("rule_code")), count("item", read("items"), F.col("type"))]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return I.checkpointed(whole)


@query(f"WITH {_DOCS} SELECT k AS intake_id, 'form:' || k AS patient_id, outcome AS state, trim(name) AS full_name, lower(email) AS email, dob, kg::DOUBLE AS weight_kg, cm::INTEGER AS height_cm, CASE WHEN declared OR drug IS NOT NULL THEN 'reported' ELSE 'none_reported' END AS medication_report FROM v")
def p7_submitted_rows(spark, sf):
    """The intakes and the patients that submitting the drafts makes."""
    out, _ = _submitted(spark, sf)
    p = out["patients"].select("patient_id", "full_name", "email", F.col("dob").cast("string"))
    return out["intakes"].join(p, "patient_id").select("intake_id", "patient_id", "state", "full_name", "email", "dob", "weight_kg", "height_cm", "medication_report")


def _submitted(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c").selectExpr("k", "c", *[f"{e} AS {n}" for n, e in _PARTS.items()])
    drug = F.when(F.col("drug").isNotNull(), F.array("drug")).otherwise(F.array().cast("array<string>"))
    document = F.to_json(F.struct(
        F.col("form").alias("formVersion"), F.struct("granted", F.col("version").alias("textVersion")).alias("consent"), F.struct(F.col("name").alias("fullName"), "email", "dob").alias("identity"),
        F.struct(F.col("cm").cast("double").alias("heightCm"), F.col("kg").cast("double").alias("weightKg")).alias("metrics"), F.struct(F.col("declared").alias("glp1Declared"), drug.alias("glp1"), F.col("other").alias("otherMedications")).alias("medications"),
        F.struct(F.array_repeat(F.lit("pcos"), F.col("cond")).alias("conditions"), F.lit("").alias("otherConditions")).alias("conditions")))
    intakes = o.select(F.col("k").alias("intake_id"), "state", document.alias("answers"))
    asked = intakes.select("intake_id").unionByName(intakes.where("intake_id % 50 = 0").selectExpr("intake_id + 1000000000000 AS intake_id"))
    k = F.col("c_custkey")
    people = table(spark, sf, "customer").where(k % 4 == 0).select(k.alias("patient_id"), F.concat(F.lit("c"), k.cast("string"), F.lit("@x.nl")).alias("email"), F.col("c_name").alias("full_name"), F.lit(None).cast("date").alias("dob"))
    return S.submit_all(intakes, asked, people, F.lit(f"{TODAY} 09:00:00").cast("timestamp"), ruleset.load()), asked
