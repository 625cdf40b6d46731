"""Value functions on literals: text, numbers, dates, rules, keys."""

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import dates as D
from ledgermill.functions import text as T
from ledgermill.operators import normalise as N
from ledgermill.operators import rules as R
from ledgermill.sources import ruleset


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_trim_and_fold(spark):
    odd = ["\t a ", "　x﻿", "\u0085y", " A  b ", ""]
    assert many(spark, odd, T.trim_all) == ["a", "x", "\u0085y", "A  b", ""]
    assert many(spark, odd, T.fold)[3] == "a b"


def test_shapes_masks_and_numbers(spark):
    assert many(spark, ["Ab-12é"], T.shape) == ["Aa-99a"]
    assert many(spark, ["aabb11"], T.collapsed_shape) == ["a+9+"]
    assert many(spark, ["12345", "abc", "", None], T.mask_identifier) == ["**345", "***", "", None]
    assert many(spark, ["12", "12,5", "1.2.3", "x"], T.parse_number) == [12.0, 12.5, None, None]
    assert many(spark, ["José", "Jose"], T.has_diacritics) == [True, False]
    assert many(spark, ["a  b", "a b"], T.has_double_space) == [True, False]
    assert many(spark, ["J. O'Neil#2"], T.unusual_name_characters)[0] == ["#", "2"]


@pytest.mark.parametrize("parts", [["a", "b"], ["a|b", "c\\d", ""], ["", "", ""], ["x\\", "|", "\\|"], ["a", "b", "c", "d", "rule", "e"]])
def test_keys_come_apart_again(spark, parts):
    key = T.dedupe_key(*[F.lit(p) for p in parts])
    assert one(spark, T.dedupe_parts(key)) == parts
    assert one(spark, T.rule_of(key)) == (parts[4] if len(parts) > 4 else None)


def test_bands_and_shifts(spark):
    assert many(spark, [0.0, 1.0, 2.5, 9.0, None], lambda c: T.band(c, [1, 2.5]), "double") == ["<1", "1-2.5", ">=2.5", ">=2.5", None]
    assert many(spark, [0.72], lambda c: T.decimal_shift(c, 30, 300), "double") == [72.0]


def test_checksum(spark):
    def right(s):
        return len(s) == 9 and s.isdigit() and sum(int(d) * w for d, w in zip(s, (9, 8, 7, 6, 5, 4, 3, 2, -1), strict=True)) % 11 == 0

    values = [f"{i * 7654321 % 10**9:09}" for i in range(200)] + ["12345678", "", "12345678x"]
    assert many(spark, values, T.checksum11) == [right(v) for v in values]


def test_dates(spark):
    raw = ["2024-02-29", "29-02-2023", "02/29/2024", "31-12-2020", "2024-1-5", "", "13/01/2020"]
    assert [str(x) if x else None for x in many(spark, raw, D.read_by_separator)] == ["2024-02-29", None, "2024-02-29", "2020-12-31", None, None, None]
    assert [str(x) if x else None for x in many(spark, ["2024-02-03", "2024-02-02", "2024-02-13"], D.alternative_reading)] == ["2024-03-02", None, None]
    assert many(spark, ["03-04-2020", "13-04-2020", "04-13-2020", "2020-04-04", "x"], D.classify_order) == ["either", "day-month", "month-day", "same", "unreadable"]
    assert [len(x) for x in many(spark, ["03-04-2020", "13-04-20"], D.candidate_dates)] == [2, 1]
    assert many(spark, ["2024-02-30", "2024-02-28", "x"], D.is_calendar_date) == [False, True, False]


@pytest.mark.parametrize(("born", "at", "age"), [("2004-02-29", "2022-02-28", 17), ("2004-02-29", "2022-03-01", 18), ("2000-06-15", "2020-06-15", 20), ("2000-06-15", "2020-06-14", 19)])
def test_ages(spark, born, at, age):
    assert one(spark, D.age_in_years(F.lit(born).cast("date"), F.lit(at).cast("date"))) == age


@pytest.mark.parametrize(("wall", "at", "twice", "never"), [
    ("2024-10-27 02:30:00", "2024-10-27 00:30:00", True, False), ("2024-03-31 02:30:00", "2024-03-31 01:30:00", False, True),
    ("2024-07-01 12:00:00", "2024-07-01 10:00:00", False, False),
])
def test_wall_times(spark, wall, at, twice, never):
    r = one(spark, D.wall_to_instant(F.lit(wall).cast("timestamp")))
    assert (str(r["at"]), r["ambiguous"], r["nonexistent"]) == (at, twice, never)


def test_mappers(spark):
    m = many(spark, [" A@B.nl ", "a b@c.nl", "none", "", "ok@x.test"], N.map_email)
    assert [x.value for x in m] == ["a@b.nl", None, None, None, "ok@x.test"]
    assert [[r.rule_code for r in x.records] for x in m] == [["WHITESPACE_TRIM", "EMAIL_LOWERCASE"], ["EMAIL_INTERNAL_SPACE_TO_NULL"], ["EMAIL_PLACEHOLDER_TO_NULL"], [], []]
    assert m[1].flags[0].proposed == "ab@c.nl"
    p = many(spark, ["+31612345678", "06-12345678", "0612345678", "0031 (6) 12345678", "020-1234567", ""], N.map_phone)
    assert [x.value for x in p] == ["+31612345678"] * 3 + [None] * 3 and p[3].flags[0].proposed == "+31612345678" and p[4].flags[0].proposed is None
    w = spark.createDataFrame([("100", "kg"), ("220.5", "lbs"), ("70", ""), ("70", "st"), ("abc", "kg"), ("900", "kg"), ("", "kg")], "v string, u string")
    r = [x["m"] for x in w.select(N.map_weight(F.col("v"), F.col("u"), 30, 300).alias("m")).collect()]
    assert [str(x.value) if x.value is not None else None for x in r] == ["100.0", "100.0", None, None, None, None, None]
    assert [x.records[-1].rule_code if x.records else None for x in r] == [None, "WEIGHT_LBS_TO_KG", "WEIGHT_UNIT_MISSING_TO_NULL", "VOCAB_UNKNOWN", "NON_NUMERIC_TO_NULL", "IMPLAUSIBLE_TO_NULL", None]
    d = many(spark, ["31-12-2020", "2030-01-01", "x", ""], lambda c: N.map_date(c, "dob", F.lit("2024-01-01").cast("date")))
    assert [str(x.value) if x.value else None for x in d] == ["2020-12-31", None, None, None] and d[1].flags[0].kind == "date_impossible"
    h = many(spark, ["180", "18", "1.8", ""], lambda c: N.map_integer(c, "height_cm", 100, 230))
    assert [x.value for x in h] == [180, None, None, None]
    t = many(spark, ["2024-10-27T02:30:00", "27-10-2024", ""], N.map_wall_time)
    assert [[(r.rule_code, r.to_value, r.evidence) for r in x.records] for x in t] == [[("TIMESTAMP_ZONE_ASSUMED", "2024-10-27T00:30:00.000Z", '{"zone":"Europe/Amsterdam","ambiguous":true}')], [], []]
    assert [[f.kind for f in x.flags] for x in t] == [[], ["timestamp_unparsed"], ["timestamp_unparsed"]] and t[0].value is not None


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_times_do_not_depend_on_the_session(spark, zone):
    from ledgermill.operators import aggregates as A

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        wall = lambda x: F.lit(x).cast("timestamp_ntz")
        r = spark.range(1).select(
            F.unix_micros(D.wall_to_instant(wall("2024-10-27 02:30:00"))["at"]).alias("at"), D.day_of(wall("2024-07-01 22:30:00")).cast("string").alias("day"),
            A.age_window(wall("2024-01-19 23:00:00"), "2024-01-20", "today").alias("a"), A.age_window(wall("2024-01-19 22:59:59"), "2024-01-20", "today").alias("b")).first()
        assert tuple(r) == (1729989000000000, "2024-07-02", True, False)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_consent_events_without_time_or_action(spark):
    e = spark.createDataFrame([(1, "2024-07-01T12:00:00", "granted"), (2, "x", "granted"), (3, "2024-07-01T12:00:00", "maybe")], "id int, at string, action string")
    got = {r.id: r for r in N.map_consent_event(e, "id", "at", "action", {"granted": "granted", "revoked": "revoked"}).collect()}
    assert got[1].event.action == "granted" and got[2].event is None and got[3].event is None and [f.kind for f in got[3].flags] == ["vocabulary_unseen"]


def test_terms(spark):
    seg = many(spark, ["a, b;c,5 d; ,e"], R.split_segments)[0]
    assert seg == ["a", "b", "c,5 d", "e"]
    hits = one(spark, R.match_terms(R.read_segments(F.array(F.lit("Thyroid-Cancer 2; cancerous thyroid"), F.lit("no"))), ["cancer", "thyroid cancer"]))
    assert [(h["text"], h["term"]) for h in hits] == [("Thyroid-Cancer 2", "cancer")]


ROW = "age int, kg double, cm int, declared boolean, medications array<string>, conditions array<string>, other array<string>"


def verdict(spark, age=40, kg=140.0, cm=200, declared=False, medications=(), conditions=(), other=()):
    rules = ruleset.load()
    df = spark.createDataFrame([(age, kg, cm, declared, list(medications), list(conditions), list(other))], ROW)
    return R.evaluate(df, rules).first()


def test_rules(spark):
    assert verdict(spark).outcome == "auto_cleared" and verdict(spark).reasons[-1].startswith("cleared")
    assert verdict(spark, age=17).outcome == "auto_rejected" and verdict(spark, age=17, declared=True).outcome == "auto_rejected"
    assert verdict(spark, kg=80.0).outcome == "auto_rejected"
    low = verdict(spark, kg=80.0, declared=True)
    assert low.outcome == "auto_flagged" and low.reasons[-1].endswith("a human decides")
    assert verdict(spark, age=None).outcome == "not_evaluable" and verdict(spark, kg=None).outcome == "not_evaluable"
    assert verdict(spark, age=None, kg=80.0).outcome == "auto_rejected"
    assert verdict(spark, kg=None, cm=None).reasons[0] == "BMI not evaluated: weight and height missing"
    band = verdict(spark, kg=112.0)
    assert band.matched == ["bmi_band_without_condition"] and "28.0" in band.reasons[0]
    assert verdict(spark, kg=112.0, conditions=["no; PCOS (2019)"]).outcome == "auto_cleared"
    assert verdict(spark, kg=112.0, conditions=["no; PCOS (2019)"]).reasons[0] == "note: BMI 28.0 in the 27–30 band, weight-related condition present (PCOS (2019))"
    assert verdict(spark, kg=112.0, other=["pcos"]).outcome == "auto_flagged"
    assert verdict(spark, other=["had Pancreatitis"]).reasons == ["flagged: self-reported history of thyroid cancer / pancreatitis (had Pancreatitis)"]
    drug = verdict(spark, medications=["Ozempic 0,5 mg; aspirin", "my wegovy"], declared=True)
    assert drug.matched == ["glp1_medication"] and drug.reasons == ["flagged: current GLP-1 medication (Ozempic 0,5 mg; my wegovy)"]
    assert verdict(spark, declared=True).reasons == ["flagged: current GLP-1 medication (declared by patient)"]


def test_index_boundaries(spark):
    """For every height, the least tenth of a kilogram at or above 27 clears the limit and the one below doesn't."""
    rows = []
    for cm in range(150, 201):
        tenths = -(-27 * cm * cm // 1000)
        rows += [(40, tenths / 10, cm, False, [], [], []), (40, (tenths - 1) / 10, cm, False, [], [], [])]
    out = [r.outcome for r in R.evaluate(spark.createDataFrame(rows, ROW), ruleset.load()).select("outcome").collect()]
    assert out == ["auto_flagged", "auto_rejected"] * 51


def test_shown_numbers_keep_their_side(spark):
    x = many(spark, [26.96, 26.999, 26.99999999, 27.0, 30.04], lambda c: R.show_number(c, lambda v: v < 27), "double")
    assert x == ["26.96", "26.999", "26.99999999", "27.0", "30.0"]


BMI, BAND = ruleset.DEFAULT["bmi"], ruleset.DEFAULT["bmi"]["flag_band"]


@pytest.mark.parametrize("bad", [
    {"bmi": {**BMI, "flag_band": {**BAND, "min": 30}}}, {"bmi": {**BMI, "reject_below": 30}}, {"bmi": {**BMI, "rounding": "half"}}, {"glp1_terms": []}, {"glp1_terms": ["-"]},
    {"flag_condition_terms": ["Upper"]}, {"precedence": {"absolute_rejects": ["nonsense"], "flag_preempts_reject": True}}, {"age": {"minimum_years": 0}}, {"version": "v2"},
    {"plausibility": {**ruleset.DEFAULT["plausibility"], "height_cm": {"min": 5, "max": 5}}}, {"weight_divergence": {}}, {"age": None},
])
def test_bad_rulesets_are_refused(bad):
    with pytest.raises(ValueError):
        ruleset.parse({**ruleset.DEFAULT, **bad})


def test_rulesets_that_pass():
    assert ruleset.parse({**ruleset.DEFAULT, "note": 1}) == ruleset.load()
    inside = ruleset.parse({**ruleset.DEFAULT, "bmi": {**BMI, "reject_below": 29}, "glp1_terms": [" ozempic "]})
    assert inside.bmi["reject_below"] == 29 and inside.glp1_terms == ["ozempic"]
