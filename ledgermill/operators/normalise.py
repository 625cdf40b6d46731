"""Column normalisation: each mapper gives struct(value, records, flags).

records: every change, as (field, from_value, to_value, rule_code, evidence); flags: what a person should see, as
(kind, field, raw, proposed). Both are arrays without nulls, ready to explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

# fixed values: patterns, rule codes and flag kinds of this module
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
RECORD = "array<struct<field:string,from_value:string,to_value:string,rule_code:string,evidence:string>>"
FLAG = "array<struct<kind:string,field:string,raw:string,proposed:string>>"


def _text(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("string")


def record(when: Column, field: str, old, new, rule: str, evidence=None) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), _text(old).alias("from_value"), _text(new).alias("to_value"), F.lit(rule).alias("rule_code"), _text(evidence).alias("evidence")))


def flag(when: Column, kind: str, field: str, raw, proposed=None) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), _text(raw).alias("raw"), _text(proposed).alias("proposed")))


def mapped(value: Column, records: list[Column] = (), flags: list[Column] = ()) -> Column:
    some = lambda x, kind: F.array_compact(F.array(*x)).cast(kind) if x else F.array().cast(kind)
    return F.struct(value.alias("value"), some(list(records), RECORD).alias("records"), some(list(flags), FLAG).alias("flags"))


def trim_whitespace(raw: Column, field: str) -> Column:
    """B1."""
    t = T.trim_all(raw)
    return mapped(t, [record(raw != t, field, raw, t, "WHITESPACE_TRIM")])


def map_email(raw: Column, field: str = "email") -> Column:
    """B2: trim, lower-case, syntax; inner spaces give a proposal, anything else is a placeholder."""
    t = T.trim_all(raw)
    low = F.lower(t)
    tight = F.regexp_replace(low, f"{T.WS}+", "")
    good = low.rlike(EMAIL)
    spaced = ~good & (tight != low) & tight.rlike(EMAIL)
    junk = ~good & ~spaced & (raw != "")
    shown = F.when(t == "", F.lit("")).otherwise(low)
    return mapped(
        F.when(good, low),
        [
            record(raw != t, field, raw, t, "WHITESPACE_TRIM"),
            record((low != t) & (t != ""), field, t, low, "EMAIL_LOWERCASE"),
            record(spaced, field, low, None, "EMAIL_INTERNAL_SPACE_TO_NULL"),
            record(junk, field, shown, None, "EMAIL_PLACEHOLDER_TO_NULL"),
        ],
        [flag(spaced, "email_internal_space", field, raw, tight), flag(junk, "email_placeholder", field, raw)],
    )


def map_date(raw: Column, field: str, as_of: Column, signup: Column | None = None) -> Column:
    """B5."""
    d = D.read_by_separator(raw)
    why = F.when(d.isNotNull(), D.impossible_reason(d, as_of, signup))
    unread = (raw != "") & d.isNull()
    return mapped(
        F.when(why.isNull(), d),
        [
            record(unread, field, raw, None, "DATE_UNREADABLE_TO_NULL"),
            record(d.isNotNull() & (D.separator_shape(raw) != "iso"), field, raw, d, "DATE_ORDER_FROM_SEPARATOR"),
            record(why.isNotNull(), field, d, None, "DATE_IMPOSSIBLE_TO_NULL"),
        ],
        [flag(unread, "date_unreadable", field, raw), flag(why.isNotNull(), "date_impossible", field, raw, why)],
    )


def map_bsn(raw: Column, field: str = "bsn") -> Column:
    """Value is struct(number, check): valid, invalid or absent."""
    nine, ok = raw.rlike("^[0-9]{9}$"), T.checksum11(raw)
    value = F.struct(F.when(nine, raw).alias("bsn"), F.when(nine & ok, "valid").when(nine, "invalid").otherwise("absent").alias("bsn_check"))
    bad = ~nine & (raw != "")
    return mapped(value, [record(bad, field, raw, None, "BSN_MALFORMED_TO_NULL")], [flag(bad, "bsn_malformed", field, raw), flag(nine & ~ok, "bsn_invalid", field, raw)])


def map_phone(raw: Column, field: str = "phone") -> Column:
    """Mobile numbers in international form; others are null, with a proposal where the digits tell it."""
    done, national = raw.rlike(r"^\+316[0-9]{8}$"), raw.rlike(r"^06-?[0-9]{8}$")
    made = F.concat(F.lit("+31"), F.substring(F.replace(raw, F.lit("-"), F.lit("")), 2, 20))
    digits = F.regexp_replace(raw, r"[\s\-().+]", "")
    tail = F.regexp_extract(digits, r"^(?:0031|31|0)(6[0-9]{8})$", 1)
    lost = ~done & ~national & (raw != "")
    return mapped(
        F.when(done, raw).when(national, made),
        [record(national, field, raw, made, "PHONE_E164_NL_MOBILE"), record(lost, field, raw, None, "PHONE_UNPARSED_TO_NULL")],
        [flag(lost, "phone_unparsed", field, raw, F.when(tail != "", F.concat(F.lit("+31"), tail)))],
    )


DECIMAL = "^[0-9]+(\\.[0-9])?$"
POUND = "0.45359237"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_weight(raw: Column, unit: Column | None, low: float, high: float, field: str = "weight_kg") -> Column:
    """One decimal; pounds to kilograms; outside the bounds null. unit None: kilograms."""
    number = raw.rlike(DECIMAL)
    read = F.struct(raw.alias("raw"), number.alias("number"), F.when(number, raw).try_cast("decimal(9,1)").alias("n"), (F.lit("kg") if unit is None else unit).alias("unit"))

    def said(x: Column, y: Column) -> Column:
        number, words = x["number"], (x["raw"] != "") & ~x["number"]
        missing = number & (x["unit"] == "")
        unseen = number & ~x["unit"].isin("kg", "lbs") & ~missing
        out = ~y["now"].between(low, high)
        return mapped(
            F.when(~out, y["now"]),
            [
                record(words, field, x["raw"], None, "NON_NUMERIC_TO_NULL"),
                record(missing, field, x["raw"], None, "WEIGHT_UNIT_MISSING_TO_NULL"),
                record(unseen, field, x["raw"], None, "VOCAB_UNKNOWN"),
                *([record(unseen, "weight_unit", x["unit"], None, "VOCAB_UNKNOWN")] if unit is not None else []),
                record(number & (x["unit"] == "lbs"), field, x["raw"], y["kg"], "WEIGHT_LBS_TO_KG"),
                record(out, field, y["now"], None, "IMPLAUSIBLE_TO_NULL"),
            ],
            [
                flag(words, "non_numeric", field, x["raw"]), flag(missing, "weight_unit_missing", field, x["raw"]),
                *([flag(unseen, "vocabulary_unseen", "weight_unit", x["unit"])] if unit is not None else []), flag(out, "implausible", field, x["raw"]),
            ],
        )

    def converted(x: Column) -> Column:
        kg = F.when(x["unit"] == "lbs", F.round(x["n"] * F.lit(POUND).cast("decimal(9,8)"), 1).cast("decimal(9,1)"))
        return let(F.struct(kg.alias("kg"), x["n"].alias("n")), lambda k: let(
            F.struct(k["kg"].alias("kg"), F.when(x["unit"] == "kg", k["n"]).otherwise(k["kg"]).alias("now")), lambda y: said(x, y)))

    return let(read, converted)


def map_integer(raw: Column, field: str, low: int | None = None, high: int | None = None) -> Column:
    """Whole numbers, with bounds where given (height) or without (units a week)."""
    whole = raw.rlike("^[0-9]+$")
    n = F.when(whole, raw).try_cast("int")
    out = n.isNotNull() & ~n.between(low, high) if low is not None else F.lit(False)
    words = (raw != "") & ~whole
    return mapped(F.when(~out, n), [record(words, field, raw, None, "NON_NUMERIC_TO_NULL"), record(out, field, raw, None, "IMPLAUSIBLE_TO_NULL")],
                  [flag(words, "non_numeric", field, raw), flag(out, "implausible", field, raw)])


def map_vocabulary(raw: Column, field: str, words: dict[str, str], rule: str = "VOCAB_MAPPED", unknown: str | None = None, empty: str | None = None) -> Column:
    """Exact spelling looked up; a spelling equal to its value leaves no record; others become `unknown`, flagged."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    hit = F.element_at(table, F.when(raw != "", raw))
    unseen = (raw != "") & hit.isNull()
    return mapped(
        F.when(raw == "", F.lit(empty)).otherwise(F.coalesce(hit, F.lit(unknown))),
        [record(hit.isNotNull() & (hit != raw), field, raw, hit, rule), record(unseen, field, raw, unknown, "VOCAB_UNKNOWN")],
        [flag(unseen, "vocabulary_unseen", field, raw)],
    )


def map_report(raw: Column, field: str, none_words: list[str], rule: str) -> Column:
    """Not answered, nothing to report, or reported."""
    none = raw.isin(none_words)
    return mapped(F.when(raw == "", "not_answered").when(none, "none_reported").otherwise("reported"), [record(none, field, raw, "none_reported", rule)])


def map_wall_time(raw: Column, field: str = "at") -> Column:
    """B13 on text YYYY-MM-DDTHH:MM:SS; the record says which zone was assumed and whether the hour was an odd one.
    Other writings, empty ones included, are null and flagged."""
    ok = raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
    got = D.wall_to_instant(F.when(ok, raw).try_cast("timestamp_ntz"))
    read = got["at"].isNotNull()
    odd = lambda k: F.when(got[k], True)
    detail = F.to_json(F.struct(F.lit(D.ZONE).alias("zone"), odd("ambiguous").alias("ambiguous"), odd("nonexistent").alias("nonexistent")))
    iso = F.date_format(got["wall"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return mapped(got["at"], [record(read, field, raw, iso, "TIMESTAMP_ZONE_ASSUMED", detail)], [flag(~read, "timestamp_unparsed", field, raw)])


def map_consent_event(rows: DataFrame, key: str, at: str, action: str, actions: dict[str, str]) -> DataFrame:
    """(key, at, action, records, flags, event): `event` is null where time or action can't be used; the row with
    its records and flags stays."""
    r = map_rows(rows, key, {"at": map_wall_time(F.col(at)), "action": map_vocabulary(F.col(action), "action", actions)})
    return r.withColumn("event", F.when(F.col("at").isNotNull() & F.col("action").isNotNull(), F.struct("at", "action")))


def map_rows(df: DataFrame, key: str, mappers: dict[str, Column]) -> DataFrame:
    """One row per input row: key, a column per field, all records and flags."""
    df = df.select(key, *[m.alias(f"_{name}") for name, m in mappers.items()])
    joined = lambda part: F.flatten(F.array(*[F.col(f"_{n}.{part}") for n in mappers])).alias(part)
    return df.select(key, *[F.col(f"_{n}.value").alias(n) for n in mappers], joined("records"), joined("flags"))


def evidence(rows: DataFrame, key: str, part: str = "records") -> DataFrame:
    """The records (or flags) as rows of their own, with the key."""
    return rows.select(key, F.explode(part).alias("_r")).select(key, "_r.*")


def rule_counts(records: DataFrame) -> DataFrame:
    """Rule, field, number of records, of those that blanked the value."""
    return records.groupBy("rule_code", "field").agg(F.count("*").alias("n"), F.count_if(F.col("to_value").isNull()).alias("blanked"))


def rule_field_map(records: DataFrame) -> DataFrame:
    """Per rule the total and a sorted list of (field, n)."""
    per = rule_counts(records)
    return per.groupBy("rule_code").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("field", "n"))).alias("fields"))


def failed_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Names of the checks that a row breaks; a null check counts as kept."""
    bad = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]
    return df.withColumn("failed", F.array_compact(F.array(*bad)))
