"""Review items: what detectors hand to a person, in one shape, with keys that a second run finds again.

An item is (type, scope, title, reason, payload, field, dedupe_key, proposed). The payload is JSON with nulls kept. Rows
that an item is about stay a table of their own beside it (dedupe_key, row) where there may be any number of them; their
number, their least and a digest of all of them stand in the payload and the key. Titles, reasons, rule codes, payload
keys and action names are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decimal_shift, dedupe_key, digest, fold, mask_identifier

ITEM = "type string, scope string, title string, reason string, payload string, field string, dedupe_key string, proposed string"


def _said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _json(parts: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})


def item(df: DataFrame, kind: str, title, reason, payload: dict[str, Column], field, key: list, proposed: Column | None = None, scope: str = "row") -> DataFrame:
    """One item per row of df. key: what stands after type and scope (entity, field, rule, raw)."""
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    return df.select(
        F.lit(kind).alias("type"), F.lit(scope).alias("scope"), text(title).alias("title"), text(reason).alias("reason"), _json(payload).alias("payload"), text(field).alias("field"),
        dedupe_key(F.lit(kind), F.lit(scope), *map(text, key)).alias("dedupe_key"), text(proposed).alias("proposed"))


def digest_of(column: str) -> list[Column]:
    """Aggregates n, first, all of a group's rows: their number, the least, a digest that no order changes."""
    h = F.xxhash64(F.col(column).cast("string"))
    return [F.count("*").alias("n"), F.min(column).alias("first"), F.concat_ws(":", F.count("*").cast("string"), F.hex(F.bit_xor(h)), F.hex(F.sum(F.shiftright(h, 24)))).alias("all")]


# rule code and title by kind of flag; a null title: the field's name makes it
FLAG_RULES = {
    "email_placeholder": ("EMAIL_PLACEHOLDER_TO_NULL", "email missing, placeholder typed"), "email_internal_space": ("EMAIL_INTERNAL_SPACE_TO_NULL", "email contains a space"),
    "date_impossible": ("DATE_IMPOSSIBLE_TO_NULL", None), "date_unreadable": ("DATE_UNREADABLE_TO_NULL", None), "bsn_invalid": ("ELFPROEF", "bsn fails the elfproef"),
    "bsn_malformed": ("BSN_MALFORMED_TO_NULL", "bsn is not nine digits"), "phone_unparsed": ("PHONE_UNPARSED_TO_NULL", "phone in an unseen form"),
    "timestamp_unparsed": ("TIMESTAMP_UNPARSED", "consent event time is unreadable; no event stored"),
}
PROPOSING = {"email_internal_space": "EMAIL_INTERNAL_SPACE_REMOVED", "phone_unparsed": "PHONE_E164_FROM_DIGITS"}
IMPOSSIBLE = {"dob": "date of birth is impossible", "submitted_at": "submission date is impossible"}


def flag_items(flags: DataFrame, key: str, entity: str, shifted: DataFrame | None = None) -> DataFrame:
    """M1: an item per flag (key, kind, field, raw, proposed) that a person has to look at, numbers masked.

    Values in no vocabulary, missing units and implausible values have items of their own; an impossible sign-up date is the
    whole record's (M8), and rows of `shifted` records raise none for a submission date."""
    own = flags.where(F.col("kind").isin(*FLAG_RULES) & ((F.col("kind") != "date_impossible") | F.col("field").isin(*IMPOSSIBLE)))
    if shifted is not None:
        own = own.join(shifted.select(key).distinct().withColumn("_shifted", F.lit(True)), key, "left").where("not (coalesce(_shifted, false) and kind = 'date_impossible' and field = 'submitted_at')")
    pick = lambda table, of: reduce(lambda out, kv: F.when(of == kv[0], F.lit(kv[1])).otherwise(out), table.items(), F.lit(None).cast("string"))
    rule, title = pick({k: r for k, (r, _) in FLAG_RULES.items()}, F.col("kind")), pick({k: t for k, (_, t) in FLAG_RULES.items() if t}, F.col("kind"))
    title = F.when(F.col("kind") == "date_impossible", pick(IMPOSSIBLE, F.col("field"))).when(F.col("kind") == "date_unreadable", _said(F.col("field"), " is not a date in a known shape")).otherwise(title)
    secret = F.col("kind").isin("bsn_invalid", "bsn_malformed")
    reason = F.when(F.col("kind") == "date_impossible", F.col("proposed"))  # the mapper says there why the date can't be
    payload = {"key": F.col(key).cast("string"), "raw": F.when(~secret, F.col("raw")), "raw_masked": F.when(secret, mask_identifier(F.col("raw"))), "canonical": F.lit(None).cast("string")}
    proposal = F.when(F.col("kind").isin(*PROPOSING) & F.col("proposed").isNotNull(), _json({"field": F.col("field"), "proposed_value": F.col("proposed"), "rule": pick(PROPOSING, F.col("kind"))}))
    return item(own, "data_quality", title, reason, payload, F.col("field"), [_said(f"{entity}:", F.col(key).cast("string")), F.col("field"), rule, F.when(secret, digest(F.col("raw"))).otherwise(F.col("raw"))], proposal)


def confirmation_items(records: DataFrame, numbers: DataFrame) -> DataFrame:
    """M3: the four questions about inferences. records (key, field, rule_code): what the mappers did; numbers: one row, n and invalid."""
    by = lambda rule, *fields: [F.count_if((F.col("rule_code") == rule) & (F.col("field") == f)).alias(f) for f in fields]
    count = lambda rule: F.count_if(F.col("rule_code") == rule).alias("n")
    ask = lambda df, title, field, rule, payload: item(df, "vocabulary", title, None, payload, field, ["rule", F.lit(field).cast("string"), rule, "confirm"], scope="vocabulary")
    dates = ("dob", "signup_date", "submitted_at")
    return reduce(DataFrame.unionByName, (
        ask(records.agg(*by("DATE_ORDER_FROM_SEPARATOR", *dates)), "Confirm the date separator convention (dash = D-M-Y, slash = M-D-Y)", None, "DATE_ORDER_FROM_SEPARATOR", {"rows_converted": F.struct(*dates)}),
        ask(records.agg(count("OUTCOME_OK_ASSUMED_APPROVED")), "Confirm that outcome `OK` means approved", "outcome", "OUTCOME_OK_ASSUMED_APPROVED", {"rows": F.col("n")}),
        ask(records.agg(count("VERSION_LABEL_ASSUMED_V2")), "Confirm that questionnaire label `2.0` is v2", "questionnaire_version", "VERSION_LABEL_ASSUMED_V2", {"rows": F.col("n")}),
        ask(numbers, "bsn retention: keep, mask or drop", "bsn", "BSN_RETENTION", {"rows_with_bsn": F.col("n"), "elfproef_failures": F.col("invalid")}),
    ))


def changed_row_items(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str], entity: str, run: str, masked: tuple[str, ...] = ("bsn",)) -> DataFrame:
    """M4: rows of an export that differ from the stored version, which is kept; row_hash in both tables."""
    s = stored.select(key, F.struct(*fields).alias("s"), F.col("row_hash").alias("stored_row_hash"))
    both = incoming.select(key, F.struct(*fields).alias("i"), F.col("row_hash").alias("incoming_row_hash")).join(s, key).where("stored_row_hash <> incoming_row_hash")
    show = lambda side, f: mask_identifier(F.col(f"{side}.{f}").cast("string")) if f in masked else F.col(f"{side}.{f}").cast("string")
    differ = lambda f: F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"i.{f}")), F.struct(F.lit(f).alias("field"), show("s", f).alias("stored"), show("i", f).alias("incoming")))
    payload = {"table": F.lit(entity), "key": F.col(key).cast("string"), "stored_row_hash": F.col("stored_row_hash"), "incoming_row_hash": F.col("incoming_row_hash"), "differences": F.array_compact(F.array(*map(differ, fields)))}
    return item(both, "data_quality", f"source row changed since import run {run}", "the export contains a different version of a row already stored; the stored row is kept", payload, None,
                [_said(f"{entity}:", F.col(key).cast("string")), "", "SOURCE_ROW_CHANGED", F.col("incoming_row_hash")])


def repeated_key_items(repeats: DataFrame, key: str, entity: str, label: str) -> DataFrame:
    """M5: later rows (key, line_no, stored_line_no, row_hash) of a key whose content isn't the first's."""
    k, line, stored = F.col(key).cast("string"), F.col("line_no").cast("string"), F.col("stored_line_no").cast("string")
    reason = _said("line ", stored, " is stored and line ", line, " is not; keep the stored values or replace individual fields through the resolution path")
    payload = {"key": k, "stored_line_no": F.col("stored_line_no"), "repeated_line_no": F.col("line_no"), "repeated_row_hash": F.col("row_hash")}
    return item(repeats, "data_quality", f"{label} repeated in the export with different values", reason, payload, None, [_said(f"{entity}:", k), "", "SOURCE_KEY_REPEATED", F.col("row_hash")])


def human_conflict_items(conflicts: DataFrame, key: str, entity: str) -> DataFrame:
    """M6: incoming values (key, field, from_value, to_value, audit_entry_id) of fields that a person decided; theirs stays."""
    k, f = F.col(key).cast("string"), F.col("field")
    payload = {"entity_type": F.lit(entity), "natural_key": k, "field": f, "stored": F.col("from_value"), "mapped": F.col("to_value"), "audit_entry_id": F.col("audit_entry_id").cast("string")}
    reason = _said("human decision in audit entry ", F.col("audit_entry_id").cast("string"), " is kept; the importer did not write")
    mapped = F.regexp_extract(F.to_json(F.array("to_value")), r"^\[(.*)\]$", 1)
    return item(conflicts, "data_quality", _said(f, " was set by a human and the export now maps differently"), reason, payload, f, [_said(f"{entity}:", k), f, "HUMAN_OWNED_FIELD_DIFFERS", F.when(F.col("to_value").isNotNull(), mapped)])


def age_flip_items(flips: DataFrame, owner: str, row: str, minimum: int) -> tuple[DataFrame, DataFrame]:
    """M7: an item per subject whose rows (owner, row, raw, read, alternative, age_read, age_other) make a minor under one reading only."""
    per = flips.groupBy(owner, "raw", "read", "alternative").agg(*digest_of(row))
    payload = {"legacy_id": F.col(owner).cast("string"), "raw": F.col("raw"), "read_under_convention": F.col("read").cast("string"), "alternative_reading": F.col("alternative").cast("string"), "intakes": F.col("n"), "first": F.col("first").cast("string")}
    key = [_said("legacy_patient:", F.col(owner).cast("string")), "dob", "DOB_READING_FLIPS_MINOR", F.col("raw")]
    reason = _said("under the convention ", F.col("read").cast("string"), ", under the alternative ", F.col("alternative").cast("string"), f"; the age rule is {minimum}")
    out = item(per, "data_quality", "date of birth: the alternative reading flips minor/adult at an intake", reason, payload, "dob", key)
    return out, flips.select(dedupe_key(F.lit("data_quality"), F.lit("row"), *[k if isinstance(k, Column) else F.lit(k) for k in key]).alias("dedupe_key"), F.col(row).alias("row"), "age_read", "age_other")


def shifted_items(shifted: DataFrame, owner: str) -> DataFrame:
    """M8: records (owner, raw, read, related: rows of theirs) that lie in the future as a whole."""
    payload = {"legacy_id": F.col(owner).cast("string"), "signup_date": F.struct(F.col("raw").alias("raw"), F.col("read").cast("string").alias("read"), F.lit(None).cast("string").alias("canonical")), "rows": F.col("related")}
    return item(shifted, "data_quality", "the whole patient record is dated in the future", "signup_date is after the import reference date; every date of this patient is listed", payload, "signup_date",
                [_said("legacy_patient:", F.col(owner).cast("string")), "signup_date", "DATE_IMPOSSIBLE_TO_NULL", F.col("raw")])


def orphan_items(orphans: DataFrame, row: str, owner: str) -> DataFrame:
    """M9: rows whose owner is nowhere."""
    r, o = F.col(row).cast("string"), F.col(owner).cast("string")
    payload = {"intake_id": r, "legacy_patient_id": o, "actions": F.array(F.lit("attach_to_existing_patient"), F.lit("leave_unresolved"))}
    return item(orphans, "orphan_intake", _said("intake ", r, " references a patient that does not exist"), _said("legacy_patient_id ", o, " is in neither patients.csv nor consents.jsonl"), payload, "patient_id",
                [_said("legacy_intake:", r), "patient_id", "ORPHAN", o])


TIER_TITLES = {2: "two patient records may be the same person", 3: "two patient records share a key but contradict each other"}


def identity_items(tiers: DataFrame, matched: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Groups of tiers 2 and 3 (root, tier, contradictions, differences) for a person to decide, and their members.
    matched (root, kind): the keys that more than one member holds."""
    kinds = matched.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    open_ = tiers.where("tier > 1").join(members.groupBy("root").agg(*digest_of(key)), "root").join(kinds, "root")
    hard = F.col("tier") == 3
    ident = [_said("legacy_patient:", F.col("first").cast("string"), "+", F.col("all")), "", _said("IDENTITY_TIER_", F.col("tier").cast("string")), F.replace("kinds", F.lit(" "), F.lit(""))]
    payload = {"tier": F.col("tier"), "conflict": hard, "matched_keys": F.col("kinds"), "contradictions": F.col("contradictions"), "differences": F.col("differences"), "candidates": F.col("n"),
               "actions": F.array(F.lit("merge_with_chosen_values"), F.lit("not_the_same_person"))}
    why = F.when(hard, _said("; contradicts on ", F.array_join("contradictions", ", "))).otherwise(_said("; differs on ", F.array_join("differences", ", ")))
    out = item(open_, "identity_conflict", F.when(hard, TIER_TITLES[3]).otherwise(TIER_TITLES[2]), _said("matched on ", F.col("kinds"), why), payload, None, ident)
    keyed = open_.select("root", dedupe_key(F.lit("identity_conflict"), F.lit("row"), *[k if isinstance(k, Column) else F.lit(k) for k in ident]).alias("dedupe_key"))
    return out, keyed.join(members.select("root", F.col(key).alias("row")), "root").select("dedupe_key", "row")


def plausibility_items(values: DataFrame, owner: str, bounds: dict[str, dict], whole: tuple[str, ...] = ("height_cm",)) -> DataFrame:
    """Per owner and field the values outside the bounds: (owner, field, raw, value, own: the owner's own one). The own
    value's decimal shift is proposed where just one lands inside."""
    low, high = (reduce(lambda out, kv: F.when(F.col("field") == kv[0], F.lit(float(kv[1][end]))).otherwise(out), bounds.items(), F.lit(None).cast("double")) for end in ("min", "max"))  # noqa: B023
    per = values.withColumns({"low": low, "high": high}).where(~F.col("value").between(F.col("low"), F.col("high")))
    own = lambda c: F.min_by(F.when(F.col("own"), F.col(c)), F.when(F.col("own"), F.col("raw")))
    per = per.groupBy(owner, "field", "low", "high").agg(*digest_of("raw"), own("value").alias("value"), own("raw").alias("raw"))
    shift = decimal_shift(F.col("value"), F.col("low"), F.col("high"))
    text = F.when(F.col("field").isin(*whole), F.round(shift).cast("long").cast("string")).otherwise(F.format_string("%.1f", shift))
    edge = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    reason = _said(F.col("n").cast("string"), " value(s) outside ", edge("low"), "–", edge("high"), "; each was stored null and the raw row keeps what the export said")
    payload = {"legacy_id": F.col(owner).cast("string"), "field": F.col("field"), "values": F.col("n"), "first": F.col("first")}
    proposed = F.when(shift.isNotNull(), _json({"field": F.col("field"), "proposed_value": text, "rule": F.lit("DECIMAL_SHIFT")}))
    return item(per, "data_quality", _said(F.col("field"), " outside the plausible range"), reason, payload, F.col("field"),
                [_said("legacy_patient:", F.col(owner).cast("string")), F.col("field"), "IMPLAUSIBLE_TO_NULL", F.col("all")], proposed)


def divergence_items(pairs: DataFrame, owner: str, row: str, tolerance: dict) -> DataFrame:
    """Owners (unit kg) all of whose comparable rows (owner, row, signup, unit, weight) lie outside the tolerance."""
    ratio = F.when(F.col("signup") > 0, F.col("weight") / F.col("signup"))
    r = pairs.where("unit = 'kg'").withColumn("ratio", ratio).where("ratio is not null").withColumn("out", ~F.col("ratio").between(tolerance["min"], tolerance["max"]))
    per = r.groupBy(owner, "signup").agg(*digest_of(row), F.count_if("out").alias("outside"), F.min("ratio").alias("least"), F.max("ratio").alias("largest")).where("outside = n")
    payload = {"legacy_id": F.col(owner).cast("string"), "signup_weight_kg": F.col("signup"), "intakes": F.col("n"), "first": F.col("first").cast("string"), "least_ratio": F.round("least", 3), "largest_ratio": F.round("largest", 3)}
    return item(per, "data_quality", "signup weight and intake weight diverge beyond the tolerance", _said(F.col("n").cast("string"), f" intakes outside {tolerance['min']}–{tolerance['max']}"), payload, "weight_kg",
                [_said("legacy_patient:", F.col(owner).cast("string")), "weight_kg", "WEIGHT_DIVERGENCE", F.col("all")])


def reconciliation_item(pairs: DataFrame, owner: str, tolerance: dict) -> DataFrame:
    """One item for all owners whose converted pounds don't agree with their rows; none where all do."""
    r = pairs.where("unit = 'lbs' and signup is not null and weight is not null").withColumn("out", ~(F.col("weight") / F.col("signup")).between(tolerance["min"], tolerance["max"]))
    per = r.groupBy(owner).agg(F.count("*").alias("compared"), F.count_if("out").alias("outside"))
    one = per.agg(F.count("*").alias("owners"), F.count_if(F.col("compared") == F.col("outside")).alias("apart"), F.sum("compared").alias("compared"), F.sum("outside").alias("outside")).where("apart > 0")
    title = _said("weight_unit `lbs`: ", F.col("apart").cast("string"), " of ", F.col("owners").cast("string"), " patients do not reconcile after conversion")
    payload = {"intakes_compared": F.col("compared"), "intakes_outside": F.col("outside"), "patients_compared": F.col("owners"), "patients_disagreeing": F.col("apart")}
    reason = "converted with 0.45359237 the signup weight leaves the tolerance the kg rows support; either the unit label or the intake weight is wrong for these rows"
    return item(one, "vocabulary", title, reason, payload, "weight_kg", ["rule", "weight_kg", "WEIGHT_LBS_DO_NOT_RECONCILE", "confirm"], scope="vocabulary")


def unit_missing_item(rows: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """One item for all numbers without a unit, and both readings of each (row, raw, as_kg, as_lbs, index_kg, index_lbs)."""
    one = rows.agg(*digest_of(row)).where("n > 0")
    ident = ["rule", "weight_kg", "WEIGHT_UNIT_MISSING_TO_NULL", "confirm"]
    proposed = _json({"field": F.lit("weight_kg"), "proposed_value": F.lit("raw × 0.45359237"), "rule": F.lit("WEIGHT_UNIT_ASSUMED_POUNDS")})
    out = item(one, "vocabulary", _said("weight_unit is empty on ", F.col("n").cast("string"), " rows: are they pounds?"), "stored null until answered; the raw value and both readings are below",
               {"factor": F.lit(0.45359237), "rows": F.col("n")}, "weight_kg", ident, proposed, scope="vocabulary")
    key = dedupe_key(F.lit("vocabulary"), F.lit("vocabulary"), *map(F.lit, ident))
    return out, rows.select(key.alias("dedupe_key"), F.col(row).alias("row"), "raw", "as_kg", "as_lbs", "index_kg", "index_lbs")


def duplicate_items(rows: DataFrame, owner: str, row: str) -> tuple[DataFrame, DataFrame]:
    """Owners with several rows on a day under any reading: rows (owner, row, day, other_day, outcome); the rows of each item."""
    days = F.array_distinct(F.array_compact(F.array("day", "other_day")))
    read = rows.select(owner, row, "outcome", F.explode(days).alias("on"))
    per = read.groupBy(owner, "on").agg(*digest_of(row), F.countDistinct(F.coalesce("outcome", F.lit(""))).alias("outcomes")).where("n > 1")
    o = F.col(owner).cast("string")
    ident = [_said("legacy_patient:", o), "submitted_at", "SAME_DAY_INTAKES", F.col("all")]
    # a pair that meets on two readings is one item, that of its first day
    first = Window.partitionBy(owner, "all").orderBy("on")
    per = per.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    reason = F.when(F.col("outcomes") > 1, "the outcomes disagree").otherwise("the outcomes agree; the submissions may still be one visit recorded twice")
    payload = {"legacy_patient_id": o, "submitted_at": F.col("on").cast("string"), "outcomes_disagree": F.col("outcomes") > 1, "intakes": F.col("n"), "first": F.col("first").cast("string"), "actions": F.array(F.lit("keep_one_as_the_outcome_of_record"), F.lit("keep_both"))}
    out = item(per, "duplicate_intake", _said(F.col("n").cast("string"), " intakes from one patient on ", F.col("on").cast("string")), reason, payload, None, ident)
    keyed = per.select(owner, "on", dedupe_key(F.lit("duplicate_intake"), F.lit("row"), *[k if isinstance(k, Column) else F.lit(k) for k in ident]).alias("dedupe_key"))
    return out, keyed.join(read, [owner, "on"]).select("dedupe_key", F.col(row).alias("row"))


ACTING_ON = ("active", "paused")


def consent_items(subjects: DataFrame, key: str) -> DataFrame:
    """States (key, status, type, state) that contradict themselves or what is done with the subject."""
    acting, state = F.col("status").isin(*ACTING_ON), F.col("state")
    silent = state.isin("no_record", "unknown_pre_log")
    rule = F.when(state == "conflict", "CONSENT_CONFLICT").when(acting & (state == "revoked"), "CONSENT_REVOKED_WHILE_ACTIVE").when(acting & silent, "CONSENT_NO_RECORD_WHILE_ACTIVE")
    title = F.when(state == "conflict", "consent log contradicts itself").when(state == "revoked", _said("consent revoked while the patient is ", F.col("status"))).otherwise(_said("no consent record for a patient who is ", F.col("status")))
    reason = (
        F.when(state == "conflict", "a revocation precedes every grant, so the log revokes something that was never granted; treated as not granted until resolved")
        .when(state == "revoked", "the last event is a revocation and the commercial status says we are still acting")
        .when(state == "no_record", "the patient signed up after the log begins and has no event in it").otherwise("the log's coverage is unknowable for this patient: they predate it")
    )
    k = F.col(key).cast("string")
    payload = {"legacy_id": k, "consent_type": F.col("type"), "consent_state": state, "patient_status": F.col("status"), "actions": F.array(F.lit("record_the_state_a_human_establishes"), F.lit("change_the_patient_status"))}
    return item(subjects.withColumn("rule", rule).where("rule is not null"), "consent", title, reason, payload, "consent_state", [_said("legacy_patient:", k), F.col("type"), F.col("rule"), state])


def future_item(events: DataFrame, as_of: str) -> DataFrame:
    """One item for all consent events (action) after the run's day; none where there are none."""
    one = events.agg(F.count("*").alias("n"), F.count_if(F.col("action") == "revoked").alias("revoked")).where("n > 0")
    granted = F.col("n") - F.col("revoked")
    reason = _said(F.col("revoked").cast("string"), " revocations and ", granted.cast("string"), " grants lie in the future; the states they produce are left as derived, because a revocation is the safe direction")
    return item(one, "vocabulary", _said(F.col("n").cast("string"), f" consent events are dated after {as_of}"), reason, {"as_of": F.lit(as_of), "granted": granted, "revoked": F.col("revoked")}, "at",
                ["legacy_consent_event", "at", "CONSENT_EVENT_IN_THE_FUTURE", as_of], scope="vocabulary")


OPEN_OUTCOMES = ("approved", "pending", "unknown")
HISTORY = (  # matched rule, title, rule code, the reason that is quoted
    ("glp1_medication", "GLP-1 medication reported in free text", "HISTORY_GLP1_MEDICATION", "flagged: current GLP-1 medication"),
    ("flag_condition", "flag condition reported in free text", "HISTORY_FLAG_CONDITION", "flagged: self-reported history of"),
)


def history_items(shadow: DataFrame) -> DataFrame:
    """Stored intakes (intake_id, legacy_outcome, outcome, matched, reasons, age, ruleset) that today's rules would hold: a
    medication or condition named in free text, a minor whose outcome wasn't a rejection."""
    k = F.col("intake_id").cast("string")
    quoted = lambda prefix: F.get(F.filter("reasons", lambda r: r.startswith(prefix)), F.lit(0))
    row = lambda title, rule, prefix: F.struct((title if isinstance(title, Column) else F.lit(title)).alias("title"), F.lit(rule).alias("rule"), quoted(prefix).alias("reason"))
    young = F.array_contains("matched", "age_below_minimum") & F.col("legacy_outcome").isin(*OPEN_OUTCOMES)
    minor = row(_said("intake from a patient aged ", F.col("age").cast("string"), ", legacy outcome ", F.col("legacy_outcome")), "HISTORY_MINOR_NOT_REJECTED", "rejected: age")
    found = F.array_compact(F.array(*[F.when(F.array_contains("matched", m), row(t, rule, prefix)) for m, t, rule, prefix in HISTORY], F.when(young, minor)))
    r = shadow.withColumn("found", F.explode(found))
    payload = {"intake_id": k, "legacy_outcome": F.col("legacy_outcome"), "shadow_outcome": F.col("outcome"), "reasons": F.col("reasons"), "ruleset_version": F.col("ruleset")}
    return item(r, "clinical_history", F.col("found.title"), F.col("found.reason"), payload, None, [_said("legacy_intake:", k), "", F.col("found.rule"), F.col("ruleset")])


def existing_items(matches: DataFrame) -> DataFrame:
    """Submissions that share keys with stored rows (submission, kind, holders, existing)."""
    s = F.col("submission").cast("string")
    per = matches.groupBy("submission").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("holders").alias("holders"), F.min("existing").alias("existing"))
    payload = {"matched_keys": F.col("kinds"), "holders": F.col("holders"), "first": F.col("existing").cast("string"), "actions": F.array(F.lit("merge_with_chosen_values"), F.lit("not_the_same_person"))}
    return item(per, "identity_conflict", "a new intake may be from a patient we already have", _said("matched on ", F.array_join("kinds", ", ")), payload, None, [_said("patient:", s), "", "POSSIBLE_EXISTING_PATIENT", F.array_join("kinds", ",")])


def unknown_medication_items(declared: DataFrame) -> DataFrame:
    """One item per folded text (text, intake_id, ruleset) of a declared medication that no term of the ruleset knows."""
    per = declared.withColumn("folded", fold(F.col("text"))).where("folded <> ''").groupBy("folded").agg(F.min_by("text", "intake_id").alias("text"), F.min("intake_id").alias("first"), F.min_by("ruleset", "intake_id").alias("ruleset"), F.count("*").alias("n"))
    payload = {"declared_text": F.col("text"), "folded": F.col("folded"), "ruleset_version": F.col("ruleset"), "term_list": F.lit("glp1_terms"), "first_seen_intake_id": F.col("first").cast("string"), "intakes": F.col("n"),
               "question": _said('add "', F.col("folded"), '" to glp1_terms in the next ruleset version?')}
    return item(per, "vocabulary", _said("a patient named a GLP-1 medication the ruleset does not know: ", F.col("folded")), _said('declared current GLP-1 use; no term of glp1_terms matched "', F.col("text"), '"'), payload, None,
                ["ruleset:glp1_terms", "", "NEW_GLP1_DECLARED_UNMATCHED", F.col("folded")], scope="vocabulary")
