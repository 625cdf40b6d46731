"""Submitted answers as one gated step: documents validated, patients made, verdicts given, moves, consent, items, all from one plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import age_in_years, is_calendar_date
from ..functions.text import fold, trim_all
from ..sources import stored
from ..sources.ruleset import Ruleset
from . import rules as R
from .detectors import possible_existing
from .events import derive_states
from .identity import checkpointed, dealt
from .items import existing_items, unknown_medication_items
from .normalise import EMAIL, map_email, trim_whitespace

# fixed values: versions, names and limits of the form
FORM_VERSION, CONSENT_VERSION, CONSENT_TYPE = "intake-form-v1", "v3", "data_processing"
FORM, ENGINE = "intake form", "eligibility engine"
OLDEST = 100
MEDICATIONS = ("semaglutide", "tirzepatide", "liraglutide", "dulaglutide", "exenatide", "lixisenatide")
CONDITIONS = ("hoge bloeddruk", "diabetes type 2", "prediabetes", "hoog cholesterol", "slaapapneu", "pcos", "schildklierkanker", "pancreatitis")
SHAPE = (
    "formVersion string, consent struct<granted: boolean, textVersion: string>, identity struct<fullName: string, email: string, dob: string>, metrics struct<heightCm: double, weightKg: double>, "
    "medications struct<glp1Declared: boolean, glp1: array<string>, otherMedications: string>, conditions struct<conditions: array<string>, otherConditions: string>"
)
ABSENT = "Missing or not of the right kind."

Check = tuple[str, Callable[[Column], Column], str]


def field_checks(today: Column, rules: Ruleset) -> list[Check]:
    """(path, what a value there has to be, what is said if it isn't), in the order in which they are said. A value that is missing or of
    another kind fails one check more and none of these. Messages are fixed values."""
    height, weight = rules.plausibility["height_cm"], rules.plausibility["weight_kg"]
    tall, heavy = (f"{b['min']} and {b['max']}." for b in (height, weight))
    once = lambda v: F.size(v) == F.size(F.array_distinct(v))
    known = lambda options: lambda v: F.forall(v, lambda x: F.coalesce(x.isin(*options), F.lit(False)))
    day = lambda v: v.try_cast("date")
    return [
        ("formVersion", lambda v: v == FORM_VERSION, f"Not a document of {FORM_VERSION}."),
        ("identity.fullName", lambda v: F.length(v) <= 200, "At most 200 characters."),
        ("identity.fullName", lambda v: trim_all(v) != "", "Enter your full name."),
        ("identity.email", lambda v: F.length(v) <= 320, "At most 320 characters."),
        ("identity.email", lambda v: F.lower(trim_all(v)).rlike(EMAIL), "Enter an email address in the form name@example.com."),
        ("identity.dob", is_calendar_date, "Enter your date of birth as YYYY-MM-DD."),
        ("identity.dob", lambda v: ~is_calendar_date(v) | (day(v) < today), "Your date of birth must be in the past."),
        ("identity.dob", lambda v: ~is_calendar_date(v) | (age_in_years(day(v), today) <= OLDEST), f"Enter a date of birth giving an age of at most {OLDEST}."),
        ("metrics.heightCm", lambda v: v == F.floor(v), "Enter your height in whole centimetres."),
        ("metrics.heightCm", lambda v: v.between(height["min"], height["max"]), f"Enter a height in centimetres between {tall}"),
        ("metrics.weightKg", lambda v: v.between(weight["min"], weight["max"]), f"Enter a weight in kilograms between {heavy}"),
        ("metrics.weightKg", lambda v: F.round(v, 1) == v, "Enter a weight with at most one decimal place."),
        ("medications.glp1Declared", lambda v: F.lit(True), ""),
        ("medications.glp1", known(MEDICATIONS), "Unknown option."),
        ("medications.glp1", once, "A medication was selected twice."),
        ("medications.otherMedications", lambda v: F.length(v) <= 1000, "At most 1000 characters."),
        ("conditions.conditions", known(CONDITIONS), "Unknown option."),
        ("conditions.conditions", once, "A condition was selected twice."),
        ("conditions.otherConditions", lambda v: F.length(v) <= 1000, "At most 1000 characters."),
        ("consent.granted", lambda v: v, "You have to agree to the consent statement before you can go on."),
        ("consent.textVersion", lambda v: v == CONSENT_VERSION, "The consent text has changed. Read it again and agree to the current version."),
    ]


def issues(answers: Column, today: Column, rules: Ruleset) -> Column:
    """Array of struct(path, message) for one document (a struct of SHAPE), empty if it may be submitted. Checks are data, compiled
    into one expression; none of them stops a job. What the medications say together is looked at once each of them is sound."""
    at = lambda path: reduce(lambda c, name: c[name], path.split("."), answers)
    say = lambda path, wrong, message: F.when(wrong, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    checks = field_checks(today, rules)
    paths = list(dict.fromkeys(p for p, _, _ in checks))
    absent = [say(p, at(p).isNull(), ABSENT) for p in paths]
    wrong = [say(p, at(p).isNotNull() & ~F.coalesce(ok(at(p)), F.lit(False)), m) for p, ok, m in checks]
    single = F.array_compact(F.array(*absent, *wrong))
    sound = F.size(F.filter(single, lambda x: x["path"].startswith("medications"))) == 0
    uses, named, own = at("medications.glp1Declared"), F.size(at("medications.glp1")) > 0, trim_all(at("medications.otherMedications")) != ""
    together = [
        say("medications", sound & ~uses & named, "You selected a GLP-1 medication but answered that you use none."),
        say("medications", sound & uses & ~named & ~own, "Tell us which GLP-1 medication you are using."),
    ]
    return F.concat(single, F.array_compact(F.array(*together)))


def parsed(document: Column) -> Column:
    """A JSON document as a struct of SHAPE; fields that aren't there or of another kind are null, keys that nobody asked for go."""
    return F.from_json(document, SHAPE, {"mode": "PERMISSIVE"})


def submit_all(intakes: DataFrame, requests: DataFrame, patients: DataFrame, now: Column, rules: Ruleset) -> dict[str, DataFrame]:
    """What submitting the requested drafts writes.

    intakes: intake_id, state, answers (JSON); requests: intake_id; patients (stored): patient_id, email, full_name, dob; now: the instant, whose
    UTC day is the day of submission. Returns refused (intake_id, kind: not_found, not_draft or invalid, issues), patients, records
    (normalisation of name and e-mail), intakes (the next rows of those submitted), evaluations, audit, consent_events, states, items.
    A draft with an issue writes nothing but its refusal; all outputs come from one table of sound drafts, written out once.
    A new patient's id is the intake's with `form:` before it. An intake that is asked for twice is submitted once.
    """
    today = F.to_date(now)
    # checking a document is dear and its rows are much alike: dealt by number, else a few tasks would check all of them
    asked = dealt(requests.select("intake_id").distinct(), requests.count(), "intake_id").join(intakes.select("intake_id", "state", "answers", F.lit(True).alias("_here")), "intake_id", "left")
    asked = asked.withColumn("a", parsed(F.coalesce("answers", F.lit("{}")))).withColumn("issues", F.when(F.col("state") == "draft", issues(F.col("a"), today, rules)))
    kind = F.when(F.col("_here").isNull(), "not_found").when(~F.col("state").eqNullSafe(F.lit("draft")), "not_draft").when(F.size("issues") > 0, "invalid")
    asked = checkpointed(asked.withColumn("kind", kind))
    refused = asked.where("kind is not null").select("intake_id", "kind", F.when(F.col("kind") == "invalid", F.col("issues")).alias("issues"))

    name, email = trim_whitespace(F.col("a.identity.fullName"), "full_name"), map_email(F.col("a.identity.email"))
    sound = asked.where("kind is null").select(
        "intake_id", F.concat(F.lit("form:"), F.col("intake_id").cast("string")).alias("patient_id"), "a", name["value"].alias("full_name"), email["value"].alias("email"),
        F.concat(name["records"], email["records"]).alias("records"), F.col("a.identity.dob").cast("date").alias("dob"), F.round("a.metrics.weightKg", 1).alias("weight_kg"), F.col("a.metrics.heightCm").cast("int").alias("height_cm"),
        F.col("a.medications.glp1Declared").alias("glp1_declared"), F.col("a.medications.glp1").alias("glp1"), F.col("a.medications.otherMedications").alias("other_medications"),
        F.col("a.conditions.conditions").alias("conditions"), F.col("a.conditions.otherConditions").alias("other_conditions"), today.alias("submitted_at"))
    judged = checkpointed(R.evaluate(R.eligibility_input(sound), rules))
    to_state = R.state_for_outcome(F.col("outcome"))
    null = F.lit(None).cast("string")
    line = lambda actor, entity, id_, was, now_, reason: F.struct(F.lit(actor).alias("actor"), F.lit(entity).alias("entity_type"), id_.cast("string").alias("entity_id"), was.alias("from_state"), now_.alias("to_state"), reason.alias("reason"))
    i, p = F.col("intake_id"), F.col("patient_id")
    audit = judged.select(F.inline(F.array(
        line(FORM, "patient", p, null, null, F.concat(F.lit("patient created by the intake form from intake "), i.cast("string"))),
        line(FORM, "intake", i, F.lit("draft"), F.lit("submitted"), F.lit("submitted through the intake form")),
        line(ENGINE, "intake", i, F.lit("submitted"), to_state, F.array_join("reasons", "; ")))))
    made = judged.select(
        "patient_id", "full_name", "email", "dob", F.lit("unknown").alias("sex"), F.lit("absent").alias("bsn_check"), F.lit("prospect").alias("status"), F.col("submitted_at").alias("signup_date"), F.lit("intake_form").alias("source"))
    events = judged.select(p, F.lit(CONSENT_TYPE).alias("type"), F.lit("granted").alias("action"), now.alias("at"), F.lit(CONSENT_VERSION).alias("version"))
    seen = events.select(F.col("patient_id").alias("subject"), "type", "action", "at", F.col("patient_id").alias("id"))
    states = derive_states(made.select(F.col("patient_id").alias("subject"), F.col("signup_date").alias("signup")), seen, [CONSENT_TYPE], F.lit("1970-01-01").cast("date"))
    born = F.when(F.col("dob").isNotNull() & (fold(F.col("full_name")) != ""), F.concat(fold(F.col("full_name")), F.lit("|"), F.col("dob").cast("string")))
    keyed = lambda df: df.select(F.col("patient_id").cast("string").alias("patient_id"), F.col("email").cast("string").alias("email"), born.alias("name_born"))
    matches = possible_existing(keyed(judged), keyed(patients), "patient_id", ["email", "name_born"])
    known = R.match_terms(R.read_segments(F.col("medications")), rules.glp1_terms)
    unknown = judged.where(F.col("glp1_declared") & (F.size(known) == 0) & (trim_all(F.col("other_medications")) != "")).select(F.col("other_medications").alias("text"), "intake_id", "ruleset")
    return {
        "refused": refused, "patients": made, "records": judged.select(p, F.inline("records")), "audit": audit, "consent_events": events, "states": states,
        "intakes": judged.select("intake_id", "patient_id", to_state.alias("state"), "submitted_at", F.col("a.formVersion").alias("questionnaire"), "weight_kg", "height_cm", "medication_report", "condition_report", F.lit("pending").alias("outcome"), "ruleset"),
        "evaluations": judged.select("intake_id", "ruleset", F.col("outcome").alias("engine_outcome"), "reasons", "matched", F.lit(False).alias("shadow")),
        "items": existing_items(matches).unionByName(unknown_medication_items(unknown))}


def write_together(outputs: dict[str, DataFrame], path: str, checks: dict[str, dict[str, Column]]) -> int:
    """Write all outputs as the next run of `path`, or none of them. checks: for an output the conditions that each of its rows has
    to meet; they are counted while the rows are written (`observe`), not in a pass of their own. The run counts once its
    mark is there; a check that fails, or a job that stops, leaves what counted before. Returns the number of the run."""
    spark = next(iter(outputs.values())).sparkSession
    run = max(stored.complete(spark, path, "run"), default=-1) + 1
    folder = f"{path}/run={run}"
    stored.remove(spark, folder)  # what a stopped run has left
    failed = {}
    try:
        for name, df in outputs.items():
            seen = Observation(f"{name}-{uuid.uuid4().hex}")
            rules = checks.get(name, {})
            counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()]
            df.observe(seen, F.count("*").alias("rows of the output"), *counts).write.parquet(f"{folder}/{name}")
            failed |= {f"{name}: {k}": seen.get[k] for k in rules if seen.get[k]}
        if failed:
            raise ValueError(f"nothing is written: {failed}")
        stored.mark(spark, folder)
    except BaseException:
        stored.remove(spark, folder)
        raise
    return run


def read_together(spark, path: str, name: str) -> DataFrame | None:
    """An output of all runs that count; None before the first."""
    runs = stored.complete(spark, path, "run")
    return spark.read.parquet(*[f"{path}/run={n}/{name}" for n in runs]) if runs else None
