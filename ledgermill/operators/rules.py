"""The term matcher, the rule engine and the state machine, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import age_at, age_in_years
from ..functions.text import trim_all
from ..sources.ruleset import Ruleset


def split_segments(c: Column) -> Column:
    """Cut at semicolons and at commas that aren't decimal; trimmed, without empties."""
    return F.filter(F.transform(F.split(c, r";|,(?!\d)"), trim_all), lambda s: s != "")


def tokens_text(c: Column) -> Column:
    """Lower-case letters and digits, one space between tokens and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def contains_run(tokens: Column, needle: Column) -> Column:
    """The needle's tokens stand in the text one after another."""
    return F.contains(tokens, needle)


def read_segments(values: Column) -> Column:
    """Segments of an array of free texts, each as struct(text, k: its tokens)."""
    segments = F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), split_segments))
    return F.transform(segments, lambda s: F.struct(s.alias("text"), tokens_text(s).alias("k")))


def _key(term: str) -> str:
    return " " + re.sub(r"[\W_]+", " ", term.lower()).strip() + " "


def match_terms(read: Column, terms: list[str]) -> Column:
    """Per segment (as `read_segments` gives them), in order, struct(text, term) of the first listed term that it
    contains. One pattern of all terms looks first whether there is any."""
    table = F.array(*[F.struct(F.lit(_key(t)).alias("k"), F.lit(t).alias("t")) for t in terms])
    some = F.filter(read, lambda m: m["k"].rlike(f" (?:{'|'.join(re.escape(_key(t)[1:]) for t in terms)})"))
    return F.transform(some, lambda m: F.struct(m["text"].alias("text"), F.get(F.filter(table, lambda t: contains_run(m["k"], t["k"])), F.lit(0))["t"].alias("term")))


def in_band(x: Column, band: dict) -> Column:
    """C5."""
    low = x >= band["min"] if band["min_inclusive"] else x > band["min"]
    return low & (x <= band["max"] if band["max_inclusive"] else x < band["max"])


def show_number(x: Column, holds) -> Column:
    """As few decimals (one at least, four at most) as keep the comparison true, else the whole number."""
    shown = [F.format_string(f"%.{d}f", x) for d in range(1, 5)]
    out = x.cast("string")
    for s in reversed(shown):
        out = F.when(holds(s.try_cast("double")) == holds(x), s).otherwise(out)
    return out


def body_mass_index(kg: Column, cm: Column) -> Column:
    """Doubles, thresholds on the unrounded value."""
    return kg.cast("double") * 10000 / (cm.cast("double") * cm.cast("double"))


def evaluate(df: DataFrame, rules: Ruleset, age="age", kg="kg", cm="cm", declared="declared", medications="medications",
             conditions="conditions", other="other") -> DataFrame:
    """Adds outcome, reasons, matched, bmi, ruleset. A missing input never clears a row.

    age int, kg, cm numbers, declared boolean; medications, conditions, other: arrays of free texts. Every rule
    is a row of a list: code, what it does (reject or flag), where it holds, what it says; the verdict is read off
    the list. Codes and texts are fixed values.
    """
    reject_below, band = rules.bmi["reject_below"], rules.bmi["flag_band"]
    own = df.columns
    texts = lambda c: read_segments(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")))
    # bound one after another, so that each is worked out once
    df = df.select(F.struct("*").alias("row"), F.col(age).alias("age"), F.col(kg).alias("kg"), F.col(cm).alias("cm"), F.coalesce(F.col(declared), F.lit(False)).alias("declared"),
                   texts(medications).alias("med"), texts(conditions).alias("con"), texts(other).alias("oth"))
    df = df.select("row", "age", "kg", "cm", "declared", body_mass_index(F.col("kg"), F.col("cm")).alias("bmi"), match_terms(F.col("med"), rules.glp1_terms).alias("drugs"),
                   match_terms(F.concat("con", "oth"), rules.flag_condition_terms).alias("history"), match_terms(F.col("con"), rules.weight_related_condition_terms).alias("related"))
    bmi, quote = F.col("bmi"), lambda c: F.array_join(F.transform(c, lambda m: m["text"]), "; ")
    sure = lambda c: F.coalesce(c, F.lit(False))
    df = df.withColumns({"low": sure(bmi < reject_below), "banded": sure(in_band(bmi, band) & (bmi >= reject_below)), "young": sure(F.col("age") < rules.age["minimum_years"]),
                         "below": show_number(bmi, lambda v: v < reject_below), "within": show_number(bmi, lambda v: in_band(v, band))})
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    too_young, too_low = said("age ", F.col("age").cast("string"), " at submission"), said("BMI ", F.col("below"), f" below {reject_below:g}")
    evidence = F.when(F.size("drugs") > 0, quote(F.col("drugs"))).otherwise("declared by patient")
    table = [
        ("age_below_minimum", "reject", F.col("young"), too_young),
        ("bmi_below_minimum", "reject", F.col("low"), too_low),
        ("bmi_band_without_condition", "flag", F.col("banded") & (F.size("related") == 0), said("BMI ", F.col("within"), " with no weight-related condition")),
        ("glp1_medication", "flag", F.col("declared") | (F.size("drugs") > 0), said("current GLP-1 medication (", evidence, ")")),
        ("flag_condition", "flag", F.size("history") > 0, said("self-reported history of thyroid cancer / pancreatitis (", quote(F.col("history")), ")")),
    ]
    any_of = lambda picked: reduce(Column.__or__, [when for _, _, when, _ in picked], F.lit(False))
    rejects, flags = [r for r in table if r[1] == "reject"], [r for r in table if r[1] == "flag"]
    df = df.withColumns({"absolute": any_of([r for r in rejects if r[0] in rules.precedence["absolute_rejects"]]), "rejected": any_of(rejects), "flagged": any_of(flags)})
    yields = F.lit(rules.precedence["flag_preempts_reject"]) & F.col("flagged") & F.col("rejected") & ~F.col("absolute")
    outcome = (
        F.when(F.col("rejected") & ~yields, "auto_rejected").when(F.col("flagged"), "auto_flagged")
        .when(F.col("age").isNull() | bmi.isNull(), "not_evaluable").otherwise("auto_cleared")
    )
    missing = F.concat_ws(" and ", F.when(F.col("kg").isNull(), "weight"), F.when(F.col("cm").isNull(), "height"))
    line = {code: F.when(when, said("rejected: " if does == "reject" else "flagged: ", text)) for code, does, when, text in table}
    reasons = [
        F.when(F.col("age").isNull(), "age not evaluated: date of birth missing"), line["age_below_minimum"],
        F.when(bmi.isNull(), said("BMI not evaluated: ", missing, " missing")), line["bmi_below_minimum"], line["bmi_band_without_condition"],
        F.when(F.col("banded") & (F.size("related") > 0), said("note: BMI ", F.col("within"), f" in the {band['min']:g}–{band['max']:g} band, weight-related condition present (", quote(F.col("related")), ")")),
        line["glp1_medication"], line["flag_condition"],
        *[F.when(yields & when, said("flagged: ", text, ", but a flag rule also matched; a human decides")) for _, _, when, text in rejects],
        F.when(~F.col("rejected") & ~F.col("flagged") & F.col("age").isNotNull() & bmi.isNotNull(), "cleared: no rejecting or flagging rule matched"),
    ]
    made = {"bmi": bmi, "outcome": outcome, "reasons": F.array_compact(F.array(*reasons)), "matched": F.array_compact(F.array(*[F.when(w, c) for c, _, w, _ in table])), "ruleset": F.lit(rules.version)}
    return df.select(*[F.col("row").getField(c).alias(c) for c in own if c not in made], *[c.alias(n) for n, c in made.items()])


def shadow_run(intakes: DataFrame, patients: DataFrame, rules: Ruleset) -> DataFrame:
    """A verdict for every stored intake, the ones that can't be judged included, beside its legacy outcome.

    intakes: intake_id, patient_id, submitted_at, kg, cm, medications, conditions (texts), outcome; patients: patient_id,
    dob. The age is that at submission, null where a date is missing or the submission comes before birth;
    the raw condition text counts as conditions, and nobody declared anything.
    """
    born = patients.select("patient_id", "dob").dropDuplicates(["patient_id"])
    both = intakes.withColumnRenamed("outcome", "legacy_outcome").join(born, "patient_id", "left")
    some = lambda c: F.array_compact(F.array(F.col(c).cast("string")))
    ready = both.select("intake_id", "patient_id", "legacy_outcome", age_at(F.col("dob"), F.col("submitted_at")).alias("age"), "kg", "cm", F.lit(False).alias("declared"),
                        some("medications").alias("medications"), some("conditions").alias("conditions"), F.array().cast("array<string>").alias("other"))
    return evaluate(ready, rules).select("intake_id", "patient_id", "legacy_outcome", "age", "outcome", "reasons", "matched", "bmi", "ruleset")


def eligibility_input(answers: DataFrame, submitted_at: str = "submitted_at") -> DataFrame:
    """What `evaluate` reads, of submitted answers (dob, weight_kg, height_cm, glp1_declared, glp1, other_medications,
    conditions, other_conditions), and whether medications and conditions were reported. Ticked options and
    own words are both medications; own words about conditions can only add a flag."""
    none = F.array().cast("array<string>")
    words = lambda c: F.when(trim_all(F.coalesce(F.col(c), F.lit(""))) != "", F.array(c)).otherwise(none)
    ticked = lambda c: F.coalesce(F.col(c), none)
    report = lambda c: F.when(c, "reported").otherwise("none_reported")
    drugs, conditions = F.concat(ticked("glp1"), words("other_medications")), ticked("conditions")
    declared = F.coalesce(F.col("glp1_declared"), F.lit(False))
    return answers.select(
        "*", age_in_years(F.col("dob"), F.to_date(submitted_at)).alias("age"), F.col("weight_kg").alias("kg"), F.col("height_cm").alias("cm"), declared.alias("declared"),
        drugs.alias("medications"), words("other_conditions").alias("other"), report(declared | (F.size(drugs) > 0)).alias("medication_report"),
        report((F.size(conditions) > 0) | (F.size(words("other_conditions")) > 0)).alias("condition_report"))


# fixed values: the twelve states and the legal moves between them (from, to, who, needs a ruleset, closed by an absolute reject)
STATES = ("draft", "submitted", "auto_cleared", "auto_flagged", "auto_rejected", "in_review", "approved", "rejected",
          "legacy_approved", "legacy_rejected", "legacy_pending", "legacy_expired")
EDGES = [
    ("draft", "submitted", "process", False, False),
    ("submitted", "auto_cleared", "process", True, False),
    ("submitted", "auto_flagged", "process", True, False),
    ("submitted", "auto_rejected", "process", True, False),
    ("auto_cleared", "in_review", "reviewer", False, False),
    ("auto_flagged", "in_review", "reviewer", False, False),
    ("auto_rejected", "in_review", "reviewer", False, False),
    ("legacy_pending", "in_review", "reviewer", False, False),
    ("in_review", "approved", "reviewer", False, True),
    ("in_review", "rejected", "reviewer", False, False),
]
BIRTH_STATES = ("draft", "legacy_approved", "legacy_rejected", "legacy_pending", "legacy_expired")  # fixed values


def edges(spark: SparkSession, rows: list[tuple] = EDGES) -> DataFrame:
    """The edge table: a fixed handful of rows."""
    return spark.createDataFrame(rows, "from_state string, to_state string, actor_kind string, needs_ruleset boolean, closed_by_absolute boolean")


def judged_moves(moves: DataFrame, table: DataFrame, absolute: tuple[str, ...] = ("age_below_minimum",)) -> DataFrame:
    """Moves (id, from_state, to_state, actor_kind, reason, ruleset, matched) with why they aren't allowed, null if they are.

    Every move needs its edge, the edge's kind of actor and a reason; some need the ruleset that decided. An approval
    needs the governing evaluation (`matched`, its rules; null: none stored) and is closed to everybody where that
    names an absolute reject.
    """
    e = F.broadcast(table.select(F.struct("from_state", "to_state").alias("_move"), F.struct("*").alias("_edge")))
    both = moves.join(e, F.struct(moves["from_state"], moves["to_state"]).eqNullSafe(F.col("_move")), "left")
    hard = F.array(*map(F.lit, absolute)).cast("array<string>")
    why = (
        F.when(F.col("_edge").isNull(), "no such edge")
        .when(~moves["actor_kind"].eqNullSafe(F.col("_edge.actor_kind")), "wrong actor")
        .when(trim_all(F.coalesce(moves["reason"], F.lit(""))) == "", "reason missing")
        .when(F.col("_edge.needs_ruleset") & (F.coalesce(moves["ruleset"], F.lit("")) == ""), "ruleset missing")
        .when(F.col("_edge.closed_by_absolute") & moves["matched"].isNull(), "no evaluation")
        .when(F.col("_edge.closed_by_absolute") & F.arrays_overlap(moves["matched"], hard), "absolute reject")
    )
    return both.select(*moves.columns, why.alias("why"))


def refused_moves(moves: DataFrame, table: DataFrame, absolute: tuple[str, ...] = ("age_below_minimum",)) -> DataFrame:
    """The moves that aren't allowed."""
    return judged_moves(moves, table, absolute).where("why is not null")


def refused_changes(before: DataFrame, after: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the next snapshot (key, state, answers) that the stored one can't become, with why.

    A new row starts as a draft or in a legacy state; answers change only in a draft; the state stays, follows an edge, or
    goes from one legacy state to another (an outcome read anew).
    """
    old = before.select(F.col(key), F.struct("state", "answers").alias("_old"))
    moves = F.broadcast(table.select(F.col("from_state").alias("_from"), F.col("to_state").alias("state"), F.lit(True).alias("_legal")))
    both = after.join(old, key, "left").withColumn("_from", F.col("_old.state")).join(moves, ["_from", "state"], "left")
    legacy = F.col("_from").startswith("legacy_") & F.col("state").startswith("legacy_")
    why = (
        F.when(F.col("_old").isNull(), F.when(~F.coalesce(F.col("state").isin(*BIRTH_STATES), F.lit(False)), "starts as draft or a legacy state"))
        .when((F.col("_from") != "draft") & ~F.col("answers").eqNullSafe(F.col("_old.answers")), "answers are evidence")
        .when(~F.col("state").eqNullSafe(F.col("_from")) & F.col("_legal").isNull() & ~F.coalesce(legacy, F.lit(False)), "no such edge")
    )
    return both.select(*after.columns, why.alias("why")).where("why is not null")


def state_for_outcome(outcome: Column) -> Column:
    """Total on the three outcomes; anything else stops the job."""
    return F.when(outcome.isin("auto_cleared", "auto_flagged", "auto_rejected"), outcome).otherwise(
        F.raise_error(F.concat(F.lit("no state for outcome "), F.coalesce(outcome, F.lit("null")))))


def transition(current: DataFrame, moves: DataFrame, table: DataFrame, absolute: tuple[str, ...] = ("age_below_minimum",)) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, audit rows). current (id, state); moves (id, to_state, actor, actor_kind, at, reason,
    ruleset, matched), one an id; refused moves leave their row as it is."""
    asked = moves.join(current.select("id", F.col("state").alias("from_state")), "id")
    good = asked.join(refused_moves(asked, table, absolute).select("id"), "id", "left_anti")
    after = current.join(good.select("id", F.col("to_state").alias("_to")), "id", "left")
    nxt = after.withColumn("state", F.coalesce("_to", "state")).drop("_to")
    audit = good.select(F.lit("intake").alias("entity_type"), F.col("id").alias("entity_id"), "from_state", "to_state", "actor", "at", "reason")
    return nxt, audit
