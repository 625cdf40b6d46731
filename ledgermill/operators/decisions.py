"""Write path: a decision as a pure step from one snapshot to the next, with audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_calendar_date
from ..functions.text import checksum11, trim_all
from .detectors import field_diff
from .identity import apply_changes, checkpointed, dealt, held_values
from .normalise import EMAIL

# fixed values: the columns that a decision may write, by owner in the order of asking; a legacy outcome isn't among them
OWNERS = {
    "patient": ["full_name", "email", "dob", "sex", "bsn", "bsn_check", "phone", "city", "weight_kg", "height_cm", "status", "signup_date"],
    "intake": ["patient_id", "submitted_at", "weight_kg", "height_cm", "alcohol_units_week"],
}
REQUIRED = ("full_name", "sex", "bsn_check", "status")  # fixed values: columns that can't be blanked
WORDS = {"sex": ("male", "female", "unknown"), "bsn_check": ("valid", "invalid", "absent"), "status": ("active", "paused", "churned", "prospect", "unknown")}  # fixed values
# fixed values: what a reviewer may do to an item of each type; the ones that close it as dismissed
ACTIONS = {
    "data_quality": ("accept_proposal", "set_value", "dismiss"), "vocabulary": ("confirm", "reject", "dismiss"), "orphan_intake": ("attach", "leave_unresolved"),
    "duplicate_intake": ("keep_one", "keep_both"), "consent": ("resolve", "dismiss", "set_state"), "clinical_history": ("resolve", "dismiss"),
    "identity_conflict": ("merge", "not_the_same_person"),
}
DISMISSING = ("dismiss", "leave_unresolved", "keep_both", "not_the_same_person")
POUNDS_RULE = "WEIGHT_UNIT_MISSING_TO_NULL"


def writable_target(field: Column, patient_id: Column, intake_id: Column) -> Column:
    """struct(entity_type, entity_id) of the first row that an item names and that owns the field: the patient's, then
    the intake's; null where neither does, and such an item can only be dismissed."""
    one = lambda kind, key: F.when(key.isNotNull() & field.isin(OWNERS[kind]), F.struct(F.lit(kind).alias("entity_type"), key.cast("string").alias("entity_id")))
    return F.coalesce(one("patient", patient_id), one("intake", intake_id))


def parsed_value(field: Column, text: Column) -> Column:
    """struct(ok, value): the text as its column holds it. A null blanks the column, where it may be blank."""
    trimmed = trim_all(text)
    word = reduce(lambda out, kv: F.when(field == kv[0], text.isin(*kv[1])).otherwise(out), WORDS.items(), F.lit(False))
    ok = (
        F.when(text.isNull(), ~field.isin(*REQUIRED)).when(field.isin("dob", "submitted_at", "signup_date"), is_calendar_date(text)).when(field == "weight_kg", text.rlike(r"^\d+(\.\d)?$"))
        .when(field.isin("height_cm", "alcohol_units_week"), text.rlike(r"^\d+$")).when(field == "bsn", text.rlike(r"^\d{9}$")).when(field == "phone", text.rlike(r"^\+316\d{8}$"))
        .when(field == "email", text.rlike(EMAIL)).when(field.isin(*WORDS), word).when(field.isin("full_name", "city"), trimmed != "").otherwise(text != "")
    )
    whole = F.regexp_replace(text, r"^0+(?=\d)", "")
    value = (
        F.when(field == "weight_kg", F.when(F.contains(text, F.lit(".")), whole).otherwise(F.concat(whole, F.lit(".0")))).when(field.isin("height_cm", "alcohol_units_week"), whole)
        .when(field.isin("full_name", "city"), trimmed).otherwise(text)
    )
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"))


def decide(items: DataFrame, requests: DataFrame, rows: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What requests mean: (decisions item, action, outcome, note, problem; changes item, entity_type, entity_id, field,
    value; subjects item, entity_type, entity_id).

    items: item, type, status, field, rule, proposed, patient_id, intake_id, derived (the consent state); requests, one an
    item: item, action, note, value (what was typed or chosen), excluded (rows left out); rows: item, row, value,
    owner_id (the rows that an item lists: a weight read as pounds and its patient; an intake of a pair); patients:
    patient_id. A request that its item can't take has a problem and neither changes nor subjects.
    """
    n_asked = requests.count()
    r = checkpointed(dealt(requests, n_asked, "item").join(items, "item"))
    part = lambda df: dealt(df, n_asked, "item")
    listed = part(r.select("item", "value", F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded"))).join(rows.select("item", "row", F.col("owner_id").isNull().alias("lone")), "item").groupBy("item").agg(
        F.count("*").alias("_rows"), F.max(F.col("row").eqNullSafe(F.col("value"))).alias("_chosen"), F.max("lone").alias("_lone"), F.count_if(F.array_contains("excluded", F.col("row"))).alias("_known"))
    # only these values are looked up; the others are a few words that most requests share
    named = r.where("type = 'orphan_intake' and action = 'attach' and value is not null").select("item", "value")
    found = held_values(named, "value", patients.select(F.col("patient_id").cast("string").alias("value"))).select("item", F.lit(True).alias("_exists"))
    r = part(r).join(listed, "item", "left").join(found, "item", "left")
    kind, action, value = F.col("type"), F.col("action"), F.col("value")
    is_ = lambda k, *does: (kind == k) & action.isin(*does) if does else kind == k
    allowed = reduce(lambda out, kv: F.when(kind == kv[0], action.isin(*kv[1])).otherwise(out), ACTIONS.items(), F.lit(False))
    typed = F.when(action == "accept_proposal", F.col("proposed")).otherwise(value)
    target = writable_target(F.col("field"), F.col("patient_id"), F.col("intake_id"))
    pounds = is_("vocabulary", "confirm") & F.col("rule").eqNullSafe(F.lit(POUNDS_RULE))
    writes = is_("data_quality", "accept_proposal", "set_value")
    n = F.coalesce("_rows", F.lit(0))
    problem = (
        F.when(F.col("status") != "open", "already closed").when(~F.coalesce(allowed, F.lit(False)), "no such action").when(trim_all(F.coalesce("note", F.lit(""))) == "", "note missing")
        .when(writes & F.col("field").isNull(), "names no field").when(is_("data_quality", "accept_proposal") & F.col("proposed").isNull(), "carries no proposal")
        .when(writes & target.isNull(), "names no row to correct").when(writes & ~parsed_value(F.col("field"), typed)["ok"], "not a value of the field")
        .when(pounds & (n == 0), "carries no rows").when(pounds & (F.size("excluded") > F.coalesce("_known", F.lit(0))), "excluded is not a row").when(pounds & F.col("_lone"), "row without a patient")
        .when(is_("orphan_intake") & F.col("intake_id").isNull(), "names no intake").when(is_("orphan_intake", "attach") & F.col("_exists").isNull(), "no such patient")
        .when(is_("duplicate_intake") & (n < 2), "carries no pair").when(is_("duplicate_intake", "keep_one") & ~F.coalesce("_chosen", F.lit(False)), "not one of the pair")
        .when(is_("consent") & F.col("patient_id").isNull(), "names no patient").when(is_("consent", "set_state") & ~F.col("derived").eqNullSafe(F.lit("conflict")), "only a conflict is settled by hand")
        .when(is_("consent", "set_state") & ~F.coalesce(value.isin("granted", "revoked"), F.lit(False)), "not a consent state")
        .when(is_("clinical_history") & F.col("intake_id").isNull(), "names no intake")
    )
    r = r.withColumns({"problem": problem, "typed": typed, "target": target, "pounds": pounds, "writes": writes})
    r = checkpointed(r.select("item", "type", "action", "note", "value", "field", "excluded", "patient_id", "intake_id", "problem", "typed", "target", "pounds", "writes"))  # read eight times
    outcome = F.when(F.col("problem").isNull(), F.when(action.isin(*DISMISSING), "dismissed").otherwise("resolved"))
    decisions = r.select("item", "action", outcome.alias("outcome"), "note", "problem")
    good = r.where("problem is null")
    made = parsed_value(F.col("field"), F.col("typed"))["value"]
    own = good.where("writes").select("item", "target.*", "field", made.alias("value"))
    # the check follows the number
    check = own.where("entity_type = 'patient' and field = 'bsn'").select("item", "entity_type", "entity_id", F.lit("bsn_check").alias("field"), F.when(F.col("value").isNull(), "absent").when(checksum11(F.col("value")), "valid").otherwise("invalid").alias("value"))
    attach = good.where((kind == "orphan_intake") & (action == "attach")).select("item", F.lit("intake").alias("entity_type"), F.col("intake_id").cast("string").alias("entity_id"), F.lit("patient_id").alias("field"), "value")
    weigh = good.where("pounds").select("item", F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded")).transform(part).join(rows, "item").where(~F.array_contains("excluded", F.col("row")))
    weigh = weigh.select("item", F.lit("patient").alias("entity_type"), F.col("owner_id").cast("string").alias("entity_id"), F.lit("weight_kg").alias("field"), parsed_value(F.lit("weight_kg"), F.col("value"))["value"].alias("value"))
    changes = reduce(DataFrame.unionByName, (own, check, attach, weigh))
    pair = part(good.where(kind == "duplicate_intake").select("item")).join(rows, "item").select("item", F.lit("intake").alias("entity_type"), F.col("owner_id").cast("string").alias("entity_id"))
    about = lambda k, entity, key: good.where(kind == k).select("item", F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"))
    return decisions, changes, reduce(DataFrame.unionByName, (pair, about("consent", "patient", "patient_id"), about("clinical_history", "intake", "intake_id")))


def resolve(stored: dict[str, DataFrame], items: DataFrame, decisions: DataFrame, changes: DataFrame, subjects: DataFrame, actor: str, at: Column) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(next rows by entity, audit item, entity_type, entity_id, changes, actor, at, reason; next items).

    stored: rows of each entity type, key `id`. Changes that change nothing are dropped; an item none of whose changes
    took effect is recorded on its subjects, else on its own intake or patient. The item is closed all the same.
    """
    changes = checkpointed(changes)
    n_items, n_changes = decisions.count(), changes.count()
    nxt, made = {}, None
    for entity, rows in stored.items():
        fields = [f for f in OWNERS[entity] if f in rows.columns]
        now = rows.select(F.col("id").cast("string").alias("entity_id"), F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias("_now"))
        own = changes.where((F.col("entity_type") == entity) & F.col("field").isin(fields))
        own = dealt(own, n_changes, "entity_id").join(now, "entity_id").withColumn("from_value", F.element_at("_now", F.col("field"))).where(~F.col("from_value").eqNullSafe(F.col("value")))
        own = checkpointed(own.select("item", "entity_type", "entity_id", "field", "from_value", F.col("value").alias("to_value")))
        nxt[entity] = apply_changes(rows, own.withColumn("survivor", F.col("entity_id").cast(rows.schema["id"].dataType)), "id", fields)
        made = own if made is None else made.unionByName(own)
    made, items = dealt(made, n_changes, "item"), dealt(items, n_items, "item")
    line = F.array_sort(F.collect_list(F.struct("field", "from_value", "to_value"))).alias("changes")  # a row's changed fields
    written = checkpointed(made.groupBy("item", "entity_type", "entity_id").agg(line))
    taken = dealt(decisions.where("problem is null"), n_items, "item")
    quiet = checkpointed(taken.select("item").join(written.select("item"), "item", "left_anti"))
    none = F.lit(None).cast(written.schema["changes"].dataType).alias("changes")
    named = quiet.join(subjects, "item").select("item", "entity_type", "entity_id", none)
    rest = quiet.join(subjects.select("item"), "item", "left_anti").join(items.select("item", "patient_id", "intake_id"), "item")
    by = F.when(F.col("intake_id").isNotNull(), "intake").when(F.col("patient_id").isNotNull(), "patient").otherwise("review_item")
    rest = rest.select("item", by.alias("entity_type"), F.coalesce(F.col("intake_id").cast("string"), F.col("patient_id").cast("string"), F.col("item").cast("string")).alias("entity_id"), none)
    audit = reduce(DataFrame.unionByName, (written, named, rest)).join(taken.select("item", F.col("note").alias("reason")), "item")
    closed = items.join(taken.select("item", F.col("outcome").alias("_o")), "item", "left")
    return nxt, audit.withColumns({"actor": F.lit(actor), "at": at}), closed.withColumn("status", F.coalesce("_o", "status")).drop("_o")


def rerun(stored: DataFrame, incoming: DataFrame, owned: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Next snapshot of a second import and the changes it made: a person's fields keep their value, rows without
    a change stay, new keys are added. Run twice on the same input it changes nothing."""
    diff = field_diff(stored, incoming, key, fields).join(owned.select(F.col("entity_id").alias(key), "field"), [key, "field"], "left_anti")
    nxt = apply_changes(stored, diff.withColumnRenamed(key, "survivor"), key, fields)
    return nxt.unionByName(incoming.join(stored.select(key), key, "left_anti").select(*stored.columns)), diff


def run_import(stored: DataFrame, incoming: DataFrame, owned: DataFrame, key: str, fields: list[str], path: str, dry_run: bool = False) -> DataFrame:
    """(what, n) of rows that an import adds and changes. A dry run counts and writes nothing; a real one writes the
    next snapshot to `path` (not where `stored` is read from)."""
    nxt, diff = rerun(stored, incoming, owned, key, fields)
    added = incoming.join(stored.select(key), key, "left_anti").agg(F.lit("added").alias("what"), F.count("*").alias("n"))
    report = added.unionByName(diff.select(key).distinct().agg(F.lit("changed").alias("what"), F.count("*").alias("n")))
    if not dry_run:
        report = report.sparkSession.createDataFrame(report.collect(), report.schema)  # two rows, counted before the write
        nxt.write.mode("overwrite").parquet(path)
    return report


def with_sequence(audit: DataFrame, order: list[Column], start: int = 0) -> DataFrame:
    """The total order of audit rows: numbers by a stated order within each entity's run of rows."""
    w = Window.partitionBy("entity_id").orderBy(*order)
    return audit.withColumn("seq", F.row_number().over(w) + start)


def submit(draft: DataFrame, evaluated: DataFrame, consents: DataFrame, key: str) -> dict[str, DataFrame]:
    """What a submission writes: the moves, the evaluation and the consent events, as DataFrames."""
    moves = draft.select(F.col(key).alias("id"), F.lit("submitted").alias("to_state")).unionByName(evaluated.select(F.col(key).alias("id"), F.col("outcome").alias("to_state")))
    return {"moves": moves, "evaluations": evaluated.select(key, "outcome", "reasons", "matched"), "consent_events": consents}


def seed_reviewers(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, seeded): names that are stored and names that a settings table asks for, each once. A reviewer is a
    name: one that is there already stays and counts as seeded; a name that is asked for twice stops the write."""
    from ..sources.files import append_new

    asked = append_new(wanted.select("name", F.lit(True).alias("seeded")), None, ["name"])
    stored = existing.select("name").distinct()
    return asked.unionByName(stored.join(asked.select("name"), "name", "left_anti").withColumn("seeded", F.lit(False)))
