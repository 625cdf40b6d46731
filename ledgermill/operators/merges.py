"""K7: a log of merges and their undoing, replayed in waves over persons, their aliases and the audit.

An entry may run when nothing before it in the log can still change a row that it reads. A merge reads and writes its loser
and its survivor; merges into one survivor that fill empty fields only may run together, as the first loser in the log
that holds a value fills it; one with decided fields has its survivor for itself. An undoing waits for all earlier
entries of its component (records that any entry or stored merge connects), since it takes back aliases that later merges
may have moved on, and all later ones wait for it. So the number of waves is that of the longest chain of waiting
entries, not of the log, and a survivor that takes in a third of all records is one wave. Who waits for whom is in the
log alone, refused or not, so waves are numbered first, over narrow rows, and the entries dealt out by them. Only rows that the log
names move through the waves; the others are added at the end as they were.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import checksum11, mask_identifier
from ..sources import stored
from .decisions import parsed_value
from .identity import checkpointed, components, dealt

# fixed values: the fields about a person, with what counts as not held
PERSON = {"full_name": "", "email": None, "dob": None, "sex": "unknown", "bsn": None, "phone": None, "city": None, "weight_kg": None, "height_cm": None, "status": "unknown"}
SOURCES = ("survivor", "loser", "edited")  # fixed values: where a decided field's value comes from
NUMBER, CHECK = "bsn", "bsn_check"  # the check follows the number, and is absent where there is none
WAVES_AT_ONCE = 16  # tables of the journal that are read one by one before they are put together
FEW = 32  # entries of a component that are numbered within one row
LASTING = ("audit", "refused", "changes")  # fixed values: tables of the journal that are returned as they stand
AUDIT = "seq long, entity_id string, from_state string, to_state string, reason string, field string, from_value string, to_value string, source_legacy_id string, chosen string"


def _check(number: Column) -> Column:
    return F.when(number.isNull(), "absent").when(checksum11(number), "valid").otherwise("invalid")


def _shown(field: Column, value: Column) -> Column:
    """Numbers are masked in the audit."""
    return F.when(field == NUMBER, mask_identifier(value)).otherwise(value)


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class _Said(NamedTuple):
    """What a step of a wave does to the state: changes and parents as in `_State.write`; owners: (patient_id or legacy_id, _to)."""

    changes: DataFrame
    parents: DataFrame
    owners: DataFrame


class _State:
    """Rows that the log names, aliases of theirs, and what was done so far.

    Each step is written out in the shared folder and read back: a checkpoint would carry its estimated size along, and
    products of sizes grow with every wave until the plans themselves are slow. What is returned stays in a folder of its
    own, so that it isn't copied at the end; the steps of a wave all read what the wave before has left.
    """

    def __init__(self, folder: str, lasting: str):
        self.folder, self.lasting, self.made = folder, lasting, 0

    def start(self, rows: DataFrame, aliases: DataFrame) -> None:
        spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
        self.fields = [f for f in PERSON if f in rows.columns]
        self.written = [*self.fields, *([CHECK] if CHECK in rows.columns else [])]
        self.rows, self.aliases = self.keep(rows), self.keep(aliases)
        none = lambda schema: [spark.createDataFrame([], schema)]
        # what each wave has said, a list of small tables; all of them stand on checkpointed ones
        self.done = none(f"seq long, survivor {kind}, loser {kind}")
        self.changes = none(f"seq long, survivor {kind}, field string, from_value string, to_value string, source_legacy_id string, chosen string")
        self.moved = none("seq long, legacy_id string")
        self.audit, self.refused = none(AUDIT), none("seq long, why string")

    def keep(self, df: DataFrame, lasts: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
        path, self.made = f"{self.lasting if lasts else self.folder}/{self.made}", self.made + 1
        df.write.partitionBy(*by).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def settle(self, *said: _Said) -> None:
        """The wave's outcome: its entries have no row in common, so each table is written once for all of them."""
        self.write(_union(*[x.changes for x in said]), _union(*[x.parents for x in said]))
        for x in said:
            self.aliases = self.aliases.join(x.owners, x.owners.columns[0], "left").select("legacy_id", F.coalesce("_to", "patient_id").alias("patient_id"))
        self.rows, self.aliases = self.keep(self.rows), self.keep(self.aliases)
        for name in ("done", "changes", "moved", "audit", "refused"):
            if len(tables := getattr(self, name)) >= WAVES_AT_ONCE:
                setattr(self, name, [self.keep(_union(*tables), name in LASTING)])

    def write(self, changes: DataFrame, parents: DataFrame) -> None:
        """changes: (survivor, field, value), one a field; parents: (id, parent), one an id."""
        per = changes.groupBy(F.col("survivor").alias("id")).agg(*[F.max(F.when(F.col("field") == f, F.struct(F.col("value").alias("v")))).alias(f"_{f}") for f in self.written])
        both = self.rows.join(per, "id", "left").join(parents.select("id", F.struct(F.col("parent").alias("v")).alias("_parent")), "id", "left")
        new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v").cast(self.rows.schema[f].dataType)).otherwise(F.col(f)) for f in self.written}
        new["merged_into"] = F.when(F.col("_parent").isNotNull(), F.col("_parent.v")).otherwise(F.col("merged_into"))
        self.rows = both.select(*[new[c].alias(c) if c in new else F.col(c) for c in self.rows.columns])


def _empty(field: Column, value: Column) -> Column:
    """Not held: null, or the field's own word for nothing."""
    nothing = reduce(lambda out, kv: F.when(field == kv[0], value == kv[1]).otherwise(out), [(f, v) for f, v in PERSON.items() if v is not None], F.lit(False))
    return value.isNull() | F.coalesce(nothing, F.lit(False))


def _merge(state: _State, asked: DataFrame) -> _Said:
    side = lambda p, rows: rows.select(F.col("id").alias("survivor" if p == "s" else "loser"), F.struct("merged_into", *state.written).alias(p))
    held = state.aliases.groupBy(F.col("patient_id").alias("loser")).agg(F.min("legacy_id").alias("legacy"))
    both = asked.join(side("s", state.rows), "survivor", "left").join(side("l", state.rows), "loser", "left").join(held, "loser", "left")
    named = F.array_except(F.map_keys("decisions"), F.array(*map(F.lit, state.fields)).cast("array<string>"))
    why = (
        F.when(F.col("survivor") == F.col("loser"), "merges into itself").when(F.col("s").isNull(), "no such survivor").when(F.col("l").isNull(), "no such loser")
        .when(F.col("l.merged_into") == F.col("survivor"), "merged so already").when(F.col("l.merged_into").isNotNull(), "merged into another").when(F.col("s.merged_into").isNotNull(), "survivor is merged away")
        .when(F.size(named) > 0, "not a field of the person")
    )
    field = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"s.{f}").cast("string").alias("was"), F.col(f"l.{f}").cast("string").alias("other"), F.element_at("decisions", F.lit(f)).alias("pick"))
    checks = [F.col(f"{p}.{CHECK}").alias(f"{p}_check") for p in "sl" if CHECK in state.written]
    judged = state.keep(both.select("seq", "survivor", "loser", "reason", "legacy", why.alias("why"), *checks, F.array(*map(field, state.fields)).alias("fields")))
    # one row a field from here on
    long = judged.where("why is null").select("seq", "survivor", "legacy", *[c for c in judged.columns if c.endswith("_check")], F.inline("fields"))
    picked = F.col("pick").isNotNull()
    long = long.withColumn("parsed", F.when(picked, parsed_value(F.col("field"), F.when(F.col("pick.source") == "edited", F.col("pick.value")).when(F.col("pick.source") == "loser", F.col("other")).otherwise(F.col("was")))))
    sound = ~picked | (F.coalesce(F.col("pick.source").isin(*SOURCES), F.lit(False)) & F.coalesce(F.col("parsed.ok"), F.lit(False)))
    gains = F.when(picked, ~F.col("was").eqNullSafe(F.col("parsed.value"))).otherwise(_empty(F.col("field"), F.col("was")) & ~_empty(F.col("field"), F.col("other")))
    long = state.keep(long.withColumns({"sound": sound, "value": F.when(picked, F.col("parsed.value")).otherwise(F.col("other")), "chosen": F.col("pick.source"), "gains": gains}).drop("parsed", "other", "pick").where("gains or not sound"))
    bad = long.where("not sound").select("seq").distinct()
    state.refused.append(state.keep(judged.where("why is not null").select("seq", "why").unionByName(bad.select("seq", F.lit("not a value of the field").alias("why"))), True))
    good = state.keep(judged.where("why is null").join(bad, "seq", "left_anti").select("seq", "survivor", "loser", "reason"))
    source = F.when(F.col("chosen").isNull() | (F.col("chosen") == "loser"), F.col("legacy"))
    said = long.join(bad, "seq", "left_anti").where("gains").withColumn("source", source).drop("legacy", "gains", "sound")
    first = state.keep(said.groupBy("survivor", "field").agg(F.min_by(F.struct(*[c for c in said.columns if c not in ("survivor", "field")]), "seq").alias("c")).select("survivor", "field", "c.*"))
    if CHECK in state.written:
        follows = F.when(F.col("chosen").isNull(), F.col("l_check")).otherwise(_check(F.col("value")))
        number = first.where(F.col("field") == NUMBER).withColumns({"was": F.col("s_check"), "value": follows, "field": F.lit(CHECK)})
        first = first.unionByName(number)
    made_ = state.keep(first.select("seq", "survivor", "field", _shown(F.col("field"), F.col("was")).alias("from_value"), _shown(F.col("field"), F.col("value")).alias("to_value"), F.col("source").alias("source_legacy_id"), "chosen"), True)
    state.changes.append(made_)
    state.done.append(good.select("seq", "survivor", "loser"))
    moves = state.keep(state.aliases.join(good.select("seq", F.col("loser").alias("patient_id")), "patient_id").select("seq", "legacy_id"))
    state.moved.append(moves)
    id_, to = F.col("loser").cast("string"), F.col("survivor").cast("string")
    null = F.lit(None).cast("string")
    reason = lambda verb, who: F.concat(F.lit(verb), who, F.lit(": "), F.col("reason"))
    gone = good.select("seq", id_.alias("entity_id"), F.lit("independent").alias("from_state"), F.lit("merged").alias("to_state"), reason("merged into patient ", to).alias("reason"), id_.alias("_l"), to.alias("_s"))
    kept = good.select("seq", to.alias("entity_id"), null.alias("from_state"), null.alias("to_state"), reason("absorbed patient ", id_).alias("reason"), id_.alias("_l"))
    state.audit.append(state.keep(_union(
        _line(gone, "merged_into", null, F.col("_s")), _line(gone.join(moves, "seq"), "patient_id", F.col("_l"), F.col("_s"), F.col("legacy_id")),
        _line(kept, "merged_from", null, F.col("_l")), _line(kept.join(made_.drop("survivor"), "seq"), F.col("field"), F.col("from_value"), F.col("to_value"), F.col("source_legacy_id"), F.col("chosen"))), True))
    parents = good.select(F.col("loser").alias("id"), F.col("survivor").alias("parent"))
    return _Said(first.select("survivor", "field", "value"), parents, good.select(F.col("loser").alias("patient_id"), F.col("survivor").alias("_to")))


def _line(entries: DataFrame, field: str | Column, was: Column, now: Column, source: Column | None = None, chosen: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    field = F.lit(field) if isinstance(field, str) else field
    some = lambda c: null if c is None else c
    return entries.select("seq", "entity_id", "from_state", "to_state", "reason", field.alias("field"), was.alias("from_value"), now.alias("to_value"), some(source).alias("source_legacy_id"), some(chosen).alias("chosen"))


def _undo(state: _State, asked: DataFrame) -> _Said:
    there = asked.drop("survivor").join(state.rows.select(F.col("id").alias("loser"), F.col("merged_into").alias("survivor"), F.lit(True).alias("_here")), "loser", "left")
    record = _union(*state.done).withColumnRenamed("seq", "merged_at").groupBy("survivor", "loser").agg(F.max("merged_at").alias("merged_at"))
    why = F.when(F.col("_here").isNull(), "no such loser").when(F.col("survivor").isNull(), "not merged into anything").when(F.col("merged_at").isNull(), "no record of the merge")
    judged = state.keep(there.join(record, ["survivor", "loser"], "left").withColumn("why", why))
    state.refused.append(state.keep(judged.where("why is not null").select("seq", "why"), True))
    good = judged.where("why is null").select("seq", "survivor", "loser", "reason", "merged_at")
    released = _union(*state.changes).drop("survivor").withColumnRenamed("seq", "merged_at").join(good.select("seq", "survivor", "merged_at"), "merged_at")
    empty = reduce(lambda out, kv: F.when(F.col("field") == kv[0], F.lit(kv[1]).cast("string")).otherwise(out), PERSON.items(), F.lit(None).cast("string"))
    back = F.when(F.col("field") == CHECK, "absent").when(F.col("chosen").isNull() | (F.col("field") == NUMBER), empty).otherwise(F.col("from_value"))
    released = state.keep(released.withColumn("value", back))
    freed = state.keep(_union(*state.moved).withColumnRenamed("seq", "merged_at").join(good.select("seq", "loser", "merged_at"), "merged_at").select("seq", "legacy_id", "loser"))
    id_, to, null = F.col("loser").cast("string"), F.col("survivor").cast("string"), F.lit(None).cast("string")
    reason = lambda verb, who: F.concat(F.lit(verb), who, F.lit(": "), F.col("reason"))
    gone = good.select("seq", id_.alias("entity_id"), F.lit("merged").alias("from_state"), F.lit("independent").alias("to_state"), reason("unmerged from patient ", to).alias("reason"), id_.alias("_l"), to.alias("_s"))
    kept = good.select("seq", to.alias("entity_id"), null.alias("from_state"), null.alias("to_state"), reason("released patient ", id_).alias("reason"), id_.alias("_l"))
    state.audit.append(state.keep(_union(
        _line(gone, "merged_into", F.col("_s"), null), _line(gone.join(freed.select("seq", "legacy_id"), "seq"), "patient_id", F.col("_s"), F.col("_l"), F.col("legacy_id")),
        _line(kept, "merged_from", F.col("_l"), null), _line(kept.join(released.drop("survivor"), "seq"), F.col("field"), F.col("to_value"), F.col("from_value"), F.col("source_legacy_id"), F.col("chosen"))), True))
    parents = good.select(F.col("loser").alias("id"), F.lit(None).cast(state.rows.schema["merged_into"].dataType).alias("parent"))
    return _Said(released.select("survivor", "field", "value"), parents, freed.select("legacy_id", F.col("loser").alias("_to")))


def _ready(pending: DataFrame) -> DataFrame:
    """pending with `clear`: nothing earlier can still change the entry's rows. Rows that a single entry touches and components
    without an undoing hold nobody up and aren't looked up."""
    merges = pending.where("kind = 'merge'")
    touches = merges.select("seq", F.col("loser").alias("row"), F.lit(True).alias("own")).unionByName(merges.select("seq", F.col("survivor").alias("row"), F.col("alone").alias("own")))
    rows = touches.groupBy("row").agg(F.min("seq").alias("_any"), F.max("seq").alias("_last"), F.min(F.when(F.col("own"), F.col("seq"))).alias("_own")).where("_any < _last")
    undone = pending.groupBy("comp").agg(F.min("seq").alias("_comp"), F.min(F.when(F.col("kind") == "unmerge", F.col("seq"))).alias("_undo")).where("_undo is not null")
    at = lambda name, p: rows.select(F.col("row").alias(name), F.col("_any").alias(f"{p}_any"), F.col("_own").alias(f"{p}_own"))
    seen = pending.join(undone, "comp", "left").join(at("loser", "l"), "loser", "left").join(at("survivor", "s"), "survivor", "left")
    first = lambda c: F.col(c).isNull() | (F.col("seq") == F.col(c))
    before = lambda c: F.col(c).isNull() | (F.col("seq") < F.col(c))
    free = F.when(F.col("alone"), first("s_any")).otherwise(before("s_own"))
    clear = F.when(F.col("kind") == "unmerge", first("_comp")).otherwise(first("l_any") & free & before("_undo"))
    return seen.select(*pending.columns, clear.alias("clear"))


def _after(x: Column, y: Column) -> Column:
    """The least wave of entry x that an earlier entry y of its component leaves: the same rules as `_ready`'s, of two entries."""
    touches = lambda row: F.coalesce(y["loser"] == row, F.lit(False)) | F.coalesce(y["survivor"] == row, F.lit(False))
    owns = lambda row: F.coalesce(y["loser"] == row, F.lit(False)) | (y["alone"] & F.coalesce(y["survivor"] == row, F.lit(False)))
    waits = x["undo"] | y["undo"] | touches(x["loser"]) | owns(x["survivor"]) | (x["alone"] & touches(x["survivor"]))
    return F.when(waits, y["wave"] + 1).when(y["survivor"] == x["survivor"], y["wave"]).otherwise(0)


def _few_waves(entries: DataFrame, n: int) -> DataFrame:
    """entries, n at most, with `wave`, of components with FEW entries at most: each in turn goes after those before it that it waits for."""
    columns = [c for c in entries.columns if c != "comp"]
    said = lambda x: [(F.col("kind") == "unmerge").alias("undo") if x is None else x["undo"], *[F.col(c) if x is None else x[c].alias(c) for c in ("loser", "survivor", "alone")]]
    kind = entries.schema["loser"].dataType.simpleString()
    none = F.array().cast(f"array<struct<undo:boolean,loser:{kind},survivor:{kind},alone:boolean,wave:int>>")
    numbered = F.aggregate("log", none, lambda done, e: F.concat(done, F.array(F.struct(*said(e["who"]), F.coalesce(F.array_max(F.transform(done, lambda y: _after(e["who"], y))), F.lit(0)).alias("wave")))))
    per = dealt(entries, n, "comp").groupBy("comp").agg(F.collect_list(F.struct("seq", F.struct(*said(None)).alias("who"), F.struct(*[c for c in columns if c != "seq"]).alias("entry"))).alias("log"))
    per = per.select(F.array_sort("log", lambda x, y: F.when(x["seq"] < y["seq"], -1).otherwise(1)).alias("log"))  # numbers differ; decisions have no order
    both = per.select(F.explode(F.arrays_zip("log", numbered["wave"].alias("wave"))).alias("e"))
    return both.select("e.log.seq", "e.log.entry.*", "e.wave")


def _waves(state: _State, pending: DataFrame) -> DataFrame:
    """(seq, wave) of pending: seq, kind, survivor, loser, alone, comp; of components of any size."""
    columns, waves, n = pending.columns, [pending.select("seq", F.lit(0).alias("wave")).limit(0)], 0
    while not pending.isEmpty():
        judged = state.keep(_ready(pending))
        # the order of losers decides who fills a field, so a merge doesn't overtake one into the same survivor
        per = judged.where("kind = 'merge'").groupBy("survivor").agg(F.min(F.when(~F.col("clear"), F.col("seq"))).alias("_stuck"), F.max(F.when(F.col("clear"), F.col("seq"))).alias("_last"))
        stuck = state.keep(per.where("_stuck < _last").select("survivor", "_stuck"))
        if not stuck.isEmpty():
            judged = state.keep(judged.join(stuck, "survivor", "left").select(*columns, (F.col("clear") & (F.col("_stuck").isNull() | (F.col("seq") < F.col("_stuck")))).alias("clear")))
        waves.append(judged.where("clear").select("seq", F.lit(n).alias("wave")))
        if len(waves) >= WAVES_AT_ONCE:
            waves = [state.keep(_union(*waves))]
        pending, n = judged.where("not clear").select(*columns), n + 1
    return _union(*waves)


def replay(rows: DataFrame, aliases: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """K7: rows, aliases, audit (a row a change), refused (seq, why) and changes after the log.

    rows: id, merged_into, fields of PERSON and bsn_check where there are any, further columns as they are; aliases:
    legacy_id, patient_id; log: seq (unique), kind (merge or unmerge), survivor (null for unmerge), loser, reason, decisions
    (field -> struct(source, value), null for none). Refused entries change nothing: a record into itself or that isn't there, a loser
    merged before, a survivor merged away, a decision that isn't a value, an undoing without the record of its merge. Decided
    fields win over filling; one decided on the value that is there stays as it is, empty or not. An undoing empties fields
    that the merge had filled, gives decided ones their earlier value back (a masked number can't come back, it is emptied) and hands
    the aliases back that the merge had moved. An empty log changes nothing.
    """
    with stored.scratch(rows.sparkSession) as folder:
        return _replay(rows, aliases, log, _State(folder, stored.new_folder(rows.sparkSession)))


def _replay(rows: DataFrame, aliases: DataFrame, log: DataFrame, state: _State) -> dict[str, DataFrame]:
    alone = (F.size(F.coalesce("decisions", F.create_map().cast("map<string,struct<source:string,value:string>>"))) > 0) | (F.col("survivor") == F.col("loser"))
    entries = state.keep(log.select("seq", "kind", "survivor", "loser", "reason", "decisions", F.coalesce(alone, F.lit(False)).alias("alone")))
    named = entries.select(F.explode(F.array("survivor", "loser")).alias("id")).where("id is not null").distinct()
    # an undoing writes the record that its loser is stored as merged into
    held = rows.join(named, "id", "left_semi").where("merged_into is not null").select(F.col("merged_into").alias("id"))
    touched = state.keep(named.unionByName(held).distinct())
    state.start(rows.join(touched, "id", "left_semi"), aliases.join(touched.withColumnRenamed("id", "patient_id"), "patient_id", "left_semi").select("legacy_id", "patient_id"))
    links = entries.where("survivor is not null").select(F.col("survivor").alias("a"), F.col("loser").alias("b"))
    links = links.unionByName(state.rows.where("merged_into is not null").select(F.col("id").alias("a"), F.col("merged_into").alias("b")))
    root = components(links).select(F.col("node").alias("loser"), F.col("root").alias("comp"))
    placed = state.keep(entries.join(root, "loser", "left").withColumn("comp", F.coalesce("comp", "loser")))
    many = state.keep(placed.groupBy("comp").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select("comp"))
    numbered, columns = [], [*entries.columns, "wave"]
    if many.isEmpty():
        numbered.append(_few_waves(placed, placed.count()).select(columns))
    else:
        held = many.select(F.col("comp").alias("_many"))
        apart = state.keep(placed.join(held, F.col("comp").eqNullSafe(F.col("_many")), "left"))
        few, rest = apart.where("_many is null").drop("_many"), apart.where("_many is not null").drop("_many")
        slim = state.keep(rest.select("seq", "kind", "survivor", "loser", "alone", "comp"))
        numbered += [_few_waves(few, few.count()).select(columns), rest.join(_waves(state, slim), "seq").select(columns)]
    log = state.keep(_union(*numbered).drop("alone"), by=("wave", "kind"))
    kinds: dict[int, set[str]] = {}
    for wave, kind in log.select("wave", "kind").distinct().collect():
        kinds.setdefault(wave, set()).add(kind)
    for wave in sorted(kinds):
        asked = lambda kind: log.where((F.col("wave") == wave) & (F.col("kind") == kind)).drop("wave", "kind")  # noqa: B023, E731
        state.settle(*[step(state, asked(kind)) for kind, step in (("unmerge", _undo), ("merge", _merge)) if kind in kinds[wave]])
    others = lambda df, key: df.join(touched.withColumnRenamed("id", key), key, "left_anti").select(df.columns)
    return {
        "rows": state.keep(others(rows, "id").unionByName(state.rows), True), "aliases": state.keep(others(aliases.select("legacy_id", "patient_id"), "patient_id").unionByName(state.aliases), True),
        **{name: _union(*getattr(state, name)) for name in LASTING}}


def identity_entries(requests: DataFrame, candidates: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries for `replay`; decisions item, action, outcome, note, problem) of requests on identity conflicts.

    requests: seq, item, action (merge, not_the_same_person), survivor, loser, note, decisions; candidates: item, patient_id (the
    records that an item compares). Both sides have to be among them, not the same and not merged away, and fields those of
    a person; so a request can't merge records that were never compared.
    """
    side = lambda name: candidates.select("item", F.col("patient_id").alias(name), F.lit(True).alias(f"_{name}")).distinct()
    gone = lambda name: rows.where("merged_into is not null").select(F.col("id").alias(name), F.lit(True).alias(f"_gone_{name}"))
    r = requests
    for name in ("survivor", "loser"):
        r = r.join(side(name), ["item", name], "left").join(gone(name), name, "left")
    strange = F.size(F.array_except(F.map_keys("decisions"), F.array(*map(F.lit, PERSON)).cast("array<string>"))) > 0
    merge = F.col("action") == "merge"
    problem = (
        F.when(~F.coalesce(F.col("action").isin("merge", "not_the_same_person"), F.lit(False)), "no such action").when(F.trim(F.coalesce("note", F.lit(""))) == "", "note missing")
        .when(merge & (F.col("_survivor").isNull() | F.col("_loser").isNull()), "not records of the item").when(merge & (F.col("survivor") == F.col("loser")), "merges into itself")
        .when(merge & (F.col("_gone_survivor").isNotNull() | F.col("_gone_loser").isNotNull()), "merged away already").when(merge & strange, "not a field of the person")
    )
    judged = checkpointed(r.withColumn("problem", problem))
    entries = judged.where("problem is null and action = 'merge'").select("seq", F.lit("merge").alias("kind"), "survivor", "loser", F.col("note").alias("reason"), "decisions")
    outcome = F.when(F.col("problem").isNull(), F.when(merge, "resolved").otherwise("dismissed"))
    return entries, judged.select("item", "action", outcome.alias("outcome"), "note", "problem")
