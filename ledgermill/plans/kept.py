"""Queries over state that is kept up to date: a stream's stored sink, partial recomputation, the merge journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derived as D
from ..operators import events as E
from ..operators import identity as I
from ..operators import merges as M
from ..sources import stored
from ..streaming.states import EndsStore, keep
from .events import _MEMBER, _S1, LOG_START, consent_events, forest, subjects
from .registry import query, table



@query(f"""WITH {_S1} SELECT subject, state, from_event, coalesce(n, 0) AS n_events FROM st LEFT JOIN (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) ON user_id = subject""")
def n1_streamed_states(spark, sf):
    """N, L1, A12: states over a stream of files in any order, taken in batch by batch and stored; each event counts once."""
    with stored.scratch(spark) as path:
        consent_events(spark, sf).repartition(8, "id").write.parquet(f"{path}/in")
        arriving = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        store = EndsStore(spark, f"{path}/store", ["subject", "type"], most=3)
        keep(arriving, store, f"{path}/offsets").awaitTermination()
        seen = I.checkpointed(store.read())
    s = E.states_from_ends(subjects(spark, sf), seen, ["processing"], F.lit(LOG_START).cast("date"))
    return s.join(seen.select("subject", "n_events"), "subject", "left").select("subject", "state", "from_event", F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query(f"{_MEMBER} SELECT subject, state, from_event FROM st")
def l2_refreshed_states(spark, sf):
    """States stored before some subjects' later events came and before some of them merged, then brought up to
    date from what those touch alone."""
    late = (F.col("subject") % 50 == 3) & (F.col("at") > "2024-01-15")
    log, chains, own = consent_events(spark, sf), I.survivor_of(forest(spark, sf)), subjects(spark, sf)
    moved = F.col("id") % 45 == 0  # these stood for themselves before
    before = I.survivor_of(forest(spark, sf).withColumn("parent", F.when(~moved, F.col("parent"))))
    with stored.scratch(spark) as path:
        kept = D.DerivedStates(spark, path, ["processing"], F.lit(LOG_START).cast("date"))
        kept.append(log.where(~late))
        kept.derive_all(before, own)
        kept.append(log.where(late))
        changed = log.where(late).select("subject").unionByName(chains.where(moved).select(F.col("id").alias("subject")))
        kept.refresh(before, chains, own, changed)
        return I.checkpointed(kept.states().select("subject", "state", "from_event"))


_FIELDS = {"n": ("full_name", "''"), "e": ("email", "NULL"), "c": ("city", "NULL"), "t": ("status", "'unknown'")}
PERSONS = """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS n, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '@x.nl' END AS e,
 CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c, CASE WHEN c_custkey % 7 < 3 THEN 'unknown' ELSE 'active' END AS t FROM customer"""


def _journal_sql() -> str:
    """Groups of four customers as one wide row, every step of the log as a table of its own."""
    held = lambda f, m: f"{f}{m} IS DISTINCT FROM {_FIELDS[f][1]} AND {f}{m} IS NOT NULL"
    gained = lambda f, s, lo: f"(NOT ({held(f, s)}) AND {held(f, lo)})"
    start = ", ".join(f"max({f}) FILTER (k % 4 = {m}) AS {f}{m}" for f in _FIELDS for m in range(4))
    steps = [f"s0 AS (SELECT k // 4 AS g, {start}, {', '.join(f'NULL::BIGINT AS i{m}, {m}::BIGINT AS a{m}' for m in range(4))} FROM persons GROUP BY 1 HAVING count(*) = 4)"]

    def merge(step: int, s: int, lo: int, was: str, decided: str = "false") -> None:
        new = [f"CASE WHEN {gained(f, s, lo)} THEN {f}{lo} ELSE {f}{s} END AS {f}{s}" for f in "net"]
        new += [f"CASE WHEN {decided} OR {gained('c', s, lo)} THEN c{lo} ELSE c{s} END AS c{s}", f"{s}::BIGINT AS i{lo}", *[f"CASE WHEN a{j} = {lo} THEN {s} ELSE a{j} END AS a{j}" for j in range(4)]]
        kept = [*[f"{gained(f, s, lo)} AS g{step}{f}" for f in "net"], f"CASE WHEN {decided} THEN c{s} IS DISTINCT FROM c{lo} ELSE {gained('c', s, lo)} END AS g{step}c", f"c{s} AS o{step}", *[f"a{j} = {lo} AS r{step}{j}" for j in range(4)]]
        steps.append(f"s{step} AS (SELECT * REPLACE ({', '.join(new)}), {', '.join(kept)} FROM {was})")

    def undo(step: int, of: int, s: int, lo: int, was: str, when: str, decided: str = "false") -> None:
        new = [f"CASE WHEN {when} AND g{of}{f} THEN {_FIELDS[f][1]} ELSE {f}{s} END AS {f}{s}" for f in "net"]
        new += [f"CASE WHEN {when} AND g{of}c THEN CASE WHEN {decided} THEN o{of} END ELSE c{s} END AS c{s}", f"CASE WHEN {when} THEN NULL ELSE i{lo} END AS i{lo}", *[f"CASE WHEN {when} AND r{of}{j} THEN {lo} ELSE a{j} END AS a{j}" for j in range(4)]]
        steps.append(f"s{step} AS (SELECT * REPLACE ({', '.join(new)}) FROM {was})")

    merge(1, 0, 1, "s0")
    merge(2, 0, 2, "s1")
    merge(3, 3, 0, "s2", "g % 2 = 0")
    undo(4, 1, 0, 1, "s3", "g % 3 = 0")
    undo(7, 3, 3, 0, "s4", "g % 4 IN (1, 2)", "g % 2 = 0")
    rows = [f"SELECT 'row' AS kind, (4 * g + {m})::VARCHAR AS key, '{name}' AS what, {value} AS value FROM s7" for m in range(4) for name, value in [
        *[(name, f"{f}{m}") for f, (name, _) in _FIELDS.items()], ("merged_into", f"(4 * g + i{m})::VARCHAR"), ("owner of its alias", f"(4 * g + a{m})::VARCHAR")]]
    said = [("merged_into", "true"), ("merged_from", "true"), *[(name, f"gOF{f}") for f, (name, _) in _FIELDS.items()]]
    audit = []
    for step, of, when in ((1, 1, "true"), (2, 2, "true"), (3, 3, "true"), (4, 1, "g % 3 = 0"), (7, 3, "g % 4 IN (1, 2)")):
        audit += [f"SELECT 'audit', '{step}', '{name}', count(*)::VARCHAR FROM s7 WHERE {when} AND {flag.replace('OF', str(of))} HAVING count(*) > 0" for name, flag in said]
        audit.append(f"SELECT 'audit', '{step}', 'patient_id', sum({' + '.join(f'r{of}{j}::INT' for j in range(4))})::BIGINT::VARCHAR FROM s7 WHERE {when} HAVING count(*) > 0")
    refused = [f"SELECT 'refused', '5', CASE WHEN g % 3 = 0 THEN 'survivor is merged away' ELSE 'merged so already' END, count(*)::VARCHAR FROM s7 GROUP BY 3", "SELECT 'refused', '6', 'merges into itself', count(*)::VARCHAR FROM s7"]
    return f"WITH persons AS ({PERSONS}), {', '.join(steps)} {' UNION ALL '.join(rows + audit + refused)}"


@query(_journal_sql())
def k7_merge_journal(spark, sf):
    """Four customers a group; two merge into the first, the first into the last (every other time with a
    decided city), some of it is undone, two entries are refused; rows, owners of aliases, audit and refusals afterwards."""
    names = {f: name for f, (name, _) in _FIELDS.items()}
    p = spark.sql(PERSONS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer")).select(F.col("k").alias("id"), F.lit(None).cast("long").alias("merged_into"), *[F.col(f).alias(name) for f, name in names.items()])
    whole = I.dealt(p.select(F.expr("id div 4").alias("g")), p.count(), "g").groupBy("g").agg(F.count("*").alias("n")).where("n = 4").select("g")
    at = lambda m: F.when(F.lit(m is not None), 4 * F.col("g") + (m or 0))
    pick = F.when(F.col("g") % 2 == 0, F.create_map(F.lit("city"), F.struct(F.lit("loser").alias("source"), F.lit(None).cast("string").alias("value"))))
    none = F.lit(None).cast("map<string,struct<source:string,value:string>>")
    one = lambda step, kind, s, lo, when="true", picks=none: F.when(F.expr(when), F.struct(
        (10 * F.col("g") + step).alias("seq"), F.lit(kind).alias("kind"), at(s).alias("survivor"), at(lo).alias("loser"), F.lit("reviewed").alias("reason"), picks.alias("decisions")))
    steps = [one(1, "merge", 0, 1), one(2, "merge", 0, 2), one(3, "merge", 3, 0, picks=pick), one(4, "unmerge", None, 1, "g % 3 = 0"), one(5, "merge", 0, 1), one(6, "merge", 3, 3), one(7, "unmerge", None, 0, "g % 4 IN (1, 2)")]
    with stored.scratch(spark) as path:
        p.join(whole, F.expr("id div 4") == F.col("g"), "left_semi").write.parquet(f"{path}/persons")  # read several times
        p = spark.read.schema(p.schema).parquet(f"{path}/persons")
        aliases = p.select(F.col("id").cast("string").alias("legacy_id"), F.col("id").alias("patient_id"))
        out = M.replay(p, aliases, whole.select(F.explode(F.array_compact(F.array(*steps))).alias("e")).select("e.*"))
    said = lambda what, value: F.struct(F.lit(what).alias("what"), value.cast("string").alias("value"))
    owned = out["rows"].join(out["aliases"].withColumn("id", F.col("legacy_id").cast("long")), "id")
    row = owned.select(F.lit("row").alias("kind"), F.col("id").cast("string").alias("key"), F.inline(F.array(*[said(n, F.col(n)) for n in (*names.values(), "merged_into")], said("owner of its alias", F.col("patient_id")))))
    count = lambda kind, df, what: df.groupBy(F.lit(kind).alias("kind"), (F.col("seq") % 10).cast("string").alias("key"), F.col(what).alias("what")).agg(F.count("*").cast("string").alias("value"))
    return row.unionByName(count("audit", out["audit"], "field")).unionByName(count("refused", out["refused"], "why"))


@query("""WITH g AS (SELECT c_custkey AS g, CASE c_custkey % 7 WHEN 0 THEN 'not_the_same_person' WHEN 1 THEN 'split' ELSE 'merge' END AS action, CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE 'seen' END AS note, c_custkey % 5 = 0 AS other, c_custkey % 11 = 0 AS self,
 c_custkey % 3 = 0 AS gone, c_custkey % 17 = 0 AS odd FROM customer), p AS (SELECT *, CASE WHEN action = 'split' THEN 'no such action' WHEN trim(note) = '' THEN 'note missing' WHEN action = 'merge' THEN CASE WHEN other THEN 'not records of the item'
 WHEN self THEN 'merges into itself' WHEN gone THEN 'merged away already' WHEN odd THEN 'not a field of the person' END END AS problem FROM g)
SELECT g AS item, action, CASE WHEN problem IS NULL THEN CASE action WHEN 'merge' THEN 'resolved' ELSE 'dismissed' END END AS outcome, problem, problem IS NULL AND action = 'merge' AS entered FROM p""")
def p4_identity_requests(spark, sf):
    """Requests on identity conflicts of two records each, and the entries of the merge log that they make."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    held = c.select(k.alias("item"), F.explode(F.array(4 * k, 4 * k + 1)).alias("patient_id"))
    action = F.when(k % 7 == 0, "not_the_same_person").when(k % 7 == 1, "split").otherwise("merge")
    loser = F.when(k % 5 == 0, 4 * k + 2).when(k % 11 == 0, 4 * k).otherwise(4 * k + 1)
    odd = F.when(k % 17 == 0, F.create_map(F.lit("shoe_size"), F.struct(F.lit("edited").alias("source"), F.lit("44").alias("value"))))
    asked = c.select(k.alias("seq"), k.alias("item"), action.alias("action"), (4 * k).alias("survivor"), loser.alias("loser"), F.when(k % 13 == 0, "  ").otherwise("seen").alias("note"), odd.alias("decisions"))
    people = held.select(F.col("patient_id").alias("id"), F.when((F.col("item") % 3 == 0) & (F.col("patient_id") % 4 == 1), F.col("patient_id") - 1).alias("merged_into"))
    entries, said = M.identity_entries(asked, held, people)
    made = entries.select(F.col("seq").alias("item"), F.lit(True).alias("entered"))
    return said.join(made, "item", "left").select("item", "action", "outcome", "problem", F.coalesce("entered", F.lit(False)).alias("entered"))
