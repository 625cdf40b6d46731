"""Entity resolution over documents: copies share a folded text, or a source with the text's opening word count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors as X
from ..operators import identity as I
from .normalising import fold_sql
from .registry import query, table

FIELDS = ["lang", "source", "n_chars"]


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as persons: the digest of the folded text as e-mail, source and exact length as a second key for
    long texts, the label as the mark of being busy."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    long_key = F.when(F.col("n_chars") > 3000, F.concat_ws("|", "lang", F.col("n_chars").cast("string")))
    p = d.join(lab, "doc_id", "left").select(
        "doc_id", *FIELDS, F.sha2(T.fold(F.col("text")).cast("binary"), 256).alias("email"), long_key.alias("phone"), "quality")
    return I.checkpointed(p)  # texts are folded once, whatever reads the persons


def keys(spark: SparkSession, sf: str, p: DataFrame | None = None) -> DataFrame:
    return I.keys_of(people(spark, sf) if p is None else p, "doc_id", {"email": F.col("email"), "phone": F.col("phone")})


_P = f"""p AS (SELECT d.doc_id, lang, source, n_chars, sha256({fold_sql("text")}) AS email, CASE WHEN n_chars > 3000 THEN lang || '|' || n_chars END AS phone, quality
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
k AS (SELECT doc_id, 'email' AS kind, email AS value FROM p WHERE email IS NOT NULL UNION ALL SELECT doc_id, 'phone', phone FROM p WHERE phone IS NOT NULL)"""
_C = f"""{_P}, e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (kind, value) WHERE x.doc_id <> y.doc_id),
reach AS (SELECT a AS doc_id, least(a, b) AS r FROM e UNION SELECT e.a, reach.r FROM reach JOIN e ON e.b = reach.doc_id),
c AS (SELECT doc_id, min(r) AS root FROM reach GROUP BY 1)"""


@query(f"WITH {_P} SELECT kind, count(*) AS n, count(DISTINCT value) AS values FROM k GROUP BY 1")
def k1_keys(spark, sf):
    """K1: keys of every record, nulls never among them."""
    return keys(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))


@query(f"WITH RECURSIVE {_C} SELECT doc_id, root FROM c")
def k2_components(spark, sf):
    """Groups of two or more by shared keys, transitively."""
    return I.groups(keys(spark, sf), "doc_id")


@query(f"""WITH RECURSIVE {_C}, h AS (SELECT kind, value, count(DISTINCT doc_id) AS holders, min(doc_id) AS one FROM k GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1)
SELECT root, kind, value, holders FROM h JOIN c ON c.doc_id = one""")
def k3_matched_keys(spark, sf):
    """K3."""
    ks = keys(spark, sf)
    return I.matched_keys(ks, I.groups(ks, "doc_id"), "doc_id")


def placed(spark: SparkSession, sf: str) -> DataFrame:
    p = people(spark, sf)
    return p.join(I.groups(keys(spark, sf, p), "doc_id"), "doc_id")


@query(f"""WITH RECURSIVE {_C}, m AS (SELECT root, count(*) AS size, count(DISTINCT lang) AS l, count(DISTINCT source) AS s, count(DISTINCT n_chars) AS n, count(DISTINCT email) AS t FROM c JOIN p USING (doc_id) GROUP BY 1)
SELECT root, size, concat_ws(',', CASE WHEN l > 1 THEN 'lang' END) AS contradictions, concat_ws(',', CASE WHEN l > 1 THEN 'lang' END, CASE WHEN s > 1 THEN 'source' END, CASE WHEN n > 1 THEN 'n_chars' END) AS differences,
 (CASE WHEN l > 1 THEN 3 WHEN t = 1 AND s <= 1 AND n <= 1 THEN 1 ELSE 2 END)::INTEGER AS tier FROM m""")
def k4_tiers(spark, sf):
    """K4, E12, M10."""
    m = placed(spark, sf)
    t = I.classify(m, {**{f: F.col(f) for f in FIELDS}, "email": F.col("email")}, ["lang"], ["email"])
    keep = F.filter("differences", lambda x: x != "email")
    return t.select("root", "size", F.array_join("contradictions", ",").alias("contradictions"), F.array_join(keep, ",").alias("differences"), "tier")


@query(f"""WITH RECURSIVE {_C}, m AS (SELECT root, doc_id, coalesce(quality = 1, false) AS busy, n_chars::VARCHAR AS signup FROM c JOIN p USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY busy DESC, signup DESC, doc_id) AS n FROM m),
w AS (SELECT root, max(doc_id) FILTER (WHERE n = 1) AS survivor, bool_or(busy) FILTER (WHERE n = 1) AS b1, bool_or(busy) FILTER (WHERE n = 2) AS b2, max(signup) FILTER (WHERE n = 1) AS s1, max(signup) FILTER (WHERE n = 2) AS s2 FROM r GROUP BY 1)
SELECT root, survivor, CASE WHEN b2 IS NULL OR (b1 AND NOT b2) THEN 'survivor is the only row with intakes' WHEN s1 <> s2 THEN 'survivor signed up later' ELSE 'survivor has the lower legacy id' END AS rule FROM w""")
def k5_survivor(spark, sf):
    """K5: survivor and the clause that decided."""
    return I.survivors(placed(spark, sf), "doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("n_chars"))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer),
pr AS (SELECT c_custkey AS survivor, c_custkey + 1 AS loser FROM r WHERE c_custkey % 2 = 0)
SELECT survivor, loser, 'c_name' AS field, s.c_name AS from_value, l.c_name AS to_value FROM pr JOIN r s ON s.c_custkey = survivor JOIN r l ON l.c_custkey = loser WHERE coalesce(s.c_name, '') = '' AND coalesce(l.c_name, '') <> ''
UNION ALL SELECT survivor, loser, 'c_mktsegment', s.c_mktsegment, l.c_mktsegment FROM pr JOIN r s ON s.c_custkey = survivor JOIN r l ON l.c_custkey = loser WHERE coalesce(s.c_mktsegment, '') = '' AND coalesce(l.c_mktsegment, '') <> ''""")
def k7_merge_fields(spark, sf):
    """Fields that a merge fills."""
    r, pairs = _holes(spark, sf)
    return I.merge_fields(pairs, r, "c_custkey", ["c_name", "c_mktsegment"])


def _holes(spark: SparkSession, sf: str):
    k = F.col("c_custkey")
    r = table(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return r, r.where("c_custkey % 2 = 0").select(k.alias("survivor"), (k + 1).alias("loser"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def k7_unmerge(spark, sf):
    """K7: merging and taking the merge back gives the rows as they were."""
    r, pairs = _holes(spark, sf)
    changes = I.merge_fields(pairs, r, "c_custkey", ["c_name", "c_mktsegment"])
    fields = ["c_name", "c_mktsegment"]
    return I.apply_changes(I.apply_changes(r, changes, "c_custkey", fields), changes, "c_custkey", fields, undo=True)


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nat FROM customer)
SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS from_value, seg AS to_value FROM n JOIN customer USING (c_custkey) WHERE seg IS DISTINCT FROM c_mktsegment
UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, nat::VARCHAR FROM n JOIN customer USING (c_custkey) WHERE nat IS DISTINCT FROM c_nationkey""")
def p6_field_diff(spark, sf):
    """Null-safe differences of two snapshots, one row each."""
    return X.field_diff(*_snapshots(spark, sf), "c_custkey", ["c_mktsegment", "c_nationkey"])


def _snapshots(spark: SparkSession, sf: str):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    n = c.select("c_custkey", F.when(k % 7 == 0, F.concat(F.upper("c_mktsegment"), F.lit("!"))).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    return c, n


@query("""SELECT l_partkey AS entity_id, l_returnflag AS field, arg_min(l_linestatus || l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""")
def p5_human_owned(spark, sf):
    """The first change of each field by a person (flag N stands for the machine)."""
    a = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("actor"), F.col("l_returnflag").alias("field"), F.col("l_shipdate").alias("at"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("seq"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("to_value"))
    return X.human_owned(a, ["N"]).select("entity_id", "field", "value")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 1 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer""")
def p5_rerun(spark, sf):
    """A second import: a person's field stays; a third run on the same input changes nothing."""
    from ..operators.decisions import rerun

    old, new = _snapshots(spark, sf)
    owned = old.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"), F.lit("c_mktsegment").alias("field"))
    fields = ["c_mktsegment", "c_nationkey"]
    once, _ = rerun(old, new, owned, "c_custkey", fields)
    return rerun(once, new, owned, "c_custkey", fields)[0]


_ITEMS = """i AS (SELECT c_custkey AS item, ['data_quality', 'vocabulary', 'orphan_intake', 'duplicate_intake', 'consent', 'clinical_history'][1 + c_custkey % 6] AS type, CASE WHEN c_custkey % 25 = 0 THEN 'resolved' ELSE 'open' END AS status,
  [['city', 'outcome'], ['weight_kg', 'weight_kg'], [NULL, NULL], ['bsn', 'bsn']][1 + c_custkey % 4][1 + (c_custkey % 14 = 0)::INT] AS field, c_custkey AS n,
  [['accept_proposal', 'set_value', 'dismiss'], ['confirm', 'reject', 'dismiss'], ['attach', 'leave_unresolved', 'merge'], ['keep_one', 'keep_both', 'keep_one'], ['resolve', 'set_state', 'set_state'], ['resolve', 'dismiss', 'resolve']][1 + c_custkey % 6][1 + c_custkey % 5 % 3] AS action,
  CASE WHEN c_custkey % 23 = 0 THEN ' ' ELSE 'seen' END AS note FROM customer),
v AS (SELECT *, CASE type WHEN 'data_quality' THEN CASE field WHEN 'city' THEN 'Delft' WHEN 'weight_kg' THEN CASE WHEN n % 3 = 0 THEN '80' ELSE 'x' END WHEN 'bsn' THEN '111222333' END WHEN 'orphan_intake' THEN CASE WHEN n % 7 = 0 THEN 'nobody' ELSE (n % 7)::VARCHAR END
  WHEN 'duplicate_intake' THEN CASE WHEN n % 4 = 1 THEN 'a' ELSE 'z' END WHEN 'consent' THEN 'granted' END AS value, CASE WHEN n % 10 < 8 THEN CASE field WHEN 'city' THEN 'Gouda' WHEN 'weight_kg' THEN '71.5' WHEN 'bsn' THEN '123456789' END END AS proposed FROM i),
d AS (SELECT *, CASE WHEN status <> 'open' THEN 'already closed' WHEN type = 'orphan_intake' AND action = 'merge' THEN 'no such action' WHEN trim(note) = '' THEN 'note missing'
  WHEN type = 'data_quality' AND action <> 'dismiss' AND field IS NULL THEN 'names no field' WHEN type = 'data_quality' AND action = 'accept_proposal' AND proposed IS NULL THEN 'carries no proposal'
  WHEN type = 'data_quality' AND action <> 'dismiss' AND field = 'outcome' THEN 'names no row to correct' WHEN type = 'data_quality' AND action = 'set_value' AND value = 'x' THEN 'not a value of the field'
  WHEN type = 'orphan_intake' AND action = 'attach' AND value = 'nobody' THEN 'no such patient' WHEN type = 'duplicate_intake' AND action = 'keep_one' AND value <> 'a' THEN 'not one of the pair'
  WHEN type = 'consent' AND action = 'set_state' AND n % 3 <> 1 THEN 'only a conflict is settled by hand' END AS problem FROM v)"""


def _decided(spark, sf):
    from ..operators import decisions as X

    n = F.col("c_custkey")
    pick = lambda i, *xs: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    kinds = ["data_quality", "vocabulary", "orphan_intake", "duplicate_intake", "consent", "clinical_history"]
    field = F.when((n % 4 == 0) & (n % 14 == 0), "outcome").otherwise(pick(n % 4, "city", "weight_kg", None, "bsn"))
    c = table(spark, sf, "customer").select(n, n.alias("item"), pick(n % 6, *kinds).alias("type"), field.alias("field"))
    by_field = lambda city, kg, bsn: F.when(F.col("field") == "city", city).when(F.col("field") == "weight_kg", kg).when(F.col("field") == "bsn", bsn)
    items = c.select(
        "item", "type", F.when(n % 25 == 0, "resolved").otherwise("open").alias("status"), "field", F.lit(X.POUNDS_RULE).alias("rule"), F.when(n % 10 < 8, by_field("Gouda", "71.5", "123456789")).alias("proposed"),
        n.cast("string").alias("patient_id"), n.cast("string").alias("intake_id"), F.when(n % 3 == 1, "conflict").otherwise("granted").alias("derived"))
    does = [("accept_proposal", "set_value", "dismiss"), ("confirm", "reject", "dismiss"), ("attach", "leave_unresolved", "merge"), ("keep_one", "keep_both", "keep_one"), ("resolve", "set_state", "set_state"), ("resolve", "dismiss", "resolve")]
    action = F.get(F.get(F.array(*[F.array(*map(F.lit, d)) for d in does]), (n % 6).cast("int")), (n % 5 % 3).cast("int"))
    value = (
        F.when(F.col("type") == "data_quality", by_field("Delft", F.when(n % 3 == 0, "80").otherwise("x"), "111222333")).when(F.col("type") == "orphan_intake", F.when(n % 7 == 0, "nobody").otherwise((n % 7).cast("string")))
        .when(F.col("type") == "duplicate_intake", F.when(n % 4 == 1, "a").otherwise("z")).when(F.col("type") == "consent", "granted")
    )
    requests = c.select("item", action.alias("action"), F.when(n % 23 == 0, " ").otherwise("seen").alias("note"), value.alias("value"), F.array(F.lit("b")).alias("excluded"))
    rows = c.select("item", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("row"), F.lit("90").alias("value"), n.cast("string").alias("owner_id"))
    patients = table(spark, sf, "customer").select(n.cast("string").alias("patient_id"))
    return items, X.decide(items, requests, rows, patients)


@query(f"""WITH {_ITEMS} SELECT type, action, CASE WHEN problem IS NULL THEN CASE WHEN action IN ('dismiss', 'leave_unresolved', 'keep_both') THEN 'dismissed' ELSE 'resolved' END END AS outcome, problem, count(*) AS n FROM d GROUP BY ALL""")
def p4_decisions(spark, sf):
    """What reviewers' requests come to, by type of item."""
    items, (decisions, _, _) = _decided(spark, sf)
    return decisions.join(items.select("item", "type"), "item").groupBy("type", "action", "outcome", "problem").agg(F.count("*").alias("n"))


@query(f"""WITH {_ITEMS}, g AS (SELECT * FROM d WHERE problem IS NULL),
ch AS (SELECT item, 'patient' AS entity_type, field, CASE action WHEN 'accept_proposal' THEN proposed ELSE CASE WHEN field = 'weight_kg' THEN '80.0' ELSE value END END AS to_value FROM g WHERE type = 'data_quality' AND action <> 'dismiss'
 UNION ALL SELECT item, 'patient', 'bsn_check', CASE CASE action WHEN 'accept_proposal' THEN proposed ELSE value END WHEN '111222333' THEN 'valid' ELSE 'invalid' END FROM g WHERE type = 'data_quality' AND action <> 'dismiss' AND field = 'bsn'
 UNION ALL SELECT item, 'intake', 'patient_id', value FROM g WHERE type = 'orphan_intake' AND action = 'attach' UNION ALL SELECT item, 'patient', 'weight_kg', '90.0' FROM g WHERE type = 'vocabulary' AND action = 'confirm'),
st AS (SELECT *, CASE field WHEN 'city' THEN 'Gouda' WHEN 'bsn_check' THEN 'absent' END AS from_value FROM ch), w AS (SELECT item, entity_type, count(*) AS changed FROM st WHERE from_value IS DISTINCT FROM to_value GROUP BY 1, 2),
a AS (SELECT item, entity_type, changed FROM w UNION ALL SELECT item, unnest(CASE type WHEN 'duplicate_intake' THEN ['intake', 'intake'] WHEN 'consent' THEN ['patient'] ELSE ['intake'] END), 0 FROM g WHERE item NOT IN (SELECT item FROM w))
SELECT type, entity_type, changed, status, count(*) AS n FROM a JOIN (SELECT item, type, CASE WHEN action IN ('dismiss', 'leave_unresolved', 'keep_both') THEN 'dismissed' ELSE 'resolved' END AS status FROM g) USING (item) GROUP BY ALL""")
def p1_resolve(spark, sf):
    """Decisions as a step from one snapshot to the next: changed fields, audit rows, closed items."""
    from ..operators.decisions import resolve

    items, (decisions, changes, subjects) = _decided(spark, sf)
    k = F.col("c_custkey").cast("string").alias("id")
    c = table(spark, sf, "customer")
    none = lambda name: F.lit(None).cast("string").alias(name)
    stored = {"patient": c.select(k, F.lit("Gouda").alias("city"), none("weight_kg"), none("bsn"), F.lit("absent").alias("bsn_check")), "intake": c.select(k, none("patient_id"))}
    _, audit, closed = resolve(stored, items, decisions, changes, subjects, "r1", F.lit("2024-01-01").cast("date"))
    both = audit.join(closed.select("item", "type", "status"), "item")
    return both.groupBy("type", "entity_type", F.coalesce(F.size("changes"), F.lit(0)).cast("long").alias("changed"), "status").agg(F.count("*").alias("n"))


@query(f"""WITH {_P}, a AS (SELECT doc_id FROM p WHERE email IN (SELECT email FROM p GROUP BY 1 HAVING count(*) > 1)), b AS (SELECT doc_id FROM p WHERE phone IN (SELECT phone FROM p GROUP BY 1 HAVING count(*) > 1))
SELECT 'copies' AS a, 'copies' AS b, count(*) AS n FROM a UNION ALL SELECT 'copies', 'like', count(*) FROM a JOIN b USING (doc_id) UNION ALL SELECT 'like', 'like', count(*) FROM b""")
def k11_overlap(spark, sf):
    """Groupings against each other."""
    k = keys(spark, sf)
    many = k.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")
    of = lambda kind: k.where(F.col("kind") == kind).join(many, ["kind", "value"], "left_semi")
    return I.overlap({"copies": of("email"), "like": of("phone")}, "doc_id")


@query(f"""WITH {_P} SELECT x.doc_id AS submission, kind, count(*) AS holders, min(y.doc_id) AS existing FROM k x JOIN k y USING (kind, value) WHERE x.doc_id % 10 = 3 AND y.doc_id % 10 <> 3 GROUP BY 1, 2""")
def m19_possible_existing(spark, sf):
    """Submissions (ids that end in 3) that share keys with stored rows."""
    p = people(spark, sf).select("doc_id", "email", "phone")
    return X.possible_existing(p.where("doc_id % 10 = 3"), p.where("doc_id % 10 <> 3"), "doc_id", ["email", "phone"])
