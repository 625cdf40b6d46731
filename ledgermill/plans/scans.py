"""Queries over files, sinks and runs: tables are written out as text in the session's shared folder and read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decisions as X
from ..operators import detectors as Q
from ..operators import events as E
from ..operators import identity as I
from ..operators import items as M
from ..operators import rules as R
from ..sources import files as S
from ..sources import ruleset
from .events import verdicts
from .identity import _C, keys, people
from .registry import query, table


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    I.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


HEADER = ["id", "name", "segment"]
_NAME = "CASE c_custkey % 4 WHEN 0 THEN ' ' || c_name || ', \"x\" ' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN '' ELSE c_name END"
_QUOTED = "CASE WHEN regexp_matches(name, '[\",\\r\\n]') THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END"


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit(" "), "c_name", F.lit(', "x" '))).when(k % 4 == 1, "two\nlines").when(k % 4 == 2, "").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select(k.cast("string").alias("id"), name.alias("name"), F.col("c_mktsegment").alias("segment"))


def written(df: DataFrame, path: str) -> str:
    """CSV with minimal quoting, a header in each file."""
    how = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**how).csv(path)
    return path


@query(f"WITH c AS (SELECT c_custkey::VARCHAR AS id, {_NAME} AS name, c_mktsegment AS segment FROM customer) SELECT id, name, segment, sha256(id || ',' || {_QUOTED} || ',' || segment) AS row_hash FROM c")
def a1_csv_scan(spark, sf):
    """A1, A2, A5: quoted commas, quotes, line feeds and outer spaces come back byte by byte."""
    return S.read_csv(spark, f"{written(dirty(spark, sf), scratch(spark))}/*.csv", HEADER).select(*HEADER, "row_hash")


@query("SELECT event_id::VARCHAR AS id, event_type AS kind, props, sha256('{\"id\":\"' || event_id || '\",\"kind\":\"' || event_type || '\"}') AS row_hash FROM events")
def a3_jsonl_scan(spark, sf):
    """A3: string values under exactly the wanted keys."""
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), "props")
    path = scratch(spark)
    e.select(F.to_json(F.struct("id", "kind"))).write.text(path)
    return S.read_jsonl(spark, f"{path}/*.txt", ["id", "kind"]).join(e.select("id", "props"), "id").select("id", "kind", "props", "row_hash")


def _one_file(spark: SparkSession, sf: str) -> str:
    """The 25 nations as one file, in order."""
    path = scratch(spark)
    n = table(spark, sf, "nation").select("n_nationkey", F.concat_ws(";", "n_nationkey", "n_name", F.lit("é")).alias("line"))
    n.repartition(1).sortWithinPartitions("n_nationkey").select("line").write.text(path)
    return f"{path}/*.txt"


_FILE = "f AS (SELECT string_agg(n_nationkey || ';' || n_name || ';é' || chr(10), '' ORDER BY n_nationkey) AS content, count(*) AS lines FROM nation)"


@query(f"WITH {_FILE} SELECT octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM f")
def a4_fingerprint(spark, sf):
    """A4: bytes and digest of a file."""
    return S.fingerprint(spark, _one_file(spark, sf)).select("bytes", "sha256")


@query(f"WITH {_FILE} SELECT ';' AS delimiter, false AS bom, 0::BIGINT AS crlf, lines AS lf, lines AS non_ascii, false AS broken_utf8 FROM f")
def a6_sniff(spark, sf):
    """What a file looks like."""
    return S.sniff(spark, _one_file(spark, sf)).drop("name")


@query("SELECT count(*) AS records, 0::BIGINT AS ragged, count(*) FILTER (WHERE c_custkey % 4 = 1) AS fields_with_newline FROM customer")
def a7_ragged(spark, sf):
    """Records, ragged ones, fields with a line feed."""
    r = S.ragged(spark, f"{written(dirty(spark, sf), scratch(spark))}/*.csv")
    return r.agg(*[F.sum(c).alias(c) for c in ("records", "ragged", "fields_with_newline")])


@query("""SELECT t.name, t.value, count(*) FILTER (WHERE p_size >= lo AND p_size <= hi) AS inside FROM part, (VALUES ('plausibility.weight_kg', '{"min": 30, "max": 300}', 30, 300), ('plausibility.height_cm', '{"min": 100, "max": 230}', 100, 230),
 ('weight_divergence.tolerance', '{"min": 0.9, "max": 1.1}', 0.9, 1.1), ('age.minimum_years', '18', 18, 1000), ('bmi.reject_below', '27', 27, 1000), ('bmi.flag_band', '{"min": 27, "max": 30, "min_inclusive": true, "max_inclusive": true}', 27, 30)) t(name, value, lo, hi) GROUP BY 1, 2""")
def a8_ruleset(spark, sf):
    """The numbers of the rules in force, read and checked, with the parts whose size lies inside each."""
    rules = ruleset.load()
    numbers = {"plausibility.weight_kg": rules.plausibility["weight_kg"], "plausibility.height_cm": rules.plausibility["height_cm"], "weight_divergence.tolerance": rules.weight_divergence["tolerance"],
               "age.minimum_years": rules.age["minimum_years"], "bmi.reject_below": rules.bmi["reject_below"], "bmi.flag_band": rules.bmi["flag_band"]}
    inside = lambda v: F.col("p_size").between(v["min"], v["max"]) if isinstance(v, dict) else F.col("p_size") >= v
    said = [F.struct(F.lit(k).alias("name"), F.lit(json.dumps(v)).alias("value"), F.count_if(inside(v)).alias("inside")) for k, v in numbers.items()]
    return table(spark, sf, "part").agg(F.array(*said).alias("all")).select(F.inline("all"))


@query("SELECT n_regionkey, n_nationkey, CASE WHEN n_regionkey = 2 THEN 'new' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 2 OR n_nationkey % 2 = 0")
def a13_rewrite(spark, sf):
    """One part of a stored table replaced, the rest as it was; a second time changes nothing."""
    n, path = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name"), scratch(spark)
    S.rewrite(n, path, ["n_regionkey"])
    for _ in range(2):
        S.rewrite(n.where("n_regionkey = 2 and n_nationkey % 2 = 0").withColumn("n_name", F.lit("new")), path, ["n_regionkey"])
    return spark.read.parquet(path).select("n_regionkey", "n_nationkey", "n_name")


@query("""WITH t AS (SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT row_number() OVER (ORDER BY state) AS i, state, n FROM t)
SELECT 'json' AS kind, i, '{"state": "' || state || '", "n": ' || n || '}' AS line FROM l UNION ALL SELECT 'md', i, '| ' || state || ' | ' || n || ' |' FROM l UNION ALL SELECT 'html', i, '<tr><td>' || state || '</td><td>' || n || '</td></tr>' FROM l""")
def a14_report(spark, sf):
    """A small report as JSON, Markdown and HTML, rows in a stated order."""
    t = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    body = {"json": S.report_lines(t, ["state"]), "md": S.to_markdown(t, ["state"]).splitlines()[2:], "html": S.to_html(t, ["state"]).splitlines()[2:-1]}
    return spark.createDataFrame([(k, i + 1, x) for k, lines in body.items() for i, x in enumerate(lines)], "kind string, i long, line string")


@query("""SELECT 'added' AS what, count(*) FILTER (WHERE c_custkey % 10 = 0) AS n FROM customer UNION ALL SELECT 'changed', count(*) FILTER (WHERE c_custkey % 10 <> 0 AND c_custkey % 7 = 0 AND c_custkey % 3 <> 0) FROM customer
UNION ALL SELECT 'stored before', count(*) FILTER (WHERE c_custkey % 10 <> 0) FROM customer UNION ALL SELECT 'stored after', count(*) FILTER (WHERE c_custkey % 10 <> 0) FROM customer""")
def a15_dry_run(spark, sf):
    """A run that counts what it would do and writes nothing."""
    k, path = F.col("c_custkey"), scratch(spark)
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    c.where(k % 10 != 0).write.parquet(path)
    stored = spark.read.parquet(path)
    new = c.withColumn("c_mktsegment", F.when(k % 7 == 0, "changed").otherwise(F.col("c_mktsegment")))
    owned = stored.where(k % 3 == 0).select(k.alias("entity_id"), F.lit("c_mktsegment").alias("field"))
    report = X.run_import(stored, new, owned, "c_custkey", ["c_mktsegment"], path, dry_run=True)
    size = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return report.unionByName(size("stored before", stored)).unionByName(size("stored after", spark.read.parquet(path)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 1 THEN NULL ELSE o_orderdate::DATE || ' 11:00:00|' || CASE WHEN o_orderkey % 2 = 0 THEN 'granted' ELSE 'revoked' END END AS event,
 CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS flags FROM orders WHERE month(o_orderdate) IN (1, 2, 12)""")
def b14_consent_events(spark, sf):
    """Rows of winter months; those without a usable time or action keep their flags and give no event."""
    from ..operators import normalise as N

    k = F.col("o_orderkey")
    at = F.when(k % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'12:00:00"))
    act = F.when(k % 4 == 1, "perhaps").when(k % 2 == 0, "granted").otherwise("revoked")
    o = table(spark, sf, "orders").where(F.month("o_orderdate").isin(1, 2, 12)).select(k, at.alias("at"), act.alias("action"))
    m = N.map_consent_event(o, "o_orderkey", "at", "action", {"granted": "granted", "revoked": "revoked"})
    said = F.concat(F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("event.at")), "yyyy-MM-dd HH:mm:ss"), F.lit("|"), "event.action")
    return m.select("o_orderkey", said.alias("event"), F.size("flags").cast("long").alias("flags"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer")
def b35_as_text(spark, sf):
    """Values as comparable text, null as null."""
    return table(spark, sf, "customer").select("c_custkey", T.as_text(F.col("c_custkey")).alias("key"), T.as_text(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))).alias("name"))


@query("""SELECT type, scope, count(*) AS n, count(DISTINCT dedupe_key) AS keys FROM (SELECT 'data_quality' AS type, 'row' AS scope, 'data_quality|row|order:' || o_orderkey AS dedupe_key FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'vocabulary', 'vocabulary', 'vocabulary|vocabulary|order|status|VOCAB_UNKNOWN|' || lower(o_orderstatus) FROM orders WHERE o_orderkey % 9 = 2 GROUP BY lower(o_orderstatus)) GROUP BY 1, 2""")
def h5_item_lists(spark, sf):
    """Items of several producers as one list."""
    o = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    flag = lambda kind, field, raw: o.select("id", "o_orderkey", "o_totalprice", F.lit(kind).alias("kind"), F.lit(field).alias("field"), raw.alias("raw"), F.lit(None).cast("string").alias("proposed"))
    a = M.flag_items(flag("date_unreadable", "total", F.col("o_totalprice").cast("string")).where("o_totalprice > 300000"), "id", "order")
    b, _ = Q.unseen_values(flag("vocabulary_unseen", "status", F.lower("o_orderstatus")).where("o_orderkey % 9 = 2"), "id", "order")
    return S.append_new(a.unionByName(b), None, ["dedupe_key"]).groupBy("type", "scope").agg(F.count("*").alias("n"), F.countDistinct("dedupe_key").alias("keys"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, count(*) AS n, max(event_type) FILTER (WHERE rn = 1) AS newest FROM e GROUP BY 1""")
def l8_timelines(spark, sf):
    """Two evidence tables as one timeline of every subject."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.lit("").alias("detail"))
    t = E.timeline(e.where("kind = 'error'"), e.where("kind <> 'error'"))
    return t.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("kind", F.struct("at", "seq")).alias("newest"))


@query("SELECT state, count(*) AS n FROM (SELECT ['auto_cleared', 'auto_flagged', 'auto_rejected'][1 + o_orderkey % 3] AS state FROM orders) GROUP BY 1")
def j11_state_for_outcome(spark, sf):
    """Every outcome has its state."""
    o = F.get(F.array(*map(F.lit, ("auto_cleared", "auto_flagged", "auto_rejected"))), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf, "orders").select(R.state_for_outcome(o).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey AS k, ['draft', 'in_review', 'auto_flagged', 'approved'][1 + o_orderkey % 4] AS a, ['submitted', 'approved', 'in_review', 'draft'][1 + o_orderkey % 4] AS b,
  CASE WHEN o_orderkey % 4 = 0 THEN 'process' ELSE 'reviewer' END AS who, o_orderkey % 7 = 0 AS mute, o_orderkey % 3 AS m FROM orders),
r AS (SELECT *, b <> 'draft' AND NOT mute AND NOT (b = 'approved' AND m IN (0, 1)) AS ok FROM s)
SELECT CASE WHEN ok THEN b ELSE a END AS state, count(*) AS n, count(*) FILTER (WHERE ok) AS audits FROM r GROUP BY 1""")
def j13_transition(spark, sf):
    """Moves applied to a snapshot, with audit rows; refused ones leave their row."""
    k = F.col("o_orderkey")
    pick = lambda i, *xs: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    o = table(spark, sf, "orders")
    now = o.select(k.alias("id"), pick(k % 4, "draft", "in_review", "auto_flagged", "approved").alias("state"))
    found = F.when(k % 3 == 1, F.array(F.lit("age_below_minimum"))).when(k % 3 == 2, F.array(F.lit("flag_condition")))
    moves = o.select(k.alias("id"), pick(k % 4, "submitted", "approved", "in_review", "draft").alias("to_state"), F.lit("r").alias("actor"), F.when(k % 4 == 0, "process").otherwise("reviewer").alias("actor_kind"),
                     F.col("o_orderdate").alias("at"), F.when(k % 7 != 0, "seen").alias("reason"), F.lit("v1").alias("ruleset"), found.alias("matched"))
    nxt, audit = R.transition(now, moves, R.edges(spark))
    return nxt.join(audit.select(F.col("entity_id").alias("id"), F.lit(1).alias("a")), "id", "left").groupBy("state").agg(F.count("*").alias("n"), F.count("a").alias("audits"))


@query(f"""WITH RECURSIVE {_C}, m AS (SELECT root, count(DISTINCT lang) AS l, count(DISTINCT source) AS s, count(DISTINCT n_chars) AS n, count(DISTINCT email) AS t FROM c JOIN p USING (doc_id) GROUP BY 1),
o AS (SELECT root, doc_id, row_number() OVER (PARTITION BY root ORDER BY coalesce(quality = 1, false) DESC, n_chars::VARCHAR DESC, doc_id) AS nth FROM c JOIN p USING (doc_id) JOIN m USING (root) WHERE l <= 1 AND s <= 1 AND n <= 1 AND t = 1)
SELECT w.doc_id AS survivor, x.doc_id AS loser FROM o w JOIN o x USING (root) WHERE w.nth = 1 AND x.nth > 1 AND x.doc_id % 10 <> 0""")
def k6_tier_one_merges(spark, sf):
    """K6: merges that need no person, but for rows that a person decided on (ids that end in 0)."""
    p = people(spark, sf)
    placed = I.groups(keys(spark, sf, p), "doc_id")
    m = p.join(placed, "doc_id")
    fields = {f: F.col(f) for f in ("lang", "source", "n_chars", "email")}
    tiers = I.classify(m, fields, ["lang"], ["email"])
    chosen = I.survivors(m, "doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("n_chars"))
    return I.tier_one_merges(tiers, placed, chosen, "doc_id", decided=p.where("doc_id % 10 = 0").select("doc_id"))


@query("""WITH d AS (SELECT count(*) AS n FROM documents) SELECT 'moves' AS what, 2 * n AS n FROM d UNION ALL SELECT 'evaluations', n FROM d UNION ALL SELECT 'consent_events', count(*) FROM events WHERE event_type = 'signup'""")
def p7_submit(spark, sf):
    """What a submission writes."""
    v = verdicts(spark, sf)
    c = table(spark, sf, "events").where("event_type = 'signup'")
    out = X.submit(v.select("doc_id"), v, c, "doc_id")
    one = lambda name: out[name].agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return one("moves").unionByName(one("evaluations")).unionByName(one("consent_events"))


@query("SELECT s_name AS name, s_suppkey % 2 = 0 AS seeded FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def p9_reviewers(spark, sf):
    """Asked for a second time, the same names are seeded again and nothing else changes."""
    s, k = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name")), F.col("s_suppkey")
    first = X.seed_reviewers(s.where(k % 3 == 0), s.where(k % 2 == 0))
    return X.seed_reviewers(first, s.where(k % 2 == 0))
