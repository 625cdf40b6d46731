"""Queries over the normalisation layer. Dirty text is derived from typed columns by rules that both engines have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import normalise as N
from .registry import query, table

_TRIMX = r"'^[\t\n\x0B\f\r\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t\n\x0B\f\r\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$'"
_WSX = r"'[\t\n\x0B\f\r\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+'"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, {_TRIMX}, '', 'g')"


def fold_sql(x: str) -> str:
    return f"regexp_replace(lower({trim_sql(x)}), {_WSX}, ' ', 'g')"


# ---- dates: the order date in three writings, one in seven with day 31 ----
_D31 = "CASE WHEN o_orderkey % 7 = 0 THEN '31' ELSE strftime(o_orderdate, '%d') END"
_RAW = f"""raw AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-') || {_D31}
 WHEN 1 THEN {_D31} || strftime(o_orderdate, '-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%m/') || {_D31} || strftime(o_orderdate, '/%Y')
 ELSE strftime(o_orderdate, '%Y.%m.') || {_D31} END AS raw FROM orders)"""
_READ = """rd AS (SELECT *, CASE WHEN regexp_full_match(raw, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(raw, '%Y-%m-%d')
 WHEN regexp_full_match(raw, '\\d{2}-\\d{2}-\\d{4}') THEN try_strptime(raw, '%d-%m-%Y')
 WHEN regexp_full_match(raw, '\\d{2}/\\d{2}/\\d{4}') THEN try_strptime(raw, '%m/%d/%Y') END::DATE AS d FROM raw)"""


def raw_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = lambda p: F.date_format("o_orderdate", p)
    day = F.when(k % 7 == 0, "31").otherwise(f("dd"))
    raw = (
        F.when(k % 4 == 0, F.concat(f("yyyy-MM-"), day)).when(k % 4 == 1, F.concat(day, f("-MM-yyyy")))
        .when(k % 4 == 2, F.concat(f("MM/"), day, f("/yyyy"))).otherwise(F.concat(f("yyyy.MM."), day))
    )
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))


@query(f"WITH {_RAW}, {_READ} SELECT o_orderkey, raw, d::VARCHAR AS iso FROM rd")
def b3_date_separator(spark, sf):
    """B3, C4, B31."""
    return raw_dates(spark, sf).select("o_orderkey", "raw", D.read_by_separator(F.col("raw")).cast("string").alias("iso"))


@query(f"""WITH {_RAW}, {_READ} SELECT o_orderkey, CASE WHEN day(d) <> month(d) THEN try_strptime(strftime(d, '%Y-%d-%m'), '%Y-%m-%d')::DATE::VARCHAR END AS other FROM rd""")
def b4_alt_reading(spark, sf):
    """B4."""
    return raw_dates(spark, sf).select("o_orderkey", D.alternative_reading(F.col("raw")).cast("string").alias("other"))


@query(f"""WITH {_RAW}, {_READ} SELECT CASE WHEN raw = '' THEN 'empty' WHEN d IS NULL THEN 'DATE_UNREADABLE_TO_NULL' WHEN d > DATE '2000-01-01' THEN 'DATE_IMPOSSIBLE_TO_NULL' ELSE 'kept' END AS fate, count(*) AS n FROM rd GROUP BY 1""")
def b5_impossible_date(spark, sf):
    """What becomes of each date, as of 2000-01-01."""
    m = N.map_date(F.col("raw"), "day", F.lit("2000-01-01").cast("date"))
    r = raw_dates(spark, sf).select("raw", m.alias("m")).select("raw", F.col("m.value").alias("v"), F.filter("m.records", lambda x: x["to_value"].isNull()).alias("lost"))
    fate = F.when(F.col("raw") == "", "empty").when(F.size("lost") > 0, F.get("lost", F.lit(0))["rule_code"]).otherwise("kept")
    return r.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS born, (o_orderdate::DATE + (o_orderkey % 20000)::INT) AS upto FROM orders UNION ALL
SELECT -1, DATE '2004-02-29', DATE '2022-02-28' UNION ALL SELECT -2, DATE '2004-02-29', DATE '2022-03-01')
SELECT o_orderkey, (year(upto) - year(born) - CASE WHEN (month(upto), day(upto)) < (month(born), day(born)) THEN 1 ELSE 0 END)::INTEGER AS age FROM p""")
def b17_age_years(spark, sf):
    """Birthdays had, with the leap day in both cases."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("born"))
    o = o.withColumn("at", F.date_add("born", (F.col("o_orderkey") % 20000).cast("int")))
    leap = spark.sql("SELECT -1L AS o_orderkey, date'2004-02-29' AS born, date'2022-02-28' AS at UNION ALL SELECT -2L, date'2004-02-29', date'2022-03-01'")
    return o.unionByName(leap).select("o_orderkey", D.age_in_years(F.col("born"), F.col("at")).cast("int").alias("age"))


_NINE = "lpad(((c_custkey * 7919 + 104729) % 1000000000)::VARCHAR, 9, '0')"
_SUM = " + ".join(f"substr(b, {i + 1}, 1)::INT * {w}" for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1)))


@query(f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'x' || {_NINE} ELSE {_NINE} END AS b FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(b, '[0-9]{{9}}') THEN b END AS bsn,
 CASE WHEN NOT regexp_full_match(b, '[0-9]{{9}}') THEN 'absent' WHEN ({_SUM}) % 11 = 0 THEN 'valid' ELSE 'invalid' END AS bsn_check FROM r""".replace(_SUM, " + ".join(f"coalesce(try_cast(substr(b, {i + 1}, 1) AS INT), 0) * {w}" for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1)))))
def b6_checksum11(spark, sf):
    """B6, B7."""
    k = F.col("c_custkey")
    nine = F.lpad(((k * 7919 + 104729) % 1000000000).cast("string"), 9, "0")
    raw = F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit("x"), nine)).otherwise(nine)
    return table(spark, sf, "customer").select("c_custkey", N.map_bsn(raw).alias("m")).select("c_custkey", "m.value.bsn", "m.value.bsn_check")


_P8 = "lpad(((c_custkey * 104729) % 100000000)::VARCHAR, 8, '0')"


@query(f"""WITH r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '+316' || {_P8} WHEN 1 THEN '06-' || {_P8} WHEN 2 THEN '06' || {_P8} WHEN 3 THEN '0031 6 ' || {_P8} WHEN 4 THEN '' ELSE '020-' || {_P8} END AS p FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(p, '\\+316[0-9]{{8}}') THEN p WHEN regexp_full_match(p, '06-?[0-9]{{8}}') THEN '+31' || substr(replace(p, '-', ''), 2) END AS phone,
 CASE WHEN p LIKE '0031%' THEN '+31' || regexp_extract(regexp_replace(p, '[ .()+-]', '', 'g'), '^(?:0031|31|0)(6[0-9]{{8}})$', 1) END AS proposed FROM r""")
def b8_phone_e164(spark, sf):
    """B8."""
    k = F.col("c_custkey")
    n = F.lpad(((k * 104729) % 100000000).cast("string"), 8, "0")
    forms = [F.concat(F.lit(p), n) for p in ("+316", "06-", "06", "0031 6 ")]
    raw = F.when(k % 6 == 0, forms[0]).when(k % 6 == 1, forms[1]).when(k % 6 == 2, forms[2]).when(k % 6 == 3, forms[3]).when(k % 6 == 4, "").otherwise(F.concat(F.lit("020-"), n))
    m = table(spark, sf, "customer").select("c_custkey", N.map_phone(raw).alias("m"))
    return m.select("c_custkey", F.col("m.value").alias("phone"), F.get("m.flags", F.lit(0))["proposed"].alias("proposed"))


_W = """w AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 6 + l_linenumber % 10 / 10.0)::DECIMAL(9,1) AS n,
 CASE l_linenumber % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'lbs' WHEN 2 THEN '' ELSE 'stone' END AS unit FROM lineitem),
k AS (SELECT *, CASE unit WHEN 'kg' THEN n WHEN 'lbs' THEN round(n * 0.45359237::DECIMAL(9,8), 1) END AS kg FROM w)"""


@query(f"""WITH {_W} SELECT unit, CASE WHEN unit = '' THEN 'WEIGHT_UNIT_MISSING_TO_NULL' WHEN unit = 'stone' THEN 'VOCAB_UNKNOWN' WHEN kg < 30 OR kg > 300 THEN 'IMPLAUSIBLE_TO_NULL' ELSE 'kept' END AS fate,
 count(*) AS n, round(coalesce(sum(CASE WHEN kg BETWEEN 30 AND 300 THEN kg END), 0)::DOUBLE, 1) AS kept_kg FROM k GROUP BY 1, 2""")
def b9_unit_convert(spark, sf):
    """Units, exact decimal conversion, bounds."""
    n = (F.col("l_quantity") * 6 + (F.col("l_linenumber") % 10) / 10).cast("decimal(9,1)").cast("string")
    i = F.col("l_linenumber") % 4
    unit = F.when(i == 0, "kg").when(i == 1, "lbs").when(i == 2, "").otherwise("stone")
    m = table(spark, sf, "lineitem").select(unit.alias("unit"), N.map_weight(n, unit, 30, 300).alias("m"))
    lost = F.get(F.filter("m.records", lambda r: r["to_value"].isNull()), F.lit(0))["rule_code"]
    return m.groupBy("unit", F.coalesce(lost, F.lit("kept")).alias("fate")).agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum("m.value"), F.lit(0)).cast("double"), 1).alias("kept_kg"))


_VOC = {"F": "finished", "Finished": "finished", "O": "open", "open": "open", "P": "pending"}


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'open' WHEN o_orderkey % 9 = 2 THEN lower(o_orderstatus) ELSE o_orderstatus END AS raw FROM orders),
v AS (SELECT * FROM (VALUES ('F','finished'),('Finished','finished'),('O','open'),('open','open'),('P','pending')) t(s, w))
SELECT coalesce(w, CASE WHEN raw = '' THEN NULL ELSE 'unknown' END) AS value, count(*) AS n, count(*) FILTER (WHERE w IS NOT NULL AND w <> raw) AS mapped, count(*) FILTER (WHERE w IS NULL AND raw <> '') AS unseen
FROM r LEFT JOIN v ON s = raw GROUP BY 1""")
def b11_vocabulary(spark, sf):
    """Exact spellings; identity leaves no record; unknown ones are flagged."""
    k = F.col("o_orderkey")
    raw = F.when(k % 9 == 0, "").when(k % 9 == 1, "open").when(k % 9 == 2, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    m = table(spark, sf, "orders").select(N.map_vocabulary(raw, "status", _VOC, unknown="unknown").alias("m"))
    return m.groupBy(F.col("m.value").alias("value")).agg(
        F.count("*").alias("n"), F.count_if(F.exists("m.records", lambda r: r["rule_code"] == "VOCAB_MAPPED")).alias("mapped"), F.count_if(F.size("m.flags") > 0).alias("unseen"))


@query("""SELECT CASE WHEN p_type = '' THEN 'not_answered' WHEN p_type IN ('LARGE BRASS', 'SMALL TIN') THEN 'none_reported' ELSE 'reported' END AS report, count(*) AS n FROM part GROUP BY 1""")
def b12_reports(spark, sf):
    """B12."""
    m = table(spark, sf, "part").select(N.map_report(F.col("p_type"), "report", ["LARGE BRASS", "SMALL TIN"], "VOCAB_NONE").alias("m"))
    return m.groupBy(F.col("m.value").alias("report")).agg(F.count("*").alias("n"))


_ZONE = """z AS (SELECT *, CASE WHEN w >= TIMESTAMP '2024-03-31 03:00:00' AND w < TIMESTAMP '2024-10-27 03:00:00' AND year(w) = 2024 THEN 2 WHEN w >= TIMESTAMP '2024-03-31 02:00:00' AND w < TIMESTAMP '2024-03-31 03:00:00' THEN 1 ELSE 1 END AS off FROM l)"""


@query(f"""WITH l AS (SELECT event_id, ts AS w FROM events WHERE year(ts) = 2024 UNION ALL SELECT -1, TIMESTAMP '2024-10-27 02:30:00' UNION ALL SELECT -2, TIMESTAMP '2024-03-31 02:30:00'), {_ZONE}
SELECT event_id, strftime(w - to_hours(off), '%Y-%m-%d %H:%M:%S') AS at,
 w >= TIMESTAMP '2024-10-27 02:00:00' AND w < TIMESTAMP '2024-10-27 03:00:00' AS ambiguous, w >= TIMESTAMP '2024-03-31 02:00:00' AND w < TIMESTAMP '2024-03-31 03:00:00' AS nonexistent FROM z""")
def b13_wall_to_instant(spark, sf):
    """Local wall time of 2024, with one time of each odd hour."""
    e = table(spark, sf, "events").where(F.year("ts") == 2024).select("event_id", F.col("ts").cast("timestamp").alias("w"))
    odd = spark.sql("SELECT -1L AS event_id, timestamp'2024-10-27 02:30:00' AS w UNION ALL SELECT -2L, timestamp'2024-03-31 02:30:00'")
    g = e.unionByName(odd).select("event_id", D.wall_to_instant(F.col("w")).alias("g"))
    return g.select("event_id", F.date_format("g.at", "yyyy-MM-dd HH:mm:ss").alias("at"), "g.ambiguous", "g.nonexistent")


_MAIL = """m AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' ' || replace(c_name, '#', '.') || '@Mail.test ' WHEN 1 THEN lower(replace(c_name, '#', '.')) || '@mail.test'
 WHEN 2 THEN replace(c_name, '#', ' ') || '@mail .test' WHEN 3 THEN 'none' WHEN 4 THEN '' ELSE chr(160) || 'A@b.nl' END AS raw FROM customer)"""
_CHAINX = f"""t AS (SELECT *, {trim_sql('raw')} AS tr, lower({trim_sql('raw')}) AS lo, regexp_replace(lower({trim_sql('raw')}), {_WSX}, '', 'g') AS ti FROM m),
g AS (SELECT *, regexp_full_match(lo, '[^\\s@]+@[^\\s@]+\\.[^\\s@]{{2,}}') AS good, regexp_full_match(ti, '[^\\s@]+@[^\\s@]+\\.[^\\s@]{{2,}}') AS tight FROM t)"""


def mails(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.replace("c_name", F.lit("#"), F.lit("."))
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit(" "), name, F.lit("@Mail.test "))).when(k % 6 == 1, F.concat(F.lower(name), F.lit("@mail.test")))
        .when(k % 6 == 2, F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("@mail .test"))).when(k % 6 == 3, "none").when(k % 6 == 4, "").otherwise(" A@b.nl")
    )
    return table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))


_RECS = f"""r AS (SELECT c_custkey, 'WHITESPACE_TRIM' AS rule_code, false AS blank FROM g WHERE raw <> tr UNION ALL SELECT c_custkey, 'EMAIL_LOWERCASE', false FROM g WHERE tr <> lo AND tr <> ''
 UNION ALL SELECT c_custkey, 'EMAIL_INTERNAL_SPACE_TO_NULL', true FROM g WHERE NOT good AND ti <> lo AND tight UNION ALL SELECT c_custkey, 'EMAIL_PLACEHOLDER_TO_NULL', true FROM g WHERE NOT good AND NOT (ti <> lo AND tight) AND raw <> '')"""


@query(f"WITH {_MAIL}, {_CHAINX} SELECT c_custkey, CASE WHEN good THEN lo END AS email, CASE WHEN NOT good AND ti <> lo AND tight THEN ti END AS proposed FROM g")
def b2_email_chain(spark, sf):
    """B1, B2, B36."""
    m = mails(spark, sf).select("c_custkey", N.map_email(F.col("raw")).alias("m"))
    return m.select("c_custkey", F.col("m.value").alias("email"), F.get("m.flags", F.lit(0))["proposed"].alias("proposed"))


@query(f"WITH {_MAIL}, {_CHAINX}, {_RECS} SELECT rule_code, 'email' AS field, count(*) AS n, count(*) FILTER (WHERE blank) AS blanked FROM r GROUP BY 1")
def e2_rule_counts(spark, sf):
    """Records exploded and counted."""
    rows = N.map_rows(mails(spark, sf), "c_custkey", {"email": N.map_email(F.col("raw"))})
    return N.rule_counts(N.evidence(rows, "c_custkey"))


@query(f"WITH {_MAIL}, {_CHAINX}, {_RECS} SELECT rule_code, count(*) AS n, 'email=' || count(*) AS fields FROM r GROUP BY 1")
def e3_rule_field_map(spark, sf):
    """Two levels."""
    rows = N.map_rows(mails(spark, sf), "c_custkey", {"email": N.map_email(F.col("raw"))})
    m = N.rule_field_map(N.evidence(rows, "c_custkey"))
    return m.select("rule_code", "n", F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["field"], f["n"].cast("string"))), ",").alias("fields"))


@query("""SELECT c_custkey, CASE WHEN length(k) <= 3 THEN repeat('*', length(k)) ELSE repeat('*', length(k) - 3) || right(k, 3) END AS masked, 'sha256:' || sha256(k) AS digest FROM (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer)""")
def b18_mask(spark, sf):
    """B18, B19."""
    k = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select("c_custkey", T.mask_identifier(k).alias("masked"), T.digest(k).alias("digest"))


_ESC = "replace(replace({0}, '\\', '\\\\'), '|', '\\|')"


@query(f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents), k AS (SELECT doc_id, text, 'item|' || {_ESC.format("source || '|x'")} || '||' || doc_id || '|' || {_ESC.format("text")} || '|' AS key FROM s)
SELECT doc_id, sha256(key) AS key_hash, sha256(text) AS rule_hash FROM k""")
def b20_dedupe_key(spark, sf):
    """Keys over whole texts, taken apart again."""
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    key = T.dedupe_key(F.lit("item"), F.concat("source", F.lit("|x")), F.lit(None), F.col("doc_id"), F.col("text"), F.lit(""))
    back = d.select("doc_id", key.alias("key"))
    return back.select("doc_id", F.sha2(F.col("key").cast("binary"), 256).alias("key_hash"), F.sha2(T.rule_of(F.col("key")).cast("binary"), 256).alias("rule_hash"))


@query("""SELECT shape, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(p_name, '\\p{Nd}', '9', 'g'), '\\p{Ll}', 'a', 'g'), '\\p{Lu}', 'A', 'g') AS shape FROM part) GROUP BY 1""")
def b23_shape_inventory(spark, sf):
    """B23, G3."""
    from ..operators.aggregates import inventory

    return inventory(table(spark, sf, "part").select(T.shape(F.col("p_name")).alias("shape")), "shape")


@query("""SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, regexp_matches(p_name, '[ ]{2}') AS double_space, round(try_cast(replace(s, ',', '.') AS DOUBLE), 2) AS number FROM
(SELECT *, CASE p_partkey % 3 WHEN 0 THEN (p_size || ',5') WHEN 1 THEN p_size::VARCHAR ELSE p_size || 'x' END AS s FROM part)""")
def b24_text_flags(spark, sf):
    """B24, B25."""
    p = table(spark, sf, "part")
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(s, F.lit(",5"))).when(k == 1, s).otherwise(F.concat(s, F.lit("x")))
    return p.select("p_partkey", T.digits_only(F.col("p_brand")).alias("digits"), T.has_double_space(F.col("p_name")).alias("double_space"), F.round(T.parse_number(raw), 2).alias("number"))


_SPACES = T.WS[1:-1].replace("\\x0B", "\\x{0B}").replace("\\x20", "\\x{20}").replace("\\xA0", "\\x{A0}")


@query(f"""SELECT doc_id, regexp_matches(text, '^[{_SPACES}]') OR regexp_matches(text, '[{_SPACES}]$') AS edge_space, regexp_matches(text, '[^ -~]') AS beside_ascii, strip_accents(text) <> text AS marks,
 sha256(list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '[^\\p{{L}}\\p{{M}} ''\\-.]'))), 'string_agg', '')) AS unusual FROM documents WHERE text <> '' AND regexp_matches(text, '[^\\p{{L}}\\p{{M}} ''\\-.]')""")
def b24_unusual_text(spark, sf):
    """Edge spaces, characters beside ASCII, marks of any script and unusual characters of whole texts."""
    t = F.col("text")
    odd = F.array_join(T.unusual_name_characters(t), "")  # no filter on it, which would work it out twice
    d = table(spark, sf, "documents").where(T.has_unusual_characters(t))
    return d.select("doc_id", T.has_edge_space(t).alias("edge_space"), T.has_diacritics(t).alias("beside_ascii"), T.has_marks(t).alias("marks"), F.sha2(odd.cast("binary"), 256).alias("unusual"))


@query(f"""WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '  ' || text ELSE text END AS text FROM documents), f AS (SELECT {fold_sql("text")} AS folded, text FROM r)
SELECT sha256(folded) AS folded_hash, count(DISTINCT text) AS spellings, count(*) AS n FROM f GROUP BY folded HAVING count(DISTINCT text) > 1""")
def e16_folding_merge(spark, sf):
    """E16, B22."""
    from ..operators.aggregates import folding

    d = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), "text")).otherwise(F.col("text")))
    d = d.withColumn("raw_hash", F.sha2(F.col("text").cast("binary"), 256))
    f = folding(d, "raw_hash", F.sha2(T.fold(F.col("text")).cast("binary"), 256))
    return f.withColumnRenamed("folded", "folded_hash")


@query("""WITH r AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT count(*) AS n, count(*) FILTER (WHERE k IS NULL) AS without_k, count(DISTINCT k) AS ks FROM r""")
def i_json_access(spark, sf):
    """I (json), D19: key access over a document column."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.count_if(k.isNull()).alias("without_k"), F.countDistinct(k).alias("ks"))


@query("""SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 18 YEAR)::DATE::VARCHAR AS latest, CASE WHEN o_totalprice < 1000 THEN 'total too small' ELSE '' END || CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN ',urgent and done' ELSE '' END AS failed FROM orders""")
def b33_checks(spark, sf):
    """Failed checks as a list, date bounds."""
    checks = {"total too small": F.col("o_totalprice") >= 1000, ",urgent and done": ~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))}
    o = N.failed_checks(table(spark, sf, "orders"), checks)
    return o.select("o_orderkey", D.dob_bounds(F.to_date("o_orderdate"))["latest"].cast("string").alias("latest"), F.array_join("failed", "").alias("failed"))
