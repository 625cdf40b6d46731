"""Profiles of tables and the submission step, on small tables with odd rows."""

import collections
import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import text as T
from ledgermill.operators import aggregates as A
from ledgermill.operators import profiles as P
from ledgermill.operators import submission as S
from ledgermill.sources import ruleset, stored


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_every_column_in_one_scan(spark):
    made = [("a ", 1, None), ("A", 1, "x"), ("", 2, "x"), ("b9", None, "x"), ("b8", 3, "ÀÀ"), ("a ", 1, "x")]
    df = spark.createDataFrame(made, "s string, n int, t string")
    counts = P.column_counts(df)
    plan = df.select("s")._jdf.queryExecution().toString()
    assert plan.count("Scan") >= 1 and counts.count() == 5 + 4 + 3
    got = {r["column"]: r.asDict() for r in P.column_inventory(counts).collect()}
    assert got["s"] == {"column": "s", "rows": 6, "nulls": 0, "empty": 1, "edge_rows": 2, "edge_values": 1, "distinct_values": 5, "distinct_folded": 4, "distinct_shapes": 4, "distinct_collapsed": 4}
    assert (got["n"]["nulls"], got["n"]["distinct_values"], got["t"]["distinct_shapes"], got["t"]["distinct_collapsed"]) == (1, 3, 2, 2)
    assert [(r.value, r.n, r["rank"]) for r in P.top_values(counts, 2).where("column = 's'").orderBy("rank").collect()] == [("a ", 2, 1), ("", 1, 2)]
    assert {(r["shape"], r.n): r.examples for r in P.shape_counts(counts, 1).where("column = 's'").collect()} == {("a ", 2): ["a "], ("A", 1): ["A"], ("", 1): [""], ("a9", 2): ["b8"]}
    nothing = P.column_counts(df.limit(0))
    assert P.column_inventory(nothing).isEmpty() and P.top_values(nothing).isEmpty()


def tail_by_hand(days, gap):
    counts = sorted(collections.Counter(d for d in days if d).items())
    runs = [[counts[0]]]
    for before, now in itertools.pairwise(counts):
        if (now[0] - before[0]).days > gap:
            runs.append([])
        runs[-1].append(now)
    size = [sum(n for _, n in r) for r in runs]
    b = size.index(max(size))
    return runs[b][0][0], runs[b][-1][0], size[b], sum(size[:b]), sum(size[b + 1 :]), [x for r in runs[b + 1 :] for x in r]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_isolated_tail_by_hand(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(1)
        base = datetime.date(2000, 1, 1)
        columns = {c: [base + datetime.timedelta(rng.choice([0, 0, 0, 5000, -3000, 9000]) + rng.randint(0, 700)) for _ in range(120)] for c in "abc"}
        columns["one"] = [base]
        columns["tie"] = [base, base + datetime.timedelta(1000)]
        df = spark.createDataFrame([(c, d) for c, ds in columns.items() for d in ds] + [("none", None), ("a", None)], "c string, d date")
        said, tail = P.isolated_tail(df, "c", "d", 60)
        want = {c: tail_by_hand(ds, 60) for c, ds in columns.items()}
        assert {r["column"]: tuple(r)[1:] for r in said.collect()} == {c: w[:5] for c, w in want.items()}
        assert sorted((r["column"], r.day, r.rows) for r in tail.collect()) == sorted((c, d, n) for c, w in want.items() for d, n in w[5])
        said, tail = P.isolated_tail(df.limit(0), "c", "d")
        assert said.isEmpty() and tail.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_associations_and_counterexamples(spark):
    df = spark.createDataFrame([(i % 6, i % 3, None if i % 3 == 0 else i % 3) for i in range(60)], "a int, b int, c int")
    got = {(r.a, r.b): r for r in P.associations(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"].agreeing == got["a", "b"].rows == 60 and got["b", "a"].agreeing == 30
    assert got["b", "c"].agreeing == got["c", "b"].agreeing == 60 and (got["a", "b"].values_a, got["a", "b"].values_b, got["a", "b"].pairs) == (6, 3, 6)
    bad = P.counterexamples(df.withColumn("i", F.monotonically_increasing_id()), F.col("a") < 4, "b", ["i"], 2).collect()
    assert {r.b for r in bad} == {1, 2} and all(r.broken == 10 and r.nth <= 2 for r in bad) and len(bad) == 4


def test_overlaps_by_sets(spark):
    rng = random.Random(2)
    sets = {f"g{i}": {rng.randint(0, 60) for _ in range(25)} for i in range(6)}
    sets["empty"] = set()
    frames = {k: spark.createDataFrame([(x,) for x in [*v, *list(v)[:3]]], "id long") for k, v in sets.items()}
    got = {(r.a, r.b): (r.n, r.only_a) for r in P.overlaps(frames, "id").collect()}
    others = {k: set().union(*(v for j, v in sets.items() if j != k)) for k in sets}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a] - others[a])) for i, a in enumerate(sets) for b in list(sets)[i:]}
    with pytest.raises(ValueError, match="groupings"):
        P.membership_masks({str(i): frames["g0"] for i in range(31)}, "id")


def test_examples_of_large_and_null_groups(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else "g", f"v{i % 50:02}", i) for i in range(400)], "g string, e string, o int")
    got = {r.g: (r.n, r.examples) for r in A.with_examples(df, "g", "e", "o").collect()}
    assert got == {None: (100, ["v00", "v04", "v08"]), "g": (300, ["v01", "v02", "v03"])}


def test_claims(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (2, 4.0)], "k int, v double")
    c = [P.Claim("rows", "t", F.count("*"), 3), P.Claim("mean", "t", F.avg("v"), 2.9, 0.2), P.Claim("distinct", "t", F.countDistinct("k"), 3), P.Claim("none", "t", F.max(F.when(F.col("k") > 9, 1)), 1), P.Claim("gone", "u", F.count("*"), 0)]
    got = P.judged_claims({"t": df}, c)
    assert {r.name: (r.found, r.verdict) for r in got.collect()} == {"rows": (3.0, "confirmed"), "mean": (3.0, "confirmed"), "distinct": (2.0, "refuted"), "none": (None, "unknown"), "gone": (None, "unknown")}
    with pytest.raises(ValueError, match="one name"):
        P.judged_claims({"t": df}, [c[0], c[0]])


def test_marks_of_every_code_point(spark):
    import unicodedata

    points = [n for n in range(1, 0x110000) if not 0xD800 <= n <= 0xDFFF]
    want = {n for n in points if any(unicodedata.category(x)[0] == "M" for x in unicodedata.normalize("NFD", chr(n)))}
    whole = spark.createDataFrame([(n, chr(n)) for n in sorted(want | set(points[::37]) | set(range(1, 0x3000)))], "id int, c string")
    assert {r.id for r in whole.where(T.has_marks(F.col("c"))).collect()} == want
    assert T._marked().count("-") < 3000


# -- submission --

GOOD = {
    "formVersion": "intake-form-v1", "consent": {"granted": True, "textVersion": "v3"}, "identity": {"fullName": " Ann Bos ", "email": "Ann@X.nl ", "dob": "1990-02-28"}, "metrics": {"heightCm": 170, "weightKg": 95.5},
    "medications": {"glp1Declared": False, "glp1": [], "otherMedications": ""}, "conditions": {"conditions": [], "otherConditions": ""}}


def document(**changes):
    d = json.loads(json.dumps(GOOD))
    for path, value in changes.items():
        *way, last = path.split("__")
        at = d
        for w in way:
            at = at[w]
        if value is KeyError:
            del at[last]
        else:
            at[last] = value
    return json.dumps(d)


def said(spark, *documents):
    df = spark.createDataFrame(list(enumerate(documents)), "i int, d string").select("i", S.parsed(F.col("d")).alias("a"))
    made = df.select("i", S.issues(F.col("a"), F.lit("2026-06-01").cast("date"), ruleset.load()).alias("x"))
    return [[(p.path, p.message) for p in r.x] for r in made.orderBy("i").collect()]


def test_documents_and_their_issues(spark):
    cases = {
        document(): [], document(more=1): [], document(identity__dob=KeyError): ["identity.dob"], document(identity=None): ["identity.fullName", "identity.email", "identity.dob"],
        document(metrics__heightCm="tall"): ["metrics.heightCm"], document(identity__dob="2026-06-01"): ["identity.dob"], document(identity__dob="1925-06-01"): ["identity.dob"], document(identity__dob="1925-06-02"): [],
        document(identity__dob="2023-02-29"): ["identity.dob"], document(identity__fullName="x" * 201): ["identity.fullName"], document(metrics__weightKg=95.55): ["metrics.weightKg"], document(metrics__heightCm=230): [],
        document(metrics__heightCm=99.5): ["metrics.heightCm"] * 2, document(consent__granted=False): ["consent.granted"], document(consent__textVersion="v2"): ["consent.textVersion"],
        document(medications__glp1=["semaglutide"]): ["medications"], document(medications__glp1Declared=True): ["medications"], document(medications__glp1Declared=True, medications__otherMedications="x"): [],
        document(medications__glp1Declared=True, medications__glp1=["semaglutide", "semaglutide"]): ["medications.glp1"], document(medications__glp1Declared=True, medications__glp1=["aspirin"]): ["medications.glp1"],
        document(conditions__conditions=["pcos", None]): ["conditions.conditions"], document(medications__glp1Declared=None): ["medications.glp1Declared"]}
    got = said(spark, *cases)
    assert [[p for p, _ in g] for g in got] == list(cases.values())
    assert len(said(spark, "not json", "{}", "[]")[0]) == len(said(spark, "{}")[0]) == 13


def submit(spark, drafts, stored_people=()):
    intakes = spark.createDataFrame(drafts, "intake_id long, state string, answers string")
    people = spark.createDataFrame(list(stored_people), "patient_id string, email string, full_name string, dob date")
    asked = intakes.select("intake_id").unionByName(intakes.select("intake_id")).unionByName(spark.createDataFrame([(999,)], "intake_id long"))
    return S.submit_all(intakes, asked, people, F.lit("2026-06-01 10:00:00").cast("timestamp"), ruleset.load())


def test_what_a_submission_writes(spark, tmp_path):
    slim = document(medications__glp1Declared=True, medications__otherMedications="Slim Quick", identity__email="new@x.nl", identity__fullName="Cas")
    young = document(identity__dob="2015-01-01", identity__email="kid@x.nl", identity__fullName="Kid")
    out = submit(spark, [(1, "draft", document()), (2, "submitted", document()), (3, "draft", "{}"), (4, "draft", slim), (5, "draft", young), (6, "draft", None)], [("p1", "ann@x.nl", "Other", None), ("p2", None, "ann  bos", datetime.date(1990, 2, 28))])
    assert {r.intake_id: (r.kind, bool(r.issues)) for r in out["refused"].collect()} == {2: ("not_draft", False), 3: ("invalid", True), 6: ("invalid", True), 999: ("not_found", False)}
    assert {r.intake_id: r.state for r in out["intakes"].collect()} == {1: "auto_cleared", 4: "auto_flagged", 5: "auto_rejected"}
    assert {(r.patient_id, r.full_name, r.email) for r in out["patients"].collect()} == {("form:1", "Ann Bos", "ann@x.nl"), ("form:4", "Cas", "new@x.nl"), ("form:5", "Kid", "kid@x.nl")}
    assert {r.rule_code for r in out["records"].collect() if r.patient_id == "form:1"} == {"WHITESPACE_TRIM", "EMAIL_LOWERCASE"}
    moves = [(r.entity_id, r.from_state, r.to_state) for r in out["audit"].collect() if r.entity_type == "intake"]
    assert sorted(moves) == sorted((str(i), a, b) for i, v in ((1, "auto_cleared"), (4, "auto_flagged"), (5, "auto_rejected")) for a, b in (("draft", "submitted"), ("submitted", v)))
    assert {(r.subject, r.state) for r in out["states"].collect()} == {(f"form:{i}", "granted") for i in (1, 4, 5)}
    assert sorted(r.type for r in out["items"].collect()) == ["identity_conflict", "vocabulary"]

    path = str(tmp_path / "runs")
    assert S.write_together(out, path, {"audit": {"a reason": F.col("reason") != ""}}) == 0
    held = {name: rows(S.read_together(spark, path, name)) for name in out}
    with pytest.raises(ValueError, match="intakes: cleared"):  # the last output fails: none of them counts
        S.write_together(out, path, {"intakes": {"cleared": F.col("state") == "auto_cleared"}})
    assert stored.complete(spark, path, "run") == [0] and not stored.exists(spark, f"{path}/run=1")
    with pytest.raises(Exception, match="no state"):
        S.write_together({**out, "items": out["items"].withColumn("type", F.raise_error(F.lit("no state for it")))}, path, {})
    assert {name: rows(S.read_together(spark, path, name)) for name in out} == held
    spark.range(1).write.parquet(f"{path}/run=1/audit")  # what a job that was killed leaves
    assert S.write_together(out, path, {}) == 1 and S.read_together(spark, path, "intakes").count() == 6
