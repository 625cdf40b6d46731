"""Table functions: scans, sinks, events, identity, decisions, moves, streams."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgermill.operators import aggregates as A
from ledgermill.operators import decisions as X
from ledgermill.operators import detectors as Q
from ledgermill.operators import events as E
from ledgermill.operators import identity as I
from ledgermill.operators import items as M
from ledgermill.operators import rules as R
from ledgermill.sources import files as S
from ledgermill.streaming import states


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- scans and sinks --


def test_csv_scan(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b'id,name\n1,"a, ""b""\nc"\n2, x \n')
    got = S.read_csv(spark, str(p), ["id", "name"]).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.name) for r in got] == [(2, "1", 'a, "b"\nc'), (4, "2", " x ")]
    assert got[1].row_hash == hashlib.sha256(b"2, x ").hexdigest()
    out = spark.createDataFrame([("1", 'a, "b"\nc'), ("2", " x ")], "id string, name string").select(S.csv_record(F.col("id"), F.col("name")).alias("r"))
    assert [r.r for r in out.collect()] == ['1,"a, ""b""\nc"', "2, x "]


@pytest.mark.parametrize("bad", [
    b"id,other\n1,2\n", b"id,name\n1\n", b'id,name\n1,"2,3\n', b'id,name\n1,2\n3,"4\n5,6\n', b'id,name\n1,a"b\n', b'id,name\n1,"a"b\n', b"id,name\n1,2\n\n3,4\n", b"id,name\n1,2\n\n", b"",
    b"\xef\xbb\xbfid,name\n1,2\n", b"\n", b"id,name,more\n",
])
def test_csv_scan_stops_at_what_it_cannot_read(spark, tmp_path, bad):
    p = tmp_path / "a.csv"
    p.write_bytes(bad)
    with pytest.raises(PySparkException):
        S.read_csv(spark, str(p), ["id", "name"]).collect()


def test_csv_scan_stops_at_an_endless_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MAX_RECORD_LINES", 20)
    p = tmp_path / "a.csv"
    p.write_text('id,name\n1,"' + "x\n" * 19 + '"\n2,b\n')
    assert [r.id for r in S.read_csv(spark, str(p), ["id", "name"]).orderBy("line_no").collect()] == ["1", "2"]
    p.write_text('id,name\n1,a\n2,"b\n' + "3,c\n" * 30 + '4,"d"\n')  # the quote of line 3 isn't closed
    with pytest.raises(Exception, match="a record of more than 20 lines at line 3 of a.csv"):
        S.read_csv(spark, str(p), ["id", "name"]).collect()


def test_csv_scan_in_splits(spark, tmp_path):
    """Records that stand over the ends of splits, several files, both line ends, no last line feed."""
    want = []
    for f in range(2):
        body, line = [b"id,name"], 2
        for i in range(400):
            name = "é" * (i % 7) + ("\n" * (i % 3)) + ('"' if i % 5 == 0 else "") + " ,"
            raw = f'{i},"{name.replace(chr(34), chr(34) * 2)}"'.encode()
            want.append((f"f{f}.csv", line, str(i), name, hashlib.sha256(raw).hexdigest()))
            body.append(raw)
            line += 1 + name.count("\n")
        (tmp_path / f"f{f}.csv").write_bytes((b"\r\n" if f else b"\n").join(body) + (b"" if f else b"\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = S.read_csv(spark, str(tmp_path), ["id", "name"])
        assert sorted((r.source_file, r.line_no, r.id, r.name, r.row_hash) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_jsonl_scan(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": "1", "b": "x"}\n{"b": "y", "a": "2"}\n')
    assert [(r.line_no, r.a, r.b) for r in S.read_jsonl(spark, str(p), ["a", "b"]).orderBy("line_no").collect()] == [(1, "1", "x"), (2, "2", "y")]
    for bad in ('{"a": "1", "b": "x", "c": "z"}', '{"a": "1"}', '{"a": "1", "b": 2}', '{"a": "1", "b": null}', "", "x", '["a"]', "\ufeff" + '{"a": "1", "b": "x"}'):
        p.write_text(f'{bad}\n{{"a": "1", "b": "x"}}\n')
        with pytest.raises(PySparkException):
            S.read_jsonl(spark, str(p), ["a", "b"]).collect()


def test_file_facts(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿a;b\r\n1;é\r\n2\n".encode())
    f = S.fingerprint(spark, str(p)).first()
    assert (f.name, f.bytes, f.sha256) == ("a.csv", p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest())
    s = S.sniff(spark, str(p)).first()
    assert (s.delimiter, s.bom, s.crlf, s.lf) == (";", True, 2, 1)
    p.write_bytes(b'a,b\n1,"x\ny"\n2\n')
    r = S.ragged(spark, str(p)).first()
    assert (r.records, r.ragged, r.fields_with_newline) == (2, 1, 1)


def test_sinks(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = S.append_new(new, None, ["k"])
    assert S.append_new(new, first, ["k"]).count() == 0
    with pytest.raises(Exception, match="key repeated"):
        S.append_new(new.union(new), None, ["k"]).collect()
    assert rows(S.upsert(new, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    for twice in (((2, "c"), (2, "d")), ((2, "d"), (2, "c"))):
        with pytest.raises(Exception, match="key repeated"):
            S.upsert(new, spark.createDataFrame(twice, "k int, v string"), ["k"]).collect()
    assert S.to_html(spark.createDataFrame([(1, "<a>"), (2, None)], "k int, v string"), ["k"]).count("<td>") == 4
    S.rewrite(new, str(tmp_path / "t"), ["k"])
    S.rewrite(new.where("k = 2").withColumn("v", F.lit("z")), str(tmp_path / "t"), ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "z")}
    assert S.report_lines(new, ["k"])[0] == '{"k": 1, "v": "a"}' and "| 2 | b |" in S.to_markdown(new, ["k"])


# -- events --

LOG = "subject int, type string, action string, at timestamp, id int"


def log(spark, events):
    df = spark.createDataFrame([(s, "t", a, at, i) for i, (s, a, at) in enumerate(events)], "subject int, type string, action string, at string, id int")
    return df.withColumn("at", F.col("at").cast("timestamp"))


def test_states(spark):
    e = log(spark, [(1, "granted", "2024-01-01"), (1, "revoked", "2024-01-01"), (2, "revoked", "2024-01-01"), (2, "granted", "2024-02-01"), (3, "granted", "2024-01-05"), (3, "granted", "2023-01-05")])
    s = spark.createDataFrame([(i, "2022-06-01" if i == 5 else "2023-06-01") for i in range(1, 6)], "subject int, signup string").withColumn("signup", F.col("signup").cast("date"))
    for parts in (1, 5):
        got = {r.subject: r.state for r in E.derive_states(s, e.repartition(parts), ["t"], F.lit("2023-01-01").cast("date")).collect()}
        assert got == {1: "revoked", 2: "conflict", 3: "granted", 4: "no_record", 5: "unknown_pre_log"}


def test_order_and_islands(spark):
    e = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, 1, 1), (2, 2, 2)], "k int, a int, b int")
    assert [r.k for r in E.out_of_order(e, "k", F.col("a"), F.col("b")).collect()] == [1]
    d = spark.createDataFrame([(1, x) for x in ("2024-01-01", "2024-01-03", "2024-03-01", "2024-03-01")], "k int, d string").withColumn("d", F.col("d").cast("date"))
    assert [(r.island, r.n) for r in E.islands(d, "k", "d", 10).orderBy("island").collect()] == [(0, 2), (1, 1)]
    acts = {"a": "g", "b": "ggg", "c": "grgr", "d": "rg", "e": "grg" * 5, "f": "rr"}
    long = {"g": "granted", "r": "revoked"}
    e = spark.createDataFrame([(k, i, long[x]) for k, v in acts.items() for i, x in enumerate(v)], "k string, i int, act string").repartition(3)
    got = dict(rows(E.sequence_pattern(e, "k", "act", [F.col("i")])))
    assert got == {"a": "single granted", "b": "3 x granted", "c": "granted then revoked", "d": "revoked then granted", "e": f"mixed ({' > '.join(long[x] for x in 'grg' * 5)})", "f": "2 x revoked"}
    assert [r.subject for r in E.still_revoked(log(spark, [(1, "granted", "2024-01-01"), (1, "revoked", "2024-02-01"), (2, "revoked", "2024-01-01"), (2, "granted", "2024-01-02")]), "subject").collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    e = log(spark, [(i % 3, "granted" if i % 2 else "revoked", f"2024-01-{1 + i:02}") for i in range(12)])
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = states.start(stream, ["subject", "type"], "running_states", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT subject, max_by(last_action, n_events) AS a, max_by(last_id, n_events) AS i FROM running_states GROUP BY subject")
    assert rows(last) == rows(E.ends(e, ["subject", "type"]).select("subject", "last_action", "last_id"))


# -- identity --


def test_groups_tiers_survivors(spark):
    people = spark.createDataFrame(
        [("p1", "Ann B", "1990-01-01", "a@x.nl", None, "active", 0, "2020-01-01"), ("p2", "ann  b ", "1990-01-01", "a@x.nl", "1", "active", 2, "2019-01-01"),
         ("p3", "Cas", "1980-01-01", "c@x.nl", "5", "active", 0, None), ("p4", "Dirk", "1981-01-01", None, "5", "active", 0, "2021-01-01"),
         ("p5", "Eve", None, "c@x.nl", None, "unknown", 0, "2021-01-01"), ("p6", "Lone", None, None, None, "active", 0, None)],
        "id string, name string, dob string, email string, phone string, status string, intakes int, signup string")
    parts = I.person_keys(F.col("name"), F.col("dob"), F.col("email"), F.lit(None).cast("string"), F.col("phone"))
    keys = I.keys_of(people, "id", parts)
    g = I.groups(keys, "id")
    assert rows(g) == [("p1", "p1"), ("p2", "p1"), ("p3", "p3"), ("p4", "p3"), ("p5", "p3")]
    m = people.join(g, "id")
    fields = {"name": F.nullif(F.regexp_replace(F.lower(F.trim("name")), " +", " "), F.lit("")), "dob": F.col("dob"), "email": F.col("email"), "phone": F.col("phone"), "status": F.nullif("status", F.lit("unknown"))}
    t = {r.root: (r.tier, r.contradictions, r.differences) for r in I.classify(m, fields, ["name", "dob", "status"], ["name", "dob", "email"]).collect()}
    assert t["p1"] == (1, [], ["phone"]) and t["p3"][0] == 3 and t["p3"][1] == ["name", "dob"]
    s = {r.root: (r.survivor, r.rule) for r in I.survivors(m, "id", F.col("intakes") > 0, F.col("signup")).collect()}
    assert s == {"p1": ("p2", "survivor is the only row with intakes"), "p3": ("p4", "survivor has the lower legacy id")}
    assert {(r.root, r.kind) for r in I.matched_keys(keys, g, "id").collect()} == {("p1", "email"), ("p1", "name_born"), ("p3", "email"), ("p3", "phone")}
    merges = I.tier_one_merges(I.classify(m, fields, ["name"], ["name"]), g, I.survivors(m, "id", F.col("intakes") > 0, F.col("signup")), "id")
    assert rows(merges) == [("p2", "p1")]


def test_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id int, parent int")
    assert I.survivor_of(chain).where("survivor <> 0").count() == 0
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "a int, b int")
    assert I.components(e).where("root <> 0").count() == 0
    with pytest.raises(ValueError):
        I.survivor_of(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id int, parent int"))


def test_merge_and_unmerge(spark):
    r = spark.createDataFrame([(1, "", None), (2, "b", "x"), (3, "c", "y")], "id int, city string, phone string")
    pairs = spark.createDataFrame([(1, 3), (1, 2)], "survivor int, loser int")
    c = I.merge_fields(pairs, r, "id", ["city", "phone"])
    after = I.apply_changes(r, c, "id", ["city", "phone"])
    assert rows(after)[0] == (1, "b", "x")
    assert rows(I.apply_changes(after, c, "id", ["city", "phone"], undo=True)) == rows(r)


# -- decisions and moves --


MOVE = "id string, from_state string, to_state string, actor_kind string, reason string, ruleset string, matched array<string>"


def test_moves(spark):
    assert len(R.STATES) == len(set(R.STATES)) == 12
    ok = [(f"{a}>{b}", a, b, k, "r", "v1", []) for a, b, k, *_ in R.EDGES]
    assert R.refused_moves(spark.createDataFrame(ok, MOVE), R.edges(spark)).count() == 0
    rest = [(f"{a}>{b}", a, b, k, "r", "v1", []) for a in R.STATES for b in R.STATES for k in ("process", "reviewer") if f"{a}>{b}" not in {m[0] for m in ok}]
    assert {r.why for r in R.refused_moves(spark.createDataFrame(rest, MOVE), R.edges(spark)).collect()} == {"no such edge"}
    odd = [("reason", *ok[0][1:4], " ", None, None), ("actor", "draft", "submitted", "reviewer", "r", None, None), ("rules", *ok[1][1:5], "", None), ("none", *ok[8][1:6], None),
           ("young", *ok[8][1:6], ["bmi_below_minimum", "age_below_minimum"]), ("null", None, "draft", "process", "r", "v1", [])]
    why = {r.id: r.why for r in R.refused_moves(spark.createDataFrame(odd, MOVE), R.edges(spark)).collect()}
    assert why == {"reason": "reason missing", "actor": "wrong actor", "rules": "ruleset missing", "none": "no evaluation", "young": "absolute reject", "null": "no such edge"}
    low = spark.createDataFrame([("low", *ok[8][1:6], ["bmi_below_minimum"])], MOVE)
    assert R.refused_moves(low, R.edges(spark)).count() == 0 and R.refused_moves(low, R.edges(spark), ("bmi_below_minimum",)).count() == 1
    now = spark.createDataFrame([("1", "draft"), ("2", "draft")], "id string, state string")
    moves = spark.createDataFrame([("1", "submitted", "c", "process", "t", "sent", None, None), ("2", "approved", "c", "process", "t", "sent", None, None)],
                                  "id string, to_state string, actor string, actor_kind string, at string, reason string, ruleset string, matched array<string>")
    nxt, audit = R.transition(now, moves, R.edges(spark))
    assert rows(nxt) == [("1", "submitted"), ("2", "draft")] and audit.count() == 1
    with pytest.raises(PySparkException):
        spark.range(1).select(R.state_for_outcome(F.lit("odd"))).collect()


def test_snapshots_keep_the_machine(spark):
    old = [(1, "draft", "a"), (2, "draft", "a"), (3, "submitted", "a"), (4, "legacy_pending", "a"), (5, "legacy_pending", "a"), (6, "approved", None), (7, "legacy_approved", "a")]
    new = [(1, "submitted", "b"), (2, "approved", "a"), (3, "submitted", "b"), (4, "legacy_approved", "a"), (5, "in_review", "a"), (6, "approved", None), (7, "in_review", "a"), (8, "draft", "x"), (9, "approved", "x")]
    kind = "id int, state string, answers string"
    got = {r.id: r.why for r in R.refused_changes(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), R.edges(spark)).collect()}
    assert got == {2: "no such edge", 3: "answers are evidence", 7: "no such edge", 9: "starts as draft or a legacy state"}


def test_decisions(spark):
    items = spark.createDataFrame(
        [(1, "data_quality", "open", "city", None, "Delft", "p1", None, None), (2, "data_quality", "open", "submitted_at", None, None, "p1", "i1", None), (3, "data_quality", "open", "outcome", None, "ok", "p1", "i1", None),
         (4, "vocabulary", "open", "weight_kg", X.POUNDS_RULE, None, None, None, None), (5, "orphan_intake", "open", None, None, None, None, "i1", None), (6, "duplicate_intake", "open", None, None, None, "p1", None, None),
         (7, "consent", "open", None, None, None, "p1", None, "conflict"), (8, "clinical_history", "open", None, None, None, None, "i1", None), (9, "data_quality", "open", "bsn", None, None, "p1", None, None)],
        "item int, type string, status string, field string, rule string, proposed string, patient_id string, intake_id string, derived string")
    ask = spark.createDataFrame(
        [(1, "accept_proposal", "n", None, None), (2, "set_value", "n", "2024-02-29", None), (3, "accept_proposal", "n", None, None), (4, "confirm", "n", None, ["b"]), (5, "attach", "n", "p2", None), (6, "keep_one", "n", "i2", None),
         (7, "set_state", "n", "granted", None), (8, "resolve", "n", None, None), (9, "set_value", "n", None, None)], "item int, action string, note string, value string, excluded array<string>")
    listed = spark.createDataFrame([(4, "a", "80", "p1"), (4, "b", "90", "p2"), (6, "i1", None, "i1"), (6, "i2", None, "i2")], "item int, row string, value string, owner_id string")
    people = spark.createDataFrame([("p1", "Delft", "70.0", "123456782", "valid"), ("p2", "x", None, None, "absent")], "id string, city string, weight_kg string, bsn string, bsn_check string")
    intakes = spark.createDataFrame([("i1", None, None, "approved"), ("i2", "p1", None, "approved")], "id string, patient_id string, submitted_at date, outcome string")
    decisions, changes, subjects = X.decide(items, ask, listed, people.select(F.col("id").alias("patient_id")))
    assert {r.item: (r.outcome, r.problem) for r in decisions.collect()} == {**{i: ("resolved", None) for i in (1, 2, 4, 5, 6, 7, 8, 9)}, 3: (None, "names no row to correct")}
    nxt, audit, closed = X.resolve({"patient": people, "intake": intakes}, items, decisions, changes, subjects, "r1", F.lit("2024-01-01").cast("date"))
    assert rows(nxt["patient"]) == [("p1", "Delft", "80.0", None, "absent"), ("p2", "x", None, None, "absent")]
    assert [(r.id, r.patient_id, str(r.submitted_at), r.outcome) for r in nxt["intake"].orderBy("id").collect()] == [("i1", "p2", "2024-02-29", "approved"), ("i2", "p1", "None", "approved")]
    said = {(r.item, r.entity_id): [c.field for c in r.changes or []] for r in audit.collect()}
    assert said == {(1, "p1"): [], (2, "i1"): ["submitted_at"], (4, "p1"): ["weight_kg"], (5, "i1"): ["patient_id"], (6, "i1"): [], (6, "i2"): [], (7, "p1"): [], (8, "i1"): [], (9, "p1"): ["bsn", "bsn_check"]}
    assert {r.item for r in closed.where("status = 'open'").collect()} == {3}
    again, _, _ = X.decide(closed, ask, listed, people.select(F.col("id").alias("patient_id")))
    assert again.where("problem = 'already closed'").count() == 8


@pytest.mark.parametrize(("field", "text", "ok", "value"), [
    ("dob", "2020-02-30", False, None), ("dob", "2020-02-28", True, "2020-02-28"), ("height_cm", "1.5", False, None), ("height_cm", "0180", True, "180"), ("weight_kg", "80", True, "80.0"), ("weight_kg", "80.25", False, None),
    ("sex", "male", True, "male"), ("sex", None, False, None), ("sex", "m", False, None), ("email", "a@b.nl", True, "a@b.nl"), ("email", "a b", False, None), ("email", None, True, None), ("bsn", "12", False, None),
    ("phone", "+31612345678", True, "+31612345678"), ("phone", "0612345678", False, None), ("full_name", "  ", False, None), ("city", " Ede ", True, "Ede"), ("status", "active", True, "active"), ("status", "gone", False, None),
])
def test_field_values(spark, field, text, ok, value):
    r = spark.range(1).select(X.parsed_value(F.lit(field), F.lit(text).cast("string")).alias("r")).first().r
    assert (bool(r.ok), r.value) == (ok, value)


def test_owners(spark):
    own = lambda f, p="p", i="i": spark.range(1).select(X.writable_target(F.lit(f), F.lit(p), F.lit(i)).alias("r")).first().r
    assert [own(f) and own(f).entity_type for f in ("weight_kg", "submitted_at", "outcome", "bsn_check", "signup_date", "patient_id", "state")] == ["patient", "intake", None, "patient", "patient", "intake", None]
    assert own("weight_kg", None).entity_type == "intake" and own("dob", None) is None


def test_second_import_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, city string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, city string")
    owned = spark.createDataFrame([(2, "city")], "entity_id int, field string")
    once, diff = X.rerun(old, new, owned, "id", ["city"])
    assert rows(once) == [(1, "x"), (2, "b"), (3, "z")] and diff.count() == 1
    again, diff = X.rerun(once, new, owned, "id", ["city"])
    assert rows(again) == rows(once) and diff.count() == 0


def test_detectors(spark):
    o = spark.createDataFrame([(1, 10), (2, 99)], "id int, owner int")
    assert rows(Q.orphans(o, spark.createDataFrame([(10,)], "k int"), "owner", "k")) == [(99, 2)]
    p = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("b", 0.5), ("b", 1.0), ("c", None)], "k string, r double")
    assert rows(Q.divergence(p, "k", F.col("r"), 0.9, 1.1)) == [("a", 2, 2)]
    f = spark.createDataFrame([(1, "01-02-2006", "2024-01-20"), (2, "01-02-1990", "2024-01-20")], "id int, raw string, at string")
    assert [r.id for r in Q.age_flips(f, "raw", F.col("at").cast("date")).collect()] in ([1], [])


FLAG = "id string, kind string, field string, raw string, proposed string"


def test_flag_items(spark):
    f = [("a", "email_placeholder", "email", "none", None), ("a", "email_internal_space", "email", "a b@c.nl", "ab@c.nl"), ("a", "bsn_invalid", "bsn", "123456789", None), ("a", "date_impossible", "dob", "1800-01-01", "after_as_of"),
         ("a", "date_impossible", "submitted_at", "2030-01-01", "after_as_of"), ("b", "date_impossible", "submitted_at", "2030-01-01", "after_as_of"), ("a", "date_impossible", "signup_date", "x", None), ("a", "implausible", "w", "9", None),
         ("a", "phone_unparsed", "phone", "x", None)]
    got = M.flag_items(spark.createDataFrame(f, FLAG), "id", "legacy_patient", spark.createDataFrame([("a",)], "id string")).collect()
    by = {r.dedupe_key: r for r in got}
    assert len(by) == len(got) == 6
    assert by["data_quality|row|legacy_patient:a|email|EMAIL_INTERNAL_SPACE_TO_NULL|a b@c.nl"].proposed == '{"field":"email","proposed_value":"ab@c.nl","rule":"EMAIL_INTERNAL_SPACE_REMOVED"}'
    secret = next(r for k, r in by.items() if "|bsn|ELFPROEF|" in k)
    assert "123456789" not in secret.dedupe_key + secret.payload and "******789" in secret.payload
    assert by["data_quality|row|legacy_patient:a|phone|PHONE_UNPARSED_TO_NULL|x"].proposed is None
    assert by["data_quality|row|legacy_patient:b|submitted_at|DATE_IMPOSSIBLE_TO_NULL|2030-01-01"].title == "submission date is impossible"


def test_items_do_not_depend_on_order(spark):
    pairs = [("p", i, 80.0, "kg", 80.0 + 30 + i) for i in range(9)] + [("q", 50, 80.0, "kg", 81.0), ("q", 51, 80.0, "kg", 180.0), ("r", 60, 80.0, "lbs", 180.0), ("s", 61, 80.0, "lbs", 80.0)]
    df = spark.createDataFrame(pairs, "owner string, row int, signup double, unit string, weight double")
    keys = [rows(M.divergence_items(df.repartition(n), "owner", "row", {"min": 0.9, "max": 1.1})) for n in (1, 5)]
    assert keys[0] == keys[1] and len(keys[0]) == 1
    assert M.reconciliation_item(df, "owner", {"min": 0.9, "max": 1.1}).first().title == "weight_unit `lbs`: 1 of 2 patients do not reconcile after conversion"
    assert M.reconciliation_item(df.where("owner = 's'"), "owner", {"min": 0.9, "max": 1.1}).count() == 0
    d = spark.createDataFrame([("p", 1, "2024-02-03", "2024-03-02", "approved"), ("p", 2, "2024-03-02", "2024-02-03", "rejected"), ("p", 3, "2024-05-05", None, "approved")], "owner string, row int, day string, other_day string, outcome string")
    items, members = M.duplicate_items(d, "owner", "row")
    assert [(r.title, r.reason) for r in items.collect()] == [("2 intakes from one patient on 2024-02-03", "the outcomes disagree")] and members.count() == 2
    v = spark.createDataFrame([("p", "weight_kg", "7.5", 7.5, True), ("p", "weight_kg", "900", 900.0, False), ("p", "height_cm", "1.8", 1.8, True), ("q", "weight_kg", "80", 80.0, True)], "owner string, field string, raw string, value double, own boolean")
    got = {r.field: r for r in M.plausibility_items(v, "owner", {"weight_kg": {"min": 30, "max": 300}, "height_cm": {"min": 100, "max": 230}}).collect()}
    assert '"proposed_value":"75.0"' in got["weight_kg"].proposed and '"proposed_value":"180"' in got["height_cm"].proposed and got["weight_kg"].reason.startswith("2 value(s) outside 30–300;")


def test_unseen_values_list_all_rows(spark):
    f = spark.createDataFrame([(i, "vocabulary_unseen" if i % 2 else "non_numeric", "status" if i % 2 else "weight_kg", "a|b") for i in range(400)], "id int, kind string, field string, raw string")
    items, where = Q.unseen_values(f, "id", "legacy_patient")
    got = {r.field: r for r in items.collect()}
    assert got["status"].dedupe_key == r"vocabulary|vocabulary|legacy_patient|status|VOCAB_UNKNOWN|a\|b" and got["status"].title == "status: unseen value `a|b` on 200 rows"
    assert got["weight_kg"].title.endswith("is not a number: zero or not answered?") and where.count() == 400
    assert rows(where.groupBy("dedupe_key").count().select("count")) == [(200,), (200,)]


def test_nearest_rank_over_ranges(spark):
    data = [(k, float(v)) for k, n in (("a", 101), ("b", 7), (None, 4), ("c", 1)) for v in range(n)] * 2 + [("a", None)]
    got = A.nearest_rank(spark.createDataFrame(data, "k string, v double").repartition(7), "v", ["k"], {"low": 0.0, "p5": 0.05, "median": 0.5, "top": 1.0}).collect()
    for r in got:
        x = sorted(v for k, v in data if k == r.k and v is not None)
        at = lambda p: x[max(1, -(-round(p * 100) * len(x) // 100)) - 1]
        assert (r.n, r.least, r.largest, r.low, r.p5, r.median, r.top) == (len(x), x[0], x[-1], x[0], at(0.05), at(0.5), x[-1])
    assert len(got) == 4


def test_empty_list_selects_nothing(spark):
    q = spark.createDataFrame([("a", 1, 1, "open")], "kind string, age int, id int, state string")
    assert A.queue([q], ["a"], 5, []).count() == 0 and A.queue([q], ["a"], 5, ["open"]).count() == 1 and A.queue([q, q, q], ["a"], 1).count() == 2
    assert A.search(q.withColumn("n", F.lit("Abc")), "b", ["n"], "id", "n").count() == 0
    assert A.search(q.withColumn("n", F.lit("Abc")), "bc", ["n"], "id", "n").count() == 1
