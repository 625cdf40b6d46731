"""State that is kept: the stream's stored sink, partial recomputation, the merge journal against a plain replay."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import derived as D
from ledgermill.operators import events as E
from ledgermill.operators import merges as M
from ledgermill.sources import stored
from ledgermill.streaming.states import EndsStore, keep

LOG = "subject int, type string, action string, at timestamp, id int"


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def events(spark, n, seed):
    rng = random.Random(seed)
    made = [(rng.randint(1, 9), rng.choice("ab"), rng.choice(["granted", "revoked"]), f"2024-01-{rng.randint(1, 28):02} 0{rng.randint(0, 2)}:00:00", i) for i in range(n)]
    return spark.createDataFrame(made, "subject int, type string, action string, at string, id int").withColumn("at", F.col("at").cast("timestamp"))


# -- stream --


@pytest.mark.parametrize("most", [2, 99])
def test_store_survives_stops_and_repeats(spark, tmp_path, most):
    e = events(spark, 200, 1)
    e.repartition(6).write.parquet(str(tmp_path / "in"))
    want = rows(E.ends(e, ["subject", "type"]))
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = EndsStore(spark, str(tmp_path / "store"), ["subject", "type"], most=most)
    assert store.read() is None and store.committed() == -1
    fails = {1: "before", 3: "after"}
    seen = []

    class Breaks(EndsStore):
        def write(self, batch, number):
            seen.append(number)
            how = fails.pop(number, None)
            if how == "before":
                raise RuntimeError("stopped before the write")
            super().write(batch, number)
            if how == "after":
                raise RuntimeError("stopped after the write, before the stream knows of it")

    breaking = Breaks(spark, str(tmp_path / "store"), ["subject", "type"], most=most)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            keep(stream(), breaking, str(tmp_path / "cp")).awaitTermination()
    keep(stream(), breaking, str(tmp_path / "cp")).awaitTermination()
    assert seen == [0, 1, 1, 2, 3, 3, 4, 5] and store.committed() == 5
    assert rows(store.read()) == want
    for n in (0, 5):  # a batch that counts already changes nothing
        if n <= store._base():
            store.write(e.limit(7), n)
    assert rows(store.read()) == want
    late = spark.createDataFrame([(1, "a", "revoked", "2020-01-01 00:00:00", -1)], "subject int, type string, action string, at string, id int").withColumn("at", F.col("at").cast("timestamp"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    keep(stream(), store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.read()) == rows(E.ends(e.unionByName(late), ["subject", "type"]))
    store.compact()
    assert rows(store.read()) == rows(E.ends(e.unionByName(late), ["subject", "type"])) and len(os.listdir(tmp_path / "store" / "batches")) == 0


def test_scratch_goes(spark):
    with stored.scratch(spark) as path:
        spark.range(3).write.parquet(f"{path}/x")
        assert stored.exists(spark, f"{path}/x")
    assert not stored.exists(spark, path)


# -- partial recomputation --


def test_refresh_equals_a_full_run_and_reads_less(spark, tmp_path):
    e = events(spark, 300, 2).where("subject <> 9")
    own = spark.createDataFrame([(i, None if i == 5 else f"20{18 + i}-01-01") for i in range(1, 10)], "subject int, signup string").withColumn("signup", F.col("signup").cast("date"))
    chain = lambda into: spark.createDataFrame([(i, into.get(i, i)) for i in range(1, 10)], "id int, survivor int")
    start = F.lit("2022-01-01").cast("date")
    kept = D.DerivedStates(spark, str(tmp_path / "kept"), ["a", "b"], start, buckets=16)
    full = lambda chains, log: rows(D.by_membership(chains, own, log, ["a", "b"], start).select("subject", "type", "state", "from_event"))
    now = lambda: rows(kept.states().select("subject", "type", "state", "from_event"))
    first = e.where("id < 280 or subject <> 3")
    before = chain({2: 1})
    kept.append(first)
    kept.derive_all(before, own)
    assert now() == full(before, first)
    kept.append(e.where("id >= 280 and subject = 3"))
    members = spark.createDataFrame([(3, 3)], "subject int, survivor int")
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(kept._only(kept.log(), members)) < files(kept.log())
    assert "PartitionFilters: [isnotnull(bucket" in kept.evidence(members)._jdf.queryExecution().toString()
    stamp = lambda: {os.path.join(d, p) for d, _, fs in os.walk(tmp_path / "kept" / "states") for p in fs if p.endswith(".parquet")}
    old = stamp()
    kept.refresh(before, before, own, spark.createDataFrame([(3,)], "subject int"))
    assert now() == full(before, e)
    assert len(old - stamp()) == 1 and len(old) > 5  # one partition was written anew
    after = chain({4: 3, 5: 3, 6: 7})  # 2 stands for itself again, 4 and 5 go to 3, 6 to 7
    changed = spark.createDataFrame([(i,) for i in (2, 4, 5, 6)], "subject int")
    for _ in range(2):
        kept.refresh(before, after, own, changed)
        assert now() == full(after, e)


# -- merges --

FIELDS = ["full_name", "email", "sex", "bsn", "city", "status", "weight_kg"]
ROW = "id long, merged_into long, full_name string, email string, sex string, bsn string, city string, status string, weight_kg decimal(5,1), bsn_check string, extra string"
ENTRY = "seq long, kind string, survivor long, loser long, reason string, decisions map<string, struct<source: string, value: string>>"


def mask(x):
    return None if x is None else "*" * (len(x) - 3) + x[-3:] if len(x) > 3 else "*" * len(x)


def check_of(x):
    return "absent" if x is None else "valid" if sum(int(c) * w for c, w in zip(x, (9, 8, 7, 6, 5, 4, 3, 2, -1), strict=True)) % 11 == 0 else "invalid"


def replay_by_hand(people, aliases, log):
    """One entry after another, as the log says."""
    p, a, audit, refused, record = {r["id"]: dict(r) for r in people}, dict(aliases), [], [], {}
    empty = lambda f, v: v is None or v == M.PERSON[f]
    shown = lambda f, v: mask(v) if f == "bsn" else v

    def parse(f, v):
        if v is None:
            return f not in ("full_name", "sex", "status"), None
        if f == "weight_kg":
            return (True, f"{float(v):.1f}") if v.replace(".", "", 1).isdigit() else (False, None)
        if f == "sex":
            return v in ("male", "female", "unknown"), v
        if f == "status":
            return v in ("active", "paused", "churned", "prospect", "unknown"), v
        if f == "bsn":
            return len(v) == 9 and v.isdigit(), v
        if f in ("full_name", "city"):
            return v.strip() != "", v.strip()
        return ("@" in v and "." in v), v

    for seq, kind, s, lo, reason, decisions in sorted(log, key=lambda x: x[0]):
        if kind == "unmerge":
            s = p[lo]["merged_into"] if lo in p else None
            why = "no such loser" if lo not in p else "not merged into anything" if s is None else "no record of the merge" if (s, lo) not in record else None
            if why:
                refused.append((seq, why))
                continue
            changes, moved = record[s, lo]
            p[lo]["merged_into"] = None
            audit.append((seq, str(lo), "merged", "independent", f"unmerged from patient {s}: {reason}", "merged_into", str(s), None, None, None))
            audit += [(seq, str(lo), "merged", "independent", f"unmerged from patient {s}: {reason}", "patient_id", str(s), str(lo), x, None) for x in moved]
            audit.append((seq, str(s), None, None, f"released patient {lo}: {reason}", "merged_from", str(lo), None, None, None))
            for f, was, now, src, ch in changes:
                p[s][f] = "absent" if f == "bsn_check" else M.PERSON[f] if ch is None or f == "bsn" else was
                audit.append((seq, str(s), None, None, f"released patient {lo}: {reason}", f, now, was, src, ch))
            for x in moved:
                a[x] = lo
            continue
        why = None
        if s == lo:
            why = "merges into itself"
        elif s not in p:
            why = "no such survivor"
        elif lo not in p:
            why = "no such loser"
        elif p[lo]["merged_into"] is not None:
            why = "merged so already" if p[lo]["merged_into"] == s else "merged into another"
        elif p[s]["merged_into"] is not None:
            why = "survivor is merged away"
        elif set(decisions or {}) - set(FIELDS):
            why = "not a field of the person"
        if not why:
            value = {f: parse(f, v if src == "edited" else p[lo if src == "loser" else s][f]) for f, (src, v) in (decisions or {}).items()}
            why = None if all(ok for ok, _ in value.values()) else "not a value of the field"
        if why:
            refused.append((seq, why))
            continue
        moved = sorted(x for x, o in a.items() if o == lo)
        source, changes = (moved[0] if moved else None), []
        for f in FIELDS:
            cur, other = p[s][f], p[lo][f]
            if f in (decisions or {}):
                new, src = value[f][1], decisions[f][0]
                if new != cur:
                    changes.append((f, shown(f, cur), shown(f, new), source if src == "loser" else None, src))
                    if f == "bsn":
                        changes.append(("bsn_check", p[s]["bsn_check"], check_of(new), source if src == "loser" else None, src))
                        p[s]["bsn_check"] = check_of(new)
                    p[s][f] = new
            elif empty(f, cur) and not empty(f, other):
                changes.append((f, shown(f, cur), shown(f, other), source, None))
                if f == "bsn":
                    changes.append(("bsn_check", p[s]["bsn_check"], p[lo]["bsn_check"], source, None))
                    p[s]["bsn_check"] = p[lo]["bsn_check"]
                p[s][f] = other
        p[lo]["merged_into"] = s
        record[s, lo] = (changes, moved)
        for x in moved:
            a[x] = s
        audit.append((seq, str(lo), "independent", "merged", f"merged into patient {s}: {reason}", "merged_into", None, str(s), None, None))
        audit += [(seq, str(lo), "independent", "merged", f"merged into patient {s}: {reason}", "patient_id", str(lo), str(s), x, None) for x in moved]
        audit.append((seq, str(s), None, None, f"absorbed patient {lo}: {reason}", "merged_from", None, str(lo), None, None))
        audit += [(seq, str(s), None, None, f"absorbed patient {lo}: {reason}", *c) for c in changes]
    return p, a, audit, refused


def person(rng, i):
    number = rng.choice([None, None, "111222333", "123456782", "123456789"])
    return {
        "id": i, "merged_into": None, "full_name": rng.choice(["", f"Name {i}"]), "email": rng.choice([None, f"p{i}@x.nl"]), "sex": rng.choice(["unknown", "female", "male"]), "bsn": number,
        "city": rng.choice([None, "Delft", f"Town {i}"]), "status": rng.choice(["unknown", "active"]), "weight_kg": rng.choice([None, "80.0", f"{50 + i}.5"]), "bsn_check": check_of(number), "extra": f"x{i}"}


def entry(rng, seq, lo, n):
    """An entry about the records lo + 1 to lo + n, now and then one that isn't there."""
    if rng.random() < 0.3:
        return (seq, "unmerge", None, lo + rng.randint(1, n), f"r{seq}", None)
    picks = {}
    if rng.random() < 0.3:
        for f in rng.sample(FIELDS, 2):
            edited = {"weight_kg": "080", "sex": "female", "status": "paused", "bsn": rng.choice(["111222333", "12"]), "email": "new@x.nl"}.get(f, rng.choice([" Typed ", " "]))
            picks[f] = rng.choice([("survivor", None), ("loser", None), ("edited", edited)])
    if rng.random() < 0.03:
        picks["shoe_size"] = ("edited", "44")
    return (seq, "merge", lo + rng.randint(1, n), 999 if rng.random() < 0.05 else lo + rng.randint(1, n), f"r{seq}", picks or None)


def as_rows(people):
    from decimal import Decimal

    names = [c.split()[0] for c in ROW.split(", ")]
    return [tuple(Decimal(p[c]) if c == "weight_kg" and p[c] is not None else p[c] for c in names) for p in people]


@pytest.mark.parametrize("seed", range(2))
def test_replay_by_hand(spark, seed):
    rng = random.Random(seed)
    n = 40
    people = [person(rng, i) for i in range(1, n + 1)]
    people[0]["merged_into"] = 2  # stored as merged, without a record
    aliases = [(f"L{i:03}", rng.randint(1, n)) for i in range(60)]
    log = [entry(rng, 10 * k, k % 6 * 5, 4) for k in range(42)] + [(1000 + k, "merge", 30, k, "crowd", None) for k in range(31, 41)]  # seven entries a group of four
    rng.shuffle(log)
    got = M.replay(spark.createDataFrame(as_rows(people), ROW), spark.createDataFrame(aliases, "legacy_id string, patient_id long"), spark.createDataFrame(log, ENTRY))
    p, a, audit, refused = replay_by_hand(people, aliases, log)
    assert rows(got["refused"]) == sorted(map(repr, refused))
    assert rows(got["rows"]) == sorted(map(repr, as_rows(p.values())))
    assert rows(got["aliases"]) == sorted(map(repr, a.items()))
    assert rows(got["audit"]) == sorted(map(repr, audit))
    assert len(audit) > 40 and len({w for _, w in refused}) > 2


def test_merge_chain_undo_gives_the_rows_back(spark):
    rng = random.Random(9)
    people = [person(rng, i) for i in range(1, 7)]
    aliases = [(f"L{i}", i) for i in range(1, 7)]
    log = [(1, "merge", 2, 1, "a", None), (2, "merge", 3, 2, "b", None), (3, "merge", 4, 3, "c", None), (4, "unmerge", None, 3, "d", None), (5, "unmerge", None, 2, "e", None), (6, "unmerge", None, 1, "f", None)]
    df, al = spark.createDataFrame(as_rows(people), ROW), spark.createDataFrame(aliases, "legacy_id string, patient_id long")
    got = M.replay(df, al, spark.createDataFrame(log, ENTRY))
    assert rows(got["aliases"]) == rows(al) and got["refused"].isEmpty()
    cleared = replay_by_hand(people, aliases, log)[0]
    assert rows(got["rows"]) == sorted(map(repr, as_rows(cleared.values())))
    assert all(cleared[q["id"]][f] == q[f] for q in people for f in FIELDS)  # nothing was decided, so all is as it was
    nothing = M.replay(df, al, spark.createDataFrame([], ENTRY))
    assert rows(nothing["rows"]) == rows(df) and nothing["audit"].isEmpty()


def test_a_crowd_into_one_survivor_is_one_wave(spark, monkeypatch):
    waves = []
    ready = M._ready
    monkeypatch.setattr(M, "_ready", lambda pending: waves.append(pending.count()) or ready(pending))
    rng = random.Random(4)
    people = [person(rng, i) for i in range(1, 61)]
    log = [(k, "merge", 1, k, "crowd", None) for k in range(2, 61)]
    got = M.replay(spark.createDataFrame(as_rows(people), ROW), spark.createDataFrame([], "legacy_id string, patient_id long"), spark.createDataFrame(log, ENTRY))
    assert waves == [59]
    assert rows(got["rows"]) == sorted(map(repr, as_rows(replay_by_hand(people, [], log)[0].values())))


def test_identity_requests(spark):
    kind = "seq long, item string, action string, survivor long, loser long, note string, decisions map<string, struct<source: string, value: string>>"
    asked = [
        (1, "i1", "merge", 1, 2, "same", None), (2, "i2", "merge", 1, 3, "not compared", None), (3, "i3", "merge", 5, 5, "self", None), (4, "i4", "merge", 6, 7, "gone", None),
        (5, "i5", "not_the_same_person", None, None, "two people", None), (6, "i6", "split", 1, 2, "x", None), (7, "i7", "merge", 1, 2, "  ", None), (8, "i8", "merge", 8, 9, "field", {"shoe_size": ("edited", "4")})]
    held = [("i1", 1), ("i1", 2), ("i2", 1), ("i2", 2), ("i3", 5), ("i4", 6), ("i4", 7), ("i5", 1), ("i8", 8), ("i8", 9), ("i7", 1), ("i7", 2)]
    people = spark.createDataFrame([(7, 6)] + [(i, None) for i in (1, 2, 3, 5, 6, 8, 9)], "id long, merged_into long")
    entries, said = M.identity_entries(spark.createDataFrame(asked, kind), spark.createDataFrame(held, "item string, patient_id long"), people)
    assert rows(entries) == [repr((1, "merge", 1, 2, "same", None))]
    assert {r.item: (r.outcome, r.problem) for r in said.collect()} == {
        "i1": ("resolved", None), "i2": (None, "not records of the item"), "i3": (None, "merges into itself"), "i4": (None, "merged away already"), "i5": ("dismissed", None),
        "i6": (None, "no such action"), "i7": (None, "note missing"), "i8": (None, "not a field of the person")}
