"""Filters from query strings, against a plain reading of them, and the work list's joins."""

import random
from urllib.parse import parse_qsl, quote_plus

from pyspark.sql import functions as F

from ledgermill.operators import worklist as W


def read(q):
    pairs = parse_qsl((q or "").removeprefix("?"), keep_blank_values=True)
    known = lambda key, words: list(dict.fromkeys(v for k, v in pairs if k == key and v in words))
    chosen = any(k in ("type", "state") for k, _ in pairs)
    types, states = (known("type", W.TYPES), known("state", W.STATES)) if chosen else (list(W.TYPES), list(W.DEFAULT_STATES))
    return chosen, types, states, (known("status", W.STATUSES) or ["open"])[0], (known("age", W.AGES) or [None])[0]


def strings():
    rng = random.Random(1)
    words = [*W.TYPES[:3], *W.STATES[:3], *W.STATUSES, *W.AGES, "", "drop table", "a=b", "é&x"]
    made = ["?" * rng.randint(0, 1) + "&".join(f"{rng.choice(['type', 'state', 'status', 'age', 'other', 'TYPE'])}={quote_plus(rng.choice(words))}" for _ in range(rng.randint(0, 5))) for _ in range(300)]
    return [*made, None, "?", "type", "&&", "?type", "age=week=x"]


def test_filters_of_any_string(spark):
    asked = strings()
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = {r.i: tuple(r.f) for r in df.select("i", W.filters_of(F.col("q")).alias("f")).collect()}
    assert [got[i] for i in range(len(asked))] == [read(q) for q in asked]
    bad = spark.createDataFrame([("type=%zz&state=draft",)], "q string").select(W.filters_of(F.col("q")).alias("f")).first().f
    assert tuple(bad) == (True, [], ["draft"], "open", None)


def test_toggling_twice_goes_back(spark):
    once = lambda q, key, word: spark.createDataFrame([(q,)], "q string").select(W.toggled(W.filters_of(F.col("q")), key, F.lit(word)).alias("t")).first().t
    assert once("", "type", "consent") == "?type=consent" and once("?type=consent", "type", "consent") == ""
    assert once("?type=consent&age=week&status=resolved", "state", "draft") == "?state=draft&type=consent&status=resolved&age=week"
    assert once("?state=draft&type=consent", "type", "consent") == "?state=draft"


def test_counts_and_joins(spark):
    items = spark.createDataFrame([(1, "consent", "t", "open", 5, "2024-01-19"), (2, "consent", "t", "resolved", 6, "2024-01-02"), (3, "vocabulary", "t", "open", None, None)], "id int, type string, title string, status string, patient int, at string")
    intakes = spark.createDataFrame([(4, "draft", "t", 9, "2024-01-19"), (5, "in_review", "t", 6, "2024-01-02")], "id int, state string, title string, patient int, at string")
    rows = W.work(items, intakes, spark.createDataFrame([(5, 7), (6, 6), (7, 7)], "id int, survivor int"), spark.createDataFrame([(7, "Seven")], "patient_id int, full_name string"))
    assert {(r.kind, r.id): (r.patient_id, r.patient_name) for r in rows.collect()} == {
        ("review_item", "1"): (7, "Seven"), ("review_item", "2"): (None, None), ("review_item", "3"): (None, None), ("intake", "4"): (None, None), ("intake", "5"): (None, None)}
    asked = ["", "type=consent&type=vocabulary", "type=consent&status=resolved", "age=today", "type=", "state=draft&state=in_review&age=older"]
    f = spark.createDataFrame(list(enumerate(asked)), "k int, q string").select("k", W.filters_of(F.col("q")).alias("filters"))
    band = F.when(F.col("at") == "2024-01-19", "today").when(F.col("at").isNotNull(), "older")
    assert dict(map(tuple, W.filtered_counts(rows, f, "k", band).collect())) == {0: 3, 1: 2, 2: 1, 3: 1, 4: 0, 5: 1}
    assert W.filtered_counts(rows.limit(0), f, "k", band).where("n > 0").isEmpty()
