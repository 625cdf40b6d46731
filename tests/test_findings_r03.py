"""What the third round's findings came to, on small tables."""

import pytest

from ledgermill.plans import registry


def _same_as_sql(spark, folder, name, **tables):
    """The query over these tables gives the rows of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(folder))
    rel = con.execute(registry.ORACLE[name])
    names = [d[0] for d in rel.description]
    text = lambda rows: sorted(tuple("~" if x is None else str(x) if isinstance(x, (str, bool)) else f"{float(x):.6f}" for x in r) for r in rows)
    mine = text([tuple(r[n] for n in names) for r in got.collect()])
    assert mine == text(rel.fetchall())
    return mine


def test_six_groupings_of_odd_texts(spark, tmp_path):
    """a name is trimmed of spaces alone; rows without a text, and rows that share an id, count too."""
    rows = [(1, "Name one a.\nrest of it", "en", "s", 10), (2, "Name one a. and more", "en", "s", 11), (3, " Tab\tx\xa0 y", "en", "s", 12), (4, "tab x y", None, "s", 12), (5, None, None, None, 12), (6, None, "en", None, 12),
            (7, "again", "fr", None, None), (7, "again", "fr", None, None), (7, "once more", "fr", "t", 1), (8, "NAME ONE A. Z", None, "t", 3), (9, "", "", "", 0), (10, "again", "fr", "t", 5)]
    _same_as_sql(spark, tmp_path, "k11_six_groupings", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))


def test_a_common_value_stays_spread(spark, monkeypatch):
    """requests that all name one patient, or the same word, aren't brought to one task; the values that are there are found."""
    from pyspark.sql import functions as F

    from ledgermill.operators import decisions, identity

    monkeypatch.setattr(identity, "ROWS_PER_TASK", 10, raising=False)
    monkeypatch.setattr(identity, "HEAVY", 50, raising=False)
    n = F.col("id")
    none = lambda name: F.lit(None).cast("string").alias(name)
    items = spark.range(200).select(n.alias("item"), F.lit("orphan_intake").alias("type"), F.lit("open").alias("status"), none("field"), none("rule"), none("proposed"), none("patient_id"), n.cast("string").alias("intake_id"), none("derived"))
    who = F.when(n % 4 == 3, F.concat(F.lit("q"), n.cast("string"))).when(n % 4 == 2, "nobody").otherwise("p")
    requests = spark.range(200).select(n.alias("item"), F.lit("attach").alias("action"), F.lit("seen").alias("note"), who.alias("value"), F.lit(None).cast("array<string>").alias("excluded"))
    rows = spark.createDataFrame([], "item long, row string, value string, owner_id string")
    patients = spark.createDataFrame([("p",), ("p",), ("q3",), ("q7",)], "patient_id string")
    said, changes, _ = decisions.decide(items, requests, rows, patients)
    assert {r.item for r in said.where("problem is null").collect()} == {i for i in range(200) if i % 4 < 2} | {3, 7}
    assert changes.count() == 102
    assert max(said.rdd.glom().map(len).collect()) < 60


def test_examples_are_written_out_whole(spark):
    """each reply's example holds every turn before it; what a conversation says is read from those texts alone."""
    from ledgermill.llm import chat

    rows = [(1, i, "assistant" if i % 2 else "user", f"said {i} </s>") for i in range(7)] + [(2, 0, "user", "alone")]
    e = chat.format_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.example): r for r in e.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    turns = [(r[2], r[3]) for r in rows]
    for n, upto in enumerate((2, 4, 6, 7)):
        assert chat.read_turns(got[1, n].text) == turns[:upto]
        target = got[1, n].text[got[1, n].loss_start : got[1, n].loss_end]
        assert chat.unescape(target) == turns[upto - 1][1] if upto < 7 else got[1, n].loss_start == -1
    assert sum(len(r.text) for k, r in got.items() if k[0] == 1) == chat.digests(e).where("conv_id = 1").first().formatted_chars


ODD_TEXTS = [None, "", " ", "a \x85", "\x85a", "a ", "﻿a;b", "plain words", "café, naïve", "é", "각 中", "x1?!?1\n", "semaglutide, 1,5 mg ; Pancreatitis;;  pcos", "\U0001f600 '-.", "thyroid cancer\t;ozempic"]


def test_unusual_text_of_odd_texts(spark, tmp_path):
    """flags of texts are worked out once each, and equal the SQL's."""
    _same_as_sql(spark, tmp_path, "b24_unusual_text", documents=spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string"))


def test_rules_read_long_blanks(spark, tmp_path):
    """trimming a segment doesn't try every place of a run of blanks inside it."""
    import time

    blanks = "ozempic" + " " * 60_000 + "daily; none"
    rows = spark.createDataFrame(list(enumerate([*ODD_TEXTS, blanks])), "doc_id long, text string")
    began = time.monotonic()
    _same_as_sql(spark, tmp_path, "j6_outcome_counts", documents=rows)
    assert time.monotonic() - began < 15


def test_terms_are_counted_block_by_block(monkeypatch):
    """op11: a slice is split in blocks, so the words of one block are held at a time; counts are those of the whole slice."""
    import re
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from ledgermill.llm import divergence

    texts = [f"Ab c{i % 7} é ab, {'x' * (i % 5)}" for i in range(300)] + ["", "...", "ab"]
    groups = np.arange(len(texts), dtype=np.int64) % 3
    longest = []
    split = pc.split_pattern_regex
    monkeypatch.setattr(divergence, "BYTES_PER_BLOCK", 200, raising=False)
    monkeypatch.setattr(divergence.pc, "split_pattern_regex", lambda t, **k: longest.append(pc.sum(pc.binary_length(t)).as_py()) or split(t, **k))
    g, term, n, d = divergence.count_batch(pa.array(texts, pa.large_string()), groups)
    words = [[w for w in re.split(divergence.BETWEEN_TERMS, t.lower()) if w] for t in texts]
    want_n, want_d = (Counter((int(k), w) for k, ws in zip(groups, words, strict=True) for w in pick(ws)) for pick in (list, set))
    keys = list(zip(g.tolist(), term.to_pylist(), strict=True))
    assert dict(zip(keys, n.tolist(), strict=True)) == want_n and dict(zip(keys, d.tolist(), strict=True)) == want_d
    assert max(longest) <= 200


def test_waves_of_small_components_are_numbered_at_once(spark, tmp_path, monkeypatch):
    """components of a few entries are numbered in one pass; the waves are those that large ones get step by step."""
    import random

    from pyspark.sql import functions as F

    from ledgermill.operators import merges as M

    rng = random.Random(7)
    log = []
    for seq in range(60):
        comp = seq % 12 * 10
        s, lo = (comp + rng.randint(1, 4) for _ in "ab")
        undo = rng.random() < 0.2
        log.append((seq, "unmerge" if undo else "merge", None if undo else s, lo, not undo and (s == lo or rng.random() < 0.3), comp))
    entries = spark.createDataFrame(log, "seq long, kind string, survivor long, loser long, alone boolean, comp long")
    few = {r.seq: r.wave for r in M._few_waves(entries, len(log)).collect()}
    ready, asked = M._ready, []
    monkeypatch.setattr(M, "_ready", lambda pending: asked.append(1) or ready(pending))
    many = {r.seq: r.wave for r in M._waves(M._State(f"{tmp_path}/a", f"{tmp_path}/b"), entries).collect()}
    assert few == many and set(few) == set(range(60)) and max(few.values()) >= 3
    assert len(asked) == max(few.values()) + 1

    # a replay of small components looks for nothing step by step
    asked.clear()
    people = spark.range(1, 4).select("id", F.lit(None).cast("long").alias("merged_into"), F.when(F.col("id") == 1, "Delft").alias("city"))
    aliases = spark.range(1, 4).select(F.col("id").cast("string").alias("legacy_id"), F.col("id").alias("patient_id"))
    two = [(1, "merge", 2, 1, "a", None), (2, "merge", 3, 2, "b", None)]
    got = M.replay(people, aliases, spark.createDataFrame(two, "seq long, kind string, survivor long, loser long, reason string, decisions map<string, struct<source: string, value: string>>"))
    assert asked == []
    assert sorted(map(tuple, got["rows"].collect())) == [(1, 2, "Delft"), (2, 3, "Delft"), (3, None, "Delft")]
    assert {r.patient_id for r in got["aliases"].collect()} == {3} and got["audit"].count() == 9 and got["refused"].isEmpty()
