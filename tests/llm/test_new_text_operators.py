"""Source divergence, fill-in-middle and line dedup against plain Python, with odd rows, and against their SQL."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgermill.llm import divergence, fill_in_middle, line_dedup, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, value long, rank int, gone string, lines string, batch int"
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(*r, None, 7, "x", None, 1, "y", None, 3) for r in rows], DOCS)


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_fill_in_middle", "op13_line_dedup"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))


# -- source divergence --


def audit_by_hand(rows, least):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(lang or "", source or "", word.findall(ascii_lower(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t in held if held[t] >= least), key=lambda t: t.encode())
        count = collections.defaultdict(collections.Counter)
        for _, source, terms in mine:
            count[source].update(t for t in terms if held[t] >= least)
            count[None].update(t for t in terms if held[t] >= least)
        share = lambda s: {t: 1 + 10**9 * (count[s][t] + 5) // (sum(count[s].values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(s) for s in {d[1] for d in mine}}
        q = share(None)
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_audit_by_hand_with_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    terms = [f"{a}{b}" for a in ("é", "z", "ab", "Ω", "\U0001f600", "￮", "K") for b in "abcdefghijklmn"]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "en", "de", None])
        weights = [1 + (hash_of(t, i % 5) % 5) for t in terms]
        text = "".join(w + rng.choice([" ", "1", "\x00", ". ", "\n"]) for w in rng.choices(terms, weights, k=rng.randint(0, 30)))
        rows.append((i, text, lang, rng.choice(["a", "b", None, "\U0001f600", "￮"])))
    rows += [(1, None, "en", "only nulls"), (None, None, None, None), (2, "", "xx", "s"), (3, "rare words here", "xx", "t"), (3, "rare words here", "xx", "t"), (5, "Za " * 30_000, "en", "long"), (6, "b" * 50_000, "en", "long")]
    df = frame(spark, rows)
    want = audit_by_hand(rows, 4)
    assert sum(r[2] == "term" for r in want) > 60
    assert sorted(tuple(r) for r in divergence.audit(df, least=4).collect()) == want
    monkeypatch.setattr(divergence, "CELLS_PER_CHUNK", 1)  # 64 terms a chunk: three chunks, ties across them
    assert sorted(tuple(r) for r in divergence.audit(df, least=4).collect()) == want
    assert divergence.audit(df.limit(0)).collect() == []


def hash_of(term, source):
    return int(hashlib.md5(f"{term}{source}".encode()).hexdigest()[:6], 16)


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**15, 8 * 10**15], dtype=np.int64)
    for total in (5, 13, 8 * 10**15 + 5, 8_999_999_999_999_999):
        got = divergence.shares(np.minimum(counts, total - 5), total)
        assert got.tolist() == [1 + 10**9 * (min(int(c), total - 5) + 5) // total for c in counts]
    with pytest.raises(ValueError, match="exactly"):
        divergence.shares(counts, 9 * 10**15)


# -- fill in middle --


def fim_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    rng = random.Random(5)
    bits = ["a", "é", "\U0001f600", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", " ", " ", "<", ">", "P", "<P", "S>", "M", "word", "\x85"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(600)]
    return [*texts, "", None, " ", "x", "<P>", "a <S> b", "<M", ">", "<", "<P", "P>", "<<P", "\n\n", "word " * 60_000, "é" * 100_000, " " * 70_000 + "x"]


@pytest.mark.parametrize("slice_bytes", [16 << 20, 1, 64])
def test_fim_by_hand_and_back(spark, monkeypatch, slice_bytes):
    rows = [(i % 590 if i else None, t, None, None) for i, t in enumerate(odd_texts())]
    df = frame(spark, rows + rows[:5])
    monkeypatch.setattr(fill_in_middle, "BYTES_PER_SLICE", slice_bytes)
    monkeypatch.setattr(fill_in_middle._slices, "__defaults__", (slice_bytes,))
    got = fill_in_middle.restore(fill_in_middle.transform(df)).collect()
    want = sorted(repr((i, *fim_by_hand(i, t), t or "")) for i, t, *_ in rows + rows[:5])
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.restore(fill_in_middle.transform(df.limit(0))).collect() == []


def test_fim_kernel_on_a_sliced_batch():
    texts = [t or "" for t in odd_texts()[:300]]
    ids = list(range(len(texts)))
    h = [np.array([int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i in ids]) for k in range(4)]
    part = pa.array(texts).slice(100, 150)
    got = fill_in_middle._transform(part, [x[100:250] for x in h])
    want = [fim_by_hand(i, t) for i, t in zip(ids, texts, strict=True)][100:250]
    assert list(zip(*(got[k].to_pylist() for k in ("n", "form", "prefix_chars", "middle_chars", "output")), strict=True)) == want
    assert fill_in_middle._restore(got["output"], got["form"]).to_pylist() == texts[100:250]


# -- line dedup --


def lines_by_hand(rows):
    key = lambda line: ascii_lower(line.strip(BLANK))
    held = collections.defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    top = {k: max(v, key=lambda i: (i is not None, i)) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


def line_rows():
    rng = random.Random(7)
    base = [f"a line of some length, number {i:03d} of the pool é" for i in range(40)] + ["x" * 39, "x" * 40, "É" * 40, "é" * 40, "short"]
    vary = lambda s: rng.choice(["", " ", "\t", "\r"]) + (s.upper() if s.isascii() and rng.random() < 0.3 else s) + rng.choice(["", "\x0b", "  "])
    rows = [(i, "\n".join(vary(x) for x in rng.choices(base, [1 / (1 + k) for k in range(len(base))], k=rng.randint(0, 12))), None, None) for i in range(150)]
    many = "every one of these documents holds this very line"
    rows += [(1000 + i, f"{many}\nown line {i}\n{many}", None, None) for i in range(60)]
    rows += [(2000, f"{many}\n" * 3000 + "end", None, None), (2000, f"other text\n{many}", None, None), (7, rows[7][1], None, None), (-5, many, None, None)]
    rows += [(None, many, None, None), (None, None, None, None), (3000, None, None, None), (3001, "", None, None), (3002, "\n\n", None, None), (3003, "y" * 300_000, None, None)]
    return rows + [(None, "only rows without an id hold this long line of text", None, None)] * 6


@pytest.mark.parametrize(("batches", "heavy"), [(8, 50_000), (1, 2), (6, 10)])
def test_lines_by_hand(spark, monkeypatch, batches, heavy):
    rows = line_rows()
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", heavy)
    df = frame(spark, rows)
    got = line_dedup.dedup_lines(df, batches).collect()
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got) == lines_by_hand(rows)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_runs_take_batches_in_any_order(spark):
    from pyspark.sql import functions as F

    rows = line_rows()
    lines = line_dedup.hashed_lines(frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    whole = lines.groupBy("h", "g", "doc_id").count().groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).where("n >= 5")
    want = sorted(map(repr, ((r.h, r.g, r.top) for r in whole.collect())))
    runs = line_dedup.LineRuns(spark, "runs_of_a_test", fan=2, buckets=3)
    try:
        for i in (3, 0, 4, 1, 2):
            runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == i))
            assert all(len(level) < 2 for level in runs.levels)
        assert len(runs.levels) == 3
        assert sorted(map(repr, ((r.h, r.g, r.top) for r in runs.common().collect()))) == want
    finally:
        runs.drop()
