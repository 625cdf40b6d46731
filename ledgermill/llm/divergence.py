"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the whole.

Texts are coded batch by batch: the batch's distinct terms are its dictionary, occurrences and documents are
counted by `bincount` over (group, id), and only these counts leave the task; Spark adds them up. A language's kept
terms are then dealt into chunks. In a chunk the kept terms form one sorted array, a term's id is its place in
it (`searchsorted`), and each source is a dense vector of counts. Order by id is order by UTF-8 bytes, so ties are cut
right inside a chunk; chunks add up, since every kept term is in one. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, lean

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 30
TOP_TERMS = 50
PRIOR = 5
SCALE_STEPS = 3  # a share is in steps of 1000 ** -3
BYTES_PER_SLICE = 32 << 20
BYTES_PER_BLOCK = 4 << 20
TERMS_PER_CHUNK = 4096
CELLS_PER_CHUNK = 1 << 25


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total) by long division, three digits a step; exact while total < 9 * 10^15."""
    if np.max(total, initial=0) >= 9_000_000_000_000_000:
        raise ValueError("a group with 9 * 10^15 terms can't be divided exactly")
    rest = np.asarray(counts, dtype=np.int64) + PRIOR
    out = np.zeros_like(rest)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _tally(keys: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often each): dense counts while the space is not much larger than the keys."""
    if space <= 4 * len(keys) + 65_536:
        counts = np.bincount(keys, minlength=space)
        some = np.flatnonzero(counts)
        return some, counts[some]
    return np.unique(keys, return_counts=True)


def count_batch(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of all terms of a batch; groups has a small number for each text."""
    coded, doc = [], []
    for lo, hi in _blocks(texts):  # what splitting leaves of a block is let go before the next; its terms stay as numbers
        lists = pc.split_pattern_regex(pc.ascii_lower(texts.slice(lo, hi - lo)), pattern=BETWEEN_TERMS)
        words = lists.flatten()
        real = pc.not_equal(words, "")
        doc.append(np.repeat(np.arange(lo, hi, dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[real.to_numpy(zero_copy_only=False)])
        coded.append(words.filter(real).dictionary_encode())
        del lists, words, real
    coded = pa.chunked_array(coded, pa.dictionary(pa.int32(), texts.type)).unify_dictionaries()
    terms = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], texts.type)
    ids = np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy() for c in coded.chunks]])
    doc, size = np.concatenate([np.zeros(0, np.int32), *doc]), max(1, len(terms))
    del coded
    space = (int(groups.max(initial=0)) + 1) * size
    keys = groups[doc]
    keys *= size
    keys += ids
    cells, n = _tally(keys, space)
    keys = doc.astype(np.int64)
    keys *= size
    keys += ids
    del doc, ids
    keys.sort()
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    pairs = keys[first]
    del keys, first
    held, d = _tally(groups[pairs // size] * size + pairs % size, space)
    assert np.array_equal(cells, held)
    return cells // size, terms.take(pa.array(cells % size)), n, d


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some 4 MB of text each (or of one longer text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES_PER_BLOCK, side="right")))
        yield lo, hi
        lo = hi


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every 32 MB of text (or one longer text)."""

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = pd.MultiIndex.from_arrays([t.column("lang").to_pandas(), t.column("source").to_pandas()])
        group, names = pd.factorize(keys)
        text = t.column("text").cast(pa.large_string()).combine_chunks()
        text = text if isinstance(text, pa.Array) else text.chunk(0)
        del t, keys
        held.clear()  # their text stands in `text`
        g, term, n, d = count_batch(text, group.astype(np.int64))
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(g)) for i in (0, 1))
        for lo in range(0, len(g), 100_000):
            at = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([lang[at], source[at], term[at].cast(pa.string()), pa.array(n[at]), pa.array(d[at])], ["lang", "source", "term", "n", "d"])

    held, size = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            held.append(part)
            size += part.nbytes
            if size >= BYTES_PER_SLICE:
                yield from counted(held)
                held, size = [], 0
    if held:
        yield from counted(held)


def _compare(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One chunk of one language: distances of all pairs of sources over its terms, and each source's first terms."""
    groups = groups.sort_values("source", kind="stable", ignore_index=True)
    sources = groups["source"].to_numpy(dtype=object)
    total, kept, lang = groups["total"].to_numpy(np.int64), int(groups["kept"][0]), groups["lang"][0]
    terms = np.unique(counts["term"].to_numpy(dtype=object)) if len(counts) else np.zeros(0, dtype=object)
    dense = np.zeros((len(sources), len(terms)), dtype=np.int64)
    if len(counts):
        dense[np.searchsorted(sources, counts["source"].to_numpy(dtype=object)), np.searchsorted(terms, counts["term"].to_numpy(dtype=object))] = counts["n"]
    out = {"source": [], "part": [], "item": [], "value": []}

    def add(source: str, part: str, items: np.ndarray, values: np.ndarray) -> None:
        out["source"].append(np.full(len(items), source, dtype=object))
        out["part"].append(np.full(len(items), part, dtype=object))
        out["item"].append(items)
        out["value"].append(values)

    whole = dense.sum(axis=0)
    if len(terms):
        p, q = shares(dense, total[:, None] + PRIOR * kept), shares(whole, int(total.sum()) + PRIOR * kept)
    else:
        p, q = dense, whole
    for i, source in enumerate(sources):
        add(source, "pair", sources[i + 1 :], np.abs(p[i + 1 :] - p[i]).sum(axis=1, dtype=np.int64))
        over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
        best = over[np.argsort(-(p[i] - q)[over], kind="stable")[:TOP_TERMS]]
        add(source, "term", terms[best], (p[i] - q)[best])
    return pd.DataFrame({"lang": lang, **{k: np.concatenate(v) for k, v in out.items()}}).astype({"value": "int64"})


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) of documents.

    Null text, lang and source are ''. A document is a row: repeated rows count as often as they occur. A language that
    keeps no term has pairs of value 0; one with a single source has no pairs, and its terms can't exceed the
    language's share. Ties go by the item's UTF-8 bytes. Other columns are ignored; an empty table gives no rows.
    The result has a row for each ordered pair of a language's sources, so it grows with their square.
    """
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    src = docs.select(col("lang"), col("source"), col("text"))
    counts = src.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    w = Window.partitionBy("lang", "term")
    marked = counts.withColumn("docs", F.sum("d").over(w)).withColumn("first", (F.min("source").over(w) == F.col("source")).cast("long"))
    kept = cut(marked.where(F.col("docs") >= least).select("lang", "source", "term", "n", "first"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    groups = src.groupBy("lang", "source").agg(F.lit(0).alias("total"), F.lit(0).alias("first")).unionByName(totals)
    groups = groups.groupBy("lang", "source").agg(F.sum("total").alias("total"), F.sum("first").alias("first"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("first").alias("kept"))
    width = F.greatest(F.lit(64), F.least(F.lit(TERMS_PER_CHUNK), F.floor(F.lit(CELLS_PER_CHUNK) / F.col("sources"))))
    langs = bounded(cut(langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("kept") / width)).cast("int"))))

    dealt = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "chunks").cast("int").alias("chunk"), "source", "term", "n")
    beside = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "source", "total", "kept")
    found = dealt.groupBy("lang", "chunk").cogroup(beside.groupBy("lang", "chunk")).applyInPandas(
        lambda a, b: _compare(a, b), "lang string, source string, part string, item string, value long")
    found = cut(found)

    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    mirrored = sums.unionByName(sums.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    pairs = ranked(mirrored)
    terms = ranked(found.where("part = 'term'").select("lang", "source", "part", "item", "value")).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
