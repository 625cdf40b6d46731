"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of slots holds a bit for each language in every slot; an n-gram of a language sets that
language's bit in its slots. The AND over an n-gram's slots gives at once all languages that contain
it. A text's n-grams are counted per language by popcounts of those masks; the share that a filter of
its fill would report by chance is taken off; the largest corrected share decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_first, lean

UNDETERMINED = "und"
SIZES = (2, 3, 4)
SAMPLE_PER_LANGUAGE = 1500
GRAMS_PER_LANGUAGE = 40_000
LOG_SLOTS = 20
HASHES = 3
MAX_BROADCAST_IDS = 200_000

_LETTER = re.compile(r"[^\W\d_]")
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what isn't one; made once a process."""
    if not _TABLE:
        t = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                t[c] = ord(low) if len(low := x.lower()) == 1 else c
        _TABLE.append(t)
    return _TABLE[0]


def has_letter(text: str) -> bool:
    """Whether a code point is a letter; numerals such as a half or a circled one are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def gram_hashes(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """64-bit hashes of the n-grams of letters; a word's edge counts as one boundary mark."""
    cps = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    t = _letters()[np.minimum(cps, 0x10FFFF)]
    solid = t > 0
    t = t[solid | np.concatenate(([True], solid[:-1]))].astype(np.uint64)
    out = []
    for n in sizes:
        if len(t) < n:
            continue
        h = np.full(len(t) - n + 1, n, dtype=np.uint64)
        inside = t[0 : len(h)] >= 0
        for i in range(n):
            part = t[i : i + len(h)]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                inside &= part > 0  # a boundary stands at an end only
        if n == 2:
            inside &= (t[:-1] > 0) | (t[1:] > 0)
        out.append(h[inside])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (words, slots)
    chance: np.ndarray  # of a false positive, per language
    sizes: tuple[int, ...] = SIZES
    hashes: int = HASHES
    default: int = 0

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], log_slots: int = LOG_SLOTS, hashes: int = HASHES,
              sizes: tuple[int, ...] = SIZES, default: str | None = None) -> LanguageModel:
        names = sorted(grams)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(names) <= np.dtype(k).itemsize * 8 or k is np.uint64)
        width = np.dtype(kind).itemsize * 8
        table = np.zeros((max(1, -(-len(names) // width)), 1 << log_slots), dtype=kind)
        for i, name in enumerate(names):
            for slot in _slots(grams[name], log_slots, hashes):
                table[i // width, slot] |= kind(1 << i % width)
        fill = [np.count_nonzero(table[i // width] & kind(1 << i % width)) / (1 << log_slots) for i in range(len(names))]
        return cls(names, table, np.array(fill) ** hashes, sizes, hashes, names.index(default) if default in names else 0)

    def shares(self, text: str) -> np.ndarray:
        """Per language the share of the text's n-grams that it holds, corrected for chance."""
        grams = gram_hashes(text, self.sizes)
        n, width = len(grams), self.table.dtype.itemsize * 8
        out = np.zeros(len(self.languages))
        if not n:
            return out
        log_slots = self.table.shape[1].bit_length() - 1
        masks = None
        for slot in _slots(grams, log_slots, self.hashes):
            got = self.table[:, slot]
            masks = got if masks is None else masks & got
        for i in range(len(out)):
            bit = self.table.dtype.type(1 << i % width)
            out[i] = np.count_nonzero(masks[i // width] & bit) / n
        return np.clip((out - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        s = self.shares(text)
        if not s.any():
            return self.languages[self.default], 0.0
        best = int(np.argmax(s))
        rest = float(np.max(np.delete(s, best), initial=0.0))
        return self.languages[best], float(s[best] / (s[best] + rest))


def _slots(grams: np.ndarray, log_slots: int, hashes: int) -> Iterator[np.ndarray]:
    step = (grams >> np.uint64(33)) | np.uint64(1)
    mask = np.uint64((1 << log_slots) - 1)
    for i in range(hashes):
        yield ((grams + np.uint64(i) * step) & mask).astype(np.int64)


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(lang, text): one text for each of at most `per_language` labelled ids of each language, in order of a hash of the id.

    Ids and languages alone are ranked; texts are then fetched for the chosen ids. Of rows that repeat an id and its
    language the least text takes part.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = hashed_first(ids.select("lang", "doc_id"), "lang", per_language)
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    if chosen.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        chosen = F.broadcast(chosen)  # with very many languages the join is shuffled instead
    rows = ids.join(chosen, (ids.doc_id == chosen._id) & (ids.lang == chosen._lang), "left_semi").select("doc_id", "lang", "text")
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE,
          sizes: tuple[int, ...] = SIZES, share: float = 0.15) -> LanguageModel:
    """Learn from the sample: a language holds an n-gram whose rate there is at least `share` of the
    largest rate anywhere. At most `grams_per_language` (the most frequent) enter the filter, so the
    model's size doesn't depend on the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.to_pandas()
            for lang, own in frame.groupby("lang"):
                g = [gram_hashes(t, sizes) for t in own["text"] if t]
                v, n = np.unique(np.concatenate(g), return_counts=True) if g else ([], [])
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"lang": lang, "gram": np.asarray(v, np.uint64).view(np.int64), "n": np.asarray(n, np.int64)}),
                    preserve_index=False)

    counted = training_sample(docs, per_language).mapInArrow(lean(count), "lang string, gram long, n long")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    held = rated.join(top, "gram").where((F.col("n") >= 2) & (F.col("rate") >= share * F.col("top")))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = held.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= grams_per_language).select("lang", "gram", "total").toPandas()
    grams = {k: own["gram"].to_numpy(np.int64).view(np.uint64) for k, own in rows.groupby("lang")}
    default = rows.loc[rows["total"].idxmax(), "lang"] if len(rows) else None
    return LanguageModel.build(grams, sizes=sizes, default=default)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Only text is read for a prediction.

    `und` with score 0: the text is null or has no letter. Letters none of whose n-grams are known
    get the language with most training text, score 0. The score is the winner's corrected share
    over the sum of the two largest. Ties go to the first language by name. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            said = [m.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return src.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows whose language can be told (not `und`), all columns as they are, without a shuffle.

    Null texts and texts without a letter go; with nothing to learn from (no labelled row) every row goes.
    Repeated rows stay or go together. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            said = [m.predict(t.as_py())[0] != UNDETERMINED for t in b.column(b.schema.get_field_index("text"))]
            yield b.filter(pa.array(said, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
