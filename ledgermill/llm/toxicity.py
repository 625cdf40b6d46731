"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Token labels come from the labelled documents: features (a word, its prefixes and suffixes) found in
toxic documents far beyond chance are seeds; a token of a toxic document with a seed is toxic. Near
copies count once there. A two-tag chain (clean, toxic) is fitted to those tags by gradient ascent of
its likelihood, with expectations from forward-backward. A document's score is a calibrated logistic
function of its tokens' marginals; tokens of marginal 0.5 or more are its offending spans.

Whole texts are scored: a text is cut into segments whose 2x2 transfer matrices are multiplied, so
that long texts take few vectorised steps and every marginal is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed_first, lean
from .langid import is_held_out

MAX_TOXIC, MAX_CLEAN = 6_000, 12_000  # labelled documents that features are counted on
MAX_FIT, MAX_FIT_CHARS = 1_500, 8_000_000  # documents of each label that the chain is fitted to, and all their characters
THRESHOLD = 0.3
SEGMENT = 128
TOKENS_AT_ONCE = 400_000
WORDS_KEPT = 400_000

_TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    parts = ["w" + word]
    parts += [f"p{word[:n]}" for n in range(3, 9) if len(word) > n]
    parts += [f"r{word[:n]}+{len(word) - n}" for n in range(3, 9) if n < len(word) <= n + 6]  # a stem and a short ending
    parts += [f"s{word[-n:]}" for n in (3, 4) if len(word) > n]
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 1) >> 1 for p in parts]


def marginals(emission: np.ndarray, starts: np.ndarray, log_transition: np.ndarray, log_start: np.ndarray) -> np.ndarray:
    """P(tag 1) of every token. emission: log odds of tag 1, texts one after another; starts: where each
    begins, the total last; log_transition[i, j]: from tag i to j; log_start: of the first token's tags."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    a = np.exp(log_transition - log_transition.max())
    e = np.exp(np.clip(emission, -30, 30))
    sizes = np.diff(starts)
    count = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), count)
    first = np.cumsum(count) - count
    nth = np.arange(len(text)) - first[text]
    begin = starts[:-1][text] + nth * SEGMENT
    length = np.minimum(SEGMENT, starts[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    begin_o, length_o = begin[order], length[order]
    opening = (nth == 0)[order][:, None]  # the first token of a text has no transition before it
    active = [int(np.searchsorted(-length_o, -t, side="left")) for t in range(SEGMENT)]
    # transfer matrix of each segment: m[i, j] from the tag before it to the tag of its last token
    m = np.zeros((len(order), 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    for t, k in enumerate(active):
        if not k:
            break
        x = e[begin_o[:k] + t]
        c0 = m[:k, :, 0] * a[0, 0] + m[:k, :, 1] * a[1, 0]
        c1 = m[:k, :, 0] * a[0, 1] + m[:k, :, 1] * a[1, 1]
        if not t:
            c0, c1 = np.where(opening[:k], m[:k, :, 0], c0), np.where(opening[:k], m[:k, :, 1], c1)
        c1 = c1 * x[:, None]
        top = np.maximum(c0, c1).max(axis=1)[:, None]
        m[:k, :, 0], m[:k, :, 1] = c0 / top, c1 / top
    seg = np.empty_like(m)
    seg[order] = m
    # what stands before (fore) and after (back) each segment, over the tags
    fore, back = np.zeros((len(text), 2)), np.ones((len(text), 2))
    s = np.exp(log_start - log_start.max())
    by_nth = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[by_nth], np.arange(int(nth.max()) + 2))
    fore[by_nth[: bounds[1]]] = s
    for t in range(1, len(bounds) - 1):
        i = by_nth[bounds[t] : bounds[t + 1]]
        v = np.einsum("ni,nij->nj", fore[i - 1], seg[i - 1])
        fore[i] = v / v.max(axis=1, keepdims=True)
    for t in range(len(bounds) - 2, 0, -1):
        i = by_nth[bounds[t] : bounds[t + 1]]
        v = np.einsum("nij,nj->ni", seg[i], back[i])
        back[i - 1] = v / v.max(axis=1, keepdims=True)
    ratio = np.empty(n)
    f = fore[order]
    for t, k in enumerate(active):
        if not k:
            break
        at = begin_o[:k] + t
        c0 = f[:k, 0] * a[0, 0] + f[:k, 1] * a[1, 0]
        c1 = f[:k, 0] * a[0, 1] + f[:k, 1] * a[1, 1]
        if not t:
            c0, c1 = np.where(opening[:k, 0], f[:k, 0], c0), np.where(opening[:k, 0], f[:k, 1], c1)
        c1 = c1 * e[at]
        top = np.maximum(c0, c1)
        f[:k, 0], f[:k, 1] = c0 / top, c1 / top
        ratio[at] = f[:k, 1] / np.maximum(f[:k, 0], 1e-300)
    b = back[order]
    for t in range(SEGMENT - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        at = begin_o[:k] + t
        ratio[at] *= b[:k, 1] / np.maximum(b[:k, 0], 1e-300)
        x = b[:k, 1] * e[at]
        c0 = a[0, 0] * b[:k, 0] + a[0, 1] * x
        c1 = a[1, 0] * b[:k, 0] + a[1, 1] * x
        top = np.maximum(c0, c1)
        b[:k, 0], b[:k, 1] = c0 / top, c1 / top
    return ratio / (1 + ratio)


@dataclass
class ToxicityModel:
    weights: dict[int, float]
    bias: float
    transition: np.ndarray
    start: np.ndarray
    calibration: np.ndarray  # of 1, log(1 + expected toxic tokens), largest marginal
    kept: dict[str, float] = field(default_factory=dict)  # emissions of words met in this process

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in features(word))

    def aggregate(self, m: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, 3) inputs of the calibration."""
        total, most = np.zeros(len(starts) - 1), np.zeros(len(starts) - 1)
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            total[full] = np.add.reduceat(m, starts[full])
            most[full] = np.maximum.reduceat(m, starts[full])
        return np.stack([np.ones(len(total)), np.log1p(total), most], axis=1)

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.calibration, -30, 30)))


def _fit_chain(starts: np.ndarray, token: np.ndarray, feature: np.ndarray, y: np.ndarray, size: int, rounds: int = 40):
    """Adam on the chain's log likelihood. starts: where each text's tokens begin; (token, feature): which token has
    which feature number; y: tags."""
    w, bias, trans, start = np.zeros(size), -4.0, np.zeros((2, 2)), np.zeros(2)
    begins = np.zeros(len(y), bool)
    begins[starts[:-1][np.diff(starts) > 0]] = True
    inner = np.flatnonzero(~begins)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    # transitions have a closed form when tags are observed; smoothed so that no step is impossible
    trans = np.log((pairs + 1) / (pairs + 1).sum(axis=1, keepdims=True))
    first = y[begins].sum()
    start = np.log(np.array([begins.sum() - first + 1, first + 1]) / (begins.sum() + 2))
    moment, spread = np.zeros(size + 1), np.zeros(size + 1)
    for i in range(1, rounds + 1):
        emission = bias + np.bincount(token, weights=w[feature], minlength=len(y))
        gap = y - marginals(emission, starts, trans, start)
        g = np.concatenate((np.bincount(feature, weights=gap[token], minlength=size) - 0.05 * w, [gap.sum()]))
        moment, spread = 0.9 * moment + 0.1 * g, 0.98 * spread + 0.02 * g * g
        step = 0.3 * (moment / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.98**i)) + 1e-8)
        w, bias = w + step[:-1], bias + float(step[-1])
    return w, bias, trans, start


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _sketches(text: str) -> tuple[int, int]:
    """Two minimum hashes of five-word shingles; near copies mostly share one of them."""
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 3) for i in range(max(1, len(w) - 4))]
    return min(h) >> 1, min(x * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for x in h) >> 1


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(doc_id, text, toxic): a bounded sample of labelled rows by hash of the id, near copies once.

    Labels other than 0 and 1 and null ids don't count; an id with both labels is toxic; null texts go. Of rows
    that repeat an id or nearly a text the one with the least id, then text, stays.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = own.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hashed_first(known, "toxic", F.when(F.col("toxic") == 1, max_toxic).otherwise(max_clean))  # at most max_toxic + max_clean rows
    src = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = src.join(F.broadcast(chosen), "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [_sketches(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in both], pa.int64()), pa.array([y for _, y in both], pa.int64())],
                names=[*b.schema.names, "s1", "s2"])

    kept = rows.select("doc_id", "text", "toxic").mapInArrow(lean(sketch), "doc_id long, text string, toxic int, s1 long, s2 long")
    for s in ("s1", "s2"):
        w = Window.partitionBy(s, "toxic").orderBy("doc_id", "text")
        kept = kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the bounded sample of `training_rows`; only ids, texts and `toxic` are read.

    The chain and the calibration are fitted to the sample's first MAX_FIT documents of each label by hash of the
    id, as far as those before a document have less than MAX_FIT_CHARS characters; whole texts, however long.
    Without labelled texts of both labels, or without a feature that tells them apart, the model gives
    every text the share of toxic labels (0 without labels).
    """
    rows = cut(training_rows(docs, labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found[y].update({f for w in set(_TOKEN.findall(text.lower())) for f in features(w)})
        for y in (0, 1):
            items = list(found[y].items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in items], pa.int64()), pa.array([y] * len(items), pa.int32()), pa.array([v for _, v in items], pa.int64())],
                names=["f", "y", "n"])

    counts = rows.mapInArrow(lean(count), "f long, y int, n long").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    of = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = of.get(1, 0), of.get(0, 0)
    prior = labels.where(F.col("toxic").cast("int").isin(0, 1) & ~is_held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("int")).alias("p")).first()["p"] or 0.0
    nothing = ToxicityModel({}, -6.0, np.log(np.full((2, 2), 0.5) + [[0.4, -0.4], [0.0, 0.0]]), np.log(np.array([0.9, 0.1])),
                            np.array([np.log((prior + 1e-4) / (1 - prior + 1e-4)), 0.0, 0.0]))
    if not n_toxic or not n_clean:
        return nothing
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    least = max(4, round(0.002 * n_toxic))
    table = (
        counts.where(F.col("t") + F.col("c") >= least).withColumn("odds", odds)
        .where(F.abs("odds") >= 1.0).orderBy(F.desc(F.abs(F.col("odds")) * F.log1p(F.col("t") + F.col("c"))), "f").limit(20_000).toPandas()
    )
    if table.empty:
        return nothing
    number = {int(f): i for i, f in enumerate(table["f"])}
    seed = ((table["odds"] >= 2.5) & (table["t"] >= least)).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(number)
    w = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text")  # of the bounded sample
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = rows.withColumns({"nth": F.row_number().over(w), "before": before}).where((F.col("nth") <= MAX_FIT) & (F.col("before") < MAX_FIT_CHARS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = shared.value, {}
        for b in batches:
            sizes, held = [], []
            for text in b.column(1).to_pylist():
                words = _TOKEN.findall(text.lower())
                for x in words:
                    if x not in kept:
                        kept[x] = [known[f] for f in features(x) if f in known]
                sizes.append(np.array([len(kept[x]) for x in words], dtype=np.int32))
                held.append(np.array([f for x in words for f in kept[x]], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "toxic", "sizes", "held"])

    fit = few.select("doc_id", "text", "toxic").mapInArrow(lean(encode), "doc_id long, toxic int, sizes array<int>, held array<int>").toArrow()
    order = np.lexsort((fit["toxic"].to_numpy(), fit["doc_id"].to_numpy()))  # whatever the partitions were
    fit = fit.take(pa.array(order)).combine_chunks()
    y = fit["toxic"].to_numpy().astype(np.float64)
    flat = lambda name: np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in fit[name]] or [np.zeros(0)]).astype(np.int64)
    sizes, feature = flat("sizes"), flat("held")
    starts = np.concatenate(([0], np.cumsum([len(x) for x in fit["sizes"]]))).astype(np.int64)
    token = np.repeat(np.arange(len(sizes)), sizes)
    hot = np.bincount(token, weights=seed[feature], minlength=len(sizes)) > 0
    tags = (hot & (np.repeat(y, np.diff(starts)) == 1)).astype(np.float64)
    if not len(sizes):
        return nothing
    weights, bias, trans, start = _fit_chain(starts, token, feature, tags, len(number))
    model = ToxicityModel({f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 1e-3}, bias, trans, start, np.zeros(3))
    emission = bias + np.bincount(token, weights=weights[feature], minlength=len(sizes))
    inputs = model.aggregate(marginals(emission, starts, trans, start), starts)
    share = y.mean()
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    model.calibration = _fit_logistic(inputs, y, weight)
    return model


def score_texts(model: ToxicityModel, texts: list[str | None]) -> list[tuple[float, str]]:
    """(score, spans) of each text."""
    kept = model.kept
    words = [_TOKEN.findall((t or "").lower()) for t in texts]
    if len(kept) > WORDS_KEPT:
        kept.clear()
    for w in words:
        for x in w:
            if x not in kept:
                kept[x] = model.emission(x)
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    emission = np.array([v for w in words for v in map(kept.__getitem__, w)])
    m = marginals(emission, starts, model.transition, model.start)
    scores = model.score(model.aggregate(m, starts))
    out = []
    for i, text in enumerate(texts):
        hot = np.flatnonzero(m[starts[i] : starts[i + 1]] >= 0.5)
        said = ""
        if len(hot):
            low = text.lower()
            if len(low) != len(text):  # a letter whose lower case is longer: offsets by single letters
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            found = list(_TOKEN.finditer(low))
            runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
            said = ",".join(f"{found[r[0]].start()}:{found[r[-1]].end()}" for r in runs if r[-1] < len(found))
        out.append((float(scores[i]), said))
    return out


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, spans (start:end, comma-joined).

    Null texts count as empty; a text without words gets the score of no toxic token. Only text is read
    for a score. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, said, size = [], [], 0
            for t in b.column(2):
                texts.append(t.as_py())
                size += len(texts[-1] or "") // 6
                if size >= TOKENS_AT_ONCE:
                    said += score_texts(m, texts)
                    texts, size = [], 0
            said += score_texts(m, texts) if texts else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([s for s, _ in said], pa.float64()),
                 pa.array([int(s >= threshold) for s, _ in said], pa.int32()), pa.array([x for _, x in said], pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "spans"])

    src = docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return src.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, spans string")
