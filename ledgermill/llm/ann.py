"""Approximate nearest neighbours by NN-descent.

The graph starts from random-projection blocks and is improved by rounds of Spark joins: each node
gathers its neighbours and a bounded sample of the nodes that name it, with their vectors; of these, those
that are new to a list are compared with all others, and what beats a node's worst neighbour is kept. Rounds
go on until few list entries change (`CHANGED` of them).
Queries walk the graph greedily: each round opens all nodes of a query's beam that aren't open yet, scores their
neighbours where these are stored, and keeps the best; a walk ends when its beam holds no closed node. The beam
grows with the logarithm of the number of nodes.

Largest inner product is made a distance of equal-length vectors by one more component
(sqrt(longest^2 - |x|^2)). Equal vectors are one node; a node stands for its smallest vec_ids. The walk
works on bytes (a scale and a signed byte a component); results are ranked by the vectors themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

TOP = 20
DEGREE = 30
REVERSE = 30
CHANGED = 0.01  # share of list entries that are new in a round; below it NN-descent has converged
TREES = 8
BLOCK = 256
START = 15  # neighbours that a node takes from a block
BEAM_PER_BIT = 10  # beam: this times log2 of the number of nodes
RANKED = 4  # this times the wanted neighbours are ranked by the vectors themselves
STORED = 4096  # vectors that are scored in one place


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double>) of rows that take part: not null, finite, not zero. Shorter vectors end in zeros."""
    v = F.col(column).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    ok = ok.where(~F.exists("vec", bad)).where(F.exists("vec", lambda x: x != 0))
    longest = ok.agg(F.max(F.size("vec")).alias("n")).first()["n"] or 0
    return ok.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vec"))))


def classes(own: DataFrame, members: int = TOP + 1) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, vec of distinct vectors; node = smallest vec_id), (members: node, vec_id, the smallest few).

    A vec_id with several vectors would name several nodes; those after its least vector get another name, below zero."""
    nodes = own.groupBy("vec").agg(F.min("vec_id").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("vec"))
    nodes = cut(nodes.withColumn("nth", nth).select(F.when(F.col("nth") == 1, F.col("vec_id")).otherwise(F.lit(-1) - F.shiftrightunsigned(F.xxhash64("vec", "vec_id"), 1)).alias("node"), "vec"))
    w = Window.partitionBy("vec").orderBy("vec_id")
    few = own.withColumn("n", F.row_number().over(w)).where(F.col("n") <= members).select("vec", "vec_id")
    return nodes, few.join(nodes, "vec").select("node", "vec_id")


def _stored(ids: np.ndarray, places: int) -> np.ndarray:
    """The place of each node among so many."""
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(places)).astype(np.int64)


def _packed(nodes: DataFrame) -> tuple[DataFrame, int, int]:
    """(node, place, code: the lengthened vector as a float32 scale and a signed byte a component), components, nodes."""
    r = nodes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("vec")).alias("d"), F.count("*").alias("n")).first()
    longest, dims, n = (r["m"] or 0.0) * (1 + 1e-12), r["d"] or 0, r["n"]
    places = max(1, -(-n // STORED))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["vec"].to_numpy()) if len(b) else np.zeros((0, dims))
            more = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))
            x = np.concatenate([x, more[:, None]], axis=1) / np.sqrt(longest)
            scale = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
            codes = np.concatenate([scale.view(np.uint8), np.round(x / scale).astype(np.int8).view(np.uint8)], axis=1)
            yield pd.DataFrame({"node": b["node"], "place": _stored(b["node"].to_numpy(np.int64), places), "code": [c.tobytes() for c in codes]})

    return nodes.select("node", "vec").mapInPandas(lean(pack), "node long, place long, code binary"), dims + 1, n


def _rows(codes: pd.Series, dims: int) -> np.ndarray:
    a = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, dims + 4)
    return a[:, 4:].view(np.int8) * a[:, :4].copy().view(np.float32)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.array([0])
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by key, cut only between keys."""
    rest = None
    for b in batches:
        if rest is not None:
            b = pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        at = int(np.searchsorted(b[key].to_numpy(), b[key].iloc[-1], side="left"))
        rest = b.iloc[at:].reset_index(drop=True)
        if at:
            yield b.iloc[:at]
    if rest is not None and len(rest):
        yield rest


EDGE = "node long, other long, score float, fresh boolean"


def _best_rows(node: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray, degree: int) -> pd.DataFrame:
    """The `degree` best edges of each node, each once; `fresh` stays on edges that only rows marked so hold."""
    o = np.lexsort((fresh, other, node))
    node, other, score, fresh = node[o], other[o], score[o], fresh[o]
    o = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])]) if len(node) else np.zeros(0, int)
    o = o[np.lexsort((other[o], -score[o], node[o]))]
    node, other, score, fresh = node[o], other[o], score[o], fresh[o]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
    few = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)])) < degree
    return pd.DataFrame({"node": node[few], "other": other[few], "score": score[few], "fresh": fresh[few]})


def _best(edges: DataFrame, degree: int) -> DataFrame:
    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, "node"):
            yield _best_rows(*(b[c].to_numpy() for c in ("node", "other", "score", "fresh")), degree)

    return edges.repartition("node").sortWithinPartitions("node").mapInPandas(lean(top), EDGE)


def _start(packed: DataFrame, dims: int, n: int, degree: int, trees: int) -> DataFrame:
    """First neighbours: nodes sorted by random sign keys are cut into blocks that are compared whole."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / (BLOCK / 2))))))
    planes = np.random.default_rng(11).standard_normal((trees, max(bits, 1), dims)).astype(np.float32)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _rows(b["code"], dims) if len(b) else np.zeros((0, dims), np.float32)
            for t in range(trees):
                k = ((x @ planes[t].T) > 0) @ (1 << np.arange(planes.shape[1])) if bits else np.zeros(len(b), np.int64)
                yield pd.DataFrame({"block": (k.astype(np.int64) << 8) | t, "node": b["node"], "code": b["code"]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # the cuts of blocks at batch ends only make blocks smaller
            ids, x, k = b["node"].to_numpy(), _rows(b["code"], dims) if len(b) else None, b["block"].to_numpy()
            out = []
            for a, z in _groups(k):
                for s in range(a, z, BLOCK):
                    e = min(s + BLOCK, z)
                    g = x[s:e] @ x[s:e].T
                    np.fill_diagonal(g, -np.inf)
                    m = min(START, e - s - 1)
                    if m > 0:
                        top = np.argpartition(-g, m - 1, axis=1)[:, :m]
                        out.append((np.repeat(ids[s:e], m), ids[s:e][top].ravel(), np.take_along_axis(g, top, 1).ravel()))
            if out:
                node, other, score = (np.concatenate(v) for v in zip(*out, strict=True))
                yield _best_rows(node, other, score, np.ones(len(node), bool), degree)

    keyed = packed.mapInPandas(lean(key), "block long, node long, code binary")
    sorted_ = keyed.repartitionByRange("block", "node").sortWithinPartitions("block", "node")  # a dense block has many tasks
    return _best(sorted_.mapInPandas(lean(compare), EDGE), degree)


def _improve(edges: DataFrame, packed: DataFrame, dims: int, degree: int, reverse: int, nth: int) -> DataFrame:
    """One round of neighbours of neighbours. The reverse side of a node is a sample of `reverse` edges, as in
    the published method; hubs thus stay bounded. Of two nodes that are compared one at least is fresh."""
    worst = edges.groupBy("node").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    worst = worst.select("node", F.when(F.col("n") >= degree, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    w = Window.partitionBy("via").orderBy(F.xxhash64("node", F.lit(nth)), "node")
    back = edges.select(F.col("other").alias("via"), F.col("node"), "fresh").withColumn("n", F.row_number().over(w)).where(F.col("n") <= reverse)
    lists = edges.select(F.col("node").alias("via"), F.col("other").alias("node"), "fresh").unionByName(back.select("via", "node", "fresh"))
    lists = lists.groupBy("via", "node").agg(F.max("fresh").alias("fresh"))
    full = lists.join(packed.join(worst, "node", "left").select("node", "code", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst")), "node")
    gathered = full.repartition("via").sortWithinPartitions("via", "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, "via"):
            ids, x, worst_of, fresh = b["node"].to_numpy(), _rows(b["code"], dims), b["worst"].to_numpy(), b["fresh"].to_numpy()
            out = []
            for s, e in _groups(b["via"].to_numpy()):
                if e - s < 2 or not fresh[s:e].any():
                    continue
                g = x[s:e] @ x[s:e].T
                np.fill_diagonal(g, -np.inf)
                i, j = np.nonzero((g > worst_of[s:e][:, None]) & (fresh[s:e][:, None] | fresh[None, s:e]))
                if len(i):
                    out.append((ids[s:e][i], ids[s:e][j], g[i, j]))
            if out:  # more than `degree` of a task can't enter a list of this length
                node, other, score = (np.concatenate(v) for v in zip(*out, strict=True))
                yield _best_rows(node, other, score, np.ones(len(node), bool), degree)

    found = gathered.select("via", "node", "code", "worst", "fresh").mapInPandas(lean(compare), EDGE)
    return _best(edges.withColumn("fresh", F.lit(False)).unionByName(found), degree)


def build_graph(packed: DataFrame, dims: int, n: int, degree: int = DEGREE, changed: float = CHANGED, trees: int = TREES, reverse: int = REVERSE) -> DataFrame:
    """edges (node, other, score) of the neighbour graph. Lists only get better, so the rounds end."""
    edges = cut(_start(packed, dims, n, degree, trees))
    for i in itertools.count():
        edges = cut(_improve(edges, packed, dims, degree, reverse, i))
        r = edges.agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n")).first()
        if r["fresh"] <= changed * r["n"]:
            return edges.select("node", "other", "score")


def _adjacency(edges: DataFrame, reverse: int) -> DataFrame:
    """(node, others array), both directions, bounded by degree + reverse."""
    w = Window.partitionBy("node").orderBy(F.desc("score"), "other")
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "score")
    back = back.withColumn("n", F.row_number().over(w)).where(F.col("n") <= reverse)
    return edges.select("node", "other").unionByName(back.select("node", "other")).groupBy("node").agg(F.collect_set("other").alias("others"))


BEAM_ROW = "query long, code binary, ids array<long>, scores array<float>, open array<boolean>"
ASK = "place long, kind int, query long, code binary, worst float, ids array<long>"


def _per_query(rows: DataFrame, one: Callable, schema: str) -> DataFrame:
    """`one` on all rows of a query: its beam (beam true) and what else there is for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, "query"):
            made = [row for s, e in _groups(b["query"].to_numpy()) for row in one(b.iloc[s:e])]
            if made:
                yield pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.repartition("query").sortWithinPartitions("query", "beam").mapInPandas(lean(run), schema)


def _score(asks: DataFrame, packed: DataFrame, dims: int) -> DataFrame:
    """(query, ids, scores) of the asked nodes that beat the beam's worst. A place's vectors come first and stay, at
    most some STORED; then what is asked there streams by, so no node is too popular."""
    stored = packed.select("place", F.lit(0).alias("kind"), F.col("node").alias("query"), "code", F.lit(0.0).cast("float").alias("worst"), F.lit(None).cast("array<long>").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, ids, x = None, np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
        for b in batches:
            out = []
            for s, e in _groups(b["place"].to_numpy() * 2 + b["kind"].to_numpy()):
                g = b.iloc[s:e]
                if place != g["place"].iloc[0]:
                    place, ids, x = g["place"].iloc[0], np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
                if not g["kind"].iloc[0]:
                    ids, x = np.r_[ids, g["query"].to_numpy()], np.concatenate([x, _rows(g["code"], dims)])
                    order = np.argsort(ids)
                    ids, x = ids[order], x[order]
                    continue
                asked = _rows(g["code"], dims)
                asked[:, -1] = 0.0
                for q, v, worst, want in zip(g["query"], asked, g["worst"], g["ids"], strict=True):
                    scores = x[np.searchsorted(ids, want)] @ v
                    if (ok := scores > worst).any():
                        out.append((q, want[ok], scores[ok]))
            if out:
                yield pd.DataFrame(out, columns=["query", "ids", "scores"])

    rows = stored.unionByName(asks).repartition("place").sortWithinPartitions("place", "kind")
    return rows.mapInPandas(lean(run), "query long, ids array<long>, scores array<float>")


def search(queries: DataFrame, edges: DataFrame, packed: DataFrame, dims: int, n: int, beam: int | None = None, reverse: int = REVERSE) -> DataFrame:
    """(query, node, score: about the inner product) of the beam of each query node. queries: (query: a node). A node is
    opened once and never enters a beam again as closed, so every walk ends."""
    beam = beam or max(4 * TOP, int(BEAM_PER_BIT * np.log2(max(n, 2))))
    places = max(1, -(-n // STORED))
    graph = cut(_adjacency(edges, reverse))
    state = queries.join(packed, queries["query"] == packed["node"]).select(
        "query", "code", F.array("query").alias("ids"), F.array(F.lit(2.0).cast("float")).alias("scores"), F.array(F.lit(False)).alias("open"))

    def wanted(g: pd.DataFrame) -> list[tuple]:
        own = g[g["beam"]]
        if not len(own) or len(own) == len(g):
            return []
        code, ids, scores = own["code"].iloc[0], np.asarray(own["ids"].iloc[0]), own["scores"].iloc[0]
        new = np.setdiff1d(np.concatenate(g["ids"][~g["beam"]].to_list()), ids)
        at = _stored(new, places)
        order = np.argsort(at, kind="stable")
        worst = float(np.min(scores)) if len(ids) >= beam else -np.inf
        return [(at[order[s]], 1, own["query"].iloc[0], code, worst, new[order[s:e]]) for s, e in _groups(at[order])]

    def merged(g: pd.DataFrame) -> list[tuple]:
        own, more = g[g["beam"]], g[~g["beam"]]
        ids, scores = (np.concatenate([np.asarray(own[c].iloc[0]), *more[c]]) for c in ("ids", "scores"))
        open_ = np.arange(len(ids)) < len(own["ids"].iloc[0])  # all of the beam was opened in this round
        best = np.lexsort((ids, -scores))[:beam]
        return [(own["query"].iloc[0], own["code"].iloc[0], ids[best].astype(np.int64), scores[best].astype(np.float32), open_[best])]

    ended = []
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    while True:
        opened = state.select("query", F.explode(F.filter("ids", lambda x, i: ~F.col("open")[i])).alias("node")).join(graph, "node")
        opened = opened.select("query", F.lit(False).alias("beam"), none("binary", "code"), F.col("others").alias("ids"), none("array<float>", "scores"))
        own = state.select("query", F.lit(True).alias("beam"), "code", "ids", "scores")
        scored = _score(_per_query(own.unionByName(opened), wanted, ASK), packed, dims).select("query", F.lit(False).alias("beam"), none("binary", "code"), "ids", "scores")
        walked = cut(_per_query(own.unionByName(scored), merged, BEAM_ROW))
        more = F.exists("open", lambda x: ~x)
        ended.append(walked.where(~more).select("query", F.explode(F.arrays_zip("ids", "scores")).alias("r")).select("query", F.col("r.ids").alias("node"), F.col("r.scores").alias("score")))
        state = walked.where(more)
        if state.isEmpty():
            return reduce(DataFrame.unionByName, ended)


def nearest(vectors: DataFrame, column: str = "embedding", top: int = TOP, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the `top` largest inner products found.

    All other rows are candidates. Vectors that are null, zero, or hold null or non-finite components take
    no part; shorter vectors count as ended by zeros. Scores are inner products of the original vectors in double
    precision; ties go to the smaller vec_id. Rows that repeat a vec_id and its vector count as one; of a vec_id with
    several vectors each is a candidate and the least asks. Fewer candidates than `top` give all of them. An
    empty table gives no rows.
    """
    own = cut(valid(vectors, column).distinct())
    nodes, members = classes(own, top + 1)
    packed, dims, n = _packed(nodes)
    packed = cut(packed)
    edges = build_graph(packed, dims, n)
    asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("qv")).withColumnRenamed("vec_id", "query_id")
    asked = cut(asked.join(nodes, asked.qv == nodes.vec).select("query_id", "qv", F.col("node").alias("query")))
    found = search(asked.select("query").distinct(), edges, packed, dims, n)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= RANKED * (top + 1)).select("query", "node")
    scored = asked.join(found, "query").join(nodes, "node")
    dot = F.aggregate(F.zip_with("qv", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = scored.select("query_id", "query", "node", dot.alias("score"))
    # only the best top + 1 nodes of a query can hold its best rows
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    scored = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top + 1).drop("n")
    rows = scored.join(members, "node").where("not (vec_id = query_id and node = query)")
    r = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
