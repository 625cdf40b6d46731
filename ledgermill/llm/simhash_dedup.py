"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 values of the text's word shingles.
Two fingerprints link at `RADIUS` = 3 or fewer differing bits. Candidates come from the perfect
binary Golay code (23, 12, 7): each 23-bit word lies within 3 bits of exactly one codeword.

Segments A and B have 23 bits, C has 18 (zero padded). Of three wrong bits, either A and B hold at
most one each, or one of the two holds two or more, which leaves at most one wrong bit in the other
and C together. One wrong bit moves a word y to distance 4 at most of the codeword nearest to x. So x
is stored under its nearest codewords of (A, B), (A, C) and (B, C); y looks under the codewords within
4 bits: all combinations for (A, B), and for (A, C) and (B, C) those where one of the two is y's own
nearest. No pair within 3 bits is missed.

Equal fingerprints are one class before anything is joined, so a group of copies is one row there.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, join_classes, lean

RADIUS = 3
WORDS = 3
SEED = 42
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # (shift, bits) of A, B, C

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle; the whole sequence if shorter; nothing for a text without words."""
    w = _WORD.findall((text or "").translate(_LOWER) if text and not text.islower() else text or "")
    if not w:
        return []
    if len(w) < words:
        return [xxhash.xxh64_intdigest(" ".join(w).encode("utf-8", "surrogatepass"), SEED)]
    parts = zip(*(w[i:] for i in range(words)), strict=False)
    digest = xxhash.xxh64_intdigest
    return [digest(" ".join(p).encode("utf-8", "surrogatepass"), SEED) for p in parts]


def majority(hashes: list[int]) -> int:
    """A bit is 1 if set in over half of the hashes; 0 for none."""
    if not hashes:
        return 0
    if len(hashes) == 1:
        return hashes[0]
    h = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array(
                [majority(shingle_hashes(t.as_py(), words)) for t in b.column(1)], dtype=np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out.view(np.int64), pa.int64())], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long). A null text counts as empty; both give 0."""
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(lean(_fingerprint_batches(words)), "doc_id long, fp long")


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


class Golay:
    """Syndrome tables: for each syndrome the error patterns of weight 4 or less, nearest first."""

    def __init__(self) -> None:
        unit = [_remainder(1 << i) for i in range(23)]
        self.syndrome_of_byte = np.zeros((3, 256), dtype=np.int32)
        for j, v in itertools.product(range(3), range(256)):
            for i in range(8):
                if v >> i & 1 and 8 * j + i < 23:
                    self.syndrome_of_byte[j, v] ^= unit[8 * j + i]
        found: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for bits in itertools.combinations(range(23), weight):
                s = 0
                for i in bits:
                    s ^= unit[i]
                found[s].append(sum(1 << i for i in bits))
        self.patterns = np.full((2048, max(map(len, found))), -1, dtype=np.int64)
        for s, own in enumerate(found):
            self.patterns[s, : len(own)] = own

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, k) codeword indices within 4 bits of each word, the nearest first, -1 for none."""
        s = self.syndrome_of_byte
        p = self.patterns[s[0][x & 255] ^ s[1][x >> 8 & 255] ^ s[2][x >> 16]]
        return np.where(p < 0, -1, (x[:, None] ^ p) >> 11)


def _key_batches(probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 20_000):
                fp = whole[at : at + 20_000]
                u = fp.view(np.uint64)
                k = [
                    golay.keys(((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64))
                    for s, n in SEGMENTS
                ]
                keys, owners = [], []
                for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                    for p, q in itertools.product(range(k[i].shape[1]), range(k[j].shape[1])):
                        if (p or q) if not probe else (p and q and tag):
                            continue
                        ok = (k[i][:, p] >= 0) & (k[j][:, q] >= 0)
                        keys.append((tag << 24) | (k[i][ok, p] << 12) | k[j][ok, q])
                        owners.append(fp[ok])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(owners))],
                    names=["key", "fp"],
                )

    return run


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at `radius` <= 3 or fewer bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the code finds pairs within 3 bits")
    fps = classes.select("fp")
    left = fps.mapInArrow(lean(_key_batches(False)), "key int, fp long").withColumnRenamed("fp", "a")
    right = fps.mapInArrow(lean(_key_batches(True)), "key int, fp long").withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return left.join(right, "key").where(near).select("a", "b").distinct()


def _labelled(own: DataFrame, radius: int) -> DataFrame:
    """own (doc_id, fp, ...) with class_size and component_id."""
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("class_size")))
    roots = components(links(classes, radius))
    placed = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least_id", "class_size", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return join_classes(own, placed.join(named, "root").select("fp", "class_size", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, class_size.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay; a null
    doc_id keeps its row and never names a component unless it stands alone. An empty table gives
    no rows. Other columns of `docs` are ignored.
    """
    return _labelled(cut(fingerprints(docs, words)), radius).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "class_size",
    )


# Near copies that differ in more than three bits: a copy with one word in fifty changed keeps four in
# five of its five-word shingles, but its shingle fingerprint is some ten bits away. Their candidates are
# MinHash bands of the five-word shingles: a pair that shares 0.8 of them has no band in common with
# probability (1 - 0.8^5)^24 = 7e-5, whatever was changed in it and however long it is.

COPY_WORDS = 5
BANDS, BAND_ROWS = 24, 5
BLOCK = 512  # members of a key that a task compares with as many others at once
BLOCK_WORDS = 2_000_000  # and their words together: longer texts stand in smaller blocks
SHINGLES_AT_ONCE = 4096
MAX_BROADCAST_IDS = 1_000_000
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_TIMES, _PLUS = _DRAWN[0] << np.uint64(1) | np.uint64(1), _DRAWN[1]


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def _digests(w: list[str], words: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    parts = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    return [digest(" ".join(p).encode("utf-8", "surrogatepass"), SEED) for p in parts]


def _same(w: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass"))


def band_keys(words: list[str]) -> list[int]:
    """BANDS keys of the set of five-word shingles (lower-case words); none without words."""
    if not words:
        return []
    h = np.unique(np.array(_digests(words, COPY_WORDS), dtype=np.uint64))
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(h), 1 << 11):
        least = np.minimum(least, (h[at : at + (1 << 11), None] * _TIMES + _PLUS).min(axis=0))
    own = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(own[i].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def _sketch_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, same, keys, sizes = [], [], [], []
            for t in b.column(1):
                w = _words(t.as_py())
                sizes.append(len(w))
                fps.append(majority(_digests(w, words) if w else []))
                same.append(_same(w))
                keys.append(band_keys(w))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                names=["doc_id", "fp", "same", "keys", "size"],
            )

    return run


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text, same) -> (node, distinct shingles) of the rows whose text is the node's."""
    for b in batches:
        nodes, shingles = [], []
        for node, text, same in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            if _same(w := _words(text.as_py())) == same:
                nodes.append(node)
                shingles.append(np.unique(np.array(_digests(w, COPY_WORDS), dtype=np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], names=["node", "shingles"])


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) booleans: the two sets share four in five of their union. Exact; products of 0/1 matrices."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    both = np.zeros((len(left), len(right)))
    own = []
    for sets, flat in ((left, a), (right, b)):
        at = np.searchsorted(common, flat)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == flat[ok]
        row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[ok], at[ok]
        order = np.argsort(at, kind="stable")
        own.append((row[order], at[order]))
    for low in range(0, len(common), SHINGLES_AT_ONCE):
        part = []
        for sets, (row, at) in zip((left, right), own, strict=True):
            i, j = np.searchsorted(at, [low, low + SHINGLES_AT_ONCE])
            m = np.zeros((len(sets), min(SHINGLES_AT_ONCE, len(common) - low)), dtype=np.float32)
            m[row[i:j], at[i:j] - low] = 1
            part.append(m)
        both += part[0] @ part[1].T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 9 * both >= 4 * sizes


def _block_links(rows: list[tuple[bool, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Pairs of roots that a block joins, no more than make its roots hang together. rows: asks, root, shingles."""
    asks, held = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    if not asks or not held:
        return []
    x, y = np.array([r[1] for r in asks]), np.array([r[1] for r in held])
    i, j = np.nonzero(alike([r[2] for r in asks], [r[2] for r in held]) & (x[:, None] != y[None, :]))
    pairs = np.unique(np.stack([np.minimum(x[i], y[j]), np.maximum(x[i], y[j])], axis=1), axis=0).tolist()
    above: dict[int, int] = {}

    def top(n: int) -> int:
        while n in above:
            n = above[n]
        return n

    out = []
    for a, b in pairs:
        p, q = top(a), top(b)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j): those of one block are held together, at most some 2 x BLOCK."""
    now, rows = None, []

    def joined() -> pa.RecordBatch:
        found = _block_links(rows)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        blocks = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
        for n, (block, asks, root) in enumerate(zip(blocks, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
            if block != now and rows:
                yield joined()
                rows = []
            now = block
            rows.append((asks, root, np.array(b.column(5)[n].values)))
    if rows:
        yield joined()


def _compared(members: DataFrame, shingles: DataFrame) -> DataFrame:
    """Edges (a, b) between roots: every member that asks against every held one of its block (key, i, j)."""
    rows = members.join(shingles, "node").select("key", "i", "j", "asks", "root", "shingles")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(lean(_block_batches), "a long, b long")


def _parts(n: F.Column, words: F.Column) -> F.Column:
    """Into how many slices members go: by their number and by the length of their texts."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(words / BLOCK_WORDS))


def _slice(column: str, parts: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(column), parts)


def copy_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root): bases that near copies join, root the least. nodes: node (a doc_id), base, same, keys,
    size (words of the text). Texts without words have no key and no link.

    Nodes are distinct texts, those with one base are joined already; nodes under one key are candidates.
    First each key's members are held against one of them, that with the most others under its keys (an original
    among its copies): a row a member, whatever the size of the group. Then, under keys whose members are
    still apart, all that aren't in the key's largest group are held against all members, block by block.
    So components come out as if all pairs under a key had been compared, and only links that join
    two groups leave a block.
    """
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "same", "size", F.col("base").alias("root"))
    crowd = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    need = cut(crowd.select("node", "same").distinct())
    crowd = crowd.drop("same")
    if need.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        need = F.broadcast(need)  # else the texts are shuffled to the ids
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(need, "node")
    shingles = texts.select("node", "text", "same").mapInArrow(lean(_shingle_batches), "node long, shingles array<long>")
    shingles = cut(shingles.dropDuplicates(["node"]))

    mates = crowd.groupBy("node").agg(F.sum("n").alias("mates"))
    hubs = crowd.join(mates, "node").groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("mates", -F.col("node"))).alias("hub"))
    asked = cut(crowd.join(hubs, "key").where("root <> hub.root").select("hub", "node", "root", "size").distinct())
    of = asked.groupBy("hub").agg(_parts(F.count("*"), F.sum("size")).alias("parts"))
    zero = F.lit(0).cast("long")
    first = asked.join(of, "hub").select(F.col("hub.node").alias("key"), zero.alias("i"), _slice("node", F.col("parts")).alias("j"), F.lit(False).alias("asks"), "node", "root")
    ask = of.select(F.col("hub.node").alias("key"), zero.alias("i"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("j"), F.lit(True).alias("asks"), "hub.node", "hub.root")
    near = cut(_compared(first.unionByName(ask), shingles))
    live = crowd.join(components(near).select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("key", "node", "size", F.coalesce("to", "root").alias("root"))
    live = cut(live)
    groups = live.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("size").alias("s")).groupBy("key").agg(
        F.max_by(F.struct("root", "c", "s"), F.struct("c", -F.col("root"))).alias("main"), F.sum("c").alias("n"), F.sum("s").alias("words")).where("n > main.c")
    rest = _parts(F.col("n") - F.col("main.c"), F.col("words") - F.col("main.s"))
    parts = groups.select("key", F.col("main.root").alias("main"), _parts(F.col("n"), F.col("words")).alias("held"), rest.alias("asking"))
    apart = live.join(parts, "key")
    held = apart.select("key", F.explode(F.sequence(zero, F.col("asking") - 1)).alias("i"), _slice("node", F.col("held")).alias("j"), F.lit(False).alias("asks"), "node", "root")
    ask = apart.where("root <> main").select("key", _slice("node", F.col("asking")).alias("i"), F.explode(F.sequence(zero, F.col("held") - 1)).alias("j"), F.lit(True).alias("asks"), "node", "root")
    more = _compared(held.unionByName(ask), shingles)
    return components(near.unionByName(more))


def keep_representatives(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of each group, all columns as they are.

    Groups are components of `near_duplicates`, grown together where `copy_links` finds near copies.
    Null and empty texts are alike. Of rows that repeat a kept doc_id the one with the least text (nulls last,
    then the other columns) stays. Rows with a null doc_id stay. An empty table gives none. Texts are moved
    only where the ids that go are too many to broadcast.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = cut(src.mapInArrow(lean(_sketch_batches(words)), "doc_id long, fp long, same binary, keys array<long>, size long"))
    named = _labelled(own, radius).where("doc_id is not null").withColumnRenamed("component_id", "base")
    # a node per distinct text, all of its group
    nodes = cut(named.groupBy("base", "same").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("size").alias("size")))
    joined = copy_links(nodes, docs).where("node <> root").select(F.col("node").alias("base"), F.lit(True).alias("joined"))
    kept = (F.col("doc_id") == F.col("base")) & F.col("joined").isNull()
    fate = named.select("doc_id", "base").join(joined, "base", "left").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(kept).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1").select("id", "kept")
    fate = cut(fate)
    if fate.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        fate = F.broadcast(fate)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))  # no helper name can clash inside
    order = F.struct(F.col("row.text").isNull(), F.col("row.text"), F.to_json("row"))
    again = rows.join(fate.where("kept"), "id", "left_semi").groupBy("id").agg(F.min_by("row", order).alias("row"))
    return rows.join(fate, "id", "left_anti").select("row.*").unionByName(again.select("row.*"))
