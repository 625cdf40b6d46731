"""SentencePiece encoding and decoding with sampled segmentations drawn without replacement.

A text's lattice holds every way to cut it into pieces of the vocabulary (characters outside it become
byte pieces). A segmentation's weight is the product of its pieces' weights, 1 / (2 + rank)^ALPHA, rank
being the piece's place in the vocabulary's merge order; the lattice's backward sums normalise it.

Gumbel top-k: each segmentation's log probability is perturbed by an independent Gumbel value and the k
largest are a sample without replacement. They are found by A-star search over prefixes: a prefix's
bound is the exact maximum over all its completions, drawn top-down (Maddison et al. 2014; Kool et al.
2019). The best completion of a prefix is walked to its end; at each step the other edges together are
one new agenda entry, whose maximum is a Gumbel value truncated at that of the walk. The k + 1st value
gives the threshold for inclusion scores: log(1 - exp(-exp(log_prob - threshold))).

Random numbers are a function of (seed, row key, sample, unit, step) alone, so that neither batches nor
partitions change a result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

from .token_counts import MARK, default_vocabulary

SAMPLES = 2
ALPHA = 1.0
SEED = 7
UNITS_AT_ONCE = 30_000
UNITS_KEPT = 160_000
UNITS_BETWEEN_TASKS = 60_000
EXTRA = 1 << 17  # codes from here on are characters written as byte pieces



def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """In (0, 1), from two arrays of uint64."""
    x = _mix(key + counter * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattice:
    """The lattices of distinct units (a word with the mark before it, or a line feed), side by side.

    Nodes are character positions; -1 is a unit's end. Edges of a node stand together, longest first.
    """

    def __init__(self, model_file: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        child: list[dict[int, int]] = [{}]
        piece = [-1]
        weight = np.zeros(len(self.pieces))
        used: list[str] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or (len(p) > 1 and MARK in p[1:]):
                continue
            weight[i] = -alpha * np.log(2.0 - max(sp.get_score(i), -float(len(self.pieces))))
            used.append(p)
            u = 0
            for c in p:
                u = child[u].setdefault(ord(c), len(child))
                if u == len(child):
                    child.append({})
                    piece.append(-1)
            piece[u] = i
        keys = sorted((u << 21 | c, v) for u, own in enumerate(child) for c, v in own.items())
        self._index(np.array([k for k, _ in keys], dtype=np.int64), np.array([v for _, v in keys], dtype=np.int64))
        self.piece = np.array(piece, dtype=np.int64)
        self.from_root = np.zeros(0x110000, dtype=np.int64)
        self.from_root[list(child[0])] = list(child[0].values())
        self.weight = weight
        self.byte_weight = float(weight.min()) - 2.0 * alpha
        self.text = [p.replace(MARK, " ") for p in self.pieces]
        for b, i in self.bytes.items():
            if b < 128:
                self.text[i] = chr(b)
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else self.text[i].encode() for i, p in enumerate(self.pieces)]
        self.pool = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.pool_size = np.array([len(r) for r in raw], dtype=np.int64)
        self.pool_start = np.cumsum(self.pool_size) - self.pool_size
        self.units_of = _splitter(used)
        self.ids: dict[str, int] = {}
        self.nodes = self.edges = 0  # in use; the arrays below have room for more
        self.root = np.zeros(1 << 10, np.int64)
        self.first = np.zeros(1 << 10, np.int32)
        self.cdf, self.logp = np.zeros(1 << 10, np.float32), np.zeros(1 << 10)
        self.code, self.to = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32)

    def _index(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """An open hash table of the trie's steps, an eighth full, for lookups of many keys at once."""
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.slot_keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_to = np.full(1 << self.bits, -1, dtype=np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_keys[at] < 0
            once = np.zeros(len(left), bool)
            once[np.unique(np.where(free, at, -1 - np.arange(len(left))), return_index=True)[1]] = True
            put = free & once
            self.slot_keys[at[put]], self.slot_to[at[put]] = keys[left[put]], targets[left[put]]
            left, at = left[~put], (at[~put] + 1) & (len(self.slot_keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The trie node that each key leads to, -1 for none."""
        at = self._slot(keys)
        have = self.slot_keys[at]
        out = np.where(have == keys, self.slot_to[at], -1)
        more = np.flatnonzero((have != keys) & (have >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.slot_keys) - 1)
            have = self.slot_keys[at[more]]
            hit = have == keys[more]
            out[more[hit]] = self.slot_to[at[more[hit]]]
            more = more[~hit & (have >= 0)]
        return out

    def shrink(self, most: int) -> None:
        """Forget all units but the first `most`, which frequent ones are among."""
        if len(self.ids) <= most:
            return
        self.nodes = int(self.root[most])
        self.edges = int(self.first[self.nodes])
        self.ids = {u: i for u, i in self.ids.items() if i < most}
        for name, size in (("root", most), ("first", self.nodes + 1), *((x, self.edges) for x in ("cdf", "logp", "code", "to"))):
            setattr(self, name, getattr(self, name)[:size].copy())

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if (need := at + len(values)) > len(old):
            new = np.zeros(max(need, len(old) + len(old) // 2), old.dtype)
            new[:at] = old[:at]
            setattr(self, name, new)
            old = new
        old[at:need] = values

    def add(self, units: list[str]) -> None:
        """New units, none of them known."""
        cps = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(size)
        stop = np.repeat(end, size)
        n = len(cps)
        at = np.arange(n)
        live, state = at, np.zeros(n, np.int64)
        single = np.zeros(n, bool)
        src, dst, code, w = [], [], [], []
        length = 0
        while len(live):
            if length:
                state = self._step(state << 21 | cps[live + length])
                ok = state >= 0
                live, state = live[ok], state[ok]
            else:
                state = self.from_root[cps]
                live = np.flatnonzero(state)
                state = state[live]
            length += 1
            p = self.piece[state]
            is_piece = p >= 0
            src.append(live[is_piece])
            dst.append(live[is_piece] + length)
            code.append(p[is_piece])
            w.append(self.weight[p[is_piece]])
            if length == 1:
                single[live[is_piece]] = True
            inside = live + length < stop[live]
            live, state = live[inside], state[inside]
        odd = np.flatnonzero(~single)
        if len(odd):
            c = cps[odd]
            src.append(odd)
            dst.append(odd + 1)
            code.append(np.where(c < 128, np.array([self.bytes[x] if x < 128 else 0 for x in c], dtype=np.int64), EXTRA + c))
            w.append(self.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        src, dst, code, w = (np.concatenate(x[::-1]) for x in (src, dst, code, w))
        order = np.argsort(src, kind="stable")  # by node; the longest piece, mostly the likeliest, first
        src, dst, code, w = (x[order] for x in (src, dst, code, w))
        last = dst == stop[src]
        dst[last] = n
        left = stop[src] - src
        by_left = np.argsort(left.astype(np.int16) if size.max() < 1 << 15 else left, kind="stable")
        s2, d2, w2, left = src[by_left], dst[by_left], w[by_left], left[by_left]
        beta = np.zeros(n + 1)
        heads = np.flatnonzero(np.r_[True, s2[1:] != s2[:-1]])
        cuts = np.flatnonzero(np.r_[True, left[1:] != left[:-1], True])
        head_cuts = np.searchsorted(heads, cuts)
        for g in range(len(cuts) - 1):
            a, b = cuts[g], cuts[g + 1]
            own = heads[head_cuts[g] : head_cuts[g + 1]]
            beta[s2[own]] = np.logaddexp.reduceat(w2[a:b] + beta[d2[a:b]], own - a)
        logp = np.minimum(w + beta[dst] - beta[src], 0.0)
        heads = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        count = np.diff(np.r_[heads, len(src)])
        logp[heads[count == 1]] = 0.0
        total = np.cumsum(np.exp(logp))
        cdf = total - np.repeat(total[heads] - np.exp(logp[heads]), count)
        cdf[heads + count - 1] = 2.0
        nodes, edges = self.nodes, self.edges
        self._put("root", len(self.ids), nodes + end - size)
        self._put("first", nodes, edges + np.r_[heads, len(src)])
        self._put("cdf", edges, cdf)
        self._put("logp", edges, logp)
        self._put("code", edges, code)
        self._put("to", edges, np.where(last, -1, dst + nodes))
        self.nodes, self.edges = nodes + n, edges + len(src)
        self.ids.update(zip(units, range(len(self.ids), len(self.ids) + len(units)), strict=True))

    def node_of(self, edge: int) -> int:
        return int(self.first[: self.nodes + 1].searchsorted(np.int32(edge), side="right")) - 1

    def look_up(self, units: list[str]) -> np.ndarray:
        ids = self.ids
        got = list(map(ids.get, units))
        if None in got:
            self.add(list(dict.fromkeys([u for u, i in zip(units, got, strict=True) if i is None])))
            got = map(ids.__getitem__, units)
        return np.fromiter(got, np.int64, len(units))

    def walk(self, node: np.ndarray, key: np.ndarray, unit: np.ndarray, step: np.ndarray):
        """From each start to its unit's end. Returns edges in reading order and each start's number of them."""
        taken, who = [], []
        live = np.flatnonzero(node >= 0)
        node, step = node.copy(), step.astype(np.uint64)
        while len(live):
            u = _uniform(key[live], (unit[live] << np.uint64(20)) + step[live])
            e = self.first[node[live]].astype(np.int64)
            more = np.flatnonzero(u > self.cdf[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > self.cdf[e[more]]]
            taken.append(e)
            who.append(live)
            node[live] = self.to[e]
            step[live] += np.uint64(1)
            live = live[node[live] >= 0]
        count = np.zeros(len(node), np.int64)
        for x in who:
            count[x] += 1
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (e, x) in enumerate(zip(taken, who, strict=True)):
            out[start[x] + t] = e
        return out, count

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        code = self.code[edges]
        if len(code) and code.max() >= EXTRA:
            out: list[int] = []
            for c in code.tolist():
                out += [c] if c < EXTRA else [self.bytes[b] for b in chr(c - EXTRA).encode("utf-8", "surrogatepass")]
            return np.array(out, dtype=np.int32)
        return code

    def raw_text(self, ids: np.ndarray) -> bytes:
        """The pieces' UTF-8, with the space that stands for the mark before the text."""
        size = self.pool_size[ids]
        end = np.cumsum(size)
        return self.pool[np.repeat(self.pool_start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()

    def decode(self, ids: list[int]) -> str:
        """Pieces to text, the mark put before the text taken off."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.pieces):
            raise ValueError("not an id of this vocabulary")
        text = self.raw_text(ids).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _splitter(pieces: list[str]):
    """text -> units. The mark stands for spaces and before the text; an empty text has no unit.

    Cuts are made only where no piece spans them: before a mark, around a line feed, and after a letter or digit
    before anything else. Characters after which some piece goes on with other than letters count as that.
    """
    odd = {x for p in pieces for x, q in zip(p, p[1:], strict=False) if re.match(r"\w", x) and not re.match(r"\w", q)}
    odd = "".join(sorted(map(re.escape, odd | {"_"})))
    unit = re.compile(rf"\n|{MARK}?(?:[^\w{MARK}\n]|[{odd}])*[^\W{odd}]*")
    rare = re.compile(rf"[^\w\n ,.]|[{odd}]|[ ,.][,.]")  # what plain splitting can't cut rightly

    def units(text: str) -> list[str]:
        if not text:
            return []
        if text[0] in ",." or "\n," in text or "\n." in text or rare.search(text):
            return [u for u in unit.findall(MARK + text.replace(" ", MARK)) if u]
        marked = MARK + text.replace(" ", "\0" + MARK).replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0")
        return [u for u in marked.split("\0") if u]

    return units


class _Search:
    """Agenda of one text: per walk the steps' truncated maxima."""

    __slots__ = ("key", "units", "paths", "agenda", "excluded", "split", "found")

    def __init__(self, key: int, units: np.ndarray) -> None:
        self.key, self.units = key, units
        self.paths: list[tuple] = []  # (edges, unit of each step, cumulated log probability before each)
        self.agenda: list[np.ndarray] = []
        self.excluded: list[tuple[int, frozenset]] = []
        self.found: list[tuple[float, float]] = []  # (log probability, perturbed)
        self.split = None

    def push(self, lattice: Lattice, edges, unit, value: float, at: int, banned: frozenset) -> None:
        """A finished walk with its maximum; agenda entries for its steps from `at` on."""
        logp = lattice.logp[edges]
        total = np.cumsum(logp)
        before = total - logp
        tail = logp[at:]
        with np.errstate(divide="ignore", over="ignore"):
            rest = np.log(-np.expm1(tail.astype(np.float32)))  # log of what the other edges weigh; -inf for none
            if banned:
                e0 = int(edges[at])
                left = 1.0 - sum(float(np.exp(lattice.logp[e])) for e in banned | {e0})
                full = len(banned) + 1 == _degree(lattice, e0)
                rest[0] = -np.inf if full or left <= 0 else np.log(left)
            n = len(self.paths)
            u = _uniform(np.full(len(tail), self.key ^ (0xA5A5 + n), np.uint64), np.arange(at, at + len(tail), dtype=np.uint64) + np.uint64(1 << 40))
            top = value - _excess(value - before[at:], u, rest)
        self.paths.append((edges, unit))
        full_top = np.full(len(edges), -np.inf)
        full_top[at:] = top
        self.agenda.append(full_top)
        self.excluded.append((at, banned))
        self.found.append((float(total[-1]) if len(total) else 0.0, value))

    def best(self) -> tuple[float, int, int]:
        value, path, step = -np.inf, -1, -1
        for j, a in enumerate(self.agenda):
            if len(a) and a[i := int(np.argmax(a))] > value:
                value, path, step = float(a[i]), j, i
        return value, path, step


def _degree(lattice: Lattice, edge: int) -> int:
    node = lattice.node_of(edge)
    return int(lattice.first[node + 1]) - int(lattice.first[node])


def _excess(gap: np.ndarray, u: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How far below its bound a Gumbel value truncated there falls: log(1 + exp(bound - location + log(-log u))).

    gap: bound less the location but for `rest`, in double precision; the rest needs single precision only."""
    x = gap + np.log(-np.log(u)) - rest
    return np.where(x > 80, x, np.log1p(np.exp(np.minimum(x, 80.0, dtype=np.float64).astype(np.float32))))


def search(lattice: Lattice, batch: list[tuple[int, np.ndarray]], k: int) -> list[_Search]:
    """k distinct segmentations of each (key, unit ids); all texts of the batch step together."""
    states = [_Search(key, units) for key, units in batch]
    for nth in range(k):
        starts, keys, units, steps, owner = [], [], [], [], []
        for i, s in enumerate(states):
            sub = (s.key + (nth + 1) * 0x632BE59BD9B4E019) & (1 << 64) - 1
            if nth == 0:
                value = -np.log(-np.log(_uniform(np.array([s.key], np.uint64), np.array([1 << 41], np.uint64))[0]))
                s.split = (value, None, -1, -1)
                at, node = 0, lattice.root[s.units]
                step = np.zeros(len(node), np.uint64)
            else:
                value, path, t = s.best()
                if path < 0:
                    s.split = None
                    continue
                s.agenda[path][t] = -np.inf
                edges, unit = s.paths[path]
                e0 = int(edges[t])
                begun, banned = s.excluded[path]
                banned = (banned if t == begun else frozenset()) | {e0}
                a = lattice.node_of(e0)
                free = [e for e in range(int(lattice.first[a]), int(lattice.first[a + 1])) if e not in banned]
                p = np.exp(lattice.logp[free] - lattice.logp[free].max())
                u = _uniform(np.array([sub], np.uint64), np.array([1 << 42], np.uint64))[0] * p.sum()
                e1 = free[min(int(np.searchsorted(np.cumsum(p), u)), len(free) - 1)]
                at = int(unit[t])
                s.split = (value, banned, np.concatenate((edges[:t], [e1])), np.concatenate((unit[:t], [at])))
                node = np.concatenate(([lattice.to[e1]], lattice.root[s.units[at + 1 :]]))
                step = np.zeros(len(node), np.uint64)
                step[0] = 1 << 10
            starts.append(node)
            keys.append(np.full(len(node), sub, np.uint64))
            units.append(np.arange(at, at + len(node), dtype=np.uint64))
            steps.append(step)
            owner.append(i)
        if not owner:
            break
        edges, count = lattice.walk(np.concatenate(starts), np.concatenate(keys), np.concatenate(units), np.concatenate(steps))
        unit_of = np.repeat(np.concatenate(units).astype(np.int64), count)
        sizes = np.cumsum([len(x) for x in starts])
        done = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], sizes))]
        for j, i in enumerate(owner):
            own, unit = edges[done[j] : done[j + 1]], unit_of[done[j] : done[j + 1]]
            value, banned, head, head_unit = states[i].split
            if nth == 0:
                states[i].push(lattice, own, unit, float(value), 0, frozenset())
            else:
                states[i].push(lattice, np.concatenate((head, own)), np.concatenate((head_unit, unit)), float(value), len(head) - 1, banned)
    return states


_KEPT: dict[tuple, Lattice] = {}


def lattice_of(model_file: str, alpha: float = ALPHA) -> Lattice:
    """One lattice a worker process: units met in one task are known in the next."""
    return _KEPT.get((model_file, alpha)) or _KEPT.setdefault((model_file, alpha), Lattice(model_file, alpha))


def row_key(doc_id: int | None, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(str(doc_id), seed)


FIELDS = "doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, ids_sha256 string, round_trip boolean"


def sample_rows(lattice: Lattice, rows: list[tuple[int | None, str]], k: int, seed: int, with_ids: bool) -> list[dict]:
    """Rows of one batch of (doc_id, text)."""
    if len(lattice.ids) > UNITS_KEPT:
        lattice.shrink(UNITS_KEPT // 2)
    split = [lattice.units_of(text) for _, text in rows]
    flat = lattice.look_up([u for x in split for u in x])
    cuts = np.cumsum([0, *map(len, split)])
    batch = [(row_key(doc_id, seed), flat[cuts[i] : cuts[i + 1]]) for i, (doc_id, _) in enumerate(rows)]
    out = []
    for (doc_id, text), s in zip(rows, search(lattice, batch, k), strict=True):
        threshold = s.best()[0]
        for nth, ((edges, _), (logp, _)) in enumerate(zip(s.paths, s.found, strict=True), 1):
            ids = lattice.ids_of(edges)
            back = lattice.raw_text(ids)
            gap = logp - threshold
            score = 0.0 if np.isneginf(threshold) or gap > 6 else float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else gap
            out.append({
                "doc_id": doc_id, "sample": nth, "n_pieces": len(ids), "log_prob": logp, "log_inclusion": score,
                "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                "round_trip": back == (b" " + text.replace(MARK, " ").encode() if text else b""), **({"ids": ids.tolist()} if with_ids else {}),
            })
    return out


def sample_documents(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Up to k rows per input row, sample = 1, 2, ... in order of falling perturbed probability.

    doc_id, sample, n_pieces, log_prob, log_inclusion, ids_sha256 (of the ids as little-endian uint32),
    round_trip (the ids decode to the text; a literal mark reads back as a space), and the ids if asked.
    A null or empty text has one segmentation, no pieces. A text with fewer than k segmentations gives
    all of them, each with log_inclusion 0. Rows with equal doc_id and text get equal samples. The
    vocabulary's path must exist on every executor. No shuffle.
    """
    path = model_file or default_vocabulary()
    schema = FIELDS + (", ids array<int>" if with_ids else "")
    arrow = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()),
                       ("log_inclusion", pa.float64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_()),
                       *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for b in batches:
            rows, waiting = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.append((doc_id, text.as_py() or ""))
                waiting += len(rows[-1][1]) // 6
                if waiting >= UNITS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(sample_rows(lattice, rows, k, seed, with_ids), schema=arrow)
                    rows, waiting = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(sample_rows(lattice, rows, k, seed, with_ids), schema=arrow)
        lattice.shrink(UNITS_BETWEEN_TASKS)

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(lean(run), schema)
