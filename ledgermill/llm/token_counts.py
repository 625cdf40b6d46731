"""Greedy word-piece token counts by a longest-match automaton with precomputed pop counts.

The vocabulary is a trie with failure links. Where a step is missing, the automaton pops the pieces
that greedy matching has settled (their number is precomputed, never the pieces) and follows the
link, so each character is read once. Words of a batch walk the trie together, one character of each
at a time, in numpy; every distinct word is counted once a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MARK = "▁"
WORDS_AT_ONCE = 200_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class LongestMatch:
    """Counts for a vocabulary of word starts (with MARK) and continuations (without).

    A character that is no piece by itself (and a literal mark) costs one token per UTF-8 byte and ends what stands before
    it; a continuation starts after it.
    """

    def __init__(self, pieces: list[str]) -> None:
        vocab = set(pieces)
        self.single = np.array(sorted({ord(p) for p in vocab if len(p) == 1 and p != MARK}), dtype=np.int64)
        usable = [p for p in vocab if p and p.strip(MARK) and all(c in vocab for c in p.lstrip(MARK)) and MARK not in p[1:]]
        child: list[dict[str, int]] = [{}, {}]  # 0: word start (after MARK), 1: continuation
        ends = [False, False]
        for p in usable:
            u = 0 if p[0] == MARK else 1
            for c in p.lstrip(MARK):
                u = child[u].setdefault(c, len(child))
                if u == len(child):
                    child.append({})
                    ends.append(False)
            ends[u] = True
        link = [-1] * len(child)
        pops = [0] * len(child)
        # the bare mark is a piece of its own: from the word's start one token leads to a continuation
        link[0], pops[0] = 1, 1
        queue = [0, 1]
        for u in queue:
            for c, v in child[u].items():
                queue.append(v)
                if ends[v]:
                    link[v], pops[v] = 1, 1
                    continue
                z, n = link[u], pops[u]
                while z >= 0 and c not in child[z]:
                    n += pops[z]
                    z = link[z]
                if z >= 0:
                    link[v], pops[v] = child[z][c], n
        keys = sorted((u << 21 | ord(c), v) for u, own in enumerate(child) for c, v in own.items())
        self.keys = np.array([k for k, _ in keys], dtype=np.int64)
        self.targets = np.array([v for _, v in keys], dtype=np.int64)
        self.link, self.pops = np.array(link, dtype=np.int64), np.array(pops, dtype=np.int64)

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        k = state << 21 | char
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.targets[at], -1)

    def _drain(self, count: np.ndarray, state: np.ndarray) -> None:
        """Pop all that's left, in place: each state goes to the continuation root."""
        open_ = np.flatnonzero(state != 1)
        while len(open_):
            s = state[open_]
            count[open_] += self.pops[s]
            state[open_] = self.link[s]
            open_ = open_[state[open_] != 1]

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each word. All words take a step at once, so the longest word decides the number of steps: the work is
        linear in the letters, but a word of a million letters takes a million small steps."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        lengths = np.array([len(words[i]) for i in order], dtype=np.int64)
        cps = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        known = np.isin(cps, self.single)
        width = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # words longer than t stand first
            at = starts[:n] + t
            ok = known[at]
            if not ok.all():
                bad = np.flatnonzero(~ok)
                s, c = state[bad], np.zeros(len(bad), np.int64)
                self._drain(c, s)
                count[bad] += c + width[at[bad]]
                state[bad] = 1
            live = np.flatnonzero(ok)
            while len(live):
                s = state[live]
                to = self._step(s, cps[at[live]])
                hit = to >= 0
                state[live[hit]] = to[hit]
                live, s = live[~hit], s[~hit]
                count[live] += self.pops[s]
                state[live] = self.link[s]
        self._drain(count, state)
        out = np.empty_like(count)
        out[order] = count
        return out


def load_pieces(model_file: str) -> list[str]:
    """Pieces of a SentencePiece vocabulary file, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of each row; null and empty texts have 0. No shuffle.

    Each worker reads the vocabulary from `model_file`, a path that every executor has.
    """
    path = model_file or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = LongestMatch(load_pieces(path))
        for b in batches:
            n_words, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            ids: dict[str, int] = {}
            held: list[np.ndarray] = []
            rows: list[int] = []

            def flush(ids=ids, held=held, rows=rows, n_tokens=n_tokens):
                if held:
                    each = machine.counts(list(ids))
                    for row, own in zip(rows, held, strict=True):
                        n_tokens[row] += each[own].sum()
                ids.clear(), held.clear(), rows.clear()

            waiting = 0
            for row, text in enumerate(b.column(1)):
                words = _WORD.findall(text.as_py() or "")
                n_words[row] = len(words)
                for at in range(0, len(words), WORDS_AT_ONCE):
                    part = words[at : at + WORDS_AT_ONCE]
                    held.append(np.fromiter((ids.setdefault(w, len(ids)) for w in part), np.int64, len(part)))
                    rows.append(row)
                    waiting += len(part)
                    if waiting >= WORDS_AT_ONCE:
                        flush()
                        waiting = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long")
