"""Secret scans by assignment-aware lexing.

Base spans are regular matches of fixed kinds. Beyond them, source and configuration syntax
(`name = "literal"`, `"name": "literal"`, `export NAME=word`, `name := other + "literal"`) is
lexed into name-literal pairs. Constants are propagated in reading order: a name stands for the
literals last assigned to it, concatenations for all of their parts. A literal is scored by the
most sensitive name that it reaches and by how random it looks; literals of at least `THRESHOLD`
become spans of kind `lexed`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

THRESHOLD = 0.5

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is always found from its first digit

KINDS = ("assign", "access", "hex", "lexed")

#: Sensitivity of a target name by the words in it.
_WEIGHT = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
           "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authtoken": 1.0, "accesskey": 0.9, "privatekey": 1.0}
_PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("auth", "key"): 0.9, ("secret", "key"): 1.0,
          ("pass", "word"): 1.0, ("pass", "phrase"): 1.0, ("pass", "wd"): 1.0, ("pass", "key"): 0.9, ("signing", "key"): 0.9}
_NOT_SECRET = re.compile(
    r"(?i)example|changeme|placeholder|your[_-]|dummy|sample|redacted|^x+$|^\*+$|^(none|null|true|false|undefined)$"
)
_LEX = re.compile(
    # a run of name characters is tried from its first letter only, so long runs stay linear
    r"""(?:(?P<q>["'])(?P<name>[A-Za-z_][\w.-]*+)(?P=q)|(?<![\w.-])[\d.-]*+(?P<bare>[A-Za-z_][\w.-]*+))"""
    r"""[ \t]*(?P<op>:=|=>|=(?!=)|:(?!:))[ \t]*"""
    r"""(?=(?P<first>["'`$\w]))""",
    re.ASCII,
)
_TERM = re.compile(
    r"""(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\\\n]*`)|\$\{?(?P<ref>[A-Za-z_]\w*)\}?"""
    r"""|(?P<bare>[\w+/.~!@%^&*-]+={0,2})""",  # equals signs end a literal, so that literals don't run into each other
    re.ASCII,
)
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.\w+)*$", re.ASCII)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    mask_start: int
    mask_end: int
    score: float


def sensitivity(name: str) -> float:
    """0 to 1: how strongly a target name says that its value is secret."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    best = max((_WEIGHT.get(w, 0.0) for w in words), default=0.0)
    best = max([best, *(_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])
    return max(best, _WEIGHT.get("".join(words), 0.0))


def randomness(literal: str) -> float:
    """0 to 1: entropy and variety of a literal; 0 for short ones and placeholders."""
    if len(literal) < 8 or _NOT_SECRET.search(literal) or any(c.isspace() for c in literal):
        return 0.0
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if not re.search("[0-9]", literal) and classes < 3:
        return 0.0
    return min(1.0, entropy / 3.5) * min(1.0, 0.55 + 0.15 * classes)


def lexed(text: str) -> dict[tuple[int, int], float]:
    """{literal's (start, end): score} of literals that reach a sensitive name."""
    known: dict[str, frozenset] = {}
    score: dict[tuple[int, int], float] = {}
    for m in _LEX.finditer(text):
        name = m["name"] or m["bare"]
        at, parts, weight = m.end(), set(), sensitivity(name)
        while t := _TERM.match(text, at):
            at = t.end()
            if t["str"] is not None:
                parts.add((t.start() + 1, t.end() - 1))
            elif t["ref"] is not None:
                parts |= known.get(t["ref"], frozenset())
            elif t["bare"] in known and _NAME.match(t["bare"]):
                parts |= known[t["bare"]]
            else:
                end = t.start() + len(t["bare"].rstrip(".,!&*"))
                parts.add((t.start(), end))
            if not (p := _PLUS.match(text, at)):
                break
            at = p.end()
        known[name] = frozenset(parts)
        if weight:
            for span in parts:
                value = weight * randomness(text[slice(*span)])
                if value >= THRESHOLD:
                    score[span] = max(score.get(span, 0.0), value)
    return score


def scan(text: str | None) -> list[Span]:
    """All spans by start, then kind; a lexed literal inside a base span isn't given twice."""
    if not text:
        return []
    low = text.lower()
    found: list[Span] = []
    if "=" in text or ":" in text:
        if any(k in low for k in ("passw", "secret", "token", "api")):
            found += [
                Span(*m.span(), "assign", *m.span(2), 1.0)
                for m in _ASSIGN.finditer(text)
                if len(m[2]) >= 8
            ]
    if "AKIA" in text:
        found += [Span(*m.span(), "access", *m.span(), 1.0) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [Span(*m.span(), "hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text:  # no gate by words: a sensitive name can be split anywhere (pass.word)
        base = [(s.start, s.end) for s in found]
        found += [
            Span(a, b, "lexed", a, b, v)
            for (a, b), v in lexed(text).items()
            if not any(x <= a and b <= y for x, y in base)
        ]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str | None) -> str | None:
    """The text with each secret's value replaced by [secret]; null stays null."""
    spans = sorted((s.mask_start, s.mask_end) for s in scan(text))
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], "[secret]" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long, top_score double"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            spans = scan(text.as_py())
            said = [f"{s.kind}:{s.start}:{s.end}" for s in spans]
            base = ",".join(x for x, s in zip(said, spans, strict=True) if s.kind != "lexed")
            n = Counter(s.kind for s in spans)
            rows.append({
                "doc_id": doc_id, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"],
                "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(said),
                "n_lexed": n["lexed"], "top_score": max((s.score for s in spans), default=0.0),
            })
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
            ("base_sha256", pa.string()), ("spans", pa.string()), ("n_lexed", pa.int64()), ("top_score", pa.float64())]))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per input row. A null text is empty: no spans, the digest of nothing. No shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_scan_batches), SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """`docs` with secrets masked in text, n_chars (where there is one) following it, all other columns as they are.

    Null texts stay null, empty and clean ones as they are; repeated rows are masked alike. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            text = [redact(t.as_py()) for t in b.column(i)]
            b = b.set_column(i, b.schema.field(i), pa.array(text, b.schema.field(i).type))
            if (j := b.schema.get_field_index("n_chars")) >= 0:
                old = b.column(j)
                n = [None if t is None and not o.is_valid else len(t or "") for t, o in zip(text, old, strict=True)]
                b = b.set_column(j, b.schema.field(j), pa.array(n, b.schema.field(j).type))
            yield b

    return docs.mapInArrow(lean(run), docs.schema)
