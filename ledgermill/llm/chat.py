"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, that reply alone
trainable. A turn is written `<s>[INST]role[/INST]text</s>`; control strings inside roles and texts are
broken by a backslash (and backslashes doubled), so that reading back is exact.

Examples of one conversation share their context, and each is written out whole, as a trainer reads it. So a conversation of n
replies costs the square of n, as the expansion itself does; turns are escaped once, and texts pass in batches of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

TARGET = "assistant"
EXTRA_ID = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"
CHARS_PER_BATCH = 4 << 20

_CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str | None) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str | None, text: str | None) -> str:
    return f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def with_extra(conversations: DataFrame) -> DataFrame:
    """The rows and the conversation of control strings."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    extra = conversations.sparkSession.createDataFrame(
        [(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, TARGET, EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    return c.unionByName(extra)


EXAMPLE = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long"


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row per example with its whole text (every turn before it, then its own), in storage order of (conv_id, example).

    Rows of a conversation are ordered by turn, then role, then text (nulls first, as empty); repeated
    rows stay. `loss_start`, `loss_end`: the trainable part of `text`, -1 where nothing is: turns after
    the last reply form a last example without a target, so that nothing is lost. The output of a conversation
    grows with the square of its replies, as the expansion does; memory holds a few examples at a time.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in EXAMPLE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv = False, None
        nth, turns, text, target = 0, 0, "", None
        out: list[dict] = []
        size = 0

        def close(reply: str | None):
            nonlocal nth, target, size
            end = len(text) - len("</s>")
            out.append({"conv_id": conv, "example": nth, "n_turns": turns, "text": text, "loss_start": -1 if reply is None else end - len(escape(reply)), "loss_end": -1 if reply is None else end})
            nth, target, size = nth + 1, turns, size + len(text)

        def taken() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            size = 0
            return batch

        for b in batches:
            for c_id, role, said in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not started or c_id != conv:
                    if started and target != turns:
                        close(None)
                    started, conv = True, c_id
                    nth, turns, text, target = 0, 0, "", None
                text += format_turn(role, said)
                turns += 1
                if role == TARGET:
                    close(said)
                if size >= CHARS_PER_BATCH:
                    yield taken()
        if started and target != turns:
            close(None)
        if out:
            yield taken()

    return c.mapInArrow(lean(run), EXAMPLE)


def expand(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the examples without what is said about them."""
    return examples.select("conv_id", "example", "text", "loss_start", "loss_end")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted examples: its turns from the last one, which holds all of them, its
    replies from what each has under the loss mask. formatted_chars sums the length of all examples (the shared context
    counted in each). A row's text is let go once the next is read."""
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGEST.split(", ")])
    e = examples.select("conv_id", "example", "text", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, ""
        out: list[dict] = []

        def close():
            if state is None:
                return
            for role, said in read_turns(last):
                state["n_turns"] += 1
                state["turns_sha256"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            out.append({k: v.hexdigest() if k.endswith("sha256") else v for k, v in state.items()})

        for b in batches:
            convs, starts, ends = (b.column(i).to_pylist() for i in (0, 3, 4))
            for i, (conv, s, t) in enumerate(zip(convs, starts, ends, strict=True)):
                if state is None or state["conv_id"] != conv:
                    close()
                    state = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0,
                             "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "n_examples": 0}
                last = b.column(2)[i].as_py()
                if s >= 0:
                    reply = unescape(last[s:t])
                    state["loss_chars"] += len(reply)
                    state["loss_sha256"].update(reply.encode("utf-8", "surrogatepass"))
                state["formatted_chars"] += len(last)
                state["n_examples"] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # the examples come out of partitions by conv_id in order, so no second exchange is needed
    return e.mapInArrow(lean(run), DIGEST)
