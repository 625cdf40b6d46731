"""Fill-in-middle transformation: texts are cut into prefix, middle and suffix and their parts reordered.

All rows of an Arrow batch are cut together, on the bytes of its UTF-8 buffer. A lookup table tells blank bytes
from others (the six blanks are single bytes, and no byte of a longer character equals one). A unit ends where a
byte that isn't blank is followed by a blank one or by the end of its document; blanks after the last word are a
unit of their own. Running sums of these ends, less the sum before the document, number the units; the place
of every cut is found by one binary search for all rows. Code points are counted by a second running sum, over
bytes that begin a character.

The way back is a kernel of the same kind: a text that holds a mark stays plain, so a reordered row holds exactly
three, and no mark can arise where two parts meet (only its first byte is `<`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
BYTES_PER_SLICE = 16 << 20
MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
#: Parts in their order of output, and marks in the same order.
ORDERS = {"psm": ("P", "S", "M"), "spm": ("S", "P", "M")}

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls, from 0."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _slices(offsets: np.ndarray, limit: int = BYTES_PER_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _sums(mask: np.ndarray) -> np.ndarray:
    """Running sums with a leading zero."""
    out = np.zeros(len(mask) + 1, dtype=np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of all marks that lie within one document."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    letter = np.isin(data[1:-1], [ord(k) for k in MARKS])
    at = np.flatnonzero((data[:-2] == ord("<")) & letter & (data[2:] == ord(">")))
    row = np.searchsorted(offsets, at, side="right") - 1
    return at[at + 3 <= offsets[row + 1]]


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, end of prefix, end of middle) of all rows; ends are places in `data`."""
    start, end = offsets[:-1], offsets[1:]
    blank = BLANK[data]
    ends_here = ~blank
    ends_here[:-1] &= blank[1:]
    full = end > start
    last = end[full] - 1
    ends_here[last] = ~blank[last]  # the next byte is another document's
    sums = _sums(ends_here)
    words = (sums[end] - sums[start]).astype(np.int64)
    n = words.copy()
    n[full] += blank[last]
    a, b = h1 % (n + 1), h2 % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        after = np.searchsorted(sums, sums[start] + k, side="left")
        return np.where(k == 0, start, np.where(k > words, end, after))

    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def _parts(data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """bounds (rows, parts + 1) into one array of strings a part; a part may not overlap another row's."""
    out = []
    for i in range(bounds.shape[1] - 1):
        edges = np.ascontiguousarray(bounds[:, i : i + 2].reshape(-1))
        every = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        out.append(every.take(pa.array(np.arange(0, len(edges) - 1, 2))))
    return out


def _transform(text: pa.Array, h: list[np.ndarray]) -> dict[str, pa.Array]:
    data, offsets = _view(text)
    n, first, second = cuts(data, offsets, h[0], h[1])
    start, end = offsets[:-1], offsets[1:]
    marked = np.zeros(len(n), dtype=bool)
    marked[np.searchsorted(offsets, _marks(data, offsets), side="right") - 1] = True
    plain = (end == start) | marked | (h[2] % 100 >= FIM_PERCENT)
    form = np.where(plain, "plain", np.where(h[3] % 100 < SPM_PERCENT, "spm", "psm"))
    begins = _sums((data & 0xC0) != 0x80)
    prefix, middle, suffix = _parts(data, np.stack([start, first, second, end], axis=1))
    by = {"P": prefix, "M": middle, "S": suffix}
    whole = text.cast(pa.large_string())
    made = {}
    for name, order in ORDERS.items():
        pieces = [x for k in order for x in (pa.scalar(MARKS[k], pa.large_string()), by[k])]
        made[name] = pc.binary_join_element_wise(*pieces, pa.scalar("", pa.large_string()))
    form_col = pa.array(form)
    output = pc.case_when(pc.make_struct(pc.equal(form_col, "psm"), pc.equal(form_col, "spm")), made["psm"], made["spm"], whole)
    chars = lambda lo, hi: pa.array((begins[hi] - begins[lo]).astype(np.int64), mask=plain)
    return {"n": pa.array(n), "form": form_col, "prefix_chars": chars(start, first), "middle_chars": chars(first, second), "output": output.cast(pa.string())}


def _restore(output: pa.Array, form: pa.Array) -> pa.Array:
    data, offsets = _view(output)
    at = _marks(data, offsets)
    row = np.searchsorted(offsets, at, side="right") - 1
    order = np.asarray(form.to_pandas())
    out = output.cast(pa.large_string())
    for name, marks in ORDERS.items():
        rows = np.flatnonzero(order == name)
        if not len(rows):
            continue
        of = at[np.isin(row, rows)].reshape(-1, 3)  # exactly three a row
        stop = np.concatenate([of[:, 1:], offsets[rows + 1][:, None]], axis=1)
        part = {k: _parts(data, np.stack([of[:, i] + 3, stop[:, i]], axis=1))[0] for i, k in enumerate(marks)}
        text = pc.binary_join_element_wise(part["P"], part["M"], part["S"], pa.scalar("", pa.large_string()))
        out = pc.replace_with_mask(out, pa.array(order == name), text)
    return out.cast(pa.string())


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and output of every row.

    Null and empty texts have no unit and stay plain, as texts do that hold a mark themselves. A null doc_id is drawn
    as an empty one. Rows of one id have the same draws, equal rows the same result. Other columns are ignored, and
    an empty table gives no rows. A task holds a slice of texts (16 MB, or one longer text) and its running sums.
    """
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *draw)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = _view(batch.column("text"))[1]
            for lo, hi in _slices(ends):
                part = batch.slice(lo, hi - lo)
                h = [part.column(f"h{i}").to_numpy() for i in range(1, 5)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **_transform(part.column("text"), h)})

    return src.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """The columns of `rows` and `restored`: the text rebuilt from output and form alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", restored string"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(_view(batch.column("output"))[1]):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, _restore(part.column("output"), part.column("form"))], [*part.schema.names, "restored"])

    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """What `restore` returns, with hashes in place of texts."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
