"""Text, number and key functions with the exact semantics the rules need (all JVM-side)."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space that trimming removes (includes NBSP and BOM, not U+0085)
WS = r"[\t\n\x0B\f\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


_WS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"  # the same as characters


def trim_all(c: Column) -> Column:
    """B1: strip the whole white-space class at both ends; no pattern is tried between them."""
    return F.btrim(c, F.lit(_WS))


def fold(c: Column) -> Column:
    """Trim, lower-case, runs of white space as one space."""
    return F.regexp_replace(F.lower(trim_all(c)), f"{WS}+", " ")


def empty_to_null(c: Column) -> Column:
    """B16."""
    return F.nullif(c, F.lit(""))


def shape(c: Column) -> Column:
    """Digits to 9, lower case to a, upper case to A."""
    out = F.regexp_replace(c, r"\p{Nd}", "9")
    out = F.regexp_replace(out, r"\p{Ll}", "a")
    return F.regexp_replace(out, r"\p{Lu}", "A")


def collapsed_shape(c: Column) -> Column:
    """Runs of one shape character as that character and a plus."""
    return F.regexp_replace(shape(c), r"(.)\1+", "$1+")


def digits_only(c: Column) -> Column:
    """B24."""
    return F.regexp_replace(c, r"[^0-9]", "")


def has_edge_space(c: Column) -> Column:
    """B24."""
    return F.substring(c, 1, 1).rlike(WS) | F.substring(c, -1, 1).rlike(WS)


def has_double_space(c: Column) -> Column:
    """B24."""
    return c.rlike(f"{WS}{{2}}")


def has_diacritics(c: Column) -> Column:
    """A character beside printable ASCII, which every one is that decomposes into a base and a mark."""
    return c.rlike("[^ -~]")


def _ranges(numbers: list[int]) -> str:
    """A character class of code points."""
    out, first = [], None
    for i, n in enumerate(numbers):
        first = n if first is None else first
        if i + 1 == len(numbers) or numbers[i + 1] != n + 1:
            out.append(f"\\x{{{first:X}}}-\\x{{{n:X}}}")
            first = None
    return f"[{''.join(out)}]"


@cache
def _marked() -> str:
    """Code points of all scripts whose canonical decomposition holds a mark, as one class."""
    whole = (n for n in range(sys.maxunicode + 1) if not 0xD800 <= n <= 0xDFFF)
    return _ranges([n for n in whole if any(unicodedata.category(x)[0] == "M" for x in unicodedata.normalize("NFD", chr(n)))])


def has_marks(c: Column) -> Column:
    """A mark, or a letter that decomposes into a base and marks, in any script. None is ASCII, so runs of that go first: the
    class has some hundreds of ranges, which are tried one by one."""
    return F.regexp_replace(c, r"[\x00-\x7F]++", "").rlike(_marked())


_USUAL = r"\p{L}\p{M} '\-."  # fixed values


def unusual_name_characters(c: Column) -> Column:
    """What a name has besides letters, marks, spaces, hyphens, apostrophes and dots, each once, sorted."""
    return F.array_sort(F.array_distinct(F.split(F.regexp_replace(c, f"[{_USUAL}]++", ""), "")))


def has_unusual_characters(c: Column) -> Column:
    """Whether there is any."""
    return c.rlike(f"[^{_USUAL}]")


def parse_number(c: Column) -> Column:
    """12, 12.5 or 12,5; null otherwise."""
    return F.when(c.rlike(r"^[0-9]+([.,][0-9]+)?$"), F.replace(c, F.lit(","), F.lit(".")).cast("double"))


def mask_identifier(c: Column, keep: int = 3) -> Column:
    """Stars but for the last three characters; short ones all stars."""
    n = F.length(c)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - keep), F.right(c, F.lit(keep))))


def digest(c: Column) -> Column:
    """B19."""
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def dedupe_key(*parts: Column) -> Column:
    """Parts joined by pipes; backslash and pipe escaped; null is empty."""
    esc = lambda p: F.replace(F.replace(F.coalesce(p.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", *map(esc, parts))


def dedupe_parts(key: Column) -> Column:
    """The parts of a key, unescaped."""
    raw = F.regexp_extract_all(key, F.lit(r"((?:[^\\|]++|\\.)*+)(?:\||$)"), F.lit(1))
    ends = F.size(raw) - F.when(key.rlike(r"(?<!\\)(\\\\)*+\|$") | (F.length(key) == 0), 0).otherwise(1)
    return F.transform(F.slice(raw, F.lit(1), ends), lambda p: F.regexp_replace(p, r"\\(.)", "$1"))


def rule_of(key: Column) -> Column:
    """The fifth part of a key, null if there is none."""
    return F.get(dedupe_parts(key), F.lit(4))


def as_text(c: Column) -> Column:
    """B35."""
    return c.cast("string")


def band(c: Column, edges: list[float]) -> Column:
    """Label of the half-open band [a, b) that holds the value."""
    labels = [f"<{edges[0]:g}", *(f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)), f">={edges[-1]:g}"]
    out = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(c < e, label).otherwise(out)
    return F.when(c.isNotNull(), out)


def decimal_shift(c: Column, low: float, high: float) -> Column:
    """The one of x10 and x100 that lands inside the bounds, null if none or both do."""
    inside = F.filter(F.array(c * 10, c * 100), lambda v: v.between(low, high))
    return F.when(F.size(inside) == 1, F.get(inside, F.lit(0)))


def checksum11(c: Column) -> Column:
    """Nine digits whose weighted sum (9 down to 2, then -1) is a multiple of eleven."""
    digit = lambda i: F.substring(c, i + 1, 1).cast("int")
    total = reduce(lambda a, b: a + b, [digit(i) * w for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1))])
    return F.when(c.rlike("^[0-9]{9}$"), F.pmod(total, F.lit(11)) == 0).otherwise(F.lit(False))
