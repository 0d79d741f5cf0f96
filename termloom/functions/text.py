"""Text expressions: normalising, slicing, windows, sentence and token splitting.

All are columns of built-in functions.  Offsets are code points, 0-based and
half-open.  Null text gives null unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Without white space, as Unicode has it, at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm(c: ColumnOrName) -> Column:
    """Lower case, outer white space removed, inner runs of it one space (white space as Unicode has it)."""
    inner = F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " ")
    return F.trim(inner)


def norm_id(c: ColumnOrName) -> Column:
    """``_`` of an id as ``:``, in upper case without outer space; empty becomes null."""
    s = F.upper(strip(F.replace(col(c), F.lit("_"), F.lit(":"))))
    return F.when(s != "", s)


def strip_span(c: ColumnOrName) -> Column:
    """White space and ``.,;:()[]{}`` removed from both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s.,;:()\[\]{}]+|[\s.,;:()\[\]{}]+$", "")


def clamp(c: ColumnOrName, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(col(c), n))


def safe_slice(text: ColumnOrName, c0: ColumnOrName, c1: ColumnOrName) -> Column:
    """The text between two offsets, clamped and put in order."""
    n = F.length(col(text))
    a, b = clamp(c0, n), clamp(c1, n)
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.substring(col(text), lo + 1, hi - lo)


def context_window(text: ColumnOrName, c0: ColumnOrName, c1: ColumnOrName, width: int = 128) -> Column:
    """struct(text, c0, c1): the text within ``width`` of a span, and the span's place in it."""
    n = F.length(col(text))
    left = F.greatest(F.lit(0), col(c0) - width)
    right = F.least(n, col(c1) + width)
    return F.struct(F.substring(col(text), left + 1, right - left).alias("text"), (col(c0) - left).alias("c0"), (col(c1) - left).alias("c1"))


def truncated(c: ColumnOrName, limit: int = 512) -> Column:
    return F.substring(col(c), 1, limit)


def approx_tokens(c: ColumnOrName) -> Column:
    """Ideographs, words of Latin letters and digits, and punctuation marks, each one; null text has none."""
    counts = [F.regexp_count(col(c), F.lit(p)) for p in (r"[\x{4e00}-\x{9fff}]", r"[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*", r"(?U)[^\w\s]")]
    return F.coalesce(counts[0] + counts[1] + counts[2], F.lit(0))


def tag(c: ColumnOrName) -> Column:
    """Runs of anything but letters, digits, ``.``, ``_`` and ``-`` as one ``_``."""
    return F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_")


# The terminators of a simple sentence, and the words of polarity.
PIECES = r"[^。！？；!?;\n.]+[。！？；!?;.]?|\n+|[。！？；!?;.]"
PRESENT = ("present", "pos", "positive", "yes", "y")
ABSENT = ("absent", "neg", "negative", "no", "n", "denied", "without", "not_present")

#: Numbers that are summed together, at least: what an aggregate gathers is copied at each step.
TOGETHER = 16

INTS = "cast(array() as array<int>)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; unlike the elements of a transform, neither it nor the result is copied."""
    return F.aggregate(F.expr(INTS), value, lambda acc, _: acc, use)


def _sums(parts: Column, size: Callable[[Column], Column]) -> Column:
    """array<int>: running sums of sizes."""
    return F.aggregate(parts, F.expr(INTS), lambda acc, x: F.array_append(acc, size(x) + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))


def ends(parts: Column) -> Column:
    """array<int>: where each of consecutive pieces of a text ends, null if there is none.

    Only numbers are gathered, in blocks of the root of their number, then each
    block is moved by the sum of those before it.
    """

    def of(parts: Column) -> Column:
        n = F.size(parts)
        return F.when(n > 0, bound(F.greatest(F.lit(TOGETHER), F.ceil(F.sqrt(n)).cast("int")), lambda size: bound(blocks(parts, size), moved)))

    def blocks(parts: Column, size: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / size).cast("int"))
        return F.transform(numbers, lambda k: _sums(F.slice(parts, k * size + 1, size), F.length))

    def moved(blocks: Column) -> Column:
        totals = _sums(blocks, lambda b: F.try_element_at(b, F.lit(-1)))
        move = lambda t: F.transform(blocks, lambda b, k: F.transform(b, lambda x: x + F.coalesce(F.get(t, k - 1), F.lit(0))))
        return F.flatten(bound(totals, move))

    return bound(parts, of)


def placed(parts: Column) -> Column:
    """array<struct<src, c0, c1>>: consecutive pieces of a text with their places."""

    def place(parts: Column, end: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(x.alias("src"), (F.get(end, i) - F.length(x)).alias("c0"), F.get(end, i).alias("c1")))

    return bound(parts, lambda p: bound(ends(p), lambda e: place(p, e)))


def simple_sentences(c: ColumnOrName) -> Column:
    """array<struct(sid, src, c0, c1)>: pieces up to a terminator or line break; blank pieces and lone terminators are left out.

    The pieces of the pattern tile the text, so offsets are running sums of lengths.
    """
    pieces = placed(F.regexp_extract_all(col(c), F.lit(PIECES), F.lit(0)))
    kept = F.filter(pieces, lambda x: (F.length(F.regexp_replace(x["src"], r"(?U)\s", "")) > 0) & ~x["src"].rlike("^[。！？；!?;.]$"))
    return F.transform(kept, lambda x, i: F.struct(i.alias("sid"), x["src"].alias("src"), x["c0"].alias("c0"), x["c1"].alias("c1")))


def token_windows(tokens: Column, size: int, stride: int) -> Column:
    """array<struct(start, tokens)>: windows of at most ``size`` tokens that overlap by ``stride``; the last is the first to reach the end."""
    if not 0 <= stride < size:
        raise ValueError("stride must be at least 0 and less than size")
    n, step = F.size(tokens), size - stride
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, size).alias("tokens"))))


def polarity(c: ColumnOrName, unknown: str | None = "uncertain") -> Column:
    """present, absent or ``unknown``; where that is None, other words stay as they are."""
    s = F.lower(strip(c))
    other = F.lit(unknown) if unknown is not None else s
    return F.when(s.isin(*PRESENT), "present").when(s.isin(*ABSENT), "absent").otherwise(F.coalesce(other, F.lit("uncertain")))
