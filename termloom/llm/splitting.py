"""Problem 3: cut oversized texts into pieces under a limit, at natural boundaries.

Balanced targets: take the least possible number of pieces, place equally long
targets, snap each to the strongest boundary near it, and add pieces as long as
a limit fails.  Consecutive pieces share exactly ``overlap`` code points.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.delivery import latest_wide
from termloom.session import table

# From the strongest to the weakest; a cut goes to the end of a match.
BOUNDARIES = [
    (5, regex.compile(r"\n[^\S\n]*\n\s*")),
    (4, regex.compile(r"\n\s*|(?<=[.!?…।؟][\"'”“»’)\]]*)\s+|[。！？]+[」』”’）]*\s*")),
    (3, regex.compile(r"[;:；：،]\s+|[;；：]\s*")),
    (2, regex.compile(r"[,，、]\s*(?!\d)|\s[–—]\s")),
    (1, regex.compile(r"\s+|\p{P}+")),
]
RUN = regex.compile(r"[^\s\p{P}]+")
#: Share of the ideal piece within which a stronger boundary may win over a nearer one.
NEAR = 0.25


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places where a cut is natural, ascending, and the strength of each."""
    best: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), strength)
    best.pop(len(text), None)
    best.pop(0, None)
    places = sorted(best)
    return places, [best[p] for p in places]


def has_long_run(text: str, size: int) -> bool:
    """Whether more than ``size`` code points in a row are neither white space nor punctuation."""
    return any(m.end() - m.start() > size for m in RUN.finditer(text))


def _cuts(n: int, size: int, overlap: int, m: int, places: list[int], strength: list[int]) -> tuple[list[int], int] | None:
    """m - 1 cuts and how many of them are hard, or None where the pieces don't suffice."""
    step, ideal = size - overlap, (n + (m - 1) * overlap) / m
    cuts, hard, prev = [], 0, overlap
    for k in range(1, m):
        high = size if k == 1 else min(prev + step, n - 1)
        low = max(n - (m - k) * step, (prev if k == 1 else prev + overlap) + 1)
        if low > high:
            return None
        target = min(max(round(k * ideal - (k - 1) * overlap), low), high)
        i, j = bisect_left(places, low), bisect_right(places, high)
        if i == j:
            if bisect_left(places, prev + 1) < j:  # there is a boundary, but more pieces are needed to reach it
                return None
            cut, hard = high, hard + 1
        else:
            near = NEAR * ideal
            cut = min(((-strength[x] if abs(places[x] - target) <= near else 0, abs(places[x] - target), places[x]) for x in range(i, j)))[2]
        cuts.append(cut)
        prev = cut
    return cuts, hard


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces (c0, c1, hard): at most ``size`` long, in order, covering the text, neighbours sharing ``overlap``.

    ``hard`` tells that the piece ends inside an unbroken run because no boundary
    was in reach.  A text within the limit, and the empty one, is one piece.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = len(text)
    if n <= size:
        return [(0, n, False)]
    places, strength = boundaries(text)
    least = 1 + -(-(n - size) // (size - overlap))
    plan = None
    for m in range(least, 2 * least + 2):
        plan = _cuts(n, size, overlap, m, places, strength)
        if plan:
            break
    cuts = plan[0] if plan else _greedy(n, size, overlap, places)
    natural = set(places)
    out, start = [], 0
    for c in [*cuts, n]:
        out.append((start, c, c != n and c not in natural))
        start = c - overlap
    return out


def _greedy(n: int, size: int, overlap: int, places: list[int]) -> list[int]:
    """The last boundary in reach each time, else a hard cut."""
    cuts, end = [], size
    while end < n:
        low = (cuts[-1] if cuts else 0) + overlap
        i = bisect_right(places, end) - 1
        cuts.append(places[i] if i >= 0 and places[i] > low else end)
        end = cuts[-1] + size - overlap
    return cuts


def split_items(df: DataFrame, key: str, column: str, size: int, overlap: int, with_text: bool = True) -> DataFrame:
    """(key, piece, c0, c1, hard, forced[, text]) of the texts longer than ``size``.

    ``forced`` tells of the item that an unbroken run in it is longer than
    ``size``, so that no way of cutting ends at natural boundaries only.  Null
    and short texts have no row.  Each row is cut by itself, so nothing is shuffled.
    """
    kind = dict(df.dtypes)[key]
    long = df.where(F.length(column) > size).select(F.col(key).alias("_k"), F.col(column).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["_k"], b["_t"]):
                forced = int(has_long_run(t, size))
                for i, (c0, c1, hard) in enumerate(split_text(t, size, overlap)):
                    rows.append((k, i, c0, c1, int(hard), forced, *([t[c0:c1]] if with_text else [])))
            yield pd.DataFrame(rows, columns=names)

    names = [key, "piece", "c0", "c1", "hard", "forced", *(["text"] if with_text else [])]
    return long.mapInPandas(run, f"`{key}` {kind}, piece int, c0 int, c1 int, hard int, forced int" + ", text string" * with_text)


def limit_of(spark: SparkSession, sf_dir: str, field: str, purpose: str) -> tuple[int, int]:
    """(size, overlap) from the fixed table of limits."""
    r = table(spark, sf_dir, "size_limits").where((F.col("field") == field) & (F.col("purpose") == purpose)).select("size", "overlap").first()
    if r is None:
        raise ValueError(f"no {purpose} limit for {field}")
    return int(r[0]), int(r[1] or 0)


def pieces(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """(field, item_id, piece, c0, c1, hard, forced[, text]) of all oversized requests and contexts."""
    out = []
    for name, key, column in (("requests", "req_id", "src"), ("samples", "sample_id", "context")):
        size, overlap = limit_of(spark, sf_dir, f"{name}.{column}", "cut")
        rows = latest_wide(table(spark, sf_dir, name), key, "loaded_at", F.length(column) > size, column)
        p = split_items(rows, key, column, size, overlap, with_text)
        out.append(p.select(F.lit(f"{name}.{column}").alias("field"), F.col(key).alias("item_id"), *p.columns[1:]))
    return out[0].unionByName(out[1])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, item_id, forced) of every oversized item, from its first piece."""
    return pieces(spark, sf_dir, with_text=False).where("piece = 0").select("field", "item_id", "forced")
