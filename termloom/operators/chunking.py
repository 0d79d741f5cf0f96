"""Long fragments cut into chunks of a budget of approximate tokens.

A chunk ends at the last separator within the budget, else where the budget is
used up; a chunk below the minimum is extended.  The search for an end looks at
most ``SCAN`` characters ahead.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import simple_sentences

SCAN = 600
SEPARATOR = re.compile(r"[,，、;；:：]\s*|\n+")


def approx_tokens(s: str) -> int:
    """Ideographs, words of Latin letters and digits, and marks; a mark inside a word counts besides it."""
    return len(re.findall(r"[一-鿿]", s)) + len(re.findall(r"[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*", s)) + len(re.findall(r"[^\w\s]", s))


def chunk(text: str, budget: int = 100, least: int = 20) -> list[tuple[int, int]]:
    """Ranges of a fragment; blank ones are left out."""
    n = len(text)
    seps = sorted({m.end() for m in SEPARATOR.finditer(text) if 0 < m.end() < n})
    out, i = [], 0
    while i < n:
        if approx_tokens(text[i:]) <= budget:
            end = n
        else:
            ahead = seps[bisect_right(seps, i) : bisect_right(seps, i + SCAN)]
            fit = [p for p in ahead if approx_tokens(text[i:p]) <= budget]
            if fit:
                end = fit[-1]
                if approx_tokens(text[i:end]) < least:
                    later = [p for p in seps if p > end and approx_tokens(text[i:p]) <= budget]
                    end = later[-1] if later else end
            else:
                # the most characters within the budget: their number only grows with the range
                lo, hi = i + 1, n
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if approx_tokens(text[i:mid]) <= budget else (lo, mid - 1)
                end = lo
                while end < n and approx_tokens(text[i:end]) < least:
                    end += 1
        if text[i:end].strip():
            out.append((i, end))
        i = end
    return out


def chunked_sentences(df: DataFrame, key: str, column: str, budget: int = 100, least: int = 20) -> DataFrame:
    """(key, sid, c0, c1, src): the simple sentences of each text, long ones cut into chunks, numbered anew."""
    kind = dict(df.dtypes)[key]
    pieces = df.where(f"{column} is not null").select(F.col(key).alias("k"), simple_sentences(column).alias("s")).where("size(s) > 0")
    flat = pieces.select("k", F.transform("s", lambda x: x["src"]).alias("src"), F.transform("s", lambda x: x["c0"]).alias("c0"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, src, c0 in zip(b["k"], b["src"], b["c0"]):
                ranges = [(a + x, a + y, s[x:y]) for s, a in zip(src, c0) for x, y in chunk(s, budget, least)]
                rows.extend((k, i, x, y, s) for i, (x, y, s) in enumerate(ranges))
            yield pd.DataFrame(rows, columns=[key, "sid", "c0", "c1", "src"])

    return flat.mapInPandas(run, f"`{key}` {kind}, sid int, c0 int, c1 int, src string")
