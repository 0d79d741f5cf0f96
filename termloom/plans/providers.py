"""Models behind the engine: what it needs of them, and deterministic stand-ins.

A provider runs inside the executors, on Arrow batches, and only on the rows that
need it.  The stand-ins make every plan runnable and testable without a model.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions import protocol
from termloom.functions.text import safe_slice, strip_span

DIMENSION = 256


def hashed_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """A vector of length 1 from letter triples, each hashed to a place and a sign."""
    v = np.zeros(dimension)
    t = f"  {text.lower()} "
    for i in range(len(t) - 2):
        place, sign = _places(t[i : i + 3], dimension)
        v[place] += sign
    n = float(np.sqrt(v @ v))
    return (v / n if n else v).astype(np.float32)


@lru_cache(1 << 18)
def _places(triple: str, dimension: int) -> tuple[int, float]:
    h = int(hashlib.md5(triple.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return h % dimension, 1.0 if h >> 31 else -1.0


def encoded(text: Column, encode: Callable[[str], np.ndarray] = hashed_vector) -> Column:
    """A vector for each text; null stays null.  Equal texts of a batch are encoded once."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = {t: encode(t).tolist() for t in s.dropna().unique()}
            yield pd.Series([known.get(t) for t in s], dtype=object)

    return run(text)


@dataclass
class Replies:
    """Calls of a language model: a prompt in, a reply out.

    A call is repeated after a failure, with growing pauses; a call that keeps
    failing has an empty reply unless ``strict``.
    """

    call: Callable[[str], str]
    threads: int = 16
    tries: int = 3
    pause: float = 0.5
    strict: bool = False

    def one(self, prompt: str) -> tuple[str, str | None]:
        error = None
        for i in range(self.tries):
            try:
                return self.call(prompt), None
            except Exception as e:  # noqa: BLE001 - whatever the model's client raises
                error = f"{type(e).__name__}: {e}"
                if i + 1 < self.tries:
                    time.sleep(self.pause * 2**i)
        if self.strict:
            raise RuntimeError(error)
        return "", error

    def over(self, df: DataFrame, prompt: str) -> DataFrame:
        """The frame with ``reply`` and ``error``.  Null prompts are not sent."""
        schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(self.threads) as pool:
                for b in batches:
                    got = list(pool.map(lambda p: (None, None) if p is None else self.one(p), b[prompt]))
                    yield b.assign(reply=pd.Series([r for r, _ in got], index=b.index, dtype=object), error=pd.Series([e for _, e in got], index=b.index, dtype=object))

        return df.mapInPandas(run, schema)


@dataclass
class BatchReplies:
    """Calls of a local model that answers many prompts at once: equal prompts of a batch are sent once, at most ``size`` in a call."""

    call: Callable[[list[str]], list[str]]
    size: int = 32

    def over(self, df: DataFrame, prompt: str) -> DataFrame:
        """The frame with ``reply`` and ``error``.  Null prompts are not sent; a call that fails leaves its prompts empty, with the reason."""
        schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                known: dict[str, tuple[str, str | None]] = {}
                todo = b[prompt].dropna().unique().tolist()
                # prompts of like length together, so that little is padded
                todo.sort(key=len)
                for i in range(0, len(todo), self.size):
                    part = todo[i : i + self.size]
                    try:
                        known.update(zip(part, ((r, None) for r in self.call(part)), strict=True))
                    except Exception as e:  # noqa: BLE001 - whatever the model raises
                        known.update((p, ("", f"{type(e).__name__}: {e}")) for p in part)
                got = [known.get(p, (None, None)) for p in b[prompt]]
                yield b.assign(reply=pd.Series([r for r, _ in got], index=b.index, dtype=object), error=pd.Series([e for _, e in got], index=b.index, dtype=object))

        return df.mapInPandas(run, schema)


def tagged_spans(df: DataFrame, key: str, text: str, tag: Callable[[str], tuple[list[tuple[int, int]], list[int]]], labels: dict[int, str]) -> DataFrame:
    """(key, c0, c1, mention): spans that a tagger finds.

    ``tag`` gives the offsets and label numbers of a text's tokens.  Special
    tokens, which have no extent, are dropped before labels are read; spans are
    stripped, and empty ones left out.  Null texts have none.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, text string, offsets array<struct<c0:int,c1:int>>, labels array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["text"]):
                offsets, ids = tag(t)
                kept = [(o, labels.get(i, "O")) for o, i in zip(offsets, ids) if o[0] != o[1]]
                rows.append((k, t, [{"c0": a, "c1": z} for (a, z), _ in kept], [x for _, x in kept]))
            yield pd.DataFrame(rows, columns=[key, "text", "offsets", "labels"])

    tokens = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")).mapInPandas(run, schema)
    found = tokens.select(key, "text", "offsets", F.explode(protocol.bioes_spans(F.col("labels"))).alias("s"))
    place = protocol.token_span(F.col("offsets"), F.col("s.i0"), F.col("s.i1"))
    spans = found.select(key, place["c0"].alias("c0"), place["c1"].alias("c1"), strip_span(safe_slice("text", place["c0"], place["c1"])).alias("mention"))
    return spans.where("mention <> ''")


def overlap_choice(prompt: str) -> str:
    """A stand-in for a refiner: the number of the candidate that shares most words with the mention, -1 if none does."""
    mention = re.search(r"(?m)^MENTION: (.*)$", prompt)
    words = set(re.findall(r"\w+", mention[1].lower())) if mention else set()
    best, at = 0, -1
    for m in re.finditer(r"(?m)^(\d+)\. \S+\t(.*)$", prompt):
        n = len(words & set(re.findall(r"\w+", m[2].lower())))
        if n > best:
            best, at = n, int(m[1])
    return str(at)


def yes_probability(pair: Column) -> Column:
    """A stand-in for a pointwise reranker over ``rerank_pair`` texts: the part of the query's words that the document has, drawn to the middle."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    q = words(F.regexp_extract(pair, r"(?s)\n<Query>: (.*?)\n<Document>: ", 1))
    document = words(F.regexp_extract(pair, r"(?s)\n<Document>: (.*)$", 1))
    return F.round(F.when(F.size(q) > 0, (F.size(F.array_intersect(q, document)) + 0.5) / (F.size(q) + 1.0)).otherwise(0.5), 6)
