"""String similarity scores from 0 to 100.

``indel_ratio`` is 200 LCS(a, b) / (|a| + |b|) with the longest common subsequence;
the others build on it.  The scores are defined here, not taken from a library;
they are case-sensitive and do not change their arguments.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The greatest ratio of the shared words alone, with the rest of one side, and with the rest of the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    gap = 1 if both else 0
    nx, ny = len(both) + gap + len(only_x), len(both) + gap + len(only_y)
    best = 200.0 * (len(both) + gap + lcs(only_x, only_y)) / (nx + ny)
    if both:
        best = max(best, 200.0 * len(both) / (len(both) + nx), 200.0 * len(both) / (len(both) + ny))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer that is at most as long."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)
    if not m:
        return 100.0 if not long else 0.0
    letters = set(short)
    best = 0.0
    for i in range(1 - m, len(long)):
        w = long[max(0, i) : i + m]
        # a best stretch begins or, where cut off at the left edge, ends with a letter of the shorter
        if (w[0] if i > 0 else w[-1]) in letters and 200.0 * len(w) / (m + len(w)) > best:
            best = max(best, indel_ratio(short, w))
            if best == 100.0:
                break
    return best


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain, word-based and partial ratios, the latter weighed down, more so for very unequal lengths."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    base = indel_ratio(a, b)
    if spread < 1.5:
        return max(base, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if spread <= 8 else 0.6
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    words = 100.0 if set(a.split()) & set(b.split()) else partial_ratio(x, y)
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * partial_ratio(x, y), 0.95 * scale * words)


def sequence_ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's matching blocks."""
    return 100.0 * difflib.SequenceMatcher(None, a, b).ratio()


SCORERS: dict[str, Callable[[str, str], float]] = {"indel": indel_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "weighted": weighted_ratio, "sequence": sequence_ratio}


def score(name: str, a: Column, b: Column) -> Column:
    """A scorer on two columns; null where either is null.  Equal pairs of a batch are scored once."""
    f = SCORERS[name]

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            known: dict[tuple, float | None] = {}
            out = []
            for k in zip(x, y):
                if k not in known:
                    known[k] = None if k[0] is None or k[1] is None else f(*k)
                out.append(known[k])
            yield pd.Series(out, dtype="float64")

    return run(a, b)


class KeyMatrix:
    """Many strings against which one string is scored at once: the bits of the LCS in one machine word for each key."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.lengths = np.array([len(k) for k in keys], dtype=np.int64)
        width = int(self.lengths.max()) if keys else 0
        codes = np.zeros((width, len(keys)), dtype=np.uint32)
        for j, k in enumerate(keys):
            codes[: len(k), j] = np.frombuffer(k.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.letters, places = np.unique(codes, return_inverse=True)
        #: by position, the number of each key's letter
        self.places = places.reshape(codes.shape).astype(np.uint16 if len(self.letters) < 1 << 16 else np.uint32)

    def lcs(self, text: str) -> np.ndarray:
        if len(text) > 64:
            return np.array([lcs(text, k) for k in self.keys], dtype=np.int64)
        masks: dict[int, int] = {}
        for i, c in enumerate(text):
            masks[ord(c)] = masks.get(ord(c), 0) | 1 << i
        table = np.array([masks.get(int(c), 0) if c else 0 for c in self.letters], dtype=np.uint64)
        full = np.uint64((1 << len(text)) - 1)
        v = np.full(len(self.keys), full, dtype=np.uint64)
        for row in self.places:
            u = v & table[row]
            v = ((v + u) | (v - u)) & full
        return len(text) - np.bitwise_count(v).astype(np.int64)


class TokenSetScorer:
    """``token_set_ratio`` of one string with all keys, the same values as for each pair."""

    #: Sets of shared words whose keys are kept ready.
    KEPT = 4000

    def __init__(self, keys: list[str]):
        self.sets = [frozenset(k.split()) for k in keys]
        self.holders: dict[str, set[int]] = {}
        for j, s in enumerate(self.sets):
            for w in s:
                self.holders.setdefault(w, set()).add(j)
        self.rests: dict[frozenset, tuple[np.ndarray, KeyMatrix]] = {}
        self.whole = KeyMatrix([" ".join(sorted(s)) for s in self.sets])

    def scores(self, text: str) -> np.ndarray:
        x = frozenset(text.split())
        if not x or not self.sets:
            return np.zeros(len(self.sets))
        joined = " ".join(sorted(x))
        n = len(joined) + self.whole.lengths
        out = 200.0 * self.whole.lcs(joined) / np.maximum(n, 1)
        out[self.whole.lengths == 0] = 0.0
        shared: dict[int, set[str]] = {}
        for w in x:
            for j in self.holders.get(w, ()):
                shared.setdefault(j, set()).add(w)
        # fewer shared words first: a key with more of them is written again by its own set
        for ws in sorted({frozenset(s) for s in shared.values()}, key=len):
            at, rest = self._rest(ws)
            both, only = " ".join(sorted(ws)), " ".join(sorted(x - ws))
            if not only:
                out[at] = 100.0
                continue
            ny, nx = len(both) + 1 + rest.lengths, len(both) + 1 + len(only)
            s = 200.0 * (len(both) + 1 + rest.lcs(only)) / (nx + ny)
            s = np.maximum(s, np.maximum(200.0 * len(both) / (len(both) + nx), 200.0 * len(both) / (len(both) + ny)))
            s[rest.lengths == 0] = 100.0
            out[at] = s
        return out

    def _rest(self, ws: frozenset) -> tuple[np.ndarray, KeyMatrix]:
        """All keys that have these words, and what else they have."""
        if ws not in self.rests:
            at = sorted(set.intersection(*(self.holders[w] for w in ws)))
            made = (np.array(at, dtype=np.int64), KeyMatrix([" ".join(sorted(self.sets[j] - ws)) for j in at]))
            if len(self.rests) >= self.KEPT:
                return made
            self.rests[ws] = made
        return self.rests[ws]


class PartialScorer:
    """``partial_ratio`` of one string with all keys, the same values as for each pair.

    All windows are read from one pass over the grid of both strings: strands start
    at its left and upper edges and cross where letters differ, once at most.  The
    longest common subsequence of one string with a stretch of the other is the
    length of the stretch less the strands that start and end within it.
    """

    #: Keys of like length that are passed over at once.
    TOGETHER = 4096

    def __init__(self, keys: list[str]):
        self.n = len(keys)
        letters = sorted({c for k in keys for c in k})
        self.code = {c: i + 2 for i, c in enumerate(letters)}
        kind = np.uint8 if len(letters) < 250 else np.uint32
        order = sorted(range(len(keys)), key=lambda j: len(keys[j]))
        #: places of the keys, their lengths, and by position their letters, ended at the same one
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(order), self.TOGETHER):
            at = order[a : a + self.TOGETHER]
            width = len(keys[at[-1]])
            codes = np.zeros((width, len(at)), dtype=kind)
            for i, j in enumerate(at):
                codes[width - len(keys[j]) :, i] = [self.code[c] for c in keys[j]]
            self.parts.append((np.array(at), np.array([len(keys[j]) for j in at]), codes))

    def scores(self, text: str) -> np.ndarray:
        out = np.zeros(self.n)
        for at, lengths, codes in self.parts:
            out[at] = self._scores(text, lengths, codes) if text else np.where(lengths == 0, 100.0, 0.0)
        return out

    def _strands(self, text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which strand ends at the right of each letter of the text, from the last, and below each position of the keys."""
        m, (width, n) = len(text), codes.shape
        kind = np.uint8 if m + width < 256 else np.uint32
        back = np.array([self.code.get(c, 1) for c in reversed(text)], dtype=codes.dtype)[:, None]
        right = np.repeat(np.arange(m, dtype=kind)[:, None], n, axis=1)
        below = np.repeat(np.arange(m, m + width, dtype=kind)[:, None], n, axis=1)
        for d in range(m + width - 1):
            # a diagonal of the grid: its cells do not touch each other
            c = d - m + 1
            a, b = max(0, -c), min(m, width - c)
            h, v = right[a:b], below[a + c : b + c]
            turn = (codes[a + c : b + c] == back[a:b]) | (h > v)
            swap = (h ^ v) * turn
            h ^= swap
            v ^= swap
        return right[::-1], below

    def _scores(self, text: str, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        m, (width, n) = len(text), codes.shape
        right, below = self._strands(text, codes)
        best = np.zeros(n)
        pads = width - lengths
        few = np.uint8 if max(m, width) < 256 else np.uint32
        if lengths[-1] >= m:
            # the text and stretches of the keys
            top = np.zeros(n)
            for s in range(int(pads[-1]) + 1 - m, width):
                a, b = max(0, s), min(width, s + m)
                w = b - np.maximum(a, pads)
                common = b - a - (below[a:b] >= m + a).view(np.uint8).sum(axis=0, dtype=few).astype(np.int64)
                top = np.maximum(top, 200.0 * common / (m + np.maximum(w, 0)))
            best = np.where(lengths >= m, top, best)
        short = np.flatnonzero((lengths < m) & (lengths > 0))
        if len(short):
            # the keys and stretches of the text
            k, ends = lengths[short], right[:, short]
            rows = np.arange(m)[:, None]
            top = np.zeros(len(short))
            for b in range(1, int(k[-1])):
                common = b - (ends[:b] < m).view(np.uint8).sum(axis=0, dtype=few).astype(np.int64)
                top = np.where(b < k, np.maximum(top, 200.0 * common / (k + b)), top)
            for s in range(m):
                b = np.minimum(m, s + k)
                last, inside = int(b[-1]), rows < b
                common = b - s - ((ends[s:last] < m - s) & inside[s:last]).view(np.uint8).sum(axis=0, dtype=few).astype(np.int64)
                top = np.maximum(top, 200.0 * common / (k + b - s))
            best[short] = top
        return best


class WeightedScorer:
    """``weighted_ratio`` of one string with all keys, the same values as for each pair."""

    def __init__(self, keys: list[str]):
        self.words = [frozenset(k.split()) for k in keys]
        self.holders: dict[str, list[int]] = {}
        for j, ws in enumerate(self.words):
            for w in ws:
                self.holders.setdefault(w, []).append(j)
        in_order = [" ".join(sorted(k.split())) for k in keys]
        self.plain, self.sorted = KeyMatrix(keys), KeyMatrix(in_order)
        self.sets, self.partial, self.partial_sorted = TokenSetScorer(keys), PartialScorer(keys), PartialScorer(in_order)

    def scores(self, text: str) -> np.ndarray:
        n = self.plain.lengths
        if not text or not len(n):
            return np.zeros(len(n))
        x = " ".join(sorted(text.split()))
        base = 200.0 * self.plain.lcs(text) / (len(text) + n)
        both = len(x) + self.sorted.lengths
        in_order = np.where(both > 0, 200.0 * self.sorted.lcs(x) / np.maximum(both, 1), 100.0)
        near = np.maximum(base, 0.95 * np.maximum(in_order, self.sets.scores(text)))
        spread = np.maximum(n, len(text)) / np.maximum(np.minimum(n, len(text)), 1)
        scale = np.where(spread <= 8, 0.9, 0.6)
        part = self.partial_sorted.scores(x)
        words = part.copy()
        for w in set(text.split()):
            words[self.holders.get(w, [])] = 100.0
        far = np.maximum(np.maximum(base, scale * self.partial.scores(text)), 0.95 * scale * np.maximum(part, words))
        return np.where(n == 0, 0.0, np.where(spread < 1.5, near, far))


#: Scorers that take all keys at once.
AT_ONCE = {"token_set": TokenSetScorer, "partial": PartialScorer, "weighted": WeightedScorer}
