"""Problem 4: the same or nearly the same annotated span in training and evaluation splits.

Samples of one concept, one plain mention and the same words of context are one
class, however many they are.  The evaluation classes of each shard become a
compressed full-text index over words: the runs of the Burrows-Wheeler transform,
written once for each shard.  A task that reads it walks the transform back to the
texts, so nothing else is stored.  Training classes stream past the index.

Which places to look at follows from counts alone.  At most a fifth of a training
text's words lack a partner in a text that is alike, so one of any fifth and one of
its words has one; and insertions included, at most two fifths of it are broken, so
one of two fifths and one disjoint runs of words stands whole in the other.
Backward search gives the number of places of both, and the set with fewer is
taken.  Every place found is grown to a maximal match; the matches of two texts are
merged and counted.  Where their chain alone has the share the pair stands; where
a bound on the words in common rules it out it falls; the rest is compared exactly.
Nothing is capped, so that no pair is lost however crowded an index is.

A word counts only within its concept, so one index serves many concepts without
mixing them.  A concept with many classes is divided: its evaluation classes into
shards, its training classes into blocks, each shard meeting each block once.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import chars
from termloom.operators.delivery import latest_sparse
from termloom.session import materialize, parallelism, table

#: Part of the longer context's words that must stand in the other in order: four of five.
PART, WHOLE = 4, 5
#: Slips by which mentions may differ.
SLIPS = 2
#: Evaluation classes of a shard and training classes of a block.
SHARD, BLOCK = 20_000, 5_000
#: Places, bytes and pairs worked on at once.
AT_ONCE = 250_000
#: Classes of words whose numbers bound the words that two texts have in common.
BAG = 64

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Words without regard to case, punctuation and character form."""
    return WORD.findall(chars.canonical(text).lower())


def plain(text: str) -> str:
    return " ".join(words(text))


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two strings, or ``most`` + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], older[j - 2] + 1)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def repeated(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges first, first + 1, ... of n numbers each, one after the other."""
    return np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class TextIndex:
    """Backward search over sequences of numbers from 1 on, kept as the runs of their Burrows-Wheeler transform."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.symbols, self.starts, self.lengths = symbols.astype(np.int64), starts.astype(np.int64), lengths.astype(np.int64)
        docs = self.docs = len(lengths)
        n = self.n = int(self.lengths.sum()) + docs
        size = np.diff(np.append(self.starts, n))
        self.counts = np.bincount(self.symbols, size, minlength=1).astype(np.int64)
        #: rows before those of each symbol; the ends of sequences come first
        self.first = np.concatenate([[0, docs], docs + np.cumsum(self.counts[1:])])
        order = np.lexsort((self.starts, self.symbols))
        s, c = self.symbols[order], size[order]
        total = np.cumsum(c) - c
        heads = np.flatnonzero(np.diff(s, prepend=-1)) if len(s) else np.zeros(0, dtype=np.int64)
        #: runs by symbol: key, symbol, start, length and the symbol's occurrences before the run
        self.keys, self.run_symbol, self.run_start, self.run_size = s * (n + 1) + self.starts[order], s, self.starts[order], c
        self.run_before = total - np.repeat(total[heads], np.diff(np.append(heads, len(s))))
        step = np.empty(len(s), dtype=np.int64)
        step[order] = self.first[s] + self.run_before
        #: the row before a row is that of its run plus the distance from the run's start
        self.step = step
        self._walk()

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> TextIndex:
        """The index of some sequences: suffixes are sorted by doubling, groups that are settled are left alone."""
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1 if len(ends) else 0
        text = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        if n > len(ends):
            text[inside] = np.concatenate(sequences)
        # each end is a symbol of its own, so that no two suffixes are equal
        value = text + len(ends)
        value[ends] = np.arange(len(ends))
        order = np.argsort(value, kind="stable")
        rank, have = np.empty(n, dtype=np.int64), 1
        _ranked(rank, order, value[order], np.arange(n))
        while True:
            shared = np.bincount(rank, minlength=n)[rank] > 1
            if not shared.any():
                break
            a, slots = np.flatnonzero(shared), np.flatnonzero(shared[order])
            key = rank[a] * n + rank[np.minimum(a + have, n - 1)]
            o = np.argsort(key, kind="stable")
            order[slots] = a[o]
            _ranked(rank, a[o], key[o], slots)
            have *= 2
        before = text[order - 1] if n else text
        new = np.flatnonzero(np.diff(before, prepend=-1))
        return cls(before[new], new, lengths)

    def _walk(self) -> None:
        """The texts, and of each row the sequence and the place in it, by walking back from the ends of all sequences at once."""
        offsets = np.cumsum(self.lengths) - self.lengths
        self.text = np.zeros(self.n - self.docs, dtype=np.uint32)
        self.offsets = offsets
        self.owner, self.place = np.zeros(self.n, dtype=np.uint32), np.zeros(self.n, dtype=np.uint32)
        doc = rows = np.arange(self.docs)
        self.owner[: self.docs], self.place[: self.docs] = doc, self.lengths
        at = self.lengths.copy()
        while True:
            live = at > 0
            doc, rows, at = doc[live], rows[live], at[live] - 1
            if not len(doc):
                break
            run = np.searchsorted(self.starts, rows, side="right") - 1
            self.text[offsets[doc] + at] = self.symbols[run]
            rows = self.step[run] + rows - self.starts[run]
            self.owner[rows], self.place[rows] = doc, at

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before a row."""
        j = np.searchsorted(self.keys, symbol * (self.n + 1) + row) - 1
        k = np.maximum(j, 0)
        same = (j >= 0) & (self.run_symbol[k] == symbol) if len(self.keys) else np.zeros(len(j), dtype=bool)
        return np.where(same, self.run_before[k] + np.minimum(row - self.run_start[k], self.run_size[k]), 0) if len(self.keys) else np.zeros(len(j), dtype=np.int64)

    def search(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi): the rows at which each stretch [begin, end) of ``text`` stands; a symbol of 0 stands nowhere."""
        lo, hi = np.zeros(len(end), dtype=np.int64), np.full(len(end), self.n, dtype=np.int64)
        which, at = np.arange(len(end)), end.copy()
        while len(which):
            go = at > begin[which]
            which, at = which[go], at[go] - 1
            symbol = text[at]
            known = symbol > 0
            base = self.first[symbol]
            lo[which] = np.where(known, base + self.rank(symbol, lo[which]), 0)
            hi[which] = np.where(known, base + self.rank(symbol, hi[which]), 0)
            alive = hi[which] > lo[which]
            which, at = which[alive], at[alive]
        return lo, np.maximum(lo, hi)


def _ranked(rank: np.ndarray, members: np.ndarray, keys: np.ndarray, slots: np.ndarray) -> None:
    """Set the rank of sorted members: the slot of the first one with the same key."""
    if len(members):
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[members] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]


def _bags(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of each text's words in each of ``BAG`` classes; words without a number are left out."""
    known = flat > 0
    return np.bincount(owner[known].astype(np.int64) * BAG + flat[known] % BAG, minlength=n * BAG).reshape(n, BAG).astype(np.uint16)


def common_words(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows, whose first nx and ny numbers count; 0 equals nothing."""
    width = max(1, -(-int(nx.max(initial=0)) // 64))
    wide = np.zeros((len(x), width * 64), dtype=np.int64)
    x = x[:, : width * 64]
    wide[:, : x.shape[1]] = np.where(np.arange(x.shape[1]) < nx[:, None], x, 0)
    v = np.full((len(x), width), ~np.uint64(0))
    for j in range(int(ny.max(initial=0))):
        letter = np.where(j < ny, y[:, j], 0)
        bits = np.packbits((wide == letter[:, None]) & (letter > 0)[:, None], axis=1, bitorder="little").view(np.uint64)
        carry = np.zeros(len(x), dtype=np.uint64)
        for k in range(width):
            u = v[:, k] & bits[:, k]
            s = v[:, k] + u
            over = s < u
            t = s + carry
            carry = (over | (t < carry)).astype(np.uint64)
            v[:, k] = t | (v[:, k] - u)
    return np.bitwise_count(~v).sum(axis=1).astype(np.int64)


class Matcher:
    """Streams training texts past an index of evaluation texts."""

    def __init__(self, index: TextIndex):
        self.index = index
        self.lengths = index.lengths.astype(np.int32)
        self.bags = _bags(index.text, np.repeat(np.arange(index.docs), index.lengths), index.docs)

    def pairs(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(text, evaluation text) of all pairs of texts that are alike: four fifths of the longer one's words stand in the other in order."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        text, at, lo, hi = self._probes(flat, owner, starts, lengths)
        bags = _bags(flat, owner, len(texts))
        out = []
        # texts are taken together as long as their places are not too many
        total = np.cumsum(hi - lo)
        a = 0
        while a < len(text):
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, side="right"))
            if b < len(text):
                b = int(np.searchsorted(text, text[b], side="left"))
            b = max(b, int(np.searchsorted(text, text[a], side="right")))
            out.append(self._alike(flat, starts, lengths, bags, text[a:b], at[a:b], lo[a:b], hi[a:b]))
            a = b
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def _probes(self, flat: np.ndarray, owner: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple:
        """(text, place in ``flat``, lo, hi) of stretches of which every alike text holds at least one, in order of texts."""
        index = self.index
        count = index.counts[flat]
        count[flat == 0] = 0
        # one word more than may lack a partner, the rarest ones
        order = np.lexsort((count, owner))
        rare = np.sort(order[np.arange(len(flat)) - starts[owner] <= lengths[owner] // WHOLE])
        # one run more than may be broken, of two words or more
        most = 2 * lengths // WHOLE + 1
        most[lengths < 2 * most] = 0
        text = np.repeat(np.arange(len(lengths)), most)
        i = repeated(np.zeros(len(most), dtype=np.int64), most)
        begin, end = starts[text] + i * lengths[text] // np.maximum(most[text], 1), starts[text] + (i + 1) * lengths[text] // np.maximum(most[text], 1)
        lo, hi = index.search(flat, begin, end)
        by_words, by_runs = np.bincount(owner[rare], count[rare], minlength=len(lengths)), np.bincount(text, hi - lo, minlength=len(lengths))
        runs = (most > 0) & (by_runs < by_words)
        rare, keep = rare[~runs[owner[rare]]], runs[text]
        symbol = flat[rare]
        t = np.concatenate([owner[rare], text[keep]])
        p = np.concatenate([rare, begin[keep]])
        l = np.concatenate([np.where(symbol > 0, index.first[symbol], 0), lo[keep]])  # noqa: E741
        h = np.concatenate([np.where(symbol > 0, index.first[symbol] + count[rare], 0), hi[keep]])
        some = h > l
        t, p, l, h = t[some], p[some], l[some], h[some]  # noqa: E741
        o = np.argsort(t, kind="stable")
        return t[o], p[o], l[o], h[o]

    def _alike(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bags: np.ndarray, text: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = self.index
        n = hi - lo
        rows = repeated(lo, n)
        e, place = index.owner[rows], index.place[rows].astype(np.int32)
        # a place counts if the lengths are fair and no more words lie before it in either text than may lack a partner
        first, nt = np.repeat((at - starts[text]).astype(np.int32), n), np.repeat(lengths[text].astype(np.int32), n)
        ne = self.lengths[e]
        need = -(-PART * np.maximum(nt, ne) // WHOLE)
        keep = np.flatnonzero((nt >= need) & (ne >= need) & (first - place <= nt - need) & (place - first <= ne - need))
        t, e, at, place = np.repeat(text, n)[keep], e[keep].astype(np.int64), first[keep].astype(np.int64), place[keep].astype(np.int64)
        # pairs of texts with enough words in common at the most
        pair, where = np.unique(t * index.docs + e, return_inverse=True)
        pt, pe = pair // max(index.docs, 1), pair % max(index.docs, 1)
        need = -(-PART * np.maximum(lengths[pt], index.lengths[pe]) // WHOLE)
        fair = np.ones(len(pair), dtype=bool)
        step = max(1, AT_ONCE // BAG)
        for a in range(0, len(pair), step):
            s = np.flatnonzero(fair[a : a + step]) + a
            fair[s] = np.minimum(bags[pt[s]], self.bags[pe[s]]).sum(axis=1, dtype=np.int64) >= need[s]
        keep = fair[where]
        where, at, place = where[keep], at[keep], place[keep]
        # places of one pair on one diagonal grow to the same maximal match or to another one on it
        w, diagonal = where, at - place
        o = np.lexsort((at, diagonal, w))
        w, diagonal, at = w[o], diagonal[o], at[o]
        left, right = self._grown(flat, starts, lengths, pt[w], pe[w], at, at - diagonal)
        spans = np.unique(np.stack([w, left, right, left - diagonal], axis=1), axis=0)
        chained = self._chained(spans, len(pair))
        sure = fair & (chained >= need)
        open_ = np.flatnonzero(fair & ~sure)
        sure[open_] = self._compared(flat, starts, lengths, pt[open_], pe[open_]) >= need[open_]
        return pt[sure], pe[sure]

    def _grown(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximal match [left, right) in the training text around the place i, which stands at j of the evaluation text."""
        ends = []
        for d in (-1, 1):
            edge = i.copy() if d < 0 else i + 1
            live = np.arange(len(i))
            x, y = (i - 1, j - 1) if d < 0 else (i + 1, j + 1)
            while len(live):
                tt, ee = t[live], e[live]
                inside = (x >= 0) & (y >= 0) & (x < lengths[tt]) & (y < self.index.lengths[ee])
                live, x, y, tt, ee = live[inside], x[inside], y[inside], tt[inside], ee[inside]
                same = flat[starts[tt] + x] == self.index.text[self.index.offsets[ee] + y]
                live, x, y = live[same], x[same], y[same]
                edge[live] += d
                x, y = x + d, y + d
            ends.append(edge)
        return ends[0], ends[1]

    @staticmethod
    def _chained(spans: np.ndarray, n: int) -> np.ndarray:
        """Words of each pair's matches (pair, left, right, place) where they follow each other in both texts, else of the longest one: words that surely are in common."""
        pair, left, right, place = spans.T if len(spans) else np.zeros((4, 0), dtype=np.int64)
        size = right - left
        out = np.zeros(n, dtype=np.int64)
        np.maximum.at(out, pair, size)
        same = pair[1:] == pair[:-1]
        crossed = np.zeros(n, dtype=bool)
        crossed[pair[1:][same & ((left[1:] < right[:-1]) | (place[1:] < place[:-1] + size[:-1]))]] = True
        total = np.bincount(pair, size, minlength=n).astype(np.int64)
        return np.where(crossed, out, np.maximum(out, total))

    def _compared(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Words in common of each pair, exactly, pairs of like lengths together."""
        out = np.zeros(len(t), dtype=np.int64)
        order = np.argsort(lengths[t], kind="stable")
        a = 0
        while a < len(order):
            size = max(64, int(lengths[t[order[a]]]) * 2)
            part = order[a : a + max(1, AT_ONCE // size)]
            part = part[: max(1, int(np.searchsorted(lengths[t[part]], size, side="right")))]
            nx, ny = lengths[t[part]], self.index.lengths[e[part]]
            grid = lambda src, first, n: np.where(np.arange(int(n.max())) < n[:, None], src[np.minimum(first[:, None] + np.arange(int(n.max())), len(src) - 1)], 0).astype(np.int64)
            out[part] = common_words(grid(flat, starts[t[part]], nx), nx, grid(self.index.text, self.index.offsets[e[part]], ny), ny)
            a += len(part)
        return out


class Shard:
    """The evaluation classes of a shard: their keys, mentions and words, and the index of their contexts."""

    def __init__(self, keys: np.ndarray, mentions: list[str], vocabulary: list[str], index: TextIndex):
        self.keys, self.mentions, self.vocabulary, self.index = keys, mentions, vocabulary, index
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.matcher = Matcher(index)
        self.near: dict[tuple[str, str], bool] = {}

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Shard:
        """Of rows (k1, k2, concept, mention, text), each class once."""
        rows = rows.drop_duplicates(["k1", "k2"])
        number: dict[str, int] = {}
        texts = [[f"{c} {w}" for w in t.split()] for c, t in zip(rows["concept"], rows["text"])]
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        sequences = [np.array([number[w] for w in t], dtype=np.int64) for t in texts]
        return cls(rows[["k1", "k2"]].to_numpy(dtype=np.int64), rows["mention"].tolist(), vocabulary, TextIndex.of(sequences))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        joined = lambda s: np.frombuffer("\n".join(s).encode(), dtype=np.uint8)
        i = self.index
        np.savez_compressed(out, keys=self.keys, mentions=joined(self.mentions), vocabulary=joined(self.vocabulary), symbols=i.symbols.astype(np.uint32), gaps=np.diff(i.starts, prepend=0).astype(np.uint32), lengths=i.lengths.astype(np.uint32))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            mentions, vocabulary = (z[k].tobytes().decode().split("\n") for k in ("mentions", "vocabulary"))
            return cls(z["keys"], mentions, vocabulary if len(z["vocabulary"]) else [], TextIndex(z["symbols"], np.cumsum(z["gaps"].astype(np.int64)), z["lengths"]))

    def pairs(self, rows: pd.DataFrame) -> pd.DataFrame:
        """(t1, t2, e1, e2): the keys of training and evaluation classes that are the same annotated span."""
        texts = [np.array([self.number.get(f"{c} {w}", 0) for w in t.split()], dtype=np.int64) for c, t in zip(rows["concept"], rows["text"])]
        t, e = self.matcher.pairs(texts)
        mentions = rows["mention"].tolist()
        keep = np.array([self._close(mentions[i], self.mentions[j]) for i, j in zip(t.tolist(), e.tolist())], dtype=bool)
        t, e = t[keep], e[keep]
        keys = rows[["k1", "k2"]].to_numpy(dtype=np.int64)
        return pd.DataFrame({"t1": keys[t, 0], "t2": keys[t, 1], "e1": self.keys[e, 0], "e2": self.keys[e, 1]})

    def _close(self, a: str, b: str) -> bool:
        if a == b:
            return True
        if (a, b) not in self.near:
            self.near[a, b] = slips(a, b, SLIPS) <= SLIPS
        return self.near[a, b]


def normal_id(c: Column) -> Column:
    """An ontology id in its usual spelling; null where it is empty."""
    s = F.replace(F.upper(F.regexp_replace(c, r"(?U)\s+", "")), F.lit("_"), F.lit(":"))
    return F.when(s != "", s)


def aliases(concepts: DataFrame) -> DataFrame:
    """(any_id, concept): main and older ids; an id that is both is the main one."""
    own = concepts.select(normal_id(F.col("hpo_id")).alias("any_id"))
    own = own.select("any_id", F.col("any_id").alias("concept"), F.lit(0).alias("r"))
    old = concepts.select(F.explode("alt_ids").alias("a"), "hpo_id").select(normal_id(F.col("a")).alias("any_id"), normal_id(F.col("hpo_id")).alias("concept"), F.lit(1).alias("r"))
    both = own.unionByName(old).where("any_id is not null")
    return both.groupBy("any_id").agg(F.min(F.struct("r", "concept")).alias("m")).select("any_id", F.col("m.concept").alias("concept"))


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The class of each sample; its mention and words go with the first sample of the class that a task meets."""
    met: set[bytes] = set()
    for b in batches:
        keys, mentions, texts = [], [], []
        for c, ev, m, t in zip(b["concept"], b["ev"], b["mention"], b["context"]):
            m, t = plain(m), plain(t)
            k = hashlib.blake2b(f"{c}\n{m}\n{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            keys.append(k)
            new = (k + b"e" if ev else k) not in met and t != ""
            if new:
                met.add(k + b"e" if ev else k)
            mentions.append(m if new else None)
            texts.append(t if new else None)
        k12 = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        yield pd.DataFrame({"sample_id": b["sample_id"], "ev": b["ev"], "concept": b["concept"], "k1": k12[:, 0], "k2": k12[:, 1], "mention": pd.Series(mentions, index=b.index, dtype=object), "text": pd.Series(texts, index=b.index, dtype=object)})


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of shard and block: first its index, then the training classes, which are matched as they come."""
    held, shard, last = None, None, None
    for b in batches:
        for g, rows in b.groupby(["home", "e", "b"], sort=False):
            if g != held:
                held, shard, last = g, None, None
            if rows["kind"].iloc[0] == 0:
                shard = Shard.from_bytes(rows["data"].iloc[0])
                rows = rows.iloc[1:]
            if not len(rows) or shard is None:
                continue
            rows = rows.drop_duplicates(["k1", "k2"])
            if last is not None and (rows["k1"].iloc[0], rows["k2"].iloc[0]) == last:
                rows = rows.iloc[1:]
            if len(rows):
                last = (rows["k1"].iloc[-1], rows["k2"].iloc[-1])
                yield shard.pairs(rows.reset_index(drop=True))


def overlapping_classes(samples: DataFrame, concepts: DataFrame, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((sample_id, ev, k1, k2), (t1, t2, e1, e2)): the class of each sample, and the pairs of a training and an evaluation class that are the same annotated span.

    Later deliveries of a sample replace earlier ones.  Samples with a null id,
    split, mention or context, a context without words, and those whose gold id is
    null, empty or unknown to the concepts, are in no pair.  A sample id is in one split.
    """
    spark = samples.sparkSession
    s = latest_sparse(samples.select("sample_id", "split", "context", "mention", "gold_id", "loaded_at"), "sample_id", "loaded_at")
    s = s.where("split in ('train', 'val', 'test') and context is not null and mention is not null")
    s = s.withColumn("any_id", normal_id(F.col("gold_id"))).join(aliases(concepts), "any_id")
    s = s.select("sample_id", (F.col("split") != "train").alias("ev"), "concept", "mention", "context")
    kind = dict(s.dtypes)["sample_id"]
    rows = materialize(s.mapInPandas(_classes, f"sample_id {kind}, ev boolean, concept string, k1 long, k2 long, mention string, text string"), "span-classes")
    classes = rows.where("text is not null").drop("sample_id")
    sizes = classes.groupBy("concept").agg(F.count_if("ev").alias("ne"), F.count_if(~F.col("ev")).alias("nt")).where("ne > 0 and nt > 0")
    # small concepts share a home; a large one has its own, divided
    es, tb = F.ceil(F.col("ne") / shard).cast("int"), F.ceil(F.col("nt") / block).cast("int")
    homes = max(parallelism(spark) * 2, rows.count() // (2 * block))
    alone = (F.col("es") > 1) | (F.col("tb") > 1)
    home = F.when(alone, F.pmod(F.xxhash64("concept"), F.lit(1 << 40)) + (1 << 41)).otherwise(F.pmod(F.xxhash64("concept"), F.lit(homes)))
    plan = sizes.select("concept", es.alias("es"), tb.alias("tb"), home.alias("home"))
    placed = classes.join(plan, "concept")
    evals = placed.where("ev").withColumn("e", F.pmod(F.col("k1"), F.col("es")).cast("int")).select("home", "e", "tb", "k1", "k2", "concept", "mention", "text")

    def build(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"home": g["home"].iloc[:1], "e": g["e"].iloc[:1], "blocks": g["tb"].max(), "data": [Shard.of(g).to_bytes()]})

    indexes = materialize(evals.groupBy("home", "e").applyInPandas(build, "home long, e int, blocks int, data binary"), "span-index")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    heads = indexes.select("home", "e", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), none("string", "concept"), none("string", "mention"), none("string", "text"), "data")
    trains = placed.where("not ev").withColumn("b", F.pmod(F.col("k2"), F.col("tb")).cast("int")).withColumn("e", F.explode(F.sequence(F.lit(0), F.col("es") - 1)))
    trains = trains.select("home", "e", "b", F.lit(1).alias("kind"), "k1", "k2", "concept", "mention", "text", none("binary", "data"))
    parts = max(parallelism(spark) * 2, rows.count() // block)
    stream = heads.unionByName(trains).repartition(parts, "home", "e", "b").sortWithinPartitions("home", "e", "b", "kind", "k1", "k2")
    pairs = stream.mapInPandas(_streamed, "t1 long, t2 long, e1 long, e2 long")
    return rows.select("sample_id", "ev", "k1", "k2"), pairs


def cross_split_pairs(samples: DataFrame, concepts: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(sample_id_a, sample_id_b, train_id, eval_id): all pairs of one record in ``train`` and one in ``val`` or ``test`` that are the same annotated span."""
    members, pairs = overlapping_classes(samples, concepts, shard, block)
    t = members.where("not ev").select(F.col("sample_id").alias("train_id"), F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    e = members.where("ev").select(F.col("sample_id").alias("eval_id"), F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    found = pairs.join(t, ["t1", "t2"]).join(e, ["e1", "e2"])
    return found.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"), "train_id", "eval_id")


def linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample_id, ev, class_id, links): each sample with the least sample of its class and side, and the number of its partners; no pair is written out."""
    sizes = members.groupBy("k1", "k2", "ev").agg(F.count("*").alias("n"), F.min("sample_id").alias("class_id"))
    pairs = materialize(pairs, "span-pairs")  # read twice
    n = lambda ev, a, b: sizes.where(ev).select(F.col("k1").alias(a), F.col("k2").alias(b), "n")
    of_t = pairs.join(n("ev", "e1", "e2"), ["e1", "e2"]).groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2")).agg(F.sum("n").alias("links")).withColumn("ev", F.lit(False))
    of_e = pairs.join(n("not ev", "t1", "t2"), ["t1", "t2"]).groupBy(F.col("e1").alias("k1"), F.col("e2").alias("k2")).agg(F.sum("n").alias("links")).withColumn("ev", F.lit(True))
    known = sizes.select("k1", "k2", "ev", "class_id").join(of_t.unionByName(of_e), ["k1", "k2", "ev"], "left")
    return members.join(known, ["k1", "k2", "ev"]).select("sample_id", "ev", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id_a, sample_id_b), smaller id first."""
    return cross_split_pairs(table(spark, sf_dir, "samples"), table(spark, sf_dir, "concepts")).select("sample_id_a", "sample_id_b")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, class_id, links) of every sample that can have a partner."""
    return linked(*overlapping_classes(table(spark, sf_dir, "samples"), table(spark, sf_dir, "concepts"))).select("sample_id", "class_id", "links")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, dataset, samples, overlapping, pairs) for each evaluation split and data set."""
    samples = table(spark, sf_dir, "samples")
    each = linked(*overlapping_classes(samples, table(spark, sf_dir, "concepts"))).where("ev and links > 0").select("sample_id", F.col("links").alias("n"))
    rows = latest_sparse(samples.select("sample_id", "split", "dataset", "loaded_at"), "sample_id", "loaded_at").where("split in ('val', 'test')")
    return rows.join(each, "sample_id", "left").groupBy("split", "dataset").agg(F.count("*").alias("samples"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
