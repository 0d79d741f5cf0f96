"""Problem 1: map freely typed values to the entry of a reference list they stand for.

A prefix-filter set-similarity join.  A phrase is the set of letter triples of its
words, so that word order does not count.  Triples are ordered by global rarity;
only the rarest ones of each phrase, as many as the wanted similarity allows, are
looked up; length and place of a shared triple rule out most candidates; Jaccard
is then computed exactly.  The best candidate that also passes an exact reading of
the words is kept: every word of the value but those of degree and certainty must
stand for one word of the entry and the other way round, through spelling, number,
an abbreviation, a missing space, or at most two slips in all.

The reference list is an index in memory, of at most ``CHUNK`` entries at a time;
a longer list is joined chunk by chunk.  Values are joined once however often they
occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import chars
from termloom.llm.overlap import normal_id, slips
from termloom.operators.delivery import latest
from termloom.session import materialize, parallelism, table

#: Least similarity of a candidate.
SIMILARITY = 0.36
SLIPS = 2
CHUNK = 100_000
#: Phrases in which a word near listed ones must occur to be a word of its own where none of those is ever typed.
OWN_PHRASES = 6
UNMATCHED = "UNMATCHED"

# Words that say nothing about the finding.
STOP = {"of", "the", "with", "in", "a", "an", "and", "to", "at", "on"}
DEGREE = {
    "some", "slight", "slightly", "mild", "mildly", "moderate", "moderately", "marked", "markedly", "severe", "severely", "strong", "strongly", "obvious", "obviously", "noticeable", "noticeably",
    "suspected", "possible", "possibly", "probable", "probably", "likely", "presumed", "questionable", "definite", "definitely", "certain", "apparent", "apparently", "clear", "clearly", "confirmed",
    "noted", "today", "very", "rather", "quite", "somewhat", "minimal", "subtle", "pronounced", "considerable", "significant", "query",
}
# Spellings of one word.
SPELLINGS = [("hemorrhag", "haemorrhag"), ("edema", "oedema"), ("tumor", "tumour"), ("color", "colour"), ("dilatation", "dilation"), ("dilation", "dilatation"), ("esthesia", "aesthesia"), ("anemi", "anaemi"), ("fiber", "fibre"), ("center", "centre"), ("ized", "ised"), ("isation", "ization"), ("odor", "odour"), ("diarrhea", "diarrhoea")]

TOKEN = re.compile(r"[^\W_]+\.?")


def read_words(text: str) -> list[str]:
    """Words of a phrase in one case and character form, without stop words; an abbreviating full stop stays with its word."""
    t = chars.canonical(text).lower()
    # a single letter before a hyphen is a letter's name, not an article
    return [m[0] for m in TOKEN.finditer(t) if m[0].rstrip(".") not in STOP or t[m.end() : m.end() + 1] == "-"]


def triples(words: list[str]) -> list[str]:
    """Letter triples of each word with its edges marked, and none of the mark of an abbreviation."""
    out = set()
    for w in words:
        w = f" {w[:-1]}" if w.endswith(".") else f" {w} "
        out.update(w[i : i + 3] for i in range(len(w) - 2))
    return sorted(out)


def forms(word: str) -> set[str]:
    """Spellings and numbers of a word."""
    out = {word} | {word.replace(a, b) for a, b in SPELLINGS if a in word}
    for w in list(out):
        if len(w) > 3:
            out.add(w[:-1] + "ies" if w.endswith("y") and w[-2] not in "aeiou" else w[:-2] + "es" if w.endswith("is") else w + "es" if w.endswith(("s", "x", "ch", "sh")) else w + "s")
    return out


def deletions(word: str, most: int) -> set[str]:
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


class Lexicon:
    """The words of the reference list and what a typed word may stand for."""

    def __init__(self, listed: list[str]):
        self.listed = set(listed)
        self.of: dict[str, set[str]] = {}
        for w in self.listed:
            for f in forms(w):
                self.of.setdefault(f, set()).add(w)
        for w in self.listed:
            self.of[w] = {w}
        # a Greek letter in capitals may have the shape, and so the form, of a Latin one
        for latin, greek in zip("abehikmnoptuxz", "αβεηικμνορτυχζ"):
            if greek in self.listed:
                self.of.setdefault(latin, {greek})
        self.near: dict[str, list[str]] = {}
        for f in self.of:
            for d in deletions(f, self.room(f)):
                self.near.setdefault(d, []).append(f)
        self.by_length = sorted(self.listed)

    @staticmethod
    def room(word: str) -> int:
        """Slips that a word may have: none in a very short one."""
        return 0 if len(word) < 4 else 1 if len(word) < 6 else SLIPS

    def nearest(self, word: str) -> tuple[int, set[str]]:
        """Distance and listed words nearest to a word that is none."""
        best, found = SLIPS + 1, set()
        if len(word) < 4 or any(c.isdigit() for c in word):
            return best, found
        for f in {f for d in deletions(word, SLIPS) for f in self.near.get(d, ())}:
            n = slips(word, f, SLIPS)
            if n <= min(best, self.room(f), SLIPS):
                found = found | self.of[f] if n == best else set(self.of[f])
                best = n
        return best, found

    def readings(self, word: str, own: bool) -> list[tuple[int, tuple[str, ...]]]:
        """(slips, listed words) that a typed word may stand for; none for a word of its own."""
        short = word.endswith(".")
        w = word.rstrip(".")
        if w in self.of:
            longer = [x for x in self.by_length if short and len(w) >= 3 and x.startswith(w) and x not in self.of[w]]
            return [(0, (x,)) for x in [*sorted(self.of[w]), *longer]]
        if w in DEGREE or (not own and len(w) >= 4 and self._degree(w)):
            return [(0, ())]
        out: list[tuple[int, tuple[str, ...]]] = []
        if short and len(w) >= 3:
            out += [(0, (x,)) for x in self.by_length if x.startswith(w) and len(x) > len(w)]
            if out:
                return out
        if own:
            return out
        n, found = self.nearest(w)
        out += [(n, (x,)) for x in sorted(found)]
        if short and len(w) >= 5 and not out:
            out += [(1, (x,)) for x in self.by_length if len(x) > len(w) and slips(x[: len(w)], w, 1) <= 1]
        if not out and len(w) >= 8:
            out += self._parted(w, short)
        return out

    def _degree(self, w: str) -> bool:
        return any(len(d) >= 5 and slips(w, d, 1) <= 1 for d in DEGREE)

    def _parted(self, w: str, short: bool) -> list[tuple[int, tuple[str, ...]]]:
        """Two words written as one."""
        best, out = SLIPS + 1, []
        for i in range(3, len(w) - 2):
            a, b = w[:i], w[i:]
            for x, y in ((a, b), (b, a)):
                if x not in self.of:
                    continue
                n, found = (0, self.of[y]) if y in self.of else self.nearest(y)
                if short and y == b and n > 0:
                    cut = {v for v in self.by_length if v.startswith(y) and len(v) > len(y)}
                    n, found = (0, cut) if cut else (n, found)
                if not found or n > best:
                    continue
                pairs = [(n, (p, q) if x == a else (q, p)) for p in self.of[x] for q in found]
                out = out + pairs if n == best else pairs
                best = n
        return sorted(set(out))


def reading_cost(readings: list[list[tuple[int, tuple[str, ...]]]], entry: list[str]) -> int | None:
    """Least slips at which the value's words, each in one reading, are the words of the entry; None if they never are."""
    best: int | None = None

    def go(i: int, left: tuple[str, ...], cost: int) -> None:
        nonlocal best
        if cost > SLIPS or (best is not None and cost >= best):
            return
        if i == len(readings):
            if not left:
                best = cost
            return
        for n, ws in readings[i]:
            rest, ok = left, True
            for w in ws:
                if w in rest:
                    k = rest.index(w)
                    rest = rest[:k] + rest[k + 1 :]
                else:
                    ok = False
                    break
            if ok:
                go(i + 1, rest, cost + n)

    go(0, tuple(entry), 0)
    return best


class PrefixIndex:
    """Entries by their rarest triples."""

    def __init__(self, entries: list[list[str]], rarity: dict[str, int], similarity: float):
        self.t = similarity
        grams = sorted({g for e in entries for g in e}, key=lambda g: (rarity.get(g, 0), g))
        #: rank by rarity; triples that no entry has come before all
        self.rank = {g: i for i, g in enumerate(grams)}
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        ordered = [np.sort(np.array([self.rank[g] for g in e], dtype=np.int64)) for e in entries]
        self.tokens = np.concatenate(ordered) if ordered else np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        post: list[tuple[int, int, int]] = []
        for e, toks in enumerate(ordered):
            for j, g in enumerate(toks[: self.prefix(len(toks))].tolist()):
                post.append((g, e, j))
        p = np.array(sorted(post), dtype=np.int64).reshape(-1, 3)
        self.entry, self.place = p[:, 1], p[:, 2]
        self.first = np.searchsorted(p[:, 0], np.arange(len(grams) + 1))

    def prefix(self, n: int) -> int:
        return n - int(np.ceil(self.t * n - 1e-9)) + 1 if n else 0

    def join(self, values: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, entry, Jaccard) of all pairs that are at least so similar."""
        sizes = np.array([len(v) for v in values], dtype=np.int64)
        known = [np.sort(np.array([self.rank[g] for g in v if g in self.rank], dtype=np.int64)) for v in values]
        vs, gs, places = [], [], []
        for i, k in enumerate(known):
            # unknown triples are the rarest and take the first places of the prefix
            unknown = int(sizes[i]) - len(k)
            k = k[: max(0, self.prefix(int(sizes[i])) - unknown)]
            vs.append(np.full(len(k), i))
            gs.append(k)
            places.append(np.arange(unknown, unknown + len(k)))
        if not vs:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z.astype(float)
        v, g, at = np.concatenate(vs).astype(np.int64), np.concatenate(gs).astype(np.int64), np.concatenate(places).astype(np.int64)
        n = self.first[g + 1] - self.first[g]
        row = np.repeat(np.arange(len(g)), n)
        p = np.repeat(self.first[g], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        v, at, e, j = v[row], at[row], self.entry[p], self.place[p]
        x, y = sizes[v], self.sizes[e]
        need = np.ceil(self.t / (1 + self.t) * (x + y) - 1e-9)
        keep = (y >= self.t * x - 1e-9) & (x >= self.t * y - 1e-9) & (1 + np.minimum(x - at - 1, y - j - 1) >= need)
        pairs = np.unique(v[keep] * len(self.sizes) + e[keep])
        v, e = pairs // max(1, len(self.sizes)), pairs % max(1, len(self.sizes))
        # exact overlap: a bit for every value and triple
        have = np.zeros((len(values), len(self.rank)), dtype=bool)
        for i, k in enumerate(known):
            have[i, k] = True
        common = np.zeros(len(pairs), dtype=np.int64)
        step = 200_000
        for a in range(0, len(pairs), step):
            vv, ee = v[a : a + step], e[a : a + step]
            m = self.sizes[ee]
            flat = np.repeat(self.starts[ee], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            hit = have[np.repeat(vv, m), self.tokens[flat]]
            common[a : a + step] = np.add.reduceat(hit, np.cumsum(m) - m) if len(m) else 0
        jaccard = common / (sizes[v] + self.sizes[e] - common)
        good = jaccard >= self.t - 1e-9
        return v[good], e[good], jaccard[good]


@lru_cache(2)
def _lexicon(words: tuple[str, ...]) -> Lexicon:
    return Lexicon(list(words))


def best_entries(values: DataFrame, entries: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(value, entry_id, jaccard, slips): the listed id of each distinct non-null value, ``UNMATCHED`` where none fits.

    ``values`` has the column ``value``, in any number of copies;
    ``entries`` has ``entry_id`` and ``name``.  The best entry has the fewest
    slips, then the greatest similarity, then the least id.  Blank values fit none;
    null names and ids are no entries; an empty list leaves all unmatched.
    """
    spark = values.sparkSession
    typed = materialize(values.where("value is not null").select("value").distinct(), "typed-values")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [read_words(x) for x in b["value"]]
            yield pd.DataFrame({"value": b["value"], "words": ws, "phrase": [" ".join(w) for w in ws]})

    read_values = typed.repartition(parallelism(spark)).mapInPandas(read, "value string, words array<string>, phrase string")
    read_values = materialize(read_values, "typed-words")
    # the reference list itself, chunk by chunk
    listed = entries.where("name is not null and entry_id is not null").select("entry_id", "name").distinct().orderBy("name", "entry_id").toPandas()
    listed["words"] = [read_words(x) for x in listed["name"]]
    vocabulary = tuple(sorted({w.rstrip(".") for ws in listed["words"] for w in ws}))
    phrases = read_values.groupBy("phrase").agg(F.first("words").alias("words"), F.count("*").alias("n"))

    # words of their own: those near a listed word that are typed in more ways than it and in no fewer phrases; copies of a value say nothing
    each = phrases.select(F.explode(F.array_distinct(F.transform("words", lambda w: F.regexp_replace(w, r"\.$", "")))).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    counts = {r["w"]: (r["n"], r["m"]) for r in each.where(F.col("w").isin(list(vocabulary))).collect()} if vocabulary else {}

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _lexicon(vocabulary)
        for b in batches:
            rows = []
            for w, n, m in zip(b["w"], b["n"], b["m"]):
                if w not in lex.of and w not in DEGREE:
                    _, near = lex.nearest(w)
                    if not near:
                        continue
                    values, among = (max(counts.get(x, (0, 0))[i] for x in near) for i in (0, 1))
                    if n > values and m >= (among or OWN_PHRASES):
                        rows.append(w)
            yield pd.DataFrame({"w": pd.Series(rows, dtype=object)})

    own = each.where("n > 1").repartition(parallelism(spark)).mapInPandas(own_words, "w string")
    marked = phrases.select("phrase", F.posexplode("words").alias("i", "w")).withColumn("w", F.regexp_replace("w", r"\.$", ""))
    marked = marked.join(own.distinct(), "w").groupBy("phrase").agg(F.collect_set("w").alias("own"))

    # rarity of the triples that entries have, over values and entries
    grams = {g for ws in listed["words"] for g in triples(ws)}

    def gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, int] = {}
            for ws in b["words"]:
                for g in triples(list(ws)):
                    if g in grams:
                        n[g] = n.get(g, 0) + 1
            yield pd.DataFrame({"g": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    rarity = {r["g"]: r["n"] for r in phrases.select("words").mapInPandas(gram_rows, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    for ws in listed["words"]:
        for g in triples(ws):
            rarity[g] = rarity.get(g, 0) + 1

    todo = phrases.select("phrase", "words").join(marked, "phrase", "left").select("phrase", "words", F.coalesce("own", F.array().cast("array<string>")).alias("own"))
    todo = materialize(todo.repartition(parallelism(spark)), "typed-phrases")
    results = None
    for a in range(0, max(1, len(listed)), CHUNK):
        part = listed.iloc[a : a + CHUNK]
        found = todo.mapInPandas(_joiner(part["entry_id"].tolist(), part["words"].tolist(), rarity, vocabulary, similarity), "phrase string, entry_id string, jaccard double, slips int")
        results = found if results is None else results.unionByName(found)
    order = F.struct(F.col("slips").alias("a"), (-F.col("jaccard")).alias("b"), F.col("entry_id").alias("c"))
    best = results.groupBy("phrase").agg(F.min(order).alias("o")).select("phrase", F.col("o.c").alias("entry_id"), F.round(-F.col("o.b"), 6).alias("jaccard"), F.col("o.a").alias("slips"))
    return read_values.select("value", "phrase").join(best, "phrase", "left").select("value", F.coalesce("entry_id", F.lit(UNMATCHED)).alias("entry_id"), "jaccard", "slips")


def _joiner(ids: list[str], entries: list[list[str]], rarity: dict[str, int], vocabulary: tuple[str, ...], similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _lexicon(vocabulary)
        index = PrefixIndex([triples(e) for e in entries], rarity, similarity)
        memory: dict[tuple[str, bool], list] = {}
        plain = [[w.rstrip(".") for w in e] for e in entries]
        for b in batches:
            for start in range(0, len(b), 1000):
                c = b.iloc[start : start + 1000]
                words = [list(w) for w in c["words"]]
                own = [set(o) for o in c["own"]]
                # words of degree stay out of the comparison of triples
                read = []
                for ws, o in zip(words, own):
                    r = []
                    for w in ws:
                        k = (w, w.rstrip(".") in o)
                        if k not in memory:
                            memory[k] = lex.readings(*k)
                        r.append(memory[k])
                    read.append(r)
                meant = [[w for w, x in zip(ws, r) if x != [(0, ())]] for ws, r in zip(words, read)]
                v, e, jaccard = index.join([triples(ws) for ws in meant])
                phrases = c["phrase"].tolist()
                best: dict[int, tuple] = {}
                for i, k, s in zip(v.tolist(), e.tolist(), jaccard.tolist()):
                    if not all(read[i]):
                        continue
                    n = reading_cost(read[i], plain[k])
                    if n is not None:
                        best[i] = min(best.get(i, (9,)), (n, -s, ids[k]))
                yield pd.DataFrame([(phrases[i], x, -s, n) for i, (n, s, x) in best.items()], columns=["phrase", "entry_id", "jaccard", "slips"])

    return run


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, value): the free text of hints, and of candidates without an id."""
    hints = latest(table(spark, sf_dir, "hints"), "hint_id", "logged_at", "mention", "hint_en")
    cand = table(spark, sf_dir, "candidates").where("hpo_id is null").select(F.lit("hpo_name").alias("field"), F.col("cand_id").alias("row_id"), F.col("hpo_name").alias("value")).distinct()
    parts = [hints.select(F.lit(c).alias("field"), F.col("hint_id").alias("row_id"), F.col(c).alias("value")) for c in ("mention", "hint_en")]
    return parts[0].unionByName(parts[1]).unionByName(cand).where("value is not null")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, name): names and synonyms of the concepts under their main ids."""
    c = table(spark, sf_dir, "concepts")
    names = F.array_append(F.coalesce("hpo_synonyms", F.array().cast("array<string>")), F.col("hpo_name"))
    return c.select(normal_id(F.col("hpo_id")).alias("entry_id"), F.explode(names).alias("name")).where("name is not null").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, hpo_id) of every non-null value."""
    values = typed_values(spark, sf_dir)
    best = best_entries(values.select("value"), entries(spark, sf_dir))
    return values.join(best.select("value", F.col("entry_id").alias("hpo_id")), "value").select("field", "row_id", "hpo_id")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, values, matched, unmatched) by field."""
    m = F.count_if(F.col("hpo_id") != UNMATCHED)
    return found(spark, sf_dir).groupBy("field").agg(F.count("*").alias("values"), m.alias("matched"), (F.count("*") - m).alias("unmatched"))
