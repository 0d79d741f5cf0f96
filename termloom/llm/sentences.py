"""Problem 2: sentence units of texts in any language and script.

Characters are tagged as the beginning of a unit or as inside one by a
linear-chain model and Viterbi decoding.  A character can begin a unit only after
a terminator, a line break with a heading or list item about it or, in scripts
without terminators, a space; all others are inside by definition, so that the
chain needs to be decoded over those candidates only.  Empty lines always divide;
the inside of a quotation and what follows a title or another abbreviation that
never ends a sentence are never divided.

The model is a structured perceptron, averaged, trained when the query runs on a
bounded sample of the texts (``TRAIN_TEXTS`` for each script).  Its labels come
from a teacher: rules of punctuation, abbreviations and layout for punctuated
scripts, and for the others how paragraphs begin, and digits and full stops; no
punctuation is stripped from their texts.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import chars
from termloom.operators.delivery import latest
from termloom.session import parallelism, table

#: Bound of the sample to train on: texts of each script, and their greatest length.
TRAIN_TEXTS, TRAIN_LENGTH = 300, 6000
EPOCHS = 30

# Abbreviations that never end a sentence, as written.
NEVER_LAST = {
    "Dr", "Prof", "St", "Mr", "Mrs", "Ms", "Mx", "Mme", "Mlle", "Mgr", "M", "MM", "Sr", "Sra", "Srta", "Dra", "Lt", "Hr", "Fr", "Fig", "fig", "Figs", "figs", "Abb", "Tab", "Nr", "No", "no", "Nos", "Vol", "vol", "pp", "p", "S",
    "approx", "aprox", "ca", "env", "vs", "i.e", "e.g", "cf", "bzw", "z", "z.B", "d", "d.h", "u", "p.ex", "p.ej", "pág", "págs", "núm", "Ed", "Eds", "Rev", "Gen", "Col", "Capt", "Sgt", "Hon", "Jr", "Mt", "Dept", "resp", "ref", "Ref",
    "Проф", "проф", "рис", "Рис", "см", "т", "т.е", "т.д", "ул", "им", "доц", "акад", "табл", "стр", "напр", "डॉ", "श्री", "د", "أ", "ص",
}
# Abbreviations that may end a sentence.
MAY_LAST = {"etc", "p.o", "q.d", "b.i.d", "t.i.d", "q.i.d", "i.v", "i.m", "s.c", "p.r.n", "a.m", "p.m", "et al", "al", "Inc", "Ltd", "Co", "Corp", "usw", "u.a", "ff", "г", "гг", "др", "пр", "ex", "ej", "h", "B", "е", "x", "j", "a.C", "d.C", "EE.UU", "U.S"}
# Second parts of abbreviations written with a space.
SECOND = {"B": "z", "h": "d", "ex": "p", "ej": "p", "е": "т", "a": "u", "д": "т"}
# Small words that continue a sentence.
SMALL = {"and", "or", "but", "by", "at", "for", "with", "in", "on", "of", "to", "from", "as", "the", "a", "an", "than", "per", "after", "before", "during", "until", "while", "which", "who", "that", "because", "so", "yet", "since", "within", "under", "said", "wrote", "asked", "noted", "added", "und", "oder", "aber", "mit", "von", "et", "ou", "mais", "de", "y", "o", "pero", "и", "или", "но", "और", "या", "पर"}
# German months and the words before an ordinal number.
MONTHS = {"Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"}
BEFORE_ORDINAL = {"der", "dem", "den", "des", "die", "das", "am", "im", "vom", "zum", "zur", "beim", "seit", "bis", "ab"}
# What continues a sentence after a closing quotation mark in scripts without case.
AFTER_QUOTE = ("随后", "然后", "接着", "之后", "并", "而后", "后来", "说", "道", "と", "って", "という", "との", "및", "라고", "고 ", "และ", "และ", "और", "या", "تم", "ثم", "و")
# Thai words that do not begin a sentence: units, counters, conjunctions and prepositions.
NOT_FIRST = ("ซม", "มม", "มล", "มก", "กก", "กรัม", "วัน", "สัปดาห์", "เดือน", "ปี", "ครั้ง", "ตำแหน่ง", "ชั่วโมง", "นาที", "คน", "หลัง", "ก่อน", "และ", "แต่", "หรือ", "โดย", "ที่", "ใน", "จาก", "ต่อ", "เมื่อ", "จน", "เพราะ", "ซึ่ง", "ว่า", "มี", "ได้", "พบ", "วัด", "ขนาด", "ๆ")

NEVER_LAST, MAY_LAST, SMALL = ({chars.canonical(w) for w in words} for words in (NEVER_LAST, MAY_LAST, SMALL))
SECOND = {chars.canonical(a): chars.canonical(b) for a, b in SECOND.items()}

TERMINATORS = ".!?…。！？｡।॥؟۔"
FULL_WIDTH = "。！？｡"
CLOSERS = "\"'”’»›」』）)]}“"
OPENERS = "\"'“‘„«‹「『（([{¿¡"
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "‹": "›", "„": "“”", '"': '"'}
MARK = re.compile(rf"(?:[•·▪◦‣*–—-]|\(?\d{{1,3}}[.)、]|\(?[A-Za-z]\))[^\S\n]+(?!(?:{'|'.join(sorted(MONTHS))})\b)(?=\S)")
END_MARKS = re.compile(rf"[{re.escape(TERMINATORS)}]+[{re.escape(CLOSERS)}]*")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")


def script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "latin"
    for name, a, b in (("cyrillic", 0x400, 0x530), ("arabic", 0x600, 0x780), ("deva", 0x900, 0x980), ("thai", 0xE00, 0xE80), ("lao", 0xE80, 0xF00), ("myanmar", 0x1000, 0x10A0), ("khmer", 0x1780, 0x1800), ("kana", 0x3040, 0x3100), ("han", 0x3400, 0xA000), ("hangul", 0xAC00, 0xD7B0)):
        if a <= o < b:
            return name
    return "other"


SPACED = {"thai", "lao", "khmer", "myanmar"}


def main_script(text: str) -> str:
    n = Counter(script(c) for c in text[:400] if c.isalpha())
    return n.most_common(1)[0][0] if n else "other"


def kind_of(ch: str) -> str:
    ch = clean(ch)[:1]
    if not ch:
        return "end"
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "upper" if ch.isupper() or ch.istitle() else "lower" if ch.islower() else script(ch)
    if ch in OPENERS:
        return "open"
    if ch in "-–—":
        return "dash"
    if ch in ",;:，；：、،؛":
        return "comma"
    return "mark" if ch in "•·▪◦‣*" else "other"


def clean(token: str) -> str:
    return token if token.isascii() else chars.canonical(token)


class Paragraph:
    """One stretch between empty lines: its candidates and what is known of each."""

    def __init__(self, text: str, a: int, b: int, learned: frozenset = frozenset()):
        self.text, self.a, self.b, self.learned = text, a, b, learned
        self.quotes = self._quotes()
        self.candidates = [(i, c) for i, c in ((i, self._look(i, j, e)) for i, j, e in self._places()) if possible(c)]

    def _quotes(self) -> list[tuple[int, int]]:
        """Matched quotations (first and last mark)."""
        t, out, stack = self.text, [], []
        for i in range(self.a, self.b):
            c = t[i]
            if c not in '"“”«»「」『』‹›„':
                continue
            if stack and c in PAIRS[t[stack[-1]]] and (c != '"' or i > stack[-1] + 1):
                out.append((stack.pop(), i))
            elif c in PAIRS:
                if c == '"' and (i + 1 >= self.b or t[i + 1].isspace()):
                    continue  # cannot open
                stack.append(i)
            else:  # a closing mark whose opening one is further down, or none
                for k in range(len(stack) - 1, -1, -1):
                    if c in PAIRS[t[stack[k]]]:
                        out.append((stack[k], i))
                        del stack[k:]
                        break
        return sorted(out)

    def quoted(self, i: int) -> bool:
        return any(a < i <= b for a, b in self.quotes)

    def _places(self) -> list[tuple[int, int, int]]:
        """(beginning, end of what stands before, start of the end marks) of each candidate."""
        t, out, seen = self.text, [], set()

        def add(i: int, j: int, e: int) -> None:
            if self.a < i < self.b and i not in seen:
                seen.add(i)
                out.append((i, j, e))

        for m in END_MARKS.finditer(t, self.a, self.b):
            # an opening mark is none of the closing ones, unless its quotation ends here
            j = m.end()
            while j > m.start() + 1 and t[j - 1] in '"“' and any(q == j - 1 for q, _ in self.quotes):
                j -= 1
            i = j
            while i < self.b and t[i].isspace():
                i += 1
            # French and others have a space before a closing mark
            k = i
            while k < self.b and t[k] in "»›”」』)" and any(q == k for _, q in self.quotes):
                k += 1
            if k > i:
                j = i = k
                while i < self.b and t[i].isspace():
                    i += 1
            if i > j or (i < self.b and (t[m.start()] in FULL_WIDTH or t[i - 1] in FULL_WIDTH + "”」』" or (t[i].isupper() or kind_of(t[i]) in ("open", "han", "kana")))):
                add(i, j, m.start())
        for m in re.compile(r"\s*\n\s*").finditer(t, self.a, self.b):
            add(m.end(), m.start(), m.start())
        for m in re.compile(r"[^\S\n]+").finditer(t, self.a, self.b):
            if m.end() < self.b and script(t[m.end()]) in SPACED:
                add(m.end(), m.start(), m.start())
        return sorted(out)

    def _look(self, i: int, j: int, e: int) -> dict:
        t = self.text
        gap = t[j:i]
        line = t.rfind("\n", self.a, j) + 1 or self.a
        line = max(line, self.a)
        ends = t[e:j]
        k = e
        while k > self.a and not t[k - 1].isspace():
            k -= 1
        token = clean(t[k:e]).lstrip("\"'“‘„«‹「『（([{¿¡-–—")
        parts = re.split(r"[.!?…]", token)
        if len(parts) > 1 and len(parts[-2]) > 2 and parts[-1][:1].isupper():
            token = parts[-1]  # the space between two sentences is missing
        before = t[self.a : k].rstrip()
        prior = clean(before.split()[-1]).rstrip(".") if before else ""
        rest = t[i : i + 24]
        word = re.match(r"[^\W\d_]+", clean(rest))
        word = word[0] if word else ""
        last = ends.rstrip(CLOSERS + " \n\t") if ends else ""
        closing = next(((a, b) for a, b in self.quotes if e < b < i and b >= j - 3), None)
        introduced = False
        if closing:
            lead = t[max(self.a, closing[0] - 40) : closing[0]].rstrip()
            introduced = bool(lead) and lead[-1] not in TERMINATORS + CLOSERS and closing[0] > self.a
        term = "none"
        if last:
            term = "dots" if last[0] == "…" or (last.startswith("..") and set(last) <= {"."}) else "strong" if set(last) & set("!?！？؟") else "full" if last[0] in "。｡।॥۔" else "stop"
        abbr = "none"
        if term == "stop":
            if line + len(t[line:e]) - len(t[line:e].lstrip()) <= k and MARK.match(t[line:i].lstrip() + "x") and k == line + len(t[line:e]) - len(t[line:e].lstrip()) and "\n" not in gap:
                abbr = "listmark"
            elif token in SECOND and prior == SECOND[token]:
                abbr = "never"
            elif token in ("No", "no"):
                abbr = "never" if kind_of(t[i : i + 1]) == "digit" else "none"
            elif token in NEVER_LAST or token in self.learned:
                abbr = "never"
            elif token in MAY_LAST:
                abbr = "may"
            elif len(token) == 1 and token.isupper():
                abbr = "initial"
            elif token.isdigit() and len(token) <= 2 and gap and (word in MONTHS or prior.lower() in BEFORE_ORDINAL):
                abbr = "ordinal"
        first_line = line == self.a
        current = t[line:j]
        item, head, colon = bool(MARK.match(current.lstrip())), first_line and "\n" in gap and 0 < len(current.strip()) <= 28 and not re.search(r"[\d,.;]", current), "\n" in gap and current.rstrip()[-1:] in (":", "：")
        marked = "\n" in gap and bool(MARK.match(t[i : i + 16])) and (not t[i].isdigit() or term != "none" or item or head or colon)
        return {
            "gap": "none" if not gap else "line" if "\n" in gap else "space",
            "term": term,
            "token": token,
            "abbr": abbr,
            "next": kind_of(t[i : i + 1]),
            "word": word,
            "small": word in SMALL,
            "short": len(re.split(rf"[{re.escape(TERMINATORS)}]\s", t[max(line, e - 60) : e])[-1].split()) <= 2,
            "foreign": bool(word) and script(rest[:1]) != "latin",
            "quote": "in" if self.quoted(i) and not any(a == i for a, _ in self.quotes) else "none" if not closing else "led" if introduced else "alone",
            "paren": any(c in ")）]" for c in ends[len(last) :]),
            "after": t[i : i + 6].startswith(AFTER_QUOTE),
            "item": item,
            "mark": marked,
            "head": head,
            "colon": colon,
            "spaced": script(t[i]) in SPACED,
            "left": re.sub(r"\d", "0", clean(t[max(self.a, j - 8) : j])).rstrip(".")[-4:],
            "code": bool(re.search(r"[A-Za-z]", t[k:j])),
            "right": re.sub(r"\d", "0", rest[:12]),
        }


def possible(c: dict) -> bool:
    """Whether a unit can begin there at all: not inside a quotation, not after what never ends one, not at a plain line break."""
    if c["quote"] == "in" or c["abbr"] in ("never", "listmark", "initial", "ordinal"):
        return False
    return c["term"] != "none" or c["spaced"] or c["mark"] or c["item"] or c["colon"] or c["head"]


def teacher(c: dict, openers: frozenset) -> bool:
    """Whether a unit begins at a candidate, by the rules."""
    if c["spaced"] and c["term"] in ("none", "stop") and c["gap"] != "none" and not c["mark"]:
        if c["gap"] == "line" and (c["item"] or c["colon"] or c["head"]):
            return True
        if c["right"][:4] in openers:
            return True
        return not c["code"] and not c["right"].startswith(NOT_FIRST) and (c["left"][-1:] == "0" or c["term"] == "stop")
    if c["gap"] == "line":
        if c["mark"] or c["item"]:
            return True
        if c["colon"] and c["next"] != "lower":
            return True
        if c["head"] and c["next"] not in ("lower", "comma", "digit") and c["term"] == "none":
            return True
    if c["term"] == "none":
        return False
    if c["next"] == "comma":
        return False
    if c["quote"] in ("led", "alone"):
        if c["next"] == "dash" or c["after"]:
            return False
        if c["next"] == "lower":
            return c["quote"] == "alone" and not c["small"]
        return True
    if c["term"] == "dots":
        if c["next"] == "lower":
            return c["gap"] != "none" and not c["small"] and not c["short"] and not c["foreign"]
        return c["next"] in ("upper", "digit", "open") and c["gap"] != "none"
    if c["term"] in ("strong", "full"):
        return not (c["paren"] and c["next"] == "lower")
    if c["abbr"] == "may":
        if c["next"] == "lower" and c["foreign"]:
            return False
        return not (c["next"] == "lower" and c["small"]) and not (c["next"] == "digit" and c["token"] not in ("etc", "t.i.d"))
    if c["paren"] and c["next"] == "lower":
        return False
    if c["gap"] == "none":
        return c["next"] in ("upper", "open", "han", "kana") and len(c["token"]) > 1 and c["token"][-1:].isalpha() and "." not in c["token"]
    return True


def features(c: dict) -> list[str]:
    """Names of what holds at a candidate."""
    token = c["token"].lower()[-6:] if not c["token"][-1:].isdigit() else "0"
    shape = f"{c['term']}|{c['gap']}|{c['next']}"
    layout = f"{c['item']:d}{c['mark']:d}{c['head']:d}{c['colon']:d}"
    out = [
        "b",
        f"s:{shape}",
        f"a:{c['abbr']}|{c['next']}|{c['small']:d}",
        f"g:{shape}|{c['short']:d}|{c['small']:d}|{c['foreign']:d}|{c['abbr']}",
        f"q:{c['quote']}|{c['next']}|{c['small']:d}|{c['after']:d}",
        f"l:{layout}|{c['gap']}|{c['next']}",
        f"m:{c['gap'] == 'line':d}|{layout}|{c['next']}|{c['term'] != 'none':d}",
        f"k:{c['term']}|{c['gap'] == 'none':d}|{c['abbr']}|{c['quote']}|{c['next']}|{c['small']:d}|{c['after']:d}|{c['foreign']:d}|{c['paren']:d}",
        f"mark:{c['mark']:d}{c['item']:d}",
        f"glue:{c['gap'] == 'none':d}|{c['term']}|{c['next']}|{len(c['token']) > 1:d}",
        f"t:{token}|{c['term']}",
        f"t2:{token}|{c['next']}",
        f"w:{c['word'].lower()[:6]}|{c['term']}",
        f"all:{shape}|{c['abbr']}|{c['quote']}|{c['small']:d}|{c['after']:d}|{c['paren']:d}|{layout}|{c['spaced']:d}",
    ]
    if c["spaced"]:
        out += [f"r{n}:{c['right'][:n]}" for n in (1, 2, 3, 4, 5)] + [f"f{n}:{c['left'][-n:]}" for n in (1, 2, 3)] + [f"rf:{c['right'][:4]}|{c['left'][-1:]}", f"c:{c['code']:d}|{c['right'][:3]}"]
    return out


def reach(d: int) -> str:
    """Class of the distance between two candidates."""
    return "1" if d < 4 else "2" if d < 12 else "3" if d < 40 else "4"


def decode(emission: list[float], places: list[int], start: int, pair: dict[tuple, float]) -> list[bool]:
    """The best tags: begins a unit or not; the text's first character always does."""
    if not emission:
        return []
    score = {True: 0.0, False: float("-inf")}
    back = []
    previous = start
    for e, p in zip(emission, places):
        r = reach(p - previous)
        step, new = {}, {}
        for tag in (False, True):
            best = max((False, True), key=lambda o: score[o] + pair.get((o, tag, r), 0.0))
            step[tag] = best
            new[tag] = score[best] + pair.get((best, tag, r), 0.0) + (e if tag else 0.0)
        back.append(step)
        score, previous = new, p
    tag = score[True] > score[False]
    out = []
    for step in reversed(back):
        out.append(tag)
        tag = step[tag]
    return out[::-1]


class Model:
    """Weights of features for beginning a unit, and of pairs of tags."""

    def __init__(self, weights: dict[str, float] | None = None, pair: dict[tuple, float] | None = None, learned: frozenset = frozenset()):
        self.weights, self.pair, self.learned = weights or {}, pair or {}, learned

    def units(self, text: str) -> list[tuple[int, int]]:
        """(c0, c1) of the units of a text, without white space at their ends."""
        out = []
        for a, b in paragraphs(text):
            p = Paragraph(text, a, b, self.learned)
            places = [i for i, _ in p.candidates]
            emission = [sum(self.weights.get(f, 0.0) for f in features(c)) for _, c in p.candidates]
            tags = decode(emission, places, a, self.pair)
            starts = [a, *(i for i, tag in zip(places, tags) if tag), b]
            for s, e in zip(starts, starts[1:]):
                while e > s and text[e - 1].isspace():
                    e -= 1
                if e > s:
                    out.append((s, e))
        return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Stretches between empty lines, without white space at their ends."""
    out, a = [], 0
    for m in [*BLANK.finditer(text), None]:
        b = m.start() if m else len(text)
        s, e = a, b
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
        a = m.end() if m else b
    return out


def drills(n: int = 9000, seed: int = 5) -> list[dict]:
    """Candidates of every kind, made up, so that kinds that a sample lacks are learned as well."""
    rng = random.Random(seed)
    choices = {
        "gap": ("none", "space", "space", "line"), "term": ("none", "stop", "stop", "strong", "full", "dots"), "abbr": ("none", "none", "never", "may", "initial", "listmark", "ordinal"),
        "next": ("upper", "upper", "lower", "digit", "open", "comma", "dash", "mark", "han", "kana", "arabic", "deva", "other"), "quote": ("none", "none", "none", "led", "alone"),
    }
    rare = ("small", "paren", "after", "item", "mark", "head", "colon", "short")
    out = []
    for _ in range(n):
        c = {k: rng.choice(v) for k, v in choices.items()} | {k: rng.random() < 0.12 for k in rare}
        if c["term"] != "stop":
            c["abbr"] = "none"
        if c["gap"] != "line":
            c |= {"mark": False, "head": False, "colon": False}
        c |= {"small": c["small"] and c["next"] == "lower", "foreign": c["next"] in ("han", "kana", "arabic", "deva") or rng.random() < 0.1}
        if c["next"] in ("upper", "lower") and c["foreign"]:
            c["small"] = False
        c["spaced"] = False
        if not possible(c):
            continue
        out.append(c | {"token": rng.choice(("etc", "word")) if c["abbr"] == "may" else "word", "word": "", "left": "", "right": "", "code": False})
    return out


def train(texts: list[str], epochs: int = EPOCHS) -> Model:
    """An averaged structured perceptron on the teacher's labels of the texts and of the drills."""
    openers = Counter()
    tokens: dict[str, Counter] = {}
    for t in texts:
        for a, b in paragraphs(t):
            if script(t[a]) in SPACED and b - a > 30:
                openers[t[a : a + 4]] += 1
        for m in re.finditer(r"(?<!\S)([^\W\d_]{1,5})\.\s+(\S)", t):
            tokens.setdefault(clean(m[1]), Counter())[kind_of(m[2])] += 1
        for m in re.finditer(r"(?<!\S)([^\W\d_]{1,5})\.\s*(?:\n\s*\n|$)", t):
            tokens.setdefault(clean(m[1]), Counter())["end"] += 1
    known = frozenset(o for o, n in openers.items() if n >= 2)
    # short tokens with a full stop that go on in lower case or digits nearly always are abbreviations
    learned = frozenset(w for w, n in tokens.items() if n.total() >= 8 and (n["lower"] + n["digit"] >= 0.9 * n.total()) and not n["end"] and w not in MAY_LAST)
    data = []
    for t in texts:
        for a, b in paragraphs(t):
            p = Paragraph(t, a, b, learned)
            c = p.candidates
            if c:
                data.append((a, [i for i, _ in c], [features(x) for _, x in c], [teacher(x, known) for _, x in c]))
    data += [(0, [40], [features(x)], [teacher(x, known)]) for x in drills()]
    random.Random(1).shuffle(data)
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    pw: dict[tuple, float] = {}
    ptotal: dict[tuple, float] = {}
    n = 1
    for _ in range(epochs):
        wrong = 0
        for start, places, feats, gold in data:
            guess = decode([sum(w.get(f, 0.0) for f in fs) for fs in feats], places, start, pw)
            if guess != gold:
                wrong += 1
                before_g, before_y, prev = True, True, start
                for fs, g, y, p in zip(feats, guess, gold, places):
                    if g != y:
                        for f in fs:
                            w[f] = w.get(f, 0.0) + (1 if y else -1)
                            total[f] = total.get(f, 0.0) + n * (1 if y else -1)
                    r = reach(p - prev)
                    for key, d in (((before_y, y, r), 1), ((before_g, g, r), -1)):
                        pw[key] = pw.get(key, 0.0) + d
                        ptotal[key] = ptotal.get(key, 0.0) + n * d
                    before_g, before_y, prev = g, y, p
            n += 1
        if not wrong:
            return Model(w, pw, learned)  # all labels are met: the weights as they are
    return Model({f: v - total[f] / n for f, v in w.items()}, {k: v - ptotal[k] / n for k, v in pw.items()}, learned)


def sample_texts(texts: DataFrame, column: str, per_script: int = TRAIN_TEXTS, length: int = TRAIN_LENGTH) -> list[str]:
    """At most so many texts of each script, the ones with the least hashes, none longer than ``length``."""

    def scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"t": b["t"], "s": [main_script(t) for t in b["t"]]})

    short = texts.select(F.col(column).alias("t")).where(F.length("t").between(1, length)).distinct()
    short = short.mapInPandas(scripts, "t string, s string")
    # each task keeps its least hashes, then the script does: nothing unbounded is gathered
    rank = F.struct(F.xxhash64("t").alias("h"), F.col("t"))
    buckets = short.groupBy("s", F.pmod(F.xxhash64("t"), F.lit(per_script)).alias("b")).agg(F.min(rank).alias("r"))
    return [r["t"] for r in buckets.select("s", "r.t").orderBy("s", "t").collect()]


def sentence_units(df: DataFrame, key: str, column: str, per_script: int = TRAIN_TEXTS) -> DataFrame:
    """(key, sid, c0, c1): the units of each text, numbered in order.

    Null, empty and blank texts have no unit.  Keys are taken as they are;
    deliver each once.
    """
    kind = dict(df.dtypes)[key]
    texts = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("t"))
    model = train(sample_texts(texts, "t", per_script))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, s, c0, c1) for k, t in zip(b["k"], b["t"]) for s, (c0, c1) in enumerate(model.units(t))]
            yield pd.DataFrame(rows, columns=[key, "sid", "c0", "c1"])

    return texts.repartition(parallelism(df.sparkSession)).mapInPandas(run, f"`{key}` {kind}, sid int, c0 int, c1 int")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req_id, sid, c0, c1) of every request's text."""
    requests = latest(table(spark, sf_dir, "requests"), "req_id", "loaded_at", "src")
    return sentence_units(requests, "req_id", "src")
