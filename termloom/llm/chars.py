"""Which characters look alike, and the canonical form of a text.

Two texts look the same when their canonical forms are equal.  The form is built
from Unicode's own tables (Python's ``unicodedata``) and a short list of letters
of different scripts that share one shape:

* invisible characters (category Cf but for the subtending Arabic signs) vanish;
* every space separator becomes a plain space, every hyphen of one width a ``-``;
* wide, narrow, no-break, font and compatibility forms of letters become the
  plain letters, among them ligatures and radical forms; raised and lowered,
  circled, squared and fraction forms differ visibly and stay;
* canonical decomposition, marks ordered by combining class, recomposition;
* Cyrillic and Greek letters of the shape of a Latin one become that one.

Case and visible marks stay.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

# Letters that share their shape with a Latin letter, and that letter.
SAME_SHAPE = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Latin letters shaped as a Greek one
    "ꞵ": "β", "Ꞵ": "B", "ɣ": "γ", "ɑ": "α", "ɡ": "g", "ı": "ı",
    # Hyphens of one width
    "‐": "-", "‑": "-", "⁃": "-", "﹣": "-", "－": "-",
    # Apostrophes of one shape
    "ʼ": "’",
}

PLAIN_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


def expand(ch: str) -> str:
    """The canonical decomposition of one character: letters and marks, possibly nothing."""
    cat = unicodedata.category(ch)
    if cat == "Cf" and not 0x600 <= ord(ch) < 0x700:
        return ""
    if cat == "Zs":
        return " "
    if ch in SAME_SHAPE:
        return SAME_SHAPE[ch]
    d = unicodedata.decomposition(ch)
    if d.startswith("<"):
        kind, _, rest = d.partition(" ")
        parts = [chr(int(x, 16)) for x in rest.split()]
        if kind not in PLAIN_KINDS or parts[0] == " " or (kind == "<compat>" and cat == "So" and not 0x2E80 <= ord(ch) < 0x2FE0):
            return ch
        return "".join(map(expand, parts))
    if 0xAC00 <= ord(ch) < 0xD7A4:
        return unicodedata.normalize("NFD", ch)
    if d:
        return "".join(expand(chr(int(x, 16))) for x in d.split())
    return ch


def code_points() -> Iterator[int]:
    """Code points that may have a decomposition or be a mark: without ASCII, ideographs, syllables, surrogates and private use."""
    blocks = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
    return itertools.chain.from_iterable(range(a, b) for a, b in blocks)


@lru_cache(1)
def table() -> dict[int, str]:
    """Code points whose expansion differs from themselves (about 5,000, fixed by Unicode; Hangul syllables apart)."""
    out = {}
    for cp in code_points():
        ch = chr(cp)
        if (e := expand(ch)) != ch:
            out[cp] = e
    return out


def canonical(text: str) -> str:
    """Canonical form of a text, on one machine; the distributed operator gives the same."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(table())))
