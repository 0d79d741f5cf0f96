"""Reading replies of language models and taggers into columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import ColumnOrName, col, polarity, strip

# The tags of the line protocol, and how a reply names a number or an id.
SENT_TAG = r"(?i)^\s*(?:SENT_EN|SENTENCE_EN|EN)\s*[:\t ]\s*(.*)$"
INDEX_TAG = r"(?i)\bINDEX\s*[:=]\s*(-?\d+)\b"
ID_TAG = r"\b(HP:\d{7})\b"

HINTS = "array<struct<hint_en:string,polarity:string,type:string>>"
NO_HINTS = f"cast(array() as {HINTS})"


def parse_indices(reply: ColumnOrName, n: Column) -> Column:
    """The numbers below ``n`` of a list such as ``0,2``, in order, once each; anything else than digits, commas and minus gives none."""
    r = strip(reply)
    ints = F.transform(F.split(r, ","), lambda x: strip(x).try_cast("int"))
    valid = F.array_distinct(F.filter(ints, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    return F.when(r.rlike("^[0-9,-]+$"), valid).otherwise(F.expr("cast(array() as array<int>)"))


def refine_choice(reply: ColumnOrName, ids: Column) -> Column:
    """The chosen number: ``INDEX: n``, else the place of the first id named, else the first whole number; it may be out of range."""
    r = col(reply)
    named = F.regexp_extract(r, INDEX_TAG, 1).try_cast("int")
    hid = F.regexp_extract(r, ID_TAG, 1)
    place = F.nullif(F.array_position(ids, hid), F.lit(0)) - 1
    first = F.regexp_extract(r, r"(-?\d+)", 1).try_cast("int")
    return F.coalesce(named, place.cast("int"), first)


def _lines(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: strip(x) != "")


def _before_end(lines: Column, end: str) -> tuple[Column, Column]:
    """Lines before the first END line, and whether there is one."""
    flags = F.transform(lines, lambda x: x.rlike(end))
    at = F.array_position(flags, True)
    return F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines), at > 0


def _last_sentence(lines: Column, pattern: str) -> Column:
    found = F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, pattern, 1))), lambda x: x != "")
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).otherwise("")


def parse_protocol(reply: ColumnOrName, dialect: str = "loose", repair: bool = True) -> Column:
    """struct(ok, sentence_en, hints, saw_end, n_bad): the line protocol ``SENT_EN`` / ``HINT`` / ``END``.

    ``loose`` takes tags in any case followed by a colon, tab or space, splits
    fields at tabs or else at white space, and ignores unknown lines.  ``tab``
    needs tabs between the fields of a hint with four fields, and counts unknown
    lines as bad.  With ``repair`` a missing END is taken as there.  A null or
    empty reply is not ok.
    """
    r = col(reply)
    loose = dialect == "loose"
    lines, saw = _before_end(_lines(r), r"(?i)^\s*END\s*\.?\s*$" if loose else r"^\s*END\s*$")
    sent = SENT_TAG
    sentence = _last_sentence(lines, sent)
    is_sent = lambda x: x.rlike(sent)
    is_hint = lambda x: x.rlike(r"(?i)^\s*HINT\s*[:\t ]" if loose else r"(?i)^\s*HINT(\s|$)")

    def fields(x: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*HINT\s*[:\t ]?\s*", ""), r"[\r ]+$", "")
        tabs = F.transform(F.split(body, "\t"), lambda p: strip(p))
        return F.when(body.contains("\t"), tabs).otherwise(F.split(body, r"\s+"))

    def hint(x: Column) -> Column:
        p = fields(x)
        n = F.size(p)
        text = strip(F.array_join(F.slice(p, 1, F.greatest(n - 2, F.lit(0))), " " if loose else "\t"))
        kind = F.lower(F.try_element_at(p, F.lit(-1)))
        return F.struct(text.alias("hint_en"), polarity(F.try_element_at(p, F.lit(-2))).alias("polarity"), F.when(kind == "", "other").otherwise(kind).alias("type"))

    raw = F.filter(lines, is_hint)
    whole = F.filter(raw, lambda x: F.size(fields(x)) >= 3)
    hints = F.filter(F.transform(whole, hint), lambda h: h["hint_en"] != "")
    bad = F.size(raw) - F.size(hints)
    if not loose:
        bad = bad + F.size(F.filter(lines, lambda x: ~is_sent(x) & ~is_hint(x)))
    ok = sentence != ""
    return F.struct(ok.alias("ok"), sentence.alias("sentence_en"), F.when(ok, hints).otherwise(F.expr(NO_HINTS)).alias("hints"), (saw | F.lit(repair) & ok).alias("saw_end"), bad.alias("n_bad"))


def safe_json(c: ColumnOrName, schema: str) -> Column:
    """The JSON object of a text: all of it, else from its first ``{`` to its last ``}``; null if neither parses."""
    whole = F.from_json(col(c), schema)
    part = F.from_json(F.regexp_extract(col(c), r"(?s)(\{.*\})", 1), schema)
    ok = lambda x: x.isNotNull() & (F.to_json(x) != "{}")
    return F.when(ok(whole), whole).when(ok(part), part)


def parse_json_hints(c: ColumnOrName) -> Column:
    """struct(ok, sentence_en, hints) of a JSON reply; a hint may be an object or a string, whose polarity is then uncertain."""
    obj = safe_json(c, "sentence_en string, hints array<string>")
    one = "hint_en string, polarity string, type string"

    def hint(h: Column) -> Column:
        o = F.from_json(h, one)
        text = F.when(h.startswith("{"), o["hint_en"]).otherwise(h)
        return F.struct(strip(text).alias("hint_en"), polarity(o["polarity"]).alias("polarity"), F.coalesce(o["type"], F.lit("other")).alias("type"))

    hints = F.filter(F.transform(F.coalesce(obj["hints"], F.array().cast("array<string>")), hint), lambda h: F.coalesce(h["hint_en"], F.lit("")) != "")
    sentence = strip(F.coalesce(obj["sentence_en"], F.lit("")))
    return F.struct((sentence != "").alias("ok"), sentence.alias("sentence_en"), hints.alias("hints"))


def bioes_spans(labels: Column) -> Column:
    """array<struct(i0, i1)>: inclusive token spans.  S stands alone, B opens, E closes what is open, O closes nothing and resets, I changes nothing."""
    kind = "array<struct<i0:int,i1:int>>"
    start = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("open"), F.expr(f"cast(array() as {kind})").alias("out"))
    # O, the most frequent, is left out: a gap between two others resets
    first = lambda x: F.upper(F.substring(x, 1, 1))
    marks = F.filter(F.transform(labels, lambda x, i: F.when(~x.startswith("O"), F.struct(i.alias("i"), first(x).alias("k")))), lambda x: x.isNotNull())

    def step(acc: Column, x: Column) -> Column:
        was = F.when(x["i"] == acc["i"] + 1, acc["open"]).otherwise(-1)
        single = F.struct(x["i"].alias("i0"), x["i"].alias("i1"))
        closed = F.struct(was.alias("i0"), x["i"].alias("i1"))
        out = F.when(x["k"] == "S", F.array_append(acc["out"], single)).when((x["k"] == "E") & (was >= 0), F.array_append(acc["out"], closed)).otherwise(acc["out"])
        opened = F.when(x["k"] == "B", x["i"]).when(x["k"] == "I", was).otherwise(-1)
        return F.struct(x["i"].alias("i"), opened.alias("open"), out.alias("out"))

    return F.aggregate(marks, start, step, lambda acc: acc["out"])


def token_span(offsets: Column, i0: Column, i1: Column) -> Column:
    """struct(c0, c1): the characters from the first to the last token of a span."""
    return F.struct(F.try_element_at(offsets, i0 + 1)["c0"].alias("c0"), F.try_element_at(offsets, i1 + 1)["c1"].alias("c1"))
