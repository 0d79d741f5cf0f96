"""Problem 5: one form for texts that look the same but are written with different characters.

Texts are exploded to positioned code points, joined with the broadcast table of
decompositions and look-alikes (fixed by Unicode, about 6,000 rows), ordered
within each combining sequence by combining class, put together again and
recomposed.  A run of printable ASCII is one piece: every character of it maps to
itself.  Texts are canonicalised once however often they occur.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm import chars
from termloom.operators.delivery import latest
from termloom.session import table

PLAIN = r"\n\x20-\x7e"


@lru_cache(1)
def _marks() -> list[int]:
    return [cp for cp in chars.code_points() if unicodedata.combining(chr(cp))]


@lru_cache(1)
def _units_pattern() -> str:
    """A run of plain characters not followed by a mark, or one character with its marks and the invisible ones between."""
    cls, start, last = [], None, None
    for cp in sorted({*_marks(), *(c for c, e in chars.table().items() if not e)}) + [None]:
        if last is not None and cp == last + 1:
            last = cp
            continue
        if start is not None:
            cls.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
        start = last = cp
    m = "".join(cls)
    return f"(?s)[{PLAIN}]+(?![{m}])|[^{m}][{m}]*|[{m}]+"


def mapping(spark: SparkSession) -> DataFrame:
    """(cp, parts): what each code point becomes, with the combining class of every part."""
    rows = {cp: e for cp, e in chars.table().items()} | {cp: chr(cp) for cp in _marks() if cp not in chars.table()}
    data = [(chr(cp), _parts(e)) for cp, e in rows.items()]
    return spark.createDataFrame(data, "cp string, parts array<struct<ch:string,ccc:int,later:int>>")


def _parts(expansion: str) -> list[tuple[str, int, int]]:
    """Parts with their combining class and the number of base characters after them: marks keep to their own base."""
    classes = [unicodedata.combining(c) for c in expansion]
    return [(c, k, classes[i + 1 :].count(0)) for i, (c, k) in enumerate(zip(expansion, classes))]


@F.pandas_udf(T.StringType())
def _recompose(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def text_key(c: Column) -> tuple[Column, Column]:
    """A key of 128 bits for a text."""
    return F.xxhash64(c), F.xxhash64(F.lit("termloom"), c)


def canonical_forms(texts: DataFrame, column: str = "text") -> DataFrame:
    """(k1, k2, form): the canonical form of each distinct non-null text, under the text's key.

    Null texts have no row; the empty text has the empty form; repeated texts have
    one row; other columns are ignored.  A text of printable ASCII is its own form.
    """
    t = texts.select(F.col(column).alias("t")).where(F.col("t").isNotNull()).distinct()
    k1, k2 = text_key(F.col("t"))
    t = t.select(k1.alias("k1"), k2.alias("k2"), "t")
    plain = t.where(F.col("t").rlike(f"^[{PLAIN}]*$")).select("k1", "k2", F.col("t").alias("form"))
    rest = t.where(~F.col("t").rlike(f"^[{PLAIN}]*$"))
    units = rest.select("k1", "k2", F.posexplode(F.regexp_extract_all("t", F.lit(_units_pattern()), F.lit(0))).alias("u", "unit"))
    cps = units.select("k1", "k2", "u", F.posexplode(F.when(F.col("unit").rlike(f"^[{PLAIN}]+$"), F.array("unit")).otherwise(F.split("unit", ""))).alias("p", "cp"))
    mapped = cps.join(F.broadcast(mapping(texts.sparkSession)), "cp", "left")
    parts = mapped.select("k1", "k2", "u", "p", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("cp").alias("ch"), F.lit(0).alias("ccc"), F.lit(0).alias("later"))))).alias("s", "part"))
    # unit, base character within it, combining class, place
    fields = ((F.col("u"), 40), (31 - F.col("part.later"), 35), (F.col("part.ccc"), 27), (F.col("p"), 8), (F.col("s"), 0))
    place = functools.reduce(operator.add, [F.shiftleft(c.cast("long"), bits) for c, bits in fields])
    built = parts.groupBy("k1", "k2").agg(F.collect_list(F.struct(place.alias("at"), F.col("part.ch").alias("ch"))).alias("a"))
    form = F.array_join(F.transform(F.array_sort("a"), lambda x: x["ch"]), "")
    # a text of nothing but invisible characters leaves no part
    rest_forms = rest.select("k1", "k2").join(built.select("k1", "k2", _recompose(form).alias("form")), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("form", F.lit("")).alias("form"))
    return plain.unionByName(rest_forms)


def with_forms(df: DataFrame, column: str, out: str = "form") -> DataFrame:
    """The frame with the canonical form of one text column; null texts keep a null form."""
    k1, k2 = text_key(F.col(column))
    forms = canonical_forms(df, column).withColumnRenamed("form", out)
    return df.withColumn("k1", k1).withColumn("k2", k2).join(forms, ["k1", "k2"], "left").drop("k1", "k2")


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def disguised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id): mentions that look like a listed name without being one, and requests that look like another's.

    Null mentions and texts are no cases; blank texts neither.
    """
    samples = latest(table(spark, sf_dir, "samples"), "sample_id", "loaded_at", "mention").where("mention is not null")
    requests = latest(table(spark, sf_dir, "requests"), "req_id", "loaded_at", "src").select("req_id", strip(F.col("src")).alias("text")).where("text <> ''")
    concepts = table(spark, sf_dir, "concepts")
    names = concepts.select(F.explode(F.array_append(F.coalesce("hpo_synonyms", F.array().cast("array<string>")), F.col("hpo_name"))).alias("text")).where("text is not null").distinct()

    k1, k2 = text_key(F.col("text"))
    key = ["k1", "k2"]
    mentions = samples.select("sample_id", F.col("mention").alias("text")).select("sample_id", k1.alias("k1"), k2.alias("k2"), "text")
    name_forms = canonical_forms(names)
    looks = canonical_forms(mentions).join(name_forms.select("form").distinct(), "form", "left_semi")
    cases = looks.join(names.select(k1.alias("k1"), k2.alias("k2")), key, "left_anti")
    found_m = mentions.join(cases.select(*key), key, "left_semi").select(F.lit("mention").alias("field"), F.col("sample_id").alias("row_id"))

    req = requests.select("req_id", k1.alias("k1"), k2.alias("k2"), "text")
    f1, f2 = text_key(F.col("form"))
    forms = canonical_forms(req).where("form <> ''").select(*key, f1.alias("f1"), f2.alias("f2"))
    twice = forms.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1")
    cases = forms.join(twice.select("f1", "f2"), ["f1", "f2"], "left_semi")
    found_s = req.join(cases.select(*key), key, "left_semi").select(F.lit("src").alias("field"), F.col("req_id").alias("row_id"))
    return found_m.unionByName(found_s)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, form): the one form of every mention and request text; null texts have a null form."""
    samples = latest(table(spark, sf_dir, "samples"), "sample_id", "loaded_at", "mention")
    requests = latest(table(spark, sf_dir, "requests"), "req_id", "loaded_at", "src")
    rows = samples.select(F.lit("mention").alias("field"), F.col("sample_id").alias("row_id"), F.col("mention").alias("text"))
    rows = rows.unionByName(requests.select(F.lit("src").alias("field"), F.col("req_id").alias("row_id"), F.col("src").alias("text")))
    return with_forms(rows, "text").select("field", "row_id", "form")
