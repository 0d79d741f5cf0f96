"""Annotation files and corpus texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import ColumnOrName, norm_id, strip

# The two styles of an annotation line.
TAB_LINE = r"(?U)^(\d+)\s+(\d+)\s+(.*)\s+((?i)HP[:_]\d+)\s*$"
BRACKET_LINE = r"(?U)^\[(\d+)::(\d+)\]\s*((?i)HP[_:]\d+)\s*\|\s*(.+?)\s*$"
SPAN = "struct<c0:int,c1:int,mention:string,concept_id:string>"


def _span(c0: Column, c1: Column, mention: Column, cid: Column) -> Column:
    return F.struct(c0.try_cast("int").alias("c0"), c1.try_cast("int").alias("c1"), strip(mention).alias("mention"), norm_id(cid).alias("concept_id"))


def tab_line(line: ColumnOrName) -> Column:
    """struct(c0, c1, mention, concept_id) of ``88 115 mention HP:0000001``; null where the line is no such line.

    A line that the pattern does not take is read as words: two numbers, the
    mention, the id.
    """
    s = strip(line)
    g = [F.regexp_extract(s, TAB_LINE, i) for i in range(1, 5)]
    words = F.split(s, r"(?U)\s+")
    n = F.size(words)
    loose = (n >= 4) & F.get(words, F.lit(0)).rlike(r"^\d+$") & F.get(words, F.lit(1)).rlike(r"^\d+$") & F.element_at(words, -1).rlike(r"^(?i)HP")
    return F.when(s.rlike(TAB_LINE), _span(*g)).when(loose, _span(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.array_join(F.slice(words, 3, F.greatest(n - 3, F.lit(0))), " "), F.element_at(words, -1)))


def bracket_line(line: ColumnOrName) -> Column:
    """The same of ``[27::42]  HP_0000001 | mention``."""
    s = strip(line)
    g = [F.regexp_extract(s, BRACKET_LINE, i) for i in range(1, 5)]
    return F.when(s.rlike(BRACKET_LINE), _span(g[0], g[1], g[3], g[2]))


def is_bracket_style(first_line: ColumnOrName) -> Column:
    s = strip(first_line)
    return s.startswith("[") & s.contains("::")


def parse_lines(lines: DataFrame, doc: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """(doc, pos, c0, c1, mention, concept_id) of annotation lines.

    The style of a document is that of its first line that is not blank.  Blank
    and malformed lines are left out.
    """
    full = lines.where(strip(line) != "")
    style = full.groupBy(doc).agg(is_bracket_style(F.min_by(line, pos)).alias("_bracket"))
    parsed = full.join(style, doc).withColumn("a", F.when(F.col("_bracket"), bracket_line(line)).otherwise(tab_line(line)))
    return parsed.where("a is not null").select(doc, pos, "a.c0", "a.c1", "a.mention", "a.concept_id")


def _named(spark: SparkSession, path: str, by_line: bool) -> DataFrame:
    df = spark.read.text(path, wholetext=not by_line)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select("value", F.url_decode(name).alias("base")).where(~F.col("base").endswith("~"))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(base, text, c0, c1, mention, concept_id): the annotations of ``root/ann`` with the texts of ``root/corpus``.

    A text is the file of the same name, or of that name with ``.txt``.  Backup
    files (``~``) and annotations without a text are left out.
    """
    ann = _named(spark, f"{root}/ann", False).select("base", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    spans = parse_lines(ann, "base")
    text = _named(spark, f"{root}/corpus", False).select(F.col("base").alias("file"), F.col("value").alias("text"))
    exact = text.withColumnRenamed("file", "base")
    stem = text.where(F.col("file").endswith(".txt")).select(F.expr("left(file, length(file) - 4)").alias("base"), F.col("text").alias("t2"))
    joined = spans.join(exact, "base", "left").join(stem, "base", "left").withColumn("text", F.coalesce("text", "t2")).drop("t2")
    return joined.where("text is not null").select("base", "text", "c0", "c1", "mention", "concept_id")


def span_pairs(spans: DataFrame, width: int = 128) -> DataFrame:
    """The spans with ``left_text`` and ``left_span``: the text around each and its place there.  Empty and reversed spans are left out."""
    from termloom.functions.text import context_window

    w = spans.where("c1 > c0").withColumn("w", context_window("text", "c0", "c1", width))
    return w.select(*[c for c in spans.columns if c != "text"], F.col("w.text").alias("left_text"), F.struct("w.c0", "w.c1").alias("left_span"))
