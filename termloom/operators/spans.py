"""Spans and tokens: overlaps, labels, best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import bound, clamp, ends

#: Pieces that tile a text: white space and the token after it; the last has no token.
TOKEN = r"(?U)\s*+(\w++|[^\w\s]|\z)"


def tokens(text: Column) -> Column:
    """array<struct(token, c0, c1)>: words and single marks with their places.

    Text and tokens are walked together: what stands between two tokens is white space.
    """

    def place(x: Column) -> Column:
        token = lambda t, i: F.struct(t.alias("token"), (F.get(x["ends"], i) - F.length(t)).alias("c0"), F.get(x["ends"], i).alias("c1"))
        return F.filter(F.transform(x["tokens"], token), lambda t: t["c1"] > t["c0"])

    found = lambda group: F.regexp_extract_all(text, F.lit(TOKEN), F.lit(group))
    return bound(F.struct(found(1).alias("tokens"), ends(found(0)).alias("ends")), place)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two half-open spans share a place."""
    return (a1 > b0) & (a0 < b1)


def token_range(offsets: Column, c0: Column, c1: Column) -> Column:
    """struct(i0, i1): the first and last token that a span overlaps; all tokens if there is none."""
    hit = F.filter(F.transform(offsets, lambda t, i: F.when(overlaps(t["c0"], t["c1"], c0, c1), i)), lambda x: x.isNotNull())
    return F.when(F.size(hit) > 0, F.struct(F.get(hit, F.lit(0)).alias("i0"), F.try_element_at(hit, F.lit(-1)).alias("i1"))).otherwise(F.struct(F.lit(0).alias("i0"), (F.size(offsets) - 1).alias("i1")))


def bioes_labels(offsets: Column, spans: Column, kind: str = "PHENO") -> Column:
    """One label for each token; a later span overwrites an earlier one."""
    over = lambda t, s: overlaps(t["c0"], t["c1"], s["c0"], s["c1"])

    def inside(offsets: Column, i: Column, hit: Column) -> Column:
        # the tokens that a span overlaps are neighbours
        before, after = (F.coalesce(over(F.get(offsets, j), hit), F.lit(False)) for j in (i - 1, i + 1))
        return F.when(before & after, f"I-{kind}").when(before, f"E-{kind}").when(after, f"B-{kind}").otherwise(f"S-{kind}")

    def label(offsets: Column, spans: Column, t: Column, i: Column) -> Column:
        last = F.try_element_at(F.filter(spans, lambda s: over(t, s)), F.lit(-1))
        # most tokens are in no span: they are looked at once
        return F.when(F.exists(spans, lambda s: over(t, s)), bound(last, lambda hit: inside(offsets, i, hit))).otherwise("O")

    some = lambda o: bound(spans, lambda s: F.transform(o, lambda t, i: label(o, s, t, i)))
    return bound(offsets, lambda o: F.when(F.size(F.coalesce(spans, F.expr("array()"))) > 0, some(o)).otherwise(F.transform(o, lambda t: F.lit("O"))))


def inclusive_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two spans whose ends belong to them."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    union = (a1 - a0 + 1) + (b1 - b0 + 1) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


#: Characters of a bucket of places; two spans can only overlap if they share a bucket.
BUCKET = 256


def overlap_join(a: DataFrame, b: DataFrame, doc: str, in_a: tuple[str, str], in_b: tuple[str, str]) -> DataFrame:
    """Rows of two frames of one document whose half-open spans overlap.

    The join is on document and bucket of places, so that a long document with
    many spans does not pair them all; a pair is kept in its first bucket only.
    """

    def buckets(c: tuple[str, str]) -> Column:
        return F.explode(F.sequence(F.floor(F.col(c[0]) / BUCKET), F.floor((F.greatest(F.col(c[1]) - 1, F.col(c[0]))) / BUCKET)))

    both = a.withColumn("_k", buckets(in_a)).join(b.withColumn("_k", buckets(in_b)), [doc, "_k"])
    first = F.col("_k") == F.floor(F.greatest(F.col(in_a[0]), F.col(in_b[0])) / BUCKET)
    return both.where(overlaps(F.col(in_a[0]), F.col(in_a[1]), F.col(in_b[0]), F.col(in_b[1])) & first).drop("_k")


def best_overlap(gold: DataFrame, pred: DataFrame, doc: str, least: float = 0.5) -> DataFrame:
    """``gold`` (doc, g0, g1) with the predicted span (p0, p1) of the greatest overlap of at least ``least``, the first of equals; null if there is none."""
    ends = lambda d, c: d.withColumn(f"_{c}", F.col(c) + 1)  # noqa: E731 - half-open for the join
    both = overlap_join(ends(gold, "g1"), ends(pred, "p1"), doc, ("g0", "_g1"), ("p0", "_p1")).withColumn("iou", F.round(inclusive_iou(F.col("g0"), F.col("g1"), F.col("p0"), F.col("p1")), 6)).where(F.col("iou") >= least)
    w = Window.partitionBy(doc, "g0", "g1").orderBy(F.desc("iou"), "p0", "p1")
    best = both.withColumn("r", F.row_number().over(w)).where("r = 1").select(doc, "g0", "g1", "p0", "p1", "iou")
    return gold.select(doc, "g0", "g1").distinct().join(best, [doc, "g0", "g1"], "left")


def valid_spans(spans: DataFrame, c0: str, c1: str, length: Column, *by: str) -> DataFrame:
    """Spans clamped to their text of ``length``, of at least one character, each once for its place and ``by``, in order of place."""
    inside = spans.withColumn(c0, clamp(c0, length)).withColumn(c1, clamp(c1, length))
    return inside.where(F.col(c1) > F.col(c0)).dropDuplicates([*by, c0, c1])
