"""Choosing rows: holdout splits, hard examples, examples to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.delivery import small


def holdout(df: DataFrame, group: str, key: str, part: float = 0.1, seed: int = 42) -> DataFrame:
    """The rows with ``held``: in each group the max(1, round(part * n)) keys that come first by a seeded digest.

    Digests are counted by their first four digits; those before the edge are held,
    those behind it are not, and only the rows at the edge are ranked, so that no
    group is gathered in one task.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 4))
    # at most 65,536 rows for each group
    counts = rows.groupBy(F.col(group).alias("_g"), "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_g")
    upto = F.sum("_c").over(w.orderBy("_b"))
    want = F.greatest(F.lit(1), F.round(F.sum("_c").over(w) * part))
    edges = counts.select("_g", "_b", "_c", upto.alias("_u"), want.alias("_k")).where("_u >= _k and _u - _c < _k").select("_g", F.col("_b").alias("_e"), (F.col("_k") - F.col("_u") + F.col("_c")).alias("_n"))
    placed = rows.join(small(edges), F.col(group).eqNullSafe(F.col("_g")))
    at_edge = placed.where("_b = _e").withColumn("held", F.row_number().over(Window.partitionBy(group).orderBy("_d", key)) <= F.col("_n"))
    rest = placed.where("_b <> _e").withColumn("held", F.col("_b") < F.col("_e"))
    return rest.unionByName(at_edge).drop("_d", "_b", "_g", "_e", "_n")


def hard_examples(rows: DataFrame, margin: str, key: str, n: int, mode: str = "margin", seed: int = 42) -> DataFrame:
    """``n`` examples: of the least margin (of all rows, or with ``first_margin`` of the first 5n by key), the first by key, or evenly at random.

    A null margin is the least one.
    """
    if mode == "first_margin":
        rows, mode = rows.orderBy(key).limit(5 * n), "margin"
    order = {"margin": [F.col(margin).asc_nulls_first(), F.col(key)], "first": [F.col(key)], "random": [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]}[mode]
    return rows.orderBy(*order).limit(n)


def examples(rows: DataFrame, kind: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each kind, the first by key; each task keeps its first ``n`` before any are shuffled."""
    w = Window.partitionBy(kind).orderBy(key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
