"""Candidates and the hierarchy of concepts: pruning, reranking, most specific sets.

``pairs`` is the closure (ancestor, descendant, steps); every concept also counts
as its own ancestor where a test says so.  Groups of candidates are small (a few
dozen for a mention), so what depends on order folds over a sorted array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_depth(candidates: DataFrame, depths: DataFrame) -> DataFrame:
    """Candidates with depth and depth_norm, the part of the greatest depth; unknown concepts have 0."""
    most = depths.agg(F.greatest(F.max("depth"), F.lit(1)).alias("_most"))
    d = depths.select(F.col("id").alias("concept_id"), "depth")
    # one row of one number
    joined = candidates.join(d, "concept_id", "left").join(F.broadcast(most))
    depth = F.coalesce("depth", F.lit(0))
    return joined.withColumn("depth_norm", depth / F.col("_most")).withColumn("depth", depth).drop("_most")


def with_descendants(candidates: DataFrame, by: str, pairs: DataFrame) -> DataFrame:
    """Candidates with ``below``: which others of the group are descendants of each."""
    a = candidates.select(by, F.col("concept_id").alias("ancestor"))
    b = candidates.select(by, F.col("concept_id").alias("descendant")).distinct()
    below = a.distinct().join(pairs.select("ancestor", "descendant"), "ancestor").join(b, [by, "descendant"]).groupBy(by, F.col("ancestor").alias("concept_id")).agg(F.collect_set("descendant").alias("below"))
    return candidates.join(below, [by, "concept_id"], "left").withColumn("below", F.coalesce("below", F.array().cast("array<string>")))


def pruned(candidates: DataFrame, by: str, pairs: DataFrame, depths: DataFrame, most: int, margin: float = 0.05) -> DataFrame:
    """(by, concept_id, score, rank): in order of score, then depth, then id, a concept is dropped if it or a descendant of it has been kept whose score is at least its own less ``margin``; at most ``most`` stay.

    Ids must be resolved.  Repeated candidates count once, at their best score.
    """
    best = candidates.where("concept_id is not null and score is not null").groupBy(by, "concept_id").agg(F.max("score").alias("score"))
    rows = with_descendants(with_depth(best, depths), by, pairs)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.col("depth_norm")).alias("b"), "concept_id", "score", "below")))
    kind = "array<struct<concept_id:string,score:double>>"

    def step(kept, x):
        beaten = F.exists(kept, lambda y: (F.array_contains(x["below"], y["concept_id"]) | (y["concept_id"] == x["concept_id"])) & (y["score"] >= x["score"] - margin))
        return F.when(beaten | (F.size(kept) >= most), kept).otherwise(F.array_append(kept, F.struct(x["concept_id"].alias("concept_id"), x["score"].alias("score"))))

    kept = rows.groupBy(by).agg(order.alias("o")).select(by, F.aggregate("o", F.expr(f"cast(array() as {kind})"), step).alias("k"))
    return kept.select(by, F.posexplode("k").alias("rank", "x")).select(by, "x.concept_id", "x.score", "rank")


def reranked(candidates: DataFrame, by: str, pairs: DataFrame, depths: DataFrame, weight: float = 0.10, delta: float = 0.02, penalty: float = 0.05) -> DataFrame:
    """Candidates with ``final`` and a new ``rank``: the score plus ``weight`` of the depth, less ``penalty`` once if some descendant in the group is better by ``delta``."""
    base = with_depth(candidates.drop("rank"), depths).withColumn("base", F.round(F.col("score") + weight * F.col("depth_norm"), 9))
    a, b = base.select(by, F.col("concept_id").alias("ancestor"), F.col("base").alias("own")), base.select(by, F.col("concept_id").alias("descendant"), F.col("base").alias("other"))
    beaten = a.join(pairs.select("ancestor", "descendant"), "ancestor").join(b, [by, "descendant"]).where(F.col("other") >= F.round(F.col("own") + delta, 9)).select(by, F.col("ancestor").alias("concept_id")).distinct().withColumn("_hit", F.lit(True))
    out = base.join(beaten, [by, "concept_id"], "left").withColumn("final", F.round(F.col("base") - F.when(F.col("_hit"), penalty).otherwise(0.0), 6))
    w = Window.partitionBy(by).orderBy(F.desc("final"), "concept_id")
    return out.withColumn("rank", F.row_number().over(w) - 1).drop("_hit", "base")


def most_specific(ids: DataFrame, by: str, pairs: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """(by, concept_id[, depth, rank]): distinct ids of each group that are no ancestor of another of it; with ``depths`` the deepest first, equal ones by id."""
    d = ids.where("concept_id is not null").select(by, "concept_id").distinct()
    other = d.select(by, F.col("concept_id").alias("descendant"))
    above = other.join(pairs.select("ancestor", "descendant"), "descendant").select(by, F.col("ancestor").alias("concept_id")).distinct()
    kept = d.join(above, [by, "concept_id"], "left_anti")
    if depths is None:
        return kept
    w = Window.partitionBy(by).orderBy(F.desc("depth"), "concept_id")
    return with_depth(kept, depths).drop("depth_norm").withColumn("rank", F.row_number().over(w) - 1)


def common_ancestor(left: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The rows with ``lca`` and ``distance``: the common ancestor of two concepts by the shortest way, ties by id; null if there is none."""
    own = left.select(F.explode(F.array(a, b)).alias("x")).distinct().select(F.col("x").alias("ancestor"), F.col("x").alias("descendant"), F.lit(0).alias("steps"))
    up = pairs.select("ancestor", "descendant", "steps").unionByName(own)
    ua, ub = up.select("ancestor", F.col("descendant").alias(a), F.col("steps").alias("sa")), up.select("ancestor", F.col("descendant").alias(b), F.col("steps").alias("sb"))
    best = left.select(a, b).distinct().join(ua, a).join(ub, [b, "ancestor"]).groupBy(a, b).agg(F.min(F.struct((F.col("sa") + F.col("sb")).alias("d"), "ancestor")).alias("m"))
    return left.join(best.select(a, b, F.col("m.ancestor").alias("lca"), F.col("m.d").alias("distance")), [a, b], "left")


def near(candidates: DataFrame, by: str, target: str, pairs: DataFrame, most: int) -> DataFrame:
    """Candidates within ``most`` steps of the concept ``target`` of their row, with ``lca`` and ``distance``; those of another branch have no common ancestor and are left out."""
    d = common_ancestor(candidates.select(F.col("concept_id").alias("a"), F.col(target).alias("b")).distinct(), pairs)
    return candidates.join(d.withColumnsRenamed({"a": "concept_id", "b": target}), ["concept_id", target]).where(F.col("distance") <= most)
