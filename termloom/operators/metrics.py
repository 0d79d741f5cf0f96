"""Hit rates and precision, recall and F1, for each data set and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, rounded to 6 places."""
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def with_hits(gold: DataFrame, ranked: DataFrame, by: str) -> DataFrame:
    """``gold`` (by, gold_id, ...) with ``gold_rank``: the rank of the gold concept among the candidates, null where it isn't."""
    hit = ranked.select(by, F.col("concept_id").alias("gold_id"), F.col("rank").alias("gold_rank")).groupBy(by, "gold_id").agg(F.min("gold_rank").alias("gold_rank"))
    return gold.join(hit, [by, "gold_id"], "left")


def retrieval_metrics(hits: DataFrame, dataset: str = "dataset", k: int = 15) -> DataFrame:
    """(dataset, total, top1, top5, recall_k) of each data set and, with a null data set, overall: ratios of sums, not means of ratios.

    A mention without its gold concept among the candidates is a miss.
    """
    n = F.count("*")
    counted = hits.groupBy(dataset).agg(n.alias("total"), F.count_if(F.col("gold_rank") < 1).alias("h1"), F.count_if(F.col("gold_rank") < 5).alias("h5"), F.count_if(F.col("gold_rank") < k).alias("hk"))
    summed = counted.rollup(dataset).agg(*[F.sum(c).alias(c) for c in ("total", "h1", "h5", "hk")], F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 1, "_GLOBAL").otherwise(F.coalesce(dataset, F.lit("none")))
    return summed.select(name.alias(dataset), "total", ratio(F.col("h1"), F.col("total")).alias("top1"), ratio(F.col("h5"), F.col("total")).alias("top5"), ratio(F.col("hk"), F.col("total")).alias("recall_k"))


def single_prf(rates: DataFrame, hit: str = "top5") -> DataFrame:
    """Hit rates with ``precision``, ``recall`` and ``f1``: with one answer for each mention all three are the rate of hits."""
    return rates.select("*", *[F.col(hit).alias(c) for c in ("precision", "recall", "f1")])


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def set_prf(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of the distinct ids of two frames (by, concept_id); null and empty ids don't count."""
    side = lambda d, n: d.where("concept_id <> ''").select(*by, "concept_id").distinct().withColumn(n, F.lit(1))
    both = side(gold, "g").join(side(pred, "p"), [*by, "concept_id"], "full_outer")
    tp, fp, fn = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()), F.count_if(F.col("g").isNull()), F.count_if(F.col("p").isNull())
    counts = both.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return counts.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def corpus_set_prf(gold: DataFrame, pred: DataFrame, dataset: str = "dataset") -> DataFrame:
    """``set_prf`` of each data set and overall; overall the ids are distinct across data sets."""
    every = lambda d: d.select(F.lit("_GLOBAL").alias(dataset), "concept_id")
    known = lambda d: d.select(F.coalesce(dataset, F.lit("none")).alias(dataset), "concept_id")
    return set_prf(known(gold).unionByName(every(gold)), known(pred).unionByName(every(pred)), [dataset])


def conditional_accuracy(rows: DataFrame, by: str, called: Column, right: Column) -> DataFrame:
    """(by, n, calls, hits, call_rate, accuracy): accuracy among the mentions that a refiner was called for; 0 without calls."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(called).alias("calls"), F.count_if(called & right).alias("hits"))
    return g.select(by, "n", "calls", "hits", ratio(F.col("calls"), F.col("n")).alias("call_rate"), ratio(F.col("hits"), F.col("calls")).alias("accuracy"))


def label_accuracy(rows: DataFrame, by: str, gold: str, pred: str) -> DataFrame:
    """(by, n, accuracy): micro precision, recall and F1 over all classes, which are one number."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), ratio(F.count_if(F.col(gold).eqNullSafe(F.col(pred))), F.count("*")).alias("accuracy"))


def info_nce(pairs: DataFrame, batch: str, a: str, b: str, score: str, temperature: float = 0.05) -> DataFrame:
    """(batch, loss): the two-way contrastive loss of each batch of scores, matching pairs being those of equal ids.

    log-sum-exp by rows and by columns, with the greatest taken out.
    """
    x = pairs.withColumn("l", F.col(score) / temperature)
    parts = []
    for key in (a, b):
        s = x.groupBy(batch, key).agg(F.max("l").alias("m"), F.collect_list("l").alias("ls"), F.max(F.when(F.col(a) == F.col(b), F.col("l"))).alias("own"))
        total = F.aggregate("ls", F.lit(0.0), lambda t, v: t + F.exp(v - F.col("m")))
        parts.append(s.select(batch, (F.col("m") + F.log(total) - F.col("own")).alias("loss")))
    return parts[0].unionByName(parts[1]).groupBy(batch).agg(F.round(F.avg("loss"), 6).alias("loss"))
