"""Which mentions are decided by their margin and which go to a refiner.

Thresholds belong to the scale of the retriever's scores.  A reply is a chosen
number or null where there was none or none that could be used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(margin: Column, low: float | Column, high: float | Column) -> Column:
    """EASY from ``high`` on, else HARD up to ``low``, else MEDIUM; a null margin is HARD."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(margin >= hi, "EASY").when(margin.isNull() | (margin <= lo), "HARD").otherwise("MEDIUM")


def valid(choice: Column, candidates: Column) -> Column:
    """The id of a chosen candidate; null for a number that is none of them."""
    return F.when(choice.isNotNull() & (choice >= 0) & (choice < F.size(candidates)), F.get(candidates, choice.cast("int")))


def eval_gate(bands: Column, best: Column, refined: Column, gold: Column) -> Column:
    """Evaluation with the answer at hand: a MEDIUM mention takes the refiner's id only where it is right.  Not for use on new data."""
    return F.when(bands == "EASY", best).when(bands == "HARD", F.coalesce(refined, best)).otherwise(F.when(refined.eqNullSafe(gold) & refined.isNotNull(), refined).otherwise(best))


def deploy_gate(bands: Column, best: Column, refined: Column) -> Column:
    """EASY keeps the best candidate, all others take the refiner's if it gave one."""
    return F.when(bands == "EASY", best).otherwise(F.coalesce(refined, best))


def fuzzy_gate(bands: Column, best: Column, fuzzy_margin: Column, fuzzy_best: Column, high: float, otherwise: Column) -> Column:
    """Before the refiner, a clear fuzzy margin decides."""
    return F.when(bands == "EASY", best).when(fuzzy_margin >= high, F.coalesce(fuzzy_best, best)).otherwise(otherwise)


def rerank_gate(bands: Column, best: Column, reranked: Column, rerank_margin: Column, least: float = 0.05) -> Column:
    """HARD takes the reranker's first; MEDIUM only where the reranker is sure."""
    return F.when(bands == "EASY", best).when(bands == "HARD", F.coalesce(reranked, best)).otherwise(F.when(rerank_margin >= least, F.coalesce(reranked, best)).otherwise(best))


def service_gate(bands: Column, best: Column, returned: Column, refined: Column) -> tuple[Column, Column]:
    """(id, source): the source is ``llm`` whenever a call returned, even one that chose nothing."""
    called = (bands != "EASY") & returned
    return F.when(called, F.coalesce(refined, best)).otherwise(best), F.when(called, "llm").otherwise("dual")


def queries_of(hints: Column, mention: Column) -> Column:
    """The texts to search for: the hints that are present, or the mention where there is none."""
    present = F.transform(F.filter(hints, lambda h: h["polarity"] == "present"), lambda h: h["hint_en"])
    return F.when(F.coalesce(F.size(present), F.lit(0)) > 0, present).otherwise(F.array(mention))


def keeps(polarity: Column, policy: str) -> Column:
    """Whether a hint stays: ``present`` only, all but ``absent``, or ``all``."""
    return {"present": polarity == "present", "not_absent": polarity != "absent", "all": F.lit(True)}[policy]
