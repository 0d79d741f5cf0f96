"""Candidates for mentions: exact, fuzzy and dense retrieval, fusion, margins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.fuzzy import AT_ONCE, SCORERS
from termloom.functions.text import norm
from termloom.session import materialize, tasks_for

#: Rows of a side of a dense or fuzzy join held in memory at once.
CHUNK = 20_000


def exact_lookup(mentions: DataFrame, mention: str, lexicon: DataFrame, depths: DataFrame) -> DataFrame:
    """The mentions with (concept_id, depth, rank) of each concept that has the term, deepest first, equal depths by id."""
    w = Window.partitionBy(*mentions.columns).orderBy(F.desc("depth"), "concept_id")
    hits = mentions.withColumn("term", norm(mention)).join(lexicon, "term").withColumnRenamed("id", "concept_id")
    hits = hits.join(depths.select(F.col("id").alias("concept_id"), "depth"), "concept_id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).select(*mentions.columns, "concept_id", "depth", "rank")


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank from 0; equal scores by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def _chunks(df: DataFrame, key: str) -> Iterator[pd.DataFrame]:
    """A side of a join, at most ``CHUNK`` rows at a time."""
    n = df.count()
    parts = max(1, -(-n // CHUNK))
    for p in range(parts):
        yield (df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)).toPandas()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _best_dots(qids: np.ndarray, q: np.ndarray, iids: np.ndarray, m: np.ndarray, k: int, skip_same: bool) -> pd.DataFrame:
    """The k greatest products of each query with some items, as they are reported, equal ones by item."""
    if not len(qids) or not len(iids):
        return pd.DataFrame({"query_id": qids[:0], "item_id": iids[:0], "score": np.zeros(0)})
    sims = np.round(q @ m.T, 6)
    if skip_same:
        sims = np.where(qids[:, None] == iids[None, :], -np.inf, sims)
    # by id first, so that equal scores keep the order of ids
    order = np.argsort(iids, kind="stable")
    top = order[np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]]
    got = pd.DataFrame({"query_id": np.repeat(qids, top.shape[1]), "item_id": iids[top].ravel(), "score": np.take_along_axis(sims, top, 1).ravel()})
    return got[np.isfinite(got["score"])]


def top_k_dot(queries: DataFrame, base: DataFrame, k: int, query: tuple[str, str] = ("query_id", "vec"), item: tuple[str, str] = ("item_id", "vec"), skip_same: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank): the k greatest dot products of every query with all of ``base``, ties by item.

    Scores are rounded to six places before they are compared.  A smaller side of
    at most ``CHUNK`` rows is held in memory, and the larger one streams through a
    matrix product where it lies; else both sides are divided into blocks of about
    that size and each block meets each block once.  Only k rows for each query and
    task leave a task.  Rows with a null id or vector are left out.
    """
    qid, qv = query
    iid, iv = item
    queries, base = queries.where(f"{qid} is not null and {qv} is not null").select(F.col(qid).alias("id"), F.col(qv).alias("vec")), base.where(f"{iid} is not null and {iv} is not null").select(F.col(iid).alias("id"), F.col(iv).alias("vec"))
    schema = f"query_id {dict(queries.dtypes)['id']}, item_id {dict(base.dtypes)['id']}, score double"
    nq, nb = queries.count(), base.count()
    if min(nq, nb) <= CHUNK:
        held_queries = nq <= nb
        chunk = (queries if held_queries else base).toPandas()
        ids, m = chunk["id"].to_numpy(), _matrix(chunk["vec"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for b in batches:
                other, theirs = _matrix(b["vec"]), b["id"].to_numpy()
                if not held_queries:
                    yield _best_dots(theirs, other, ids, m, k, skip_same)
                    continue
                got = _best_dots(ids, m, theirs, other, k, skip_same)
                best = got if best is None else pd.concat([best, got])
                best = best.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        out = (base if held_queries else queries).mapInPandas(run, schema)
    else:
        bq, bb = -(-nq // CHUNK), -(-nb // CHUNK)
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = queries.withColumn("q", block(bq)).withColumn("b", every(bb))
        i = base.withColumn("b", block(bb)).withColumn("q", every(bq))

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            return _best_dots(x["id"].to_numpy(), _matrix(x["vec"]), y["id"].to_numpy(), _matrix(y["vec"]), k, skip_same)

        out = q.groupBy("q", "b").cogroup(i.groupBy("q", "b")).applyInPandas(meet, schema)
    return top_k(out, ["query_id"], "score", "item_id", k)


def fuzzy_top_k(texts: DataFrame, text: str, keys: DataFrame, k: int, key_limit: int | None, scorer: str = "token_set", least: float = 0.0) -> DataFrame:
    """(text, concept_id, key, score, rank): for each distinct text its k best concepts by their best key.

    First the ``key_limit`` best keys are taken, then the best key of each
    concept, then k concepts; equal scores by key and id.  Without a limit all keys
    count; then those below the k-th best cannot matter.  ``keys`` is (key, concept_id), held in memory a bounded chunk at a time.  Null and empty texts
    have no row.
    """
    distinct = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    distinct = materialize(distinct, "fuzzy-texts")
    distinct = distinct.repartition(tasks_for(distinct))
    out = None

    def make(names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = SCORERS[scorer]
            fast = AT_ONCE[scorer](names) if scorer in AT_ONCE else None
            order = np.argsort(np.array(names, dtype=object), kind="stable")
            for b in batches:
                rows = []
                for t in b["text"]:
                    s = fast.scores(t) if fast else np.array([f(t, n) for n in names])
                    s = np.round(s, 6)
                    if key_limit is None:
                        # each key has a concept, so that k keys suffice but for ties
                        best = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else order
                    else:
                        best = order[np.argsort(-s[order], kind="stable")[:key_limit]]
                    rows.extend((t, names[j], float(s[j])) for j in best if s[j] >= least)
                yield pd.DataFrame(rows, columns=["text", "key", "score"])

        return run

    for chunk in _chunks(keys.where("key <> ''").select("key").distinct(), "key"):
        part = distinct.mapInPandas(make(sorted(chunk["key"].tolist())), "text string, key string, score double")
        out = part if out is None else out.unionByName(part)
    limited = out if key_limit is None else top_k(out, ["text"], "score", "key", key_limit).drop("rank")
    best = limited.join(keys, "key").groupBy("text", "concept_id").agg(F.max_by(F.struct("key", "score"), F.struct("score", F.xxhash64("key"))).alias("b"))
    return top_k(best.select("text", "concept_id", "b.key", "b.score"), ["text"], "score", "concept_id", k)


def fused(*scored: DataFrame, by: str) -> DataFrame:
    """(by, concept_id, score): the greatest score of each candidate over several retrievers."""
    out = scored[0].select(by, "concept_id", "score")
    for s in scored[1:]:
        out = out.unionByName(s.select(by, "concept_id", "score"))
    return out.groupBy(by, "concept_id").agg(F.max("score").alias("score"))


def margins(ranked: DataFrame, by: str, single: str = "zero") -> DataFrame:
    """(by, best_id, s0, s1, margin) from ranks 0 and 1; the margin of a single candidate is 0 or, with ``single='score'``, its score."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    m = ranked.where("rank < 2").groupBy(by).agg(at(0, "concept_id").alias("best_id"), at(0, "score").alias("s0"), at(1, "score").alias("s1"))
    alone = F.lit(0.0) if single == "zero" else F.col("s0")
    return m.withColumn("margin", F.round(F.when(F.col("s1").isNull(), alone).otherwise(F.col("s0") - F.col("s1")), 6))


def in_order_margin(ranked: DataFrame, by: str, score: str) -> DataFrame:
    """(by, margin): the score at rank 0 less that at rank 1, which another ranking made, so that it may be negative."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(score)))
    return ranked.where("rank < 2").groupBy(by).agg(F.round(F.coalesce(at(0) - at(1), F.lit(0.0)), 6).alias("margin"))


def enriched(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates with name, definition and synonyms, after the top-k so that few rows are joined."""
    return ranked.join(nodes.select(F.col("id").alias("concept_id"), F.col("name").alias("hpo_name"), F.col("definition").alias("hpo_def"), F.col("synonyms").alias("hpo_synonyms")), "concept_id", "left")


def packed(ranked: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group with ``candidates``, an array in order of rank."""
    fields = ["rank", "concept_id", "hpo_name", "hpo_def", "hpo_synonyms", "score"]
    c = F.array_sort(F.collect_list(F.struct(*fields)))
    shape = F.transform(c, lambda x: F.struct(x["concept_id"].alias("hpo_id"), x["hpo_name"].alias("hpo_name"), x["hpo_def"].alias("hpo_def"), x["hpo_synonyms"].alias("hpo_synonyms"), x["score"].alias("score")))
    return ranked.groupBy(*by).agg(shape.alias("candidates"))


