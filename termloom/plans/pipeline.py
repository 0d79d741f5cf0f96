"""One pipeline for all variants: retriever, text, refiner and metric are options."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import prompts, protocol, vectors
from termloom.functions.text import norm, truncated
from termloom.operators import hierarchy, metrics, retrieval, routing
from termloom.plans.providers import Replies, encoded, overlap_choice, yes_probability
from termloom.session import materialize
from termloom.sources import ontology

PROMPT = "CONTEXT: {{context}}\nMENTION: {{mention}}\nCANDIDATES:\n{{candidates}}\nAnswer with one number, -1 if none fits."
RERANK = "Does the document describe the concept that the query names?"


@dataclass(frozen=True)
class Variant:
    """What a run consists of.

    ``retriever``: dense, fuzzy or fused; ``text``: plain or tagged, for the
    encoder; ``scorer``, ``keys`` (names, or terms: also synonyms), ``form``
    (norm, lower, or raw: as written), ``key_limit`` (null: all keys count) and ``points`` (what the greatest score is): of the fuzzy
    retriever; ``hierarchy``: whether candidates are pruned by the hierarchy and, by
    their dense scores, reranked; ``prompt``: the text sent to a language model; ``refiner``: none, llm, fuzzy_llm or rerank; ``mode``: deploy, or
    oracle_eval, which consults the answer and is for comparison only.
    """

    retriever: str = "dense"
    text: str = "plain"
    scorer: str = "token_set"
    keys: str = "terms"
    form: str = "norm"
    key_limit: int | None = None
    points: float = 1.0
    refiner: str = "llm"
    mode: str = "deploy"
    k: int = 15
    low: float = 0.05
    high: float = 0.20
    fuzzy_high: float = 0.20
    rerank_least: float = 0.05
    restrict_to_recalled: bool = False
    include_aliases: bool = False
    hierarchy: bool = False
    prompt: str = PROMPT


VARIANTS = {
    "dense_llm": Variant(),
    "dense_llm_eval": Variant(mode="oracle_eval", restrict_to_recalled=True),
    "dense_gate": Variant(refiner="fuzzy_llm"),
    "dense_rerank": Variant(text="tagged", refiner="rerank", k=35),
    "fuzzy_llm": Variant(retriever="fuzzy", scorer="partial", keys="names", form="lower", points=100.0, k=35, low=0.15, high=0.25),
    "fuzzy_weighted": Variant(retriever="fuzzy", scorer="weighted", form="raw", key_limit=105, k=35, low=0.15, high=0.25),
    "fused": Variant(retriever="fused", key_limit=256, refiner="none", k=35, hierarchy=True),
    "dense_only": Variant(refiner="none"),
}


def concept_texts(nodes: DataFrame, v: Variant) -> DataFrame:
    """(item_id, text): what the encoder reads of each concept; the builder is part of the variant so that a table's text is on record."""
    n = ontology.clones(nodes) if v.include_aliases else nodes
    text = prompts.gold_text("name", "definition", "synonyms") if v.text == "plain" else prompts.tagged_text("id", "name", "synonyms", "definition")
    return n.select(F.col("id").alias("item_id"), text.alias("text"))


def _vectors(mentions: DataFrame, nodes: DataFrame, v: Variant) -> tuple[DataFrame, DataFrame]:
    """(mention, vec) and (item_id, vec), written once."""
    q = mentions.select("mention", encoded(F.col("mention")).alias("vec"))
    b = concept_texts(nodes, v).select("item_id", encoded(F.col("text")).alias("vec"))
    return materialize(q, "mention-vectors"), materialize(b, "concept-vectors")


def by_hierarchy(ranked: DataFrame, mentions: DataFrame, nodes: DataFrame, v: Variant) -> DataFrame:
    """The candidates pruned by the hierarchy, then in the order of their dense scores and depths."""
    pairs = ontology.closure(ontology.edges(nodes))
    depths = materialize(ontology.depths(nodes, pairs), "depths")
    kept = hierarchy.pruned(ranked.select("mention", "concept_id", "score"), "mention", pairs, depths, v.k)
    q, b = _vectors(mentions, nodes, v)
    sims = kept.join(q.withColumnRenamed("vec", "a"), "mention").join(b.select(F.col("item_id").alias("concept_id"), F.col("vec").alias("b")), "concept_id")
    sims = sims.select("mention", "concept_id", F.round(vectors.dot(F.col("a"), F.col("b")), 6).alias("score"))
    again = hierarchy.reranked(materialize(sims, "pruned"), "mention", pairs, depths)
    return again.select("mention", "concept_id", F.col("final").alias("score"), "rank")


def retrieve(mentions: DataFrame, nodes: DataFrame, v: Variant) -> DataFrame:
    """(mention, concept_id, score, rank) for each distinct mention."""
    distinct = mentions.where("mention <> ''").select("mention").distinct()
    parts = []
    if v.retriever in ("dense", "fused"):
        d = retrieval.top_k_dot(*_vectors(distinct, nodes, v), v.k, ("mention", "vec"))
        parts.append(d.select(F.col("query_id").alias("mention"), F.col("item_id").alias("concept_id"), "score"))
    if v.retriever in ("fuzzy", "fused"):
        form = {"norm": norm, "lower": F.lower, "raw": F.trim}[v.form]
        if v.keys == "names":
            # a concept without a name goes by its id
            terms = nodes.select(F.coalesce(F.nullif("name", F.lit("")), "id").alias("t"), "id")
        else:
            terms = (nodes.where("trim(name) <> ''") if v.form == "raw" else nodes).select(F.explode(F.array_append("synonyms", F.col("name"))).alias("t"), "id")
        keys = terms.select(form(F.col("t")).alias("key"), F.col("id").alias("concept_id")).where("key <> ''").distinct()
        if v.form == "raw":
            # a string that several concepts have stands for the first
            keys = keys.groupBy("key").agg(F.min("concept_id").alias("concept_id"))
        weight, least = (0.5, 88.0) if v.retriever == "fused" else (v.points, 0.0)
        lowered = distinct.select("mention", form(F.col("mention")).alias("text"))
        f = retrieval.fuzzy_top_k(lowered, "text", keys, v.k, v.key_limit, v.scorer, least)
        parts.append(lowered.join(f, "text").select("mention", "concept_id", F.round(F.col("score") / 100 * weight, 6).alias("score")))
    if v.retriever == "fused":
        exact = distinct.withColumn("term", norm("mention")).join(ontology.lexicon(nodes), "term")
        parts.append(exact.select("mention", F.col("id").alias("concept_id"), F.lit(1.0).alias("score")))
    ranked = retrieval.top_k(retrieval.fused(*parts, by="mention"), ["mention"], "score", "concept_id", v.k)
    return by_hierarchy(materialize(ranked, "candidates"), distinct, nodes, v) if v.hierarchy else ranked


def _refined(todo: DataFrame, v: Variant, replies: Replies) -> DataFrame:
    """(row_id, refined, sure): the id that the refiner chooses for each row, and how sure a reranker is."""
    ids = F.transform("candidates", lambda c: c["hpo_id"])
    if v.refiner == "rerank":
        each = todo.select("row_id", "mention", F.posexplode("candidates").alias("rank0", "c"))
        doc = prompts.tagged_text(F.col("c.hpo_id"), F.col("c.hpo_name"), F.col("c.hpo_synonyms"), F.col("c.hpo_def"), most=None)
        pair = prompts.rerank_pair(RERANK, F.col("mention"), doc)
        scored = each.select("row_id", F.col("c.hpo_id").alias("concept_id"), yes_probability(pair).alias("score"))
        m = retrieval.margins(retrieval.top_k(scored, ["row_id"], "score", "concept_id", 2), "row_id")
        return m.select("row_id", F.col("best_id").alias("refined"), F.col("margin").alias("sure"))
    prompt = prompts.rendered(v.prompt, context=F.col("context"), mention=F.col("mention"), candidates=prompts.compact_candidates(F.col("candidates")))
    asked = replies.over(todo.select("row_id", ids.alias("ids"), prompt.alias("prompt")), "prompt")
    choice = F.get(protocol.parse_indices("reply", F.size("ids")), F.lit(0))
    return asked.select("row_id", routing.valid(choice, F.col("ids")).alias("refined"), F.lit(None).cast("double").alias("sure"))


def run(samples: DataFrame, nodes: DataFrame, v: Variant, replies: Replies | None = None) -> DataFrame:
    """(row_id, dataset, gold_id, best_id, margin, band, final_id, source, recalled) of each sample (row_id, dataset, context, mention, gold_id).

    The refiner is called only for rows that are not EASY; those rows are split
    off before the call.  A row without candidates has a null final id.
    """
    replies = replies or Replies(overlap_choice)
    ranked = materialize(retrieve(samples, nodes, v), "ranked")
    m = retrieval.margins(ranked, "mention", "score" if v.retriever == "fuzzy" else "zero")
    rows = samples.join(m.select("mention", "best_id", "margin"), "mention", "left").withColumn("band", routing.band(F.col("margin"), v.low, v.high))
    hit = ranked.select("mention", F.col("concept_id").alias("gold_id"), F.lit(True).alias("recalled"))
    rows = rows.join(hit, ["mention", "gold_id"], "left").withColumn("recalled", F.coalesce("recalled", F.lit(False)))
    if v.refiner == "none":
        return rows.select("row_id", "dataset", "gold_id", "best_id", "margin", "band", F.col("best_id").alias("final_id"), F.lit("dual").alias("source"), "recalled")
    ask = rows.where("band <> 'EASY' and best_id is not null")
    if v.restrict_to_recalled:
        ask = ask.where("recalled")
    packed = retrieval.packed(retrieval.enriched(ranked, nodes), ["mention"])
    # written once: a model is called once for each row, however often the result is read
    refined = materialize(_refined(ask.select("row_id", "mention", truncated("context").alias("context")).join(packed, "mention"), v, replies), "refined")
    rows = rows.join(refined, "row_id", "left")
    gate = routing.eval_gate(F.col("band"), F.col("best_id"), F.col("refined"), F.col("gold_id")) if v.mode == "oracle_eval" else routing.deploy_gate(F.col("band"), F.col("best_id"), F.col("refined"))
    if v.refiner == "rerank":
        gate = routing.rerank_gate(F.col("band"), F.col("best_id"), F.col("refined"), F.col("sure"), v.rerank_least)
    if v.refiner == "fuzzy_llm":
        fuzzy = _candidate_fuzzy(samples.select("mention").distinct(), ranked, nodes)
        rows = rows.join(fuzzy, "mention", "left")
        gate = routing.fuzzy_gate(F.col("band"), F.col("best_id"), F.col("fuzzy_margin"), F.col("fuzzy_best"), v.fuzzy_high, gate)
    source = F.when(gate.eqNullSafe(F.col("best_id")), "dual").otherwise(v.refiner)
    return rows.select("row_id", "dataset", "gold_id", "best_id", "margin", "band", gate.alias("final_id"), source.alias("source"), "recalled")


def _candidate_fuzzy(mentions: DataFrame, ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mention, fuzzy_margin, fuzzy_best): likeness of the mention with its own candidates' names."""
    from termloom.functions.fuzzy import score

    names = nodes.select(F.col("id").alias("concept_id"), "name")
    s = ranked.join(mentions, "mention").join(names, "concept_id").select("mention", "concept_id", "rank", F.round(score("sequence", F.lower("mention"), F.lower("name")) / 100, 6).alias("f"))
    margin = retrieval.in_order_margin(s, "mention", "f").withColumnRenamed("margin", "fuzzy_margin")
    best = s.groupBy("mention").agg(F.max_by("concept_id", F.struct("f", -F.col("rank"))).alias("fuzzy_best"))
    return margin.join(best, "mention")


def report(result: DataFrame) -> DataFrame:
    """(dataset, total, dual_top1, final_top1, call_rate, recall): for each data set and overall."""
    n = F.count("*")
    right = lambda c: F.count_if(F.col(c).eqNullSafe(F.col("gold_id")) & F.col("gold_id").isNotNull())
    g = result.groupBy("dataset").agg(n.alias("total"), right("best_id").alias("d"), right("final_id").alias("f"), F.count_if(F.col("band") != "EASY").alias("c"), F.count_if("recalled").alias("r"))
    g = g.rollup("dataset").agg(*[F.sum(x).alias(x) for x in ("total", "d", "f", "c", "r")], F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 1, "_GLOBAL").otherwise(F.coalesce("dataset", F.lit("none")))
    return g.select(name.alias("dataset"), "total", *[metrics.ratio(F.col(a), F.col("total")).alias(b) for a, b in (("d", "dual_top1"), ("f", "final_top1"), ("c", "call_rate"), ("r", "recall"))])


def variant(name: str, **options: object) -> Variant:
    return replace(VARIANTS[name], **options)
