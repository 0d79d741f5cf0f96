"""Queries on retrieval: dense and fuzzy search, fusion, margins, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import prompts, vectors
from termloom.functions.fuzzy import score
from termloom.functions.text import norm
from termloom.operators import hierarchy, metrics, retrieval, sampling
from termloom.operators.delivery import latest
from termloom.operators.routing import band
from termloom.plans.q_ontology import hierarchy_of, nodes_of
from termloom.plans.registry import HINTS, LEXICON, ONTOLOGY, query, sql_id, sql_norm, with_parts
from termloom.session import materialize, table
from termloom.sources import ontology

K = 15
#: Vectors of each label that stand for concepts; the first is the one that a mention of the label means.
EACH = 4
CONCEPTS = f"c AS (SELECT vec_id, label, embedding, r FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= {EACH})"
DENSE = (
    CONCEPTS,
    "m AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM c))",
    "x AS (SELECT m.vec_id AS query_id, c.vec_id AS item_id, round(list_dot_product(m.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM m, c)",
    f"t AS (SELECT * FROM (SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS INTEGER) AS rank FROM x) WHERE rank < {K})",
    "g AS (SELECT query_id, max(item_id) FILTER (rank = 0) AS best_id, max(score) FILTER (rank = 0) AS s0, max(score) FILTER (rank = 1) AS s1 FROM t GROUP BY query_id)",
    "b AS (SELECT query_id, best_id, round(s0 - coalesce(s1, s0), 6) AS margin FROM g)",
)


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mentions and concepts: the first ``EACH`` vectors of each label are concepts', the very first the gold one."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    first = e.select("vec_id", "label").withColumn("r", F.row_number().over(w)).where(F.col("r") <= EACH).select("vec_id", "r")
    return e.join(first, "vec_id", "left_anti"), e.join(first, "vec_id")


def dense(spark: SparkSession, d: str) -> DataFrame:
    m, c = _embeddings(spark, d)
    return retrieval.top_k_dot(m, c, K, ("vec_id", "embedding"), ("vec_id", "embedding"))


def dense_hits(spark: SparkSession, d: str) -> DataFrame:
    m, c = _embeddings(spark, d)
    gold = m.select(F.col("vec_id").alias("query_id"), "label").join(c.where("r = 1").select("label", F.col("vec_id").alias("gold_id")), "label")
    ranked = dense(spark, d).withColumnRenamed("item_id", "concept_id")
    return metrics.with_hits(gold, ranked, "query_id")


@query("dense_topk", with_parts(*DENSE) + "SELECT query_id, item_id, score, rank FROM t")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d)


@query("margin_band", with_parts(*DENSE) + "SELECT query_id, best_id, margin, CASE WHEN margin >= 0.2 THEN 'EASY' WHEN margin <= 0.05 THEN 'HARD' ELSE 'MEDIUM' END AS band FROM b")
def margin_band(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval.margins(dense(spark, d).withColumnRenamed("item_id", "concept_id"), "query_id")
    return m.select("query_id", "best_id", "margin", band(F.col("margin"), 0.05, 0.20).alias("band"))


HITS = "k AS (SELECT m.label, t.rank FROM m JOIN (SELECT * FROM c WHERE r = 1) c USING (label) LEFT JOIN t ON t.query_id = m.vec_id AND t.item_id = c.vec_id)"
RATES = "CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (rank < 1) / count(*), 6) AS top1, round(count(*) FILTER (rank < 5) / count(*), 6) AS top5, round(count(*) FILTER (rank < 15) / count(*), 6) AS recall_k"


@query("retrieval_metrics", with_parts(*DENSE, HITS) + f"SELECT 'embeddings' AS dataset, {RATES} FROM k UNION ALL SELECT '_GLOBAL', {RATES} FROM k")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(dense_hits(spark, d).withColumn("dataset", F.lit("embeddings")))


@query("rollup_metrics", with_parts(*DENSE, HITS) + f"SELECT CASE WHEN grouping(label) = 1 THEN '_GLOBAL' ELSE CAST(label AS VARCHAR) END AS dataset, {RATES} FROM k GROUP BY ROLLUP (label)")
def rollup_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(dense_hits(spark, d).withColumn("dataset", F.col("label").cast("string")))


@query("dense_search", "SELECT query_id, item_id, score, rank FROM (SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank < 10")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.top_k_dot(e.where("vec_id % 20 = 0"), e, 10, ("vec_id", "embedding"), ("vec_id", "embedding"), skip_same=True)


@query("hard_examples", with_parts(*DENSE) + "SELECT query_id, best_id, margin FROM b ORDER BY margin, query_id LIMIT 25")
def hard_examples(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval.margins(dense(spark, d).withColumnRenamed("item_id", "concept_id"), "query_id")
    return sampling.hard_examples(m.select("query_id", "best_id", "margin"), "margin", "query_id", 25)


@query("retrieval_prf", with_parts(*DENSE, HITS) + f"SELECT *, top5 AS precision, top5 AS recall, top5 AS f1 FROM (SELECT 'embeddings' AS dataset, {RATES} FROM k UNION ALL SELECT '_GLOBAL', {RATES} FROM k)")
def retrieval_prf(spark: SparkSession, d: str) -> DataFrame:
    return metrics.single_prf(retrieval_metrics(spark, d))


@query("hard_examples_first", with_parts(*DENSE) + "SELECT query_id, best_id, margin FROM (SELECT * FROM b ORDER BY query_id LIMIT 125) ORDER BY margin, query_id LIMIT 25")
def hard_examples_first(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval.margins(dense(spark, d).withColumnRenamed("item_id", "concept_id"), "query_id")
    return sampling.hard_examples(m.select("query_id", "best_id", "margin"), "margin", "query_id", 25, "first_margin")


#: Vectors of one batch of the contrastive loss: every pair of a batch is scored.
BATCH = 32


@query(
    "contrastive_loss",
    with_parts(
        CONCEPTS, f"x AS (SELECT e.vec_id // {BATCH} AS batch, e.vec_id, e.embedding AS e, c.embedding AS g FROM embeddings e JOIN c USING (label) WHERE c.r = 1)", "l AS (SELECT x.batch, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e::DOUBLE[], y.g::DOUBLE[]) / 0.05 AS l FROM x JOIN x y USING (batch))",
        "p AS (SELECT batch, ln(sum(exp(l - m))) + any_value(m) - max(l) FILTER (a = b) AS loss FROM (SELECT *, max(l) OVER (PARTITION BY batch, a) AS m FROM l) GROUP BY batch, a UNION ALL SELECT batch, ln(sum(exp(l - m))) + any_value(m) - max(l) FILTER (a = b) FROM (SELECT *, max(l) OVER (PARTITION BY batch, b) AS m FROM l) GROUP BY batch, b)",
    ) + "SELECT batch, round(avg(loss), 6) AS loss FROM p GROUP BY batch",
)
def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    """The loss of each batch of vectors with the vectors of their concepts."""
    e = table(spark, d, "embeddings")
    _, c = _embeddings(spark, d)
    x = e.join(c.where("r = 1").select("label", F.col("embedding").alias("g")), "label").select(F.floor(F.col("vec_id") / BATCH).cast("long").alias("batch"), "vec_id", "embedding", "g")
    pairs = x.select("batch", F.col("vec_id").alias("a"), "embedding").join(x.select("batch", F.col("vec_id").alias("b"), "g"), "batch")
    return metrics.info_nce(pairs.select("batch", "a", "b", vectors.dot(F.col("embedding"), F.col("g")).alias("score")), "batch", "a", "b", "score")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return ontology.lexicon(nodes_of(spark, d)).select(F.col("term").alias("key"), F.col("id").alias("concept_id"))


def _hint_texts(spark: SparkSession, d: str, column: str) -> DataFrame:
    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", column)
    return h.select("hint_id", norm(column).alias("text"))


@query("fuzzy_topk")
def fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    h = _hint_texts(spark, d, "hint_en")
    found = retrieval.fuzzy_top_k(h, "text", _keys(spark, d), 5, 50)
    return h.join(found, "text").select("hint_id", "concept_id", "key", "score", "rank")


@query("fuzzy_threshold")
def fuzzy_threshold(spark: SparkSession, d: str) -> DataFrame:
    h = _hint_texts(spark, d, "mention")
    found = retrieval.fuzzy_top_k(h, "text", _keys(spark, d), 256, 256, least=88.0)
    return h.join(found, "text").select("hint_id", "concept_id", F.round(F.col("score") / 100 * 0.5, 6).alias("score"))


def sql_lcs(a: str, b: str) -> str:
    """The longest common subsequence of two strings, the first of at most 120 letters, by the bits of a wide integer."""
    letter = lambda t, i: f"substr({t}, CAST({i} AS INTEGER), 1)"
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_reduce(list_transform(range(length({a})), lambda i: CASE WHEN {letter(a, 'i + 1')} = {letter(b, 'k')} THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END), lambda p, q: p | q, 0::HUGEINT)"
    v = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k: {mask}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count({v}) END)"


def sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {sql_lcs(a, b)} / (length({a}) + length({b})) END"


_JOINED = lambda x: f"array_to_string(list_sort({x}), ' ')"
WORDS_SQL = (
    HINTS,
    f"c AS (SELECT cand_id, hint_id, {sql_norm('hpo_name')} AS name, {sql_norm('mention')} AS text FROM candidates JOIN h USING (hint_id) WHERE hpo_name IS NOT NULL AND mention IS NOT NULL)",
    "p AS (SELECT DISTINCT text, name, list_filter(string_split(text, ' '), lambda w: w <> '') AS x, list_filter(string_split(name, ' '), lambda w: w <> '') AS y FROM c)",
    f"w AS (SELECT text, name, x, y, {_JOINED('x')} AS sx, {_JOINED('y')} AS sy, {_JOINED('list_intersect(x, y)')} AS b, {_JOINED('list_distinct(list_filter(x, lambda w: NOT list_contains(y, w)))')} AS dx, {_JOINED('list_distinct(list_filter(y, lambda w: NOT list_contains(x, w)))')} AS dy FROM p)",
    "z AS (SELECT *, CASE WHEN b <> '' THEN 1 ELSE 0 END AS gap FROM w)",
    f"q2 AS (SELECT text, name, round({sql_ratio('text', 'name')}, 6) AS indel, round({sql_ratio('sx', 'sy')}, 6) AS token_sort, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN b <> '' AND (dx = '' OR dy = '') THEN 100 ELSE greatest(200.0::DOUBLE * (length(b) + gap + {sql_lcs('dx', 'dy')}) / (2 * (length(b) + gap) + length(dx) + length(dy)), CASE WHEN b <> '' THEN 200.0::DOUBLE * length(b) / (2 * length(b) + gap + least(length(dx), length(dy))) ELSE 0 END) END, 6) AS token_set FROM z)",
)


def _candidate_scores(spark: SparkSession, d: str, *scorers: str) -> DataFrame:
    h = _hint_texts(spark, d, "mention")
    c = table(spark, d, "candidates").select("cand_id", "hint_id", norm("hpo_name").alias("name")).join(h, "hint_id")
    c = c.where("text is not null and name is not null")
    pairs = c.select("text", "name").distinct()
    scored = pairs.select("text", "name", *[F.round(score(s, F.col("text"), F.col("name")), 6).alias(s) for s in scorers])
    return c.join(scored, ["text", "name"]).drop("text", "name")


@query("candidate_fuzzy", with_parts(*WORDS_SQL) + "SELECT cand_id, hint_id, indel, token_sort, token_set FROM c JOIN q2 USING (text, name)")
def candidate_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _candidate_scores(spark, d, "indel", "token_sort", "token_set")


@query("candidate_fuzzy_parts")
def candidate_fuzzy_parts(spark: SparkSession, d: str) -> DataFrame:
    return _candidate_scores(spark, d, "partial", "weighted", "sequence")


CANDIDATES = "cd AS (SELECT x.hint_id, coalesce(rs.id, x.i) AS concept_id, max(x.score) AS score FROM (SELECT hint_id, " + sql_id("hpo_id") + " AS i, score FROM candidates) x LEFT JOIN rs ON rs.any_id = x.i WHERE x.i IS NOT NULL AND x.score IS NOT NULL AND x.hint_id IS NOT NULL GROUP BY ALL)"


def candidates_of(spark: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    """(hint_id, concept_id, score): candidates with id and score, resolved, each once at its best score."""
    c = ontology.resolved(table(spark, d, "candidates").where("score is not null and hint_id is not null").select("hint_id", "hpo_id", "score"), "hpo_id", nodes)
    return c.where("concept_id is not null").groupBy("hint_id", "concept_id").agg(F.max("score").alias("score"))


@query("score_fusion", with_parts(HINTS, *ONTOLOGY[:3], LEXICON, CANDIDATES) + "SELECT hint_id, concept_id, max(score) AS score FROM (SELECT * FROM cd UNION ALL SELECT hint_id, lx.id, 1.0::DOUBLE FROM h JOIN lx ON lx.term = trim(regexp_replace(lower(mention), '[\\s\\pZ\\x{85}]+', ' ', 'g'))) GROUP BY ALL")
def score_fusion(spark: SparkSession, d: str) -> DataFrame:
    n = materialize(nodes_of(spark, d), "nodes")
    exact = _hint_texts(spark, d, "mention").join(ontology.lexicon(n), F.col("text") == F.col("term")).select("hint_id", F.col("id").alias("concept_id"), F.lit(1.0).alias("score"))
    return retrieval.fused(candidates_of(spark, d, n), exact, by="hint_id")


RANKED = "rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, concept_id) - 1 AS INTEGER) AS rank FROM cd)"


@query("candidate_margins", with_parts(*ONTOLOGY[:3], CANDIDATES, RANKED) + "SELECT hint_id, max(concept_id) FILTER (rank = 0) AS best_id, max(score) FILTER (rank = 0) AS s0, max(score) FILTER (rank = 1) AS s1, round(CASE WHEN max(score) FILTER (rank = 1) IS NULL THEN 0 ELSE max(score) FILTER (rank = 0) - max(score) FILTER (rank = 1) END, 6) AS margin, round(max(score) FILTER (rank = 0) - coalesce(max(score) FILTER (rank = 1), 0), 6) AS margin_alone FROM rk GROUP BY hint_id")
def candidate_margins(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_of(spark, d)
    r = retrieval.top_k(candidates_of(spark, d, n), ["hint_id"], "score", "concept_id", 2)
    m = retrieval.margins(r, "hint_id")
    alone = F.round(F.col("s0") - F.coalesce("s1", F.lit(0.0)), 6)
    return m.withColumn("margin_alone", alone)


BLOCK = "'[' || rank || ']' || chr(10) || '  ID: ' || rk.concept_id || chr(10) || '  Name: ' || coalesce(n.name, '') || chr(10) || '  Definition: ' || coalesce(n.definition, '') || chr(10) || '  Synonyms: ' || coalesce(array_to_string(n.synonyms, '; '), '')"


@query("candidate_blocks", with_parts(*ONTOLOGY[:3], CANDIDATES, RANKED) + f"SELECT hint_id, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY rank) AS blocks, string_agg(rank || '. ' || rk.concept_id || chr(9) || coalesce(n.name, ''), chr(10) ORDER BY rank) AS lines FROM rk LEFT JOIN n ON n.id = rk.concept_id WHERE rank < 35 GROUP BY hint_id")
def candidate_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = materialize(nodes_of(spark, d), "nodes")
    r = retrieval.top_k(candidates_of(spark, d, n), ["hint_id"], "score", "concept_id", 35)
    p = retrieval.packed(retrieval.enriched(r, n), ["hint_id"])
    return p.select("hint_id", prompts.candidate_block(F.col("candidates")).alias("blocks"), prompts.compact_candidates(F.col("candidates")).alias("lines"))


@query(
    "hier_rerank",
    with_parts(*ONTOLOGY, CANDIDATES, "b AS (SELECT cd.*, coalesce(d.depth, 0) AS depth, coalesce(d.depth, 0) / greatest((SELECT max(depth) FROM d), 1) AS depth_norm FROM cd LEFT JOIN d ON d.id = cd.concept_id)", "x AS (SELECT *, round(score + 0.1::DOUBLE * depth_norm, 9) AS base FROM b)", "y AS (SELECT x.*, EXISTS (SELECT 1 FROM cl JOIN x o ON o.concept_id = cl.descendant AND o.hint_id = x.hint_id WHERE cl.ancestor = x.concept_id AND o.base >= round(x.base + 0.02::DOUBLE, 9)) AS hit FROM x)", "z AS (SELECT hint_id, concept_id, score, round(base - CASE WHEN hit THEN 0.05::DOUBLE ELSE 0 END, 6) AS final FROM y)", recursive=True)
    + "SELECT hint_id, concept_id, score, final, CAST(row_number() OVER (PARTITION BY hint_id ORDER BY final DESC, concept_id) - 1 AS INTEGER) AS rank FROM z",
)
def hier_rerank(spark: SparkSession, d: str) -> DataFrame:
    n, pairs, depths = hierarchy_of(spark, d)
    return hierarchy.reranked(candidates_of(spark, d, n), "hint_id", pairs, depths).select("hint_id", "concept_id", "score", "final", "rank")


PRUNED = (
    "dn AS (SELECT cd.hint_id, cd.concept_id, cd.score, coalesce(d.depth, 0) AS depth FROM cd LEFT JOIN d ON d.id = cd.concept_id)",
    "o AS (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, depth DESC, concept_id) AS r FROM dn)",
    "bl AS (SELECT o.hint_id, o.concept_id, list(x.concept_id) AS below FROM o JOIN cl ON cl.ancestor = o.concept_id JOIN o x ON x.hint_id = o.hint_id AND x.concept_id = cl.descendant GROUP BY ALL)",
    "ob AS (SELECT o.*, list_append(coalesce(below, []), o.concept_id) AS own FROM o LEFT JOIN bl USING (hint_id, concept_id))",
    "k AS (SELECT hint_id, 0::BIGINT AS r, []::STRUCT(c VARCHAR, s DOUBLE)[] AS kept FROM (SELECT DISTINCT hint_id FROM o) UNION ALL SELECT k.hint_id, ob.r, CASE WHEN len(kept) >= 35 OR len(list_filter(kept, lambda y: list_contains(ob.own, y.c) AND y.s >= ob.score - 0.05::DOUBLE)) > 0 THEN kept ELSE list_append(kept, {'c': ob.concept_id, 's': ob.score}) END FROM k JOIN ob ON ob.hint_id = k.hint_id AND ob.r = k.r + 1)",
    "pe AS (SELECT hint_id, arg_max(kept, r) AS kept FROM k GROUP BY hint_id)",
)


@query("hier_prune", with_parts(*ONTOLOGY, CANDIDATES, *PRUNED, recursive=True) + "SELECT hint_id, x.c AS concept_id, x.s AS score, CAST(i - 1 AS INTEGER) AS rank FROM (SELECT hint_id, unnest(kept) AS x, generate_subscripts(kept, 1) AS i FROM pe)")
def hier_prune(spark: SparkSession, d: str) -> DataFrame:
    n, pairs, depths = hierarchy_of(spark, d)
    return hierarchy.pruned(candidates_of(spark, d, n), "hint_id", pairs, depths, 35)


@query(
    "ontology_filter",
    with_parts(*ONTOLOGY[:5], CANDIDATES, RANKED, "pr AS (SELECT a.hint_id, a.concept_id, a.score, b.concept_id AS best FROM rk a JOIN rk b ON b.hint_id = a.hint_id AND b.rank = 0)", "up AS (SELECT ancestor, descendant, steps FROM cl UNION ALL SELECT DISTINCT concept_id, concept_id, 0 FROM cd)", "m AS (SELECT pr.hint_id, pr.concept_id, min(x.steps + y.steps) AS dist FROM pr JOIN up x ON x.descendant = pr.concept_id JOIN up y ON y.descendant = pr.best AND y.ancestor = x.ancestor GROUP BY ALL)", recursive=True)
    + "SELECT hint_id, concept_id, CAST(dist AS INTEGER) AS distance FROM m WHERE dist <= 4",
)
def ontology_filter(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of a hint that are within four steps of its best one."""
    n, pairs, _ = hierarchy_of(spark, d)
    c = materialize(candidates_of(spark, d, n), "candidates")
    best = retrieval.top_k(c, ["hint_id"], "score", "concept_id", 1).select("hint_id", F.col("concept_id").alias("best"))
    return hierarchy.near(c.join(best, "hint_id"), "hint_id", "best", pairs, 4).select("hint_id", "concept_id", "distance")


@query("candidate_fields", with_parts(*ONTOLOGY[:3], CANDIDATES, RANKED) + "SELECT hint_id, n.name AS name, n.definition AS def, CAST(len(n.synonyms) AS INTEGER) AS n_synonyms FROM rk LEFT JOIN n ON n.id = rk.concept_id WHERE rank = 0")
def candidate_fields(spark: SparkSession, d: str) -> DataFrame:
    n = materialize(nodes_of(spark, d), "nodes")
    r = retrieval.top_k(candidates_of(spark, d, n), ["hint_id"], "score", "concept_id", 5)
    p = retrieval.packed(retrieval.enriched(r, n), ["hint_id"]).select("hint_id", F.get(prompts.with_plain_names(F.col("candidates")), F.lit(0)).alias("c"))
    # the size of a null list is null
    return p.select("hint_id", "c.name", "c.def", F.when(F.col("c.synonyms").isNotNull(), F.size("c.synonyms")).alias("n_synonyms"))
