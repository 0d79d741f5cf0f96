"""Queries on the ontology and on ids and terms resolved against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import prompts
from termloom.functions.text import norm_id
from termloom.operators import hierarchy, retrieval
from termloom.operators.delivery import latest
from termloom.plans.registry import ALIASES, EDGES, HINTS, LEXICON, NODES, ONTOLOGY, RESOLVER, SAMPLES, query, sql_id, with_parts
from termloom.session import materialize, table
from termloom.sources import ontology


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return ontology.nodes(table(spark, d, "concepts"))


def hierarchy_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, closure and depths; the closure is written once."""
    n = nodes_of(spark, d)
    pairs = ontology.closure(ontology.edges(n))
    return n, pairs, materialize(ontology.depths(n, pairs), "depths")


@query("ontology_nodes", with_parts(NODES) + "SELECT id, name, CAST(len(synonyms) AS INTEGER) AS n_synonyms, definition, CAST(len(alt_ids) AS INTEGER) AS n_alt, CAST(len(parents) AS INTEGER) AS n_parents, CAST(len(children) AS INTEGER) AS n_children FROM n")
def ontology_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_of(spark, d)
    return n.select("id", "name", F.size("synonyms").alias("n_synonyms"), "definition", F.size("alt_ids").alias("n_alt"), F.size("parents").alias("n_parents"), F.size("children").alias("n_children"))


@query("ontology_edges", with_parts(NODES, ALIASES, RESOLVER, EDGES) + "SELECT parent, child FROM e")
def ontology_edges(spark: SparkSession, d: str) -> DataFrame:
    return ontology.edges(nodes_of(spark, d))


@query("ontology_closure", with_parts(*ONTOLOGY[:5], recursive=True) + "SELECT ancestor, descendant, CAST(steps AS INTEGER) AS steps FROM cl")
def ontology_closure(spark: SparkSession, d: str) -> DataFrame:
    return ontology.closure(ontology.edges(nodes_of(spark, d)))


@query("ontology_depth", with_parts(*ONTOLOGY, recursive=True) + "SELECT id AS concept_id, depth, depth / greatest((SELECT max(depth) FROM d), 1) AS depth_norm FROM d")
def ontology_depth(spark: SparkSession, d: str) -> DataFrame:
    n, _, depths = hierarchy_of(spark, d)
    return hierarchy.with_depth(n.select(F.col("id").alias("concept_id")), depths).select("concept_id", "depth", "depth_norm")


@query("ontology_root_depth", with_parts(*ONTOLOGY[:5], recursive=True) + "SELECT n.id AS concept_id, CAST(coalesce(min(cl.steps), 0) AS INTEGER) AS depth FROM n LEFT JOIN cl ON cl.descendant = n.id AND cl.ancestor = (SELECT min(id) FROM n WHERE name = 'All') GROUP BY n.id")
def ontology_root_depth(spark: SparkSession, d: str) -> DataFrame:
    n, pairs, _ = hierarchy_of(spark, d)
    root = n.where("name = 'All'").agg(F.min("id")).first()[0]
    return ontology.depths(n, pairs, root or "").select(F.col("id").alias("concept_id"), "depth")


@query("alias_clones", with_parts(NODES, ALIASES) + "SELECT alias AS id, name, CAST(len(synonyms) AS INTEGER) AS n_synonyms FROM al JOIN n USING (id) UNION ALL SELECT id, name, CAST(len(synonyms) AS INTEGER) FROM n")
def alias_clones(spark: SparkSession, d: str) -> DataFrame:
    return ontology.clones(nodes_of(spark, d)).select("id", "name", F.size("synonyms").alias("n_synonyms"))


@query("alias_resolve", with_parts(SAMPLES, NODES, ALIASES, RESOLVER) + f"SELECT sample_id, gold_id, coalesce(rs.id, {sql_id('gold_id')}) AS concept_id, rs.id IS NOT NULL AS known FROM s LEFT JOIN rs ON rs.any_id = {sql_id('gold_id')}")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = materialize(nodes_of(spark, d), "nodes")
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "gold_id")
    r = ontology.resolved(s, "gold_id", n)
    known = n.select(F.col("id").alias("concept_id"), F.lit(True).alias("k"))
    return r.join(known, "concept_id", "left").select("sample_id", "gold_id", "concept_id", F.coalesce("k", F.lit(False)).alias("known"))


@query("gold_in_ontology", with_parts(SAMPLES, NODES, ALIASES, RESOLVER) + f"SELECT dataset, count(*) AS n_kept, count(DISTINCT rs.id) AS n_concepts FROM s JOIN rs ON rs.any_id = {sql_id('gold_id')} GROUP BY dataset")
def gold_in_ontology(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "dataset", "gold_id")
    n = nodes_of(spark, d)
    kept = ontology.resolved(s, "gold_id", n).join(n.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    return kept.groupBy("dataset").agg(F.count("*").alias("n_kept"), F.countDistinct("concept_id").alias("n_concepts"))


@query("lexicon_terms", with_parts(NODES, LEXICON) + "SELECT term, id FROM lx")
def lexicon_terms(spark: SparkSession, d: str) -> DataFrame:
    return ontology.lexicon(nodes_of(spark, d))


@query(
    "exact_lexicon",
    with_parts(HINTS, *ONTOLOGY, LEXICON, recursive=True) + "SELECT hint_id, mention, lx.id AS concept_id, depth, CAST(row_number() OVER (PARTITION BY hint_id ORDER BY depth DESC, lx.id) - 1 AS INTEGER) AS rank FROM h JOIN lx ON lx.term = trim(regexp_replace(lower(mention), '[\\s\\pZ\\x{85}]+', ' ', 'g')) JOIN d ON d.id = lx.id",
)
def exact_lexicon(spark: SparkSession, d: str) -> DataFrame:
    n, _, depths = hierarchy_of(spark, d)
    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", "mention")
    return retrieval.exact_lookup(h, "mention", ontology.lexicon(n), depths)


@query(
    "refine_id_set",
    with_parts(*ONTOLOGY, "c AS (SELECT DISTINCT hint_id, coalesce(rs.id, x.i) AS concept_id FROM (SELECT hint_id, " + sql_id("hpo_id") + " AS i FROM candidates) x LEFT JOIN rs ON rs.any_id = x.i WHERE x.i IS NOT NULL)", recursive=True)
    + "SELECT hint_id, concept_id, coalesce(d.depth, 0) AS depth, CAST(row_number() OVER (PARTITION BY hint_id ORDER BY coalesce(d.depth, 0) DESC, concept_id) - 1 AS INTEGER) AS rank FROM c LEFT JOIN d ON d.id = c.concept_id WHERE NOT EXISTS (SELECT 1 FROM c o JOIN cl ON cl.descendant = o.concept_id WHERE o.hint_id = c.hint_id AND cl.ancestor = c.concept_id)",
)
def refine_id_set(spark: SparkSession, d: str) -> DataFrame:
    n, pairs, depths = hierarchy_of(spark, d)
    c = ontology.resolved(table(spark, d, "candidates").select("hint_id", "hpo_id"), "hpo_id", n)
    return hierarchy.most_specific(c, "hint_id", pairs, depths)


@query(
    "common_ancestor",
    with_parts(
        SAMPLES, *ONTOLOGY[:5],
        "p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM s JOIN rs a ON a.any_id = " + sql_id("gold_id") + " JOIN rs b ON b.any_id = " + sql_id("dual_best_id") + ")",
        "up AS (SELECT ancestor, descendant, steps FROM cl UNION ALL SELECT id, id, 0 FROM n)",
        "m AS (SELECT p.a, p.b, x.ancestor, x.steps + y.steps AS dist, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.steps + y.steps, x.ancestor) AS r FROM p JOIN up x ON x.descendant = p.a JOIN up y ON y.descendant = p.b AND y.ancestor = x.ancestor)",
        recursive=True,
    ) + "SELECT p.a, p.b, m.ancestor AS lca, CAST(m.dist AS INTEGER) AS distance FROM p LEFT JOIN m ON m.a = p.a AND m.b = p.b AND m.r = 1",
)
def common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    n, pairs, _ = hierarchy_of(spark, d)
    r = ontology.resolver(n)
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "gold_id", "dual_best_id")
    s = s.select(norm_id("gold_id").alias("x"), norm_id("dual_best_id").alias("y")).distinct()
    p = s.join(r.select(F.col("any_id").alias("x"), F.col("id").alias("a")), "x").join(r.select(F.col("any_id").alias("y"), F.col("id").alias("b")), "y").select("a", "b").distinct()
    return hierarchy.common_ancestor(materialize(p, "concept-pairs"), pairs)


DEFINITION = "CASE WHEN trim(definition) <> '' THEN trim(definition) END"


@query("gold_text", with_parts(NODES) + f"SELECT id, concat_ws(' ', coalesce(name, '') || '.', {DEFINITION}, CASE WHEN len(synonyms) > 0 THEN 'Synonyms: ' || array_to_string(synonyms, ', ') || '.' END) AS gold_text FROM n")
def gold_text(spark: SparkSession, d: str) -> DataFrame:
    return nodes_of(spark, d).select("id", prompts.gold_text("name", "definition", "synonyms").alias("gold_text"))


def sql_tagged(most: str, model: str | None = None, extra: str | None = None) -> str:
    syn = f"array_to_string(synonyms{most}, '; ')"
    more = ""
    if model:
        more += f", CASE WHEN {f'{DEFINITION} IS NULL' if most else f'{model} IS DISTINCT FROM {DEFINITION}'} THEN '[LLM_DEF] ' || {model} END"
    if extra:
        more += f", '[ADD_DEF] ' || {extra}"
    return f"concat_ws(chr(10), '[HPO_ID] ' || id, '[NAME] ' || coalesce(CASE WHEN trim(name) <> '' THEN trim(name) END, id), CASE WHEN len(synonyms) > 0 THEN '[SYN] ' || {syn} END, '[DEF] ' || {DEFINITION}{more})"


# the ontology has no definitions by a model: its first synonym and its older ids stand in
_MODEL, _EXTRA = "CASE WHEN trim(synonyms[1]) <> '' THEN trim(synonyms[1]) END", "nullif(array_to_string(list_sort(alt_ids), ' '), '')"


def _with_model(n: DataFrame) -> DataFrame:
    return n.withColumn("model", F.get("synonyms", F.lit(0))).withColumn("extra", F.array_join(F.array_sort("alt_ids"), " "))


@query("tagged_text", with_parts(NODES) + f"SELECT id, t AS tagged, CAST(CASE WHEN strpos(t, name) > 0 THEN strpos(t, name) - 1 ELSE 0 END AS INTEGER) AS c0, CAST(CASE WHEN strpos(t, name) > 0 THEN strpos(t, name) - 1 + length(name) ELSE length(t) END AS INTEGER) AS c1 FROM (SELECT *, {sql_tagged('[1:3]', _MODEL, _EXTRA)} AS t FROM n)")
def tagged_text(spark: SparkSession, d: str) -> DataFrame:
    t = _with_model(nodes_of(spark, d)).withColumn("tagged", prompts.tagged_text("id", "name", "synonyms", "definition", "extra", model="model"))
    s = prompts.name_span(F.col("tagged"), "name")
    return t.select("id", "tagged", s["c0"].alias("c0"), s["c1"].alias("c1"))


@query("prompt_text", with_parts(NODES) + f"SELECT id, {sql_tagged('', _MODEL, _EXTRA)} AS prompt_text FROM n")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    return _with_model(nodes_of(spark, d)).select("id", prompts.tagged_text("id", "name", "synonyms", "definition", "extra", most=None, model="model").alias("prompt_text"))


@query("prompt_info", with_parts(NODES) + "SELECT id AS hpo_id, CASE WHEN trim(name) <> '' THEN name ELSE id END AS hpo_name, CASE WHEN trim(definition) <> '' THEN definition ELSE '' END AS hpo_def, CAST(len(synonyms) AS INTEGER) AS n_synonyms FROM n")
def prompt_info(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each entry under another of the keys they may stand under."""
    n = nodes_of(spark, d)
    odd = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    record = F.when(odd, F.create_map(F.lit("label"), F.array("name"), F.lit("def"), F.array("definition"), F.lit("synonym"), "synonyms")).otherwise(F.create_map(F.lit("Name"), F.array("name"), F.lit("Def"), F.array("definition"), F.lit("Synonym"), "synonyms"))
    x = n.select(prompts.prompt_info(record, "id").alias("x"))
    return x.select("x.hpo_id", "x.hpo_name", "x.hpo_def", F.size("x.hpo_synonyms").alias("n_synonyms"))
