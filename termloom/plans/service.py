"""The text service as a batch: requests in, one JSON answer each out.

Sentences, hints, candidates and refined choices are frames keyed by request,
sentence and hint; they are put together in order only for the answer.  A failed
sentence or call is a value in the answer, not a failure of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import prompts, protocol
from termloom.functions.text import norm_id, polarity, simple_sentences, truncated
from termloom.operators import retrieval, routing
from termloom.operators.delivery import latest
from termloom.operators.metrics import ratio
from termloom.plans.pipeline import PROMPT
from termloom.plans.providers import Replies, overlap_choice
from termloom.plans.q_ontology import nodes_of
from termloom.plans.registry import ALIASES, HINTS, NODES, REQUESTS, RESOLVER, query, sql_id, sql_polarity, with_parts
from termloom.session import materialize, table
from termloom.sources import ontology, sinks


def extracted(replies: DataFrame, reply: str = "reply", dialect: str = "tab") -> DataFrame:
    """(keys..., hint_no, hint_en, polarity, type) from a model's replies; replies that cannot be read give none."""
    keys = [c for c in replies.columns if c not in (reply, "error", "prompt")]
    p = replies.withColumn("p", protocol.parse_protocol(reply, dialect)).where("p.ok")
    return p.select(*keys, F.posexplode("p.hints").alias("hint_no", "h")).select(*keys, "hint_no", "h.hint_en", "h.polarity", "h.type")


def computed_once(df: DataFrame, text: str, out: str, compute) -> DataFrame:
    """A costly function of a text, such as a translation, run for each distinct text and joined back; null stays null."""
    distinct = df.where(F.col(text).isNotNull()).select(text).distinct()
    return df.join(distinct.withColumn(out, compute(F.col(text))), text, "left")


def entities(hints: DataFrame, candidates: DataFrame, requests: DataFrame, nodes: DataFrame, replies: Replies | None = None) -> DataFrame:
    """(req_id, sid, hint_id, mention, polarity, best_id, margin, gate, final_id, final_source) of each hint that is not absent.

    ``candidates`` is (hint_id, concept_id, score); thresholds of a request above 1
    are per cent.  Hints without candidates have null ids and are HARD.
    """
    replies = replies or Replies(overlap_choice)
    kept = hints.withColumn("polarity", polarity("polarity")).where(routing.keeps(F.col("polarity"), "not_absent") & (F.coalesce("hint_en", "mention").isNotNull()))
    ranked = materialize(retrieval.top_k(candidates, ["hint_id"], "score", "concept_id", 35), "service-ranked")
    m = retrieval.margins(ranked, "hint_id").select("hint_id", "best_id", "margin")
    scale = F.when(F.col("tau_high") > 1, 100.0).otherwise(1.0)
    taus = requests.select("req_id", (F.col("tau_low") / scale).alias("lo"), (F.col("tau_high") / scale).alias("hi"), truncated("src", 1200).alias("context"))
    rows = kept.join(taus, "req_id").join(m, "hint_id", "left").withColumn("gate", routing.band(F.col("margin"), F.col("lo"), F.col("hi")))
    # only these are sent to the refiner
    jobs = rows.where("gate <> 'EASY' and best_id is not null")
    packed = retrieval.packed(retrieval.enriched(ranked, nodes), ["hint_id"])
    hint_line = prompts.compact_hints(F.array(F.struct(F.coalesce("hint_en", "mention").alias("hint_en"), "polarity")))
    prompt = prompts.rendered(PROMPT, context=prompts.evidence_context("context", hint_line), mention=F.coalesce("hint_en", "mention"), candidates=prompts.compact_candidates(F.col("candidates")))
    asked = replies.over(jobs.join(packed, "hint_id").select("hint_id", F.transform("candidates", lambda c: c["hpo_id"]).alias("ids"), prompt.alias("prompt")), "prompt")
    choice = F.get(protocol.parse_indices("reply", F.size("ids")), F.lit(0))
    answers = asked.select("hint_id", routing.valid(choice, F.col("ids")).alias("refined"), F.col("error").isNull().alias("returned"))
    rows = rows.join(answers, "hint_id", "left")
    final, source = routing.service_gate(F.col("gate"), F.col("best_id"), F.coalesce("returned", F.lit(False)), F.col("refined"))
    out = rows.select("req_id", "sid", "hint_id", "mention", "polarity", "best_id", "margin", "gate", final.alias("final_id"), source.alias("final_source"))
    # written once, so that however often it is read no prompt is sent again
    return materialize(out, "service-entities")


def answers(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(req_id, status, body): sentences with their entities in order and the counts; 400 where there is no text."""
    text = requests.select("req_id", "src", F.explode_outer(simple_sentences("src")).alias("s"))
    fields = [F.col(c) for c in ("hint_id", "mention", "polarity", "best_id", "margin", "gate", "final_id", "final_source")]
    by_sentence = found.groupBy("req_id", "sid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("entities"))
    joined = text.select("req_id", F.col("s.sid").alias("sid"), F.col("s.src").alias("src"), F.col("s.c0").alias("c0"), F.col("s.c1").alias("c1")).join(by_sentence, ["req_id", "sid"], "left")
    one = F.struct("sid", "src", "c0", "c1", F.coalesce("entities", F.expr("array()")).alias("entities"))
    body = joined.groupBy("req_id").agg(F.array_sort(F.collect_list(F.when(F.col("sid").isNotNull(), one))).alias("sentences"))
    stats = found.groupBy("req_id").agg(F.count("*").alias("n_entities"), F.count_if(F.col("final_source") == "llm").alias("n_llm"))
    rows = body.join(stats, "req_id", "left").select("req_id", "sentences", F.struct(F.size("sentences").alias("n_sentences"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_llm", F.lit(0)).alias("n_llm")).alias("meta"))
    empty = F.when(F.size("sentences") == 0, "empty text")
    return sinks.response(rows.withColumn("error", empty), "sentences", "meta", error="error", key="req_id")


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = materialize(nodes_of(spark, d), "nodes")
    q = latest(table(spark, d, "requests"), "req_id", "loaded_at", "src", "tau_low", "tau_high")
    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", "req_id", "sid", "mention", "hint_en", "polarity")
    c = ontology.resolved(table(spark, d, "candidates").where("score is not null and hpo_id is not null").select("hint_id", norm_id("hpo_id").alias("hpo_id"), "score"), "hpo_id", n)
    c = c.groupBy("hint_id", "concept_id").agg(F.max("score").alias("score"))
    return q, entities(h, c, q, n)


SERVICE = (
    HINTS, REQUESTS, NODES, ALIASES, RESOLVER,
    f"c AS (SELECT hint_id, coalesce(rs.id, x.i) AS concept_id, max(x.score) AS score FROM (SELECT hint_id, {sql_id('hpo_id')} AS i, score FROM candidates WHERE score IS NOT NULL AND hpo_id IS NOT NULL) x LEFT JOIN rs ON rs.any_id = x.i GROUP BY ALL)",
    "m AS (SELECT hint_id, round(max(score) - coalesce(max(score) FILTER (r = 2), max(score)), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, concept_id) AS r FROM c) GROUP BY hint_id)",
    f"e AS (SELECT q.client, h.hint_id, m.hint_id AS known, CASE WHEN margin >= CASE WHEN tau_high > 1 THEN tau_high / 100 ELSE tau_high END THEN 'EASY' WHEN margin IS NULL OR margin <= CASE WHEN tau_high > 1 THEN tau_low / 100 ELSE tau_low END THEN 'HARD' ELSE 'MEDIUM' END AS gate FROM h JOIN q USING (req_id) LEFT JOIN m ON m.hint_id = h.hint_id WHERE coalesce(hint_en, mention) IS NOT NULL AND {sql_polarity('polarity')} <> 'absent')",
)


@query("service_stats", with_parts(*SERVICE) + "SELECT client, count(*) AS entities, count(*) FILTER (gate <> 'EASY' AND known IS NOT NULL) AS calls, round(count(*) FILTER (gate <> 'EASY' AND known IS NOT NULL) / count(*), 6) AS call_rate FROM e GROUP BY client")
def service_stats(spark: SparkSession, d: str) -> DataFrame:
    _, found = _inputs(spark, d)
    client = latest(table(spark, d, "requests"), "req_id", "loaded_at", "client")
    calls = F.count_if(F.col("final_source") == "llm")
    return found.join(client, "req_id").groupBy("client").agg(F.count("*").alias("entities"), calls.alias("calls"), ratio(calls, F.count("*")).alias("call_rate"))


@query("service_answers")
def service_answers(spark: SparkSession, d: str) -> DataFrame:
    q, found = _inputs(spark, d)
    return answers(q, found)
