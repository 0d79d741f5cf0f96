"""Queries on routing, replies, set metrics and whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import protocol
from termloom.functions.text import norm, norm_id, polarity
from termloom.operators import metrics, routing
from termloom.operators.delivery import latest
from termloom.plans import pipeline
from termloom.plans.q_ontology import DEFINITION, nodes_of, sql_tagged
from termloom.plans.registry import ALIASES, HINTS, NODES, REQUESTS, RESOLVER, SAMPLES, query, sql_id, sql_norm, sql_polarity, with_parts
from termloom.session import materialize, table
from termloom.sources import ontology, sinks

GATE = (
    SAMPLES, NODES, ALIASES, RESOLVER,
    f"g AS (SELECT sample_id, coalesce(dataset, 'none') AS dataset, coalesce(a.id, {sql_id('gold_id')}) AS gold, coalesce(b.id, {sql_id('dual_best_id')}) AS best, dual_margin AS margin FROM s LEFT JOIN rs a ON a.any_id = {sql_id('gold_id')} LEFT JOIN rs b ON b.any_id = {sql_id('dual_best_id')})",
    "r AS (SELECT *, CASE WHEN margin >= 0.2 THEN 'EASY' WHEN margin IS NULL OR margin <= 0.05 THEN 'HARD' ELSE 'MEDIUM' END AS band, sample_id % 4 <> 3 AS returned, CASE sample_id % 4 WHEN 0 THEN gold WHEN 1 THEN best END AS refined, (sample_id % 7) / 50.0::DOUBLE AS sure FROM g)",
)


def _gate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Samples with band and a stand-in for a refiner's answer that depends on the id."""
    n = materialize(nodes_of(spark, d), "nodes")
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "dataset", "gold_id", "dual_best_id", "dual_margin")
    r = ontology.resolved(ontology.resolved(s, "gold_id", n, "gold"), "dual_best_id", n, "best")
    m = F.col("sample_id") % 4
    return r.select(
        "sample_id", F.coalesce("dataset", F.lit("none")).alias("dataset"), "gold", "best", F.col("dual_margin").alias("margin"), routing.band(F.col("dual_margin"), 0.05, 0.20).alias("band"),
        (m != 3).alias("returned"), F.when(m == 0, F.col("gold")).when(m == 1, F.col("best")).alias("refined"), (F.col("sample_id") % 7 / F.lit(50.0)).alias("sure"),
    )


@query(
    "gates",
    with_parts(*GATE) + "SELECT sample_id, band, CASE WHEN band = 'EASY' THEN best WHEN band = 'HARD' THEN coalesce(refined, best) WHEN refined = gold THEN refined ELSE best END AS eval_id, CASE WHEN band = 'EASY' THEN best ELSE coalesce(refined, best) END AS deploy_id, CASE WHEN band = 'EASY' THEN best WHEN sure >= 0.1 THEN coalesce(gold, best) WHEN band = 'HARD' THEN coalesce(refined, best) ELSE coalesce(refined, best) END AS fuzzy_id, CASE WHEN band = 'EASY' THEN best WHEN band = 'HARD' THEN coalesce(refined, best) WHEN sure >= 0.05 THEN coalesce(refined, best) ELSE best END AS rerank_id, CASE WHEN band <> 'EASY' AND returned THEN coalesce(refined, best) ELSE best END AS service_id, CASE WHEN band <> 'EASY' AND returned THEN 'llm' ELSE 'dual' END AS source FROM r",
)
def gates(spark: SparkSession, d: str) -> DataFrame:
    r = _gate_rows(spark, d)
    b, best, refined = F.col("band"), F.col("best"), F.col("refined")
    deploy = routing.deploy_gate(b, best, refined)
    service, source = routing.service_gate(b, best, F.col("returned"), refined)
    return r.select("sample_id", "band", routing.eval_gate(b, best, refined, F.col("gold")).alias("eval_id"), deploy.alias("deploy_id"), routing.fuzzy_gate(b, best, F.col("sure"), F.col("gold"), 0.1, deploy).alias("fuzzy_id"), routing.rerank_gate(b, best, refined, F.col("sure")).alias("rerank_id"), service.alias("service_id"), source.alias("source"))


@query("conditional_accuracy", with_parts(*GATE) + "SELECT dataset, count(*) AS n, count(*) FILTER (band <> 'EASY') AS calls, count(*) FILTER (band <> 'EASY' AND refined IS NOT NULL AND refined = gold) AS hits, round(count(*) FILTER (band <> 'EASY') / count(*), 6) AS call_rate, round(coalesce(count(*) FILTER (band <> 'EASY' AND refined IS NOT NULL AND refined = gold) / nullif(count(*) FILTER (band <> 'EASY'), 0), 0), 6) AS accuracy FROM r GROUP BY dataset")
def conditional_accuracy(spark: SparkSession, d: str) -> DataFrame:
    right = F.coalesce(F.col("refined") == F.col("gold"), F.lit(False))
    return metrics.conditional_accuracy(_gate_rows(spark, d), "dataset", F.col("band") != "EASY", right)


@query("label_accuracy", with_parts(*GATE) + "SELECT dataset, count(*) AS n, round(count(*) FILTER (gold IS NOT DISTINCT FROM best) / count(*), 6) AS accuracy FROM r GROUP BY dataset")
def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_accuracy(_gate_rows(spark, d), "dataset", "gold", "best")


COUNTS = "SELECT coalesce(gd, pd) AS dataset, count(*) FILTER (gd IS NOT NULL AND pd IS NOT NULL) AS tp, count(*) FILTER (gd IS NULL) AS fp, count(*) FILTER (pd IS NULL) AS fn FROM (SELECT DISTINCT dataset AS gd, gold FROM u WHERE gold <> '') a FULL JOIN (SELECT DISTINCT dataset AS pd, best FROM u WHERE best <> '') b ON gd = pd AND gold = best GROUP BY ALL"


@query("corpus_set_prf", with_parts(*GATE, "u AS (SELECT dataset, gold, best FROM g UNION ALL SELECT '_GLOBAL', gold, best FROM g)", f"c AS ({COUNTS})") + "SELECT dataset, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c")
def corpus_set_prf(spark: SparkSession, d: str) -> DataFrame:
    r = materialize(_gate_rows(spark, d).select("dataset", "gold", "best"), "gate-rows")
    return metrics.corpus_set_prf(r.select("dataset", F.col("gold").alias("concept_id")), r.select("dataset", F.col("best").alias("concept_id")))


@query("metric_scalars", with_parts(*GATE) + "SELECT dataset || '/' || m AS tag, 0 AS step, v AS value FROM (SELECT dataset, unnest(['n', 'accuracy']) AS m, unnest([CAST(count(*) AS DOUBLE), round(count(*) FILTER (gold IS NOT DISTINCT FROM best) / count(*), 6)]) AS v FROM r GROUP BY dataset)")
def metric_scalars(spark: SparkSession, d: str) -> DataFrame:
    return sinks.scalars(label_accuracy(spark, d))


@query("request_bands", with_parts(HINTS, REQUESTS, "m AS (SELECT hint_id, max(score) AS s0, coalesce(max(score) FILTER (r = 2), max(score)) AS s1 FROM (SELECT hint_id, score, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, cand_id) AS r FROM candidates WHERE score IS NOT NULL) GROUP BY hint_id)", "x AS (SELECT h.hint_id, round(s0 - s1, 6) AS margin, CASE WHEN tau_high > 1 THEN tau_low / 100 ELSE tau_low END AS low, CASE WHEN tau_high > 1 THEN tau_high / 100 ELSE tau_high END AS high FROM h JOIN q USING (req_id) JOIN m USING (hint_id))") + "SELECT hint_id, margin, CASE WHEN margin >= high THEN 'EASY' WHEN margin <= low THEN 'HARD' ELSE 'MEDIUM' END AS band FROM x")
def request_bands(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", "req_id")
    q = latest(table(spark, d, "requests"), "req_id", "loaded_at", "tau_low", "tau_high")
    c = table(spark, d, "candidates").where("score is not null").withColumn("r", F.row_number().over(Window.partitionBy("hint_id").orderBy(F.desc("score"), "cand_id"))).where("r <= 2")
    m = c.groupBy("hint_id").agg(F.max("score").alias("s0"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.max("score")).alias("s1"))
    scale = F.when(F.col("tau_high") > 1, 100.0).otherwise(1.0)
    x = h.join(q, "req_id").join(m, "hint_id").withColumn("margin", F.round(F.col("s0") - F.col("s1"), 6))
    return x.select("hint_id", "margin", routing.band(F.col("margin"), F.col("tau_low") / scale, F.col("tau_high") / scale).alias("band"))


@query("hint_queries", with_parts(HINTS) + f"SELECT req_id, sid, CASE WHEN count(*) FILTER (hint_en IS NOT NULL AND {sql_polarity('polarity')} = 'present') > 0 THEN count(*) FILTER (hint_en IS NOT NULL AND {sql_polarity('polarity')} = 'present') ELSE 1 END AS n_queries FROM h GROUP BY req_id, sid")
def hint_queries(spark: SparkSession, d: str) -> DataFrame:
    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", "req_id", "sid", "mention", "hint_en", "polarity")
    hints = F.filter(F.collect_list(F.struct("hint_en", polarity("polarity").alias("polarity"))), lambda x: x["hint_en"].isNotNull())
    g = h.groupBy("req_id", "sid").agg(hints.alias("hints"), F.min("mention").alias("mention"))
    return g.select("req_id", "sid", F.size(routing.queries_of(F.col("hints"), F.col("mention"))).cast("long").alias("n_queries"))


@query(
    "parse_indices",
    "SELECT hint_id, n, CASE hint_id % 6 WHEN 0 THEN [n - 1] WHEN 1 THEN [0] WHEN 2 THEN CASE WHEN n > 1 THEN [1, 0] ELSE [0] END ELSE [] END::INTEGER[] AS chosen FROM (SELECT hint_id, CAST(count(*) AS INTEGER) AS n FROM candidates WHERE hint_id IS NOT NULL GROUP BY hint_id)",
)
def parse_indices(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where("hint_id is not null").groupBy("hint_id").agg(F.count("*").cast("int").alias("n"))
    m = F.col("hint_id") % 6
    reply = F.when(m == 0, (F.col("n") - 1).cast("string")).when(m == 1, "\t0,99,0\u00a0\n").when(m == 2, "1,0,1,-1").when(m == 3, "-1").when(m == 4, "[0]").otherwise("")
    return c.select("hint_id", "n", protocol.parse_indices(reply, F.col("n")).alias("chosen"))


@query("refine_choice", "SELECT cand_id, CASE cand_id % 4 WHEN 0 THEN 3 WHEN 1 THEN CASE WHEN regexp_matches(hpo_id, '^HP:\\d{7}$') THEN 1 END WHEN 2 THEN -1 END::INTEGER AS choice FROM candidates")
def refine_choice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    m = F.col("cand_id") % 4
    reply = F.when(m == 0, "I would say index = 3.").when((m == 1) & F.col("hpo_id").rlike(r"^HP:\d{7}$"), F.concat(F.lit("best: "), F.col("hpo_id"))).when(m == 2, "none (-1)").otherwise("none")
    return c.select("cand_id", protocol.refine_choice(reply, F.array(F.lit("HP:0000000"), F.coalesce("hpo_id", F.lit("?")))).alias("choice"))


HINT_ROWS = f"hh AS (SELECT req_id, sid, {sql_norm('hint_en')} AS t, CASE WHEN {sql_polarity('polarity')} = 'present' THEN 'present' ELSE 'other' END AS p FROM h WHERE trim(hint_en) <> '' AND {sql_norm('hint_en')} <> '')"


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies in the line protocol as a model would give them, some without END."""
    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", "req_id", "sid", "hint_en", "polarity", "hint_type")
    h = h.select("req_id", "sid", norm("hint_en").alias("t"), F.coalesce("polarity", F.lit("unk")).alias("p"), F.coalesce("hint_type", F.lit("other")).alias("k")).where("t <> ''")
    g = h.groupBy("req_id", "sid").agg(F.array_sort(F.collect_list(F.concat_ws("\t", F.lit("HINT"), "t", "p", "k"))).alias("lines"))
    end = F.when(F.col("req_id") % 3 == 0, "").otherwise("\nEND\nnot read")
    return g.withColumn("reply", F.concat(F.lit("SENT_EN\tpart "), F.col("sid").cast("string"), F.lit("\n"), F.array_join("lines", "\n"), end))


@query("parse_protocol", with_parts(HINTS, HINT_ROWS) + "SELECT req_id, sid, true AS ok, 'part ' || sid AS sentence_en, CAST(count(*) AS INTEGER) AS n_hints, CAST(count(*) FILTER (p = 'present') AS INTEGER) AS n_present, 0 AS n_bad FROM hh GROUP BY req_id, sid")
def parse_protocol(spark: SparkSession, d: str) -> DataFrame:
    p = _replies(spark, d).select("req_id", "sid", protocol.parse_protocol("reply", "tab").alias("x"))
    present = F.size(F.filter("x.hints", lambda h: h["polarity"] == "present"))
    return p.select("req_id", "sid", "x.ok", "x.sentence_en", F.size("x.hints").alias("n_hints"), present.alias("n_present"), F.col("x.n_bad").alias("n_bad"))


@query("parse_json_hints", with_parts(HINTS, HINT_ROWS) + "SELECT req_id, sid, true AS ok, CAST(count(*) AS INTEGER) AS n_hints, string_agg(t, '|' ORDER BY t) AS hints FROM hh GROUP BY req_id, sid")
def parse_json_hints(spark: SparkSession, d: str) -> DataFrame:
    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", "req_id", "sid", "hint_en").select("req_id", "sid", norm("hint_en").alias("hint_en")).where("hint_en <> ''")
    body = F.to_json(F.struct(F.lit("x").alias("sentence_en"), F.array_sort(F.collect_list(F.struct("hint_en"))).alias("hints")))
    r = h.groupBy("req_id", "sid").agg(F.concat(F.lit("Here it is: "), body, F.lit(" (end)")).alias("reply"))
    x = r.select("req_id", "sid", protocol.parse_json_hints("reply").alias("x"))
    return x.select("req_id", "sid", "x.ok", F.size("x.hints").alias("n_hints"), F.array_join(F.array_sort(F.transform("x.hints", lambda y: y["hint_en"])), "|").alias("hints"))


@query(
    "request_stats",
    with_parts(
        HINTS, REQUESTS, HINT_ROWS, "f AS (SELECT req_id, count(DISTINCT sid) AS n FROM fragments GROUP BY req_id)", "e AS (SELECT req_id, count(*) AS n, count(*) FILTER (hint_en IS NULL) AS missing FROM h GROUP BY req_id)",
        "r AS (SELECT req_id, count(*) FILTER (sid % 5 = 4) AS failed, count(*) FILTER (sid % 5 <> 4 AND req_id % 3 = 0) AS no_end FROM (SELECT DISTINCT req_id, sid FROM hh) GROUP BY req_id)",
    ) + "SELECT client, count(*) AS requests, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS sentences, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS hints, CAST(coalesce(sum(e.missing), 0) AS BIGINT) AS missing, count(*) FILTER (src IS NULL OR trim(src) = '') AS blank, CAST(coalesce(sum(r.failed), 0) AS BIGINT) AS failed, CAST(coalesce(sum(r.no_end), 0) AS BIGINT) AS missing_end FROM q LEFT JOIN f USING (req_id) LEFT JOIN e USING (req_id) LEFT JOIN r USING (req_id) GROUP BY client",
)
def request_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts by client; of the replies for its sentences, made up as ``_replies``, every fifth call fails."""
    q = latest(table(spark, d, "requests"), "req_id", "loaded_at", "client", "src")
    f = table(spark, d, "fragments").groupBy("req_id").agg(F.countDistinct("sid").alias("s"))
    h = latest(table(spark, d, "hints"), "hint_id", "logged_at", "req_id", "hint_en").groupBy("req_id").agg(F.count("*").alias("n"), F.count_if(F.col("hint_en").isNull()).alias("m"))
    reply = F.when(F.col("sid") % 5 != 4, F.col("reply"))
    p = _replies(spark, d).select("req_id", protocol.parse_protocol(reply, "tab", repair=False).alias("p"))
    r = p.groupBy("req_id").agg(F.count_if(~F.col("p.ok")).alias("bad"), F.count_if(F.col("p.ok") & ~F.col("p.saw_end")).alias("open"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    every = q.join(f, "req_id", "left").join(h, "req_id", "left").join(r, "req_id", "left").groupBy("client")
    return every.agg(F.count("*").alias("requests"), total("s", "sentences"), total("n", "hints"), total("m", "missing"), F.count_if(F.col("src").isNull() | (F.trim("src") == "")).alias("blank"), total("bad", "failed"), total("open", "missing_end"))


def samples_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples as a pipeline takes them, with their gold ids resolved, and the nodes."""
    n = materialize(nodes_of(spark, d), "nodes")
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "dataset", "context", "mention", "gold_id")
    r = ontology.resolved(s.withColumn("gold_id", norm_id("gold_id")), "gold_id", n, "gold")
    return r.select(F.col("sample_id").alias("row_id"), "dataset", "context", "mention", F.col("gold").alias("gold_id")), n


def _pipeline(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        s, n = samples_of(spark, d)
        return pipeline.report(pipeline.run(s, n, pipeline.VARIANTS[name]))

    return run


def _words(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"


def sql_pipeline(v: pipeline.Variant) -> str | None:
    """A variant with dense retrieval over the stand-ins' vectors and replies; None for what SQL cannot say."""
    if v.retriever != "dense" or v.refiner == "fuzzy_llm" or v.hierarchy:
        return None
    plain = f"concat_ws(' ', coalesce(name, '') || '.', {DEFINITION}, CASE WHEN len(synonyms) > 0 THEN 'Synonyms: ' || array_to_string(synonyms, ', ') || '.' END)"
    chosen = {
        "none": "ch AS (SELECT NULL::VARCHAR AS mention, NULL::VARCHAR AS refined, NULL::DOUBLE AS sure LIMIT 0)",
        "llm": f"wd AS (SELECT mention, concept_id, rank, len(list_intersect({_words('mention')}, {_words('name')})) AS k FROM rk JOIN n ON n.id = rk.concept_id), ch AS (SELECT mention, arg_min(concept_id, -k * 1000 + rank) AS refined, NULL::DOUBLE AS sure FROM wd WHERE k > 0 GROUP BY mention)",
        "rerank": f"yp AS (SELECT mention, concept_id, round((len(list_intersect({_words('mention')}, {_words(sql_tagged(''))})) + 0.5::DOUBLE) / (len({_words('mention')}) + 1), 6) AS y FROM rk JOIN n ON n.id = rk.concept_id WHERE len({_words('mention')}) > 0 UNION ALL SELECT mention, concept_id, 0.5 FROM rk WHERE len({_words('mention')}) = 0), yr AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY y DESC, concept_id) AS r FROM yp), ch AS (SELECT mention, max(concept_id) FILTER (r = 1) AS refined, round(CASE WHEN max(y) FILTER (r = 2) IS NULL THEN 0 ELSE max(y) FILTER (r = 1) - max(y) FILTER (r = 2) END, 6) AS sure FROM yr WHERE r <= 2 GROUP BY mention)",
    }[v.refiner]
    gate = "CASE WHEN band = 'EASY' THEN best_id ELSE coalesce(refined, best_id) END"
    if v.mode == "oracle_eval":
        gate = "CASE WHEN band = 'EASY' THEN best_id WHEN band = 'HARD' THEN coalesce(refined, best_id) WHEN refined = gold THEN refined ELSE best_id END"
    if v.refiner == "rerank":
        gate = f"CASE WHEN band = 'EASY' THEN best_id WHEN band = 'HARD' OR sure >= {v.rerank_least} THEN coalesce(refined, best_id) ELSE best_id END"
    asked = "w.recalled" if v.restrict_to_recalled else "true"
    rate = lambda c: f"round(count(*) FILTER ({c}) / count(*), 6)"
    return with_parts(
        SAMPLES, NODES, ALIASES, RESOLVER,
        f"sm AS (SELECT sample_id, dataset, mention, coalesce(rs.id, {sql_id('gold_id')}) AS gold FROM s LEFT JOIN rs ON rs.any_id = {sql_id('gold_id')})",
        f"tx AS (SELECT DISTINCT 'm' AS kind, mention AS id, mention AS t FROM sm WHERE mention <> '' UNION ALL SELECT 'c', id, {plain if v.text == 'plain' else sql_tagged('[1:3]')} FROM n)",
        "tg AS (SELECT kind, id, substr(u, CAST(i AS INTEGER), 3) AS g FROM (SELECT kind, id, u, unnest(range(1, length(u) - 1)) AS i FROM (SELECT kind, id, '  ' || lower(t) || ' ' AS u FROM tx)))",
        "gh AS (SELECT g, h % 256 AS place, CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END AS sign FROM (SELECT g, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT g FROM tg)))",
        "pl AS (SELECT kind, id, place, sum(sign)::DOUBLE AS x FROM tg JOIN gh USING (g) GROUP BY ALL)",
        "vc AS (SELECT kind, id, place, (x / sqrt(sum(x * x) OVER (PARTITION BY kind, id)))::FLOAT::DOUBLE AS x FROM pl WHERE x <> 0)",
        "dt AS (SELECT a.id AS mention, b.id AS concept_id, round(sum(a.x * b.x), 6) AS score FROM vc a JOIN vc b USING (place) WHERE a.kind = 'm' AND b.kind = 'c' GROUP BY ALL)",
        f"rk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, concept_id) - 1 AS INTEGER) AS rank FROM dt) WHERE rank < {v.k})",
        "mg AS (SELECT mention, max(concept_id) FILTER (rank = 0) AS best_id, round(CASE WHEN max(score) FILTER (rank = 1) IS NULL THEN 0 ELSE max(score) FILTER (rank = 0) - max(score) FILTER (rank = 1) END, 6) AS margin FROM rk GROUP BY mention)",
        chosen,
        f"w AS (SELECT sm.*, best_id, CASE WHEN margin >= {v.high} THEN 'EASY' WHEN margin IS NULL OR margin <= {v.low} THEN 'HARD' ELSE 'MEDIUM' END AS band, EXISTS (SELECT 1 FROM rk WHERE rk.mention = sm.mention AND rk.concept_id = sm.gold) AS recalled FROM sm LEFT JOIN mg USING (mention))",
        f"fi AS (SELECT *, {gate} AS final_id FROM (SELECT w.*, CASE WHEN {asked} THEN ch.refined END AS refined, ch.sure FROM w LEFT JOIN ch USING (mention)))",
    ) + f"SELECT CASE WHEN grouping(ds) = 1 THEN '_GLOBAL' ELSE ds END AS dataset, count(*) AS total, {rate('best_id = gold')} AS dual_top1, {rate('final_id = gold')} AS final_top1, {rate("band <> 'EASY'")} AS call_rate, {rate('recalled')} AS recall FROM (SELECT *, coalesce(dataset, 'none') AS ds FROM fi) GROUP BY ROLLUP (ds)"


for _name, _variant in pipeline.VARIANTS.items():
    query(f"pipeline_{_name}", sql_pipeline(_variant))(_pipeline(_name))
