"""Queries on texts: splitting, windows, normal forms, annotation lines, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import protocol, text
from termloom.operators import chunking, sampling, spans
from termloom.operators.delivery import latest, latest_value
from termloom.operators.metrics import set_prf
from termloom.plans.registry import HINTS, REQUESTS, SAMPLES, query, sql_id, sql_norm, sql_polarity, sql_strip, with_parts
from termloom.session import table
from termloom.sources import annotations

PIECES_SQL = "[^。！？；!?;\\n.]+[。！？；!?;.]?|\\n+|[。！？；!?;.]"
SPLIT = (
    f"p AS (SELECT req_id, i, piece, CAST(sum(length(piece)) OVER (PARTITION BY req_id ORDER BY i) - length(piece) AS INTEGER) AS c0, CAST(sum(length(piece)) OVER (PARTITION BY req_id ORDER BY i) AS INTEGER) AS c1 FROM (SELECT req_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT req_id, regexp_extract_all(src, '{PIECES_SQL}') AS l FROM q WHERE src IS NOT NULL)))",
    "f AS (SELECT req_id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY i) - 1 AS INTEGER) AS sid, piece AS src, c0, c1 FROM p WHERE length(regexp_replace(piece, '[\\s\\pZ\\x{85}]', '', 'g')) > 0 AND NOT regexp_full_match(piece, '[。！？；!?;.]'))",
)


def requests_of(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "requests"), "req_id", "loaded_at", "src")


def sentences_of(spark: SparkSession, d: str) -> DataFrame:
    s = requests_of(spark, d).select("req_id", F.explode(text.simple_sentences("src")).alias("s"))
    return s.select("req_id", "s.sid", "s.src", "s.c0", "s.c1")


def fragments_of(spark: SparkSession, d: str) -> DataFrame:
    """The logged fragments, each place once."""
    return table(spark, d, "fragments").where("req_id is not null").select("req_id", "c0", "c1").distinct()


@query("sentence_split", with_parts(REQUESTS, *SPLIT) + "SELECT req_id, sid, src, c0, c1 FROM f")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return sentences_of(spark, d)


@query("long_sentence_split")
def long_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked_sentences(requests_of(spark, d), "req_id", "src")


@query("approx_tokens", "SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_''][A-Za-z0-9]+)*')) + len(regexp_extract_all(text, '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\pZ\\x{85}]')), 0) AS INTEGER) AS n_tokens FROM documents")
def approx_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.approx_tokens("text").alias("n_tokens"))


@query("context_window", with_parts(SAMPLES) + "SELECT sample_id, substring(context, greatest(0, c0 - 64) + 1, least(length(context), c1 + 64) - greatest(0, c0 - 64)) AS left_text, CAST(c0 - greatest(0, c0 - 64) AS INTEGER) AS c0, CAST(c1 - greatest(0, c0 - 64) AS INTEGER) AS c1 FROM s WHERE c1 > c0 AND context IS NOT NULL")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "context", "c0", "c1").where("context is not null")
    p = annotations.span_pairs(s.withColumnRenamed("context", "text"), 64)
    return p.select("sample_id", "left_text", "left_span.c0", "left_span.c1")


@query("fragment_join", with_parts(REQUESTS, "f AS (SELECT DISTINCT req_id, c0, c1, src AS piece FROM fragments)") + "SELECT req_id, f.c0, f.c1, substring(q.src, least(greatest(0, least(f.c0, length(q.src))), greatest(0, least(f.c1, length(q.src)))) + 1, abs(greatest(0, least(f.c1, length(q.src))) - greatest(0, least(f.c0, length(q.src))))) AS cut, piece IS NOT DISTINCT FROM substring(q.src, f.c0 + 1, f.c1 - f.c0) AS same FROM f JOIN q USING (req_id) WHERE q.src IS NOT NULL AND f.c0 IS NOT NULL AND f.c1 IS NOT NULL")
def fragment_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragments").where("c0 is not null and c1 is not null").select("req_id", "c0", "c1", F.col("src").alias("piece")).distinct()
    j = f.join(requests_of(spark, d).where("src is not null"), "req_id").withColumn("cut", text.safe_slice("src", "c0", "c1"))
    return j.select("req_id", "c0", "c1", "cut", F.col("piece").eqNullSafe(F.expr("substring(src, c0 + 1, c1 - c0)")).alias("same"))


@query("normal_mentions", with_parts(SAMPLES) + f"SELECT sample_id, {sql_norm('mention')} AS norm, regexp_replace(mention, '^[\\s\\pZ\\x{{85}}.,;:()\\[\\]{{}}]+|[\\s\\pZ\\x{{85}}.,;:()\\[\\]{{}}]+$', '', 'g') AS stripped, regexp_replace(mention, '[^A-Za-z0-9._-]+', '_', 'g') AS tag FROM s")
def normal_mentions(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "mention")
    return s.select("sample_id", text.norm("mention").alias("norm"), text.strip_span("mention").alias("stripped"), text.tag("mention").alias("tag"))


@query("token_windows", "SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(len(t[s + 1:s + 128]) AS INTEGER) AS n_tokens, t[s + 1] AS first_token FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - 128) / 96)) AS BIGINT) + 1)) * 96 AS s FROM (SELECT doc_id, string_split(n, ' ') AS t FROM (SELECT doc_id, " + sql_norm("text") + " AS n FROM documents) WHERE n <> ''))")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.norm("text").alias("n")).where("n <> ''")
    w = t.select("doc_id", F.explode(text.token_windows(F.split("n", " "), 128, 32)).alias("w"))
    return w.select("doc_id", "w.start", F.size("w.tokens").alias("n_tokens"), F.get("w.tokens", F.lit(0)).alias("first_token"))


TOKENS = (
    "x AS (SELECT sample_id, context, c0, c1 FROM s WHERE context IS NOT NULL AND c1 > c0)",
    "p AS (SELECT sample_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT sample_id, regexp_extract_all(context, '[\\s\\pZ\\x{85}]+|[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}]+|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\pZ\\x{85}]') AS l FROM x))",
    "o AS (SELECT sample_id, piece, i, sum(length(piece)) OVER (PARTITION BY sample_id ORDER BY i) AS b FROM p)",
    "t AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY i) - 1 AS k, b - length(piece) AS a, b FROM o WHERE NOT regexp_matches(piece, '^[\\s\\pZ\\x{85}]'))",
)


@query(
    "bioes_round_trip",
    with_parts(SAMPLES, *TOKENS) + "SELECT sample_id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(min(k) FILTER (b > c0 AND a < c1) AS INTEGER) AS i0, CAST(max(k) FILTER (b > c0 AND a < c1) AS INTEGER) AS i1, CAST(min(a) FILTER (b > c0 AND a < c1) AS INTEGER) AS c0, CAST(max(b) FILTER (b > c0 AND a < c1) AS INTEGER) AS c1 FROM t JOIN x USING (sample_id) GROUP BY sample_id",
)
def bioes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    def trip(t: Column) -> Column:
        place = lambda s: protocol.token_span(t, s["i0"], s["i1"])
        back = lambda s: F.struct(s["i0"].alias("i0"), s["i1"].alias("i1"), place(s)["c0"].alias("c0"), place(s)["c1"].alias("c1"))
        found = protocol.bioes_spans(spans.bioes_labels(t, F.array(F.struct("c0", "c1"))))
        return F.struct(F.size(t).alias("n_tokens"), F.transform(found, back).alias("spans"))

    # the trip is made before the latest delivery is chosen, so that no context is shuffled
    value = F.when(F.expr("context is not null and c1 > c0"), text.bound(spans.tokens(F.col("context")), trip))
    s = latest_value(table(spark, d, "samples"), "sample_id", "loaded_at", value, "context", "c0", "c1").where("value.n_tokens > 0")
    p = s.select("sample_id", "value.n_tokens", F.explode_outer("value.spans").alias("s"))
    return p.select("sample_id", "n_tokens", "s.i0", "s.i1", "s.c0", "s.c1")


@query("polarity_policies", with_parts(HINTS, f"p AS (SELECT {sql_polarity('polarity')} AS polarity FROM h)") + "SELECT polarity, count(*) AS n, count(*) FILTER (polarity = 'present') AS kept_present, count(*) FILTER (polarity <> 'absent') AS kept_not_absent FROM p GROUP BY polarity")
def polarity_policies(spark: SparkSession, d: str) -> DataFrame:
    from termloom.operators.routing import keeps

    p = latest(table(spark, d, "hints"), "hint_id", "logged_at", "polarity").select(text.polarity("polarity").alias("polarity"))
    return p.groupBy("polarity").agg(F.count("*").alias("n"), F.count_if(keeps(F.col("polarity"), "present")).alias("kept_present"), F.count_if(keeps(F.col("polarity"), "not_absent")).alias("kept_not_absent"))


@query("holdout_split", with_parts(SAMPLES) + "SELECT sample_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || sample_id), sample_id) <= greatest(1, round(count(*) OVER (PARTITION BY dataset) * 0.1)) AS held FROM s")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "dataset").select("sample_id", "dataset")
    return sampling.holdout(s, "dataset", "sample_id")


@query("annotation_lines", with_parts(SAMPLES) + f"SELECT sample_id, base AS doc, c0, c1, {sql_strip('mention')} AS mention, {sql_id('gold_id')} AS concept_id FROM s WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND trim(mention) <> '' AND regexp_matches(gold_id, '(?i)^HP[:_]\\d+$')")
def annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "samples"), "sample_id", "loaded_at", "base", "c0", "c1", "mention", "gold_id").where("c0 is not null and c1 is not null and trim(mention) <> ''").where(F.col("gold_id").rlike(r"^(?i)HP[:_]\d+$"))
    bracket = F.pmod(F.xxhash64("base"), F.lit(2)) == 0
    line = F.when(bracket, F.format_string("[%d::%d]  %s | %s", "c0", "c1", "gold_id", "mention")).otherwise(F.format_string("%d %d %s %s", "c0", "c1", "mention", "gold_id"))
    p = annotations.parse_lines(s.select(F.col("base").alias("doc"), F.col("sample_id").alias("pos"), line.alias("line")))
    return p.select(F.col("pos").alias("sample_id"), "doc", "c0", "c1", "mention", "concept_id")


@query("span_prf", with_parts(REQUESTS, *SPLIT, "g AS (SELECT DISTINCT req_id, c0, c1 FROM fragments WHERE req_id IS NOT NULL)", "x AS (SELECT count(*) FILTER (g.c0 IS NOT NULL AND f.c0 IS NOT NULL) AS tp, count(*) FILTER (g.c0 IS NULL) AS fp, count(*) FILTER (f.c0 IS NULL) AS fn FROM g FULL JOIN f ON g.req_id = f.req_id AND g.c0 = f.c0 AND g.c1 = f.c1)") + "SELECT 'fragments' AS dataset, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM x")
def span_prf(spark: SparkSession, d: str) -> DataFrame:
    place = F.concat_ws(":", "req_id", "c0", "c1").alias("concept_id")
    name = F.lit("fragments").alias("dataset")
    return set_prf(fragments_of(spark, d).select(name, place), sentences_of(spark, d).select(name, place), ["dataset"])


IOU = "greatest(0, least(g.c1 - 1, f.c1 - 1) - greatest(g.c0, f.c0) + 1)"


@query("iou_best", with_parts(REQUESTS, *SPLIT, "g AS (SELECT DISTINCT req_id, c0, c1 FROM fragments WHERE req_id IS NOT NULL AND c1 > c0)", f"b AS (SELECT g.req_id, g.c0 AS g0, g.c1 - 1 AS g1, f.c0 AS p0, f.c1 - 1 AS p1, round({IOU} / ((g.c1 - g.c0) + (f.c1 - f.c0) - {IOU}), 6) AS iou FROM g JOIN f ON f.req_id = g.req_id AND f.c0 < g.c1 AND f.c1 > g.c0)", "t AS (SELECT *, row_number() OVER (PARTITION BY req_id, g0, g1 ORDER BY iou DESC, p0, p1) AS r FROM b WHERE iou >= 0.5)") + "SELECT g.req_id, g.c0 AS g0, CAST(g.c1 - 1 AS INTEGER) AS g1, t.p0, CAST(t.p1 AS INTEGER) AS p1, t.iou FROM g LEFT JOIN t ON t.req_id = g.req_id AND t.g0 = g.c0 AND t.g1 = g.c1 - 1 AND t.r = 1")
def iou_best(spark: SparkSession, d: str) -> DataFrame:
    g = fragments_of(spark, d).where("c1 > c0").select("req_id", F.col("c0").alias("g0"), (F.col("c1") - 1).alias("g1"))
    p = sentences_of(spark, d).select("req_id", F.col("c0").alias("p0"), (F.col("c1") - 1).alias("p1"))
    return spans.best_overlap(g, p, "req_id")


@query("interval_overlap", with_parts(REQUESTS, *SPLIT) + "SELECT f.req_id, f.sid, count(*) AS n_overlaps FROM f JOIN (SELECT DISTINCT req_id, c0, c1 FROM fragments) g ON g.req_id = f.req_id AND g.c1 > f.c0 AND g.c0 < f.c1 GROUP BY f.req_id, f.sid")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    f, g = sentences_of(spark, d).select("req_id", "sid", "c0", "c1"), fragments_of(spark, d).select("req_id", F.col("c0").alias("g0"), F.col("c1").alias("g1"))
    j = spans.overlap_join(f, g, "req_id", ("c0", "c1"), ("g0", "g1"))
    return j.groupBy("req_id", "sid").agg(F.count("*").alias("n_overlaps"))
