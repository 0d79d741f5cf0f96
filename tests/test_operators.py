"""Hierarchy, routing, metrics, retrieval, deliveries, sampling, pipeline."""

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from termloom.operators import delivery, hierarchy, metrics, retrieval, routing, sampling, spans
from termloom.plans import pipeline
from termloom.plans.providers import Replies, overlap_choice
from termloom.sources import ontology


def test_latest(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c"), (None, 3, "d"), (3, 1, None)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    want = [(1, "b"), (2, "c"), (3, None)]
    key = lambda r: (r["k"], r["v"] or "")
    assert sorted(((r["k"], r["v"]) for r in delivery.latest(df, "k", "o", "v").collect()), key=str) == sorted(want, key=str)
    assert sorted(map(key, delivery.latest_sparse(df, "k", "o").collect())) == [(1, "b"), (2, "c"), (3, "")]
    assert [tuple(r) for r in delivery.latest_wide(df, "k", "o", F.col("v") == "a", "v").collect()] == []
    assert [tuple(r) for r in delivery.latest_wide(df, "k", "o", F.col("v") == "b", "v").collect()] == [(1, "b")]
    assert delivery.latest(df.limit(0), "k", "o").count() == 0


TREE = [("r", "a"), ("r", "b"), ("a", "a1"), ("a", "a2"), ("a1", "a11")]


def tree(spark):
    e = spark.createDataFrame(TREE, "parent string, child string")
    pairs = ontology.closure(e)
    d = {"r": 0, "a": 1, "b": 1, "a1": 2, "a2": 2, "a11": 3}
    return pairs, spark.createDataFrame(list(d.items()), "id string, depth int"), d


def below(a, b):
    up = {c: p for p, c in TREE}
    while b in up:
        b = up[b]
        if a == b:
            return True
    return False


def test_prune_and_rerank(spark):
    pairs, depths, d = tree(spark)
    rng = random.Random(5)
    rows = [(g, c, rng.choice([0.5, 0.52, 0.55, 0.6])) for g in range(12) for c in rng.sample(sorted(d), rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "g int, concept_id string, score double")
    got = {}
    for r in hierarchy.pruned(df, "g", pairs, depths, 4).orderBy("g", "rank").collect():
        got.setdefault(r["g"], []).append(r["concept_id"])
    for g in range(12):
        kept = []
        for c, s in sorted(((c, s) for x, c, s in rows if x == g), key=lambda x: (-x[1], -d[x[0]], x[0])):
            if len(kept) < 4 and not any((below(c, k) or c == k) and t >= s - 0.05 for k, t in kept):
                kept.append((c, s))
        assert got[g] == [c for c, _ in kept]
    r = hierarchy.reranked(df, "g", pairs, depths).collect()
    for x in r:
        own = [(c, round(s + 0.1 * d[c] / 3, 9)) for g, c, s in rows if g == x["g"]]
        base = dict(own)[x["concept_id"]]
        hit = any(below(x["concept_id"], c) and t >= round(base + 0.02, 9) for c, t in own)
        assert abs(x["final"] - (base - 0.05 * hit)) < 2e-6
    assert hierarchy.pruned(df.limit(0), "g", pairs, depths, 4).count() == 0
    lca = hierarchy.common_ancestor(spark.createDataFrame([("a11", "a2"), ("a", "a"), ("b", "zz")], "a string, b string"), pairs)
    assert {(x["a"], x["b"]): (x["lca"], x["distance"]) for x in lca.collect()} == {("a11", "a2"): ("a", 3), ("a", "a"): ("a", 0), ("b", "zz"): (None, None)}


def test_bands_and_margins(spark):
    df = spark.createDataFrame([(1, "a", 0.75, 0), (1, "b", 0.5, 1), (2, "a", 0.625, 0), (2, "b", 0.5, 1), (3, "a", 0.53125, 0), (3, "b", 0.5, 1), (4, "a", 0.75, 0)], "g int, concept_id string, score double, rank int")
    m = retrieval.margins(df, "g").withColumn("band", routing.band(F.col("margin"), 0.05, 0.20))
    assert {r["g"]: (r["margin"], r["band"]) for r in m.collect()} == {1: (0.25, "EASY"), 2: (0.125, "MEDIUM"), 3: (0.03125, "HARD"), 4: (0.0, "HARD")}
    assert {r["g"]: r["margin"] for r in retrieval.margins(df, "g", "score").collect()}[4] == 0.75


def test_set_prf(spark):
    g = spark.createDataFrame([("x", c) for c in "ABCC"], "dataset string, concept_id string")
    p = spark.createDataFrame([("x", c) for c in ("A", "B", "D", None, "")], "dataset string, concept_id string")
    rows = {r["dataset"]: r for r in metrics.corpus_set_prf(g, p).collect()}
    assert set(rows) == {"x", "_GLOBAL"}
    assert all((r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and r["f1"] == 0.666667 for r in rows.values())
    assert metrics.corpus_set_prf(g.limit(0), p.limit(0)).count() == 0


def test_top_k_dot(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", 7)
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2, 3, (9, 4)).astype(float), rng.integers(-2, 3, (23, 4)).astype(float)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    want = sorted((i, j, r) for i in range(9) for r, j in enumerate(sorted(range(23), key=lambda j: (-(a[i] @ b[j]), j))[:5]))
    got = retrieval.top_k_dot(frame(a), frame(b), 5, ("id", "vec"), ("id", "vec")).collect()
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in got) == want
    want = sorted((i, j, r) for i in range(23) for r, j in enumerate(sorted(range(9), key=lambda j: (-(b[i] @ a[j]), j))[:5]))
    got = retrieval.top_k_dot(frame(b), frame(a), 5, ("id", "vec"), ("id", "vec")).collect()
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in got) == want


def test_best_overlap(spark):
    rng = random.Random(2)
    span = lambda: (lambda x: (x, x + rng.randint(0, 400)))(rng.randint(0, 900))
    gold, pred = {(k % 2, *span()) for k in range(20)}, {(k % 2, *span()) for k in range(20)}
    got = spans.best_overlap(spark.createDataFrame(sorted(gold), "doc int, g0 int, g1 int"), spark.createDataFrame(sorted(pred), "doc int, p0 int, p1 int"), "doc").collect()

    def iou(a, b):
        n = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1)
        return round(n / (a[1] - a[0] + b[1] - b[0] + 2 - n), 6)

    for r in got:
        best = sorted((-iou((r["g0"], r["g1"]), p[1:]), *p[1:]) for p in pred if p[0] == r["doc"] and iou((r["g0"], r["g1"]), p[1:]) >= 0.5)[:1]
        assert (r["p0"], r["p1"]) == (best[0][1:] if best else (None, None))
    assert len(got) == len(gold)


def test_gates(spark):
    df = spark.createDataFrame([("EASY", "b", "r", "r"), ("MEDIUM", "b", "r", "r"), ("MEDIUM", "b", "r", "x"), ("HARD", "b", None, "x")], "band string, best string, refined string, gold string")
    c = [F.col(x) for x in df.columns]
    assert [r[0] for r in df.select(routing.eval_gate(*c)).collect()] == ["b", "r", "b", "b"]
    assert [r[0] for r in df.select(routing.deploy_gate(*c[:3])).collect()] == ["b", "r", "r", "b"]


def test_samples(spark):
    df = spark.createDataFrame([(i, "g" if i < 15 else "h") for i in range(17)], "id int, grp string")
    h = sampling.holdout(df, "grp", "id", 0.2)
    assert {r["grp"]: r["n"] for r in h.groupBy("grp").agg(F.count_if("held").alias("n")).collect()} == {"g": 3, "h": 1}
    assert sampling.examples(df, "grp", "id", 2).count() == 4
    assert sampling.hard_examples(df, "id", "id", 3, "random").count() == 3


def test_replies_retry_and_fail(spark):
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert Replies(flaky, pause=0).one("p") == ("ok", None)
    r = Replies(lambda p: 1 / 0, tries=2, pause=0).over(spark.createDataFrame([("a",), (None,)], "p string"), "p").collect()
    assert sorted((x["reply"] or "", x["error"] is not None) for x in r) == [("", False), ("", True)]
    assert overlap_choice("MENTION: big ears\n0. HP:1\tSmall feet\n1. HP:2\tBig ears") == "1"


def test_pipeline(spark):
    n = ontology.nodes(spark.createDataFrame([("HP:1", "Big ears", ["Large ears"], "d", [], [], []), ("HP:2", "Small feet", None, None, ["HP:9"], ["HP:1"], [])], "hpo_id string, hpo_name string, hpo_synonyms array<string>, hpo_def string, alt_ids array<string>, father array<string>, child array<string>"))
    s = spark.createDataFrame([(1, "d", "c", "big ears", "HP:1"), (2, "d", "c", "feet small", "HP:2"), (3, None, None, None, "HP:2")], "row_id int, dataset string, context string, mention string, gold_id string")
    for name in pipeline.VARIANTS:
        r = {x["row_id"]: x for x in pipeline.run(s, n, pipeline.VARIANTS[name]).collect()}
        assert r[1]["final_id"] == "HP:1" and r[2]["final_id"] == "HP:2" and r[3]["final_id"] is None, name
    rep = {x["dataset"]: x["total"] for x in pipeline.report(pipeline.run(s, n, pipeline.VARIANTS["dense_only"])).collect()}
    assert rep == {"d": 2, "none": 1, "_GLOBAL": 3}


def test_fuzzy_variant_scores_all_names_in_part(spark):
    from termloom.functions.fuzzy import partial_ratio, weighted_ratio

    names = ["Ears that are big", "Big bears", "Feet", "Small feet, big toes", None]
    n = ontology.nodes(spark.createDataFrame([(f"HP:{i}", x, ["feet big"], None, [], [], []) for i, x in enumerate(names)], "hpo_id string, hpo_name string, hpo_synonyms array<string>, hpo_def string, alt_ids array<string>, father array<string>, child array<string>"))
    m = spark.createDataFrame([("Big ears",), ("feet big",)], "mention string")
    got = pipeline.retrieve(m, n, pipeline.VARIANTS["fuzzy_llm"])
    want = {(a, f"HP:{i}"): round(partial_ratio(a.lower(), (x or f"HP:{i}").lower()), 6) for a in ("Big ears", "feet big") for i, x in enumerate(names)}
    assert {(r["mention"], r["concept_id"]): r["score"] for r in got.collect()} == want
    got = pipeline.retrieve(m, n, pipeline.VARIANTS["fuzzy_weighted"])
    want = {(a, f"HP:{i}"): max(weighted_ratio(a, k) for k in (x, "feet big" if i == 0 else x) if k) / 100 for a in ("Big ears", "feet big") for i, x in enumerate(names) if x}
    got = {(r["mention"], r["concept_id"]): r["score"] for r in got.collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_stream(spark, tmp_path):
    from termloom.streaming import requests as stream

    rows = [(i, datetime(2031, 1, 1, i), "c", f"One. Two {i}!") for i in range(6)]
    schema = "req_id long, received_at timestamp, client string, src string"
    for part in (rows[:3], rows[3:], rows[:1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream.sentences(stream.first_deliveries(stream.read_requests(spark, str(tmp_path / "in"), schema)))
    q = s.writeStream.format("memory").queryName("sents").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sents").count() == 12
    v = stream.volume(stream.read_requests(spark, str(tmp_path / "in"), schema), delay="0 seconds")
    q = v.writeStream.format("memory").queryName("vol").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("vol").count() >= 3


def test_service_answers(spark):
    import json

    from termloom.plans import service

    n = ontology.nodes(spark.createDataFrame([("HP:1", "Big ears", None, None, None, None, None), ("HP:2", "Small feet", None, None, None, None, None)], "hpo_id string, hpo_name string, hpo_synonyms array<string>, hpo_def string, alt_ids array<string>, father array<string>, child array<string>"))
    q = spark.createDataFrame([(1, "He has small feet. Big ears too.", 5.0, 20.0), (2, " ", 0.05, 0.2), (3, None, None, None)], "req_id long, src string, tau_low double, tau_high double")
    h = spark.createDataFrame([(7, 1, 0, "feet", "small feet", "yes"), (8, 1, 1, "ears", "big ears", "absent"), (9, 1, 1, None, None, None)], "hint_id long, req_id long, sid int, mention string, hint_en string, polarity string")
    c = spark.createDataFrame([(7, "HP:1", 0.5), (7, "HP:2", 0.49)], "hint_id long, concept_id string, score double")
    found = service.entities(h, c, q, n)
    r = {x["req_id"]: x for x in service.answers(q, found).collect()}
    assert (r[1]["status"], r[2]["status"], r[3]["status"]) == (200, 400, 400)
    body = json.loads(r[1]["body"])
    assert body["meta"] == {"n_sentences": 2, "n_entities": 1, "n_llm": 1}
    assert body["sentences"][0]["entities"][0]["final_id"] == "HP:2" and body["sentences"][1]["entities"] == []
    assert service.computed_once(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t", "u", F.upper).count() == 3
    e = service.extracted(spark.createDataFrame([(1, "SENT_EN\tx\nHINT\tbig ears\tyes\tp\nEND"), (2, "?")], "req_id int, reply string"))
    assert [(x["req_id"], x["hint_en"], x["polarity"]) for x in e.collect()] == [(1, "big ears", "present")]


def test_holdout_is_the_first_digests(spark):
    import hashlib

    rows = [(i, "g" if i % 3 else None if i % 2 else "h") for i in range(500)]
    got = {r["id"] for r in sampling.holdout(spark.createDataFrame(rows, "id int, grp string"), "grp", "id", 0.13).where("held").collect()}
    want = set()
    for g in ("g", "h", None):
        ids = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, x in rows if x == g)
        want |= {i for _, i in ids[: max(1, int(len(ids) * 0.13 + 0.5))]}
    assert got == want
    assert sampling.holdout(spark.createDataFrame([], "id int, grp string"), "grp", "id").count() == 0


def test_hard_examples_of_the_first(spark):
    df = spark.createDataFrame([(i, float(50 - i)) for i in range(50)], "id int, m double")
    assert [r["id"] for r in sampling.hard_examples(df, "m", "id", 3, "first_margin").collect()] == [14, 13, 12]
    assert [r["id"] for r in sampling.hard_examples(df, "m", "id", 3).collect()] == [49, 48, 47]


def counting(folder):
    """A model that notes each call in a folder."""
    folder = str(folder)

    def call(prompt):
        import uuid
        from pathlib import Path

        from termloom.plans.providers import overlap_choice

        (Path(folder) / uuid.uuid4().hex).write_text(prompt)
        return overlap_choice(prompt)

    return call


def test_models_are_called_once(spark, tmp_path):
    from termloom.plans import service

    n = ontology.nodes(spark.createDataFrame([(f"HP:{i}", x, None, None, None, None, None) for i, x in enumerate(("Big ears", "Small feet", "Big feet"))], "hpo_id string, hpo_name string, hpo_synonyms array<string>, hpo_def string, alt_ids array<string>, father array<string>, child array<string>"))
    q = spark.createDataFrame([(1, "He has small feet. Big ears too.", 5.0, 90.0)], "req_id long, src string, tau_low double, tau_high double")
    h = spark.createDataFrame([(7, 1, 0, "feet", "small feet", "yes"), (8, 1, 1, "ears", "big ears", "yes")], "hint_id long, req_id long, sid int, mention string, hint_en string, polarity string")
    c = spark.createDataFrame([(k, f"HP:{i}", 0.5) for k in (7, 8) for i in (0, 1)], "hint_id long, concept_id string, score double")
    (tmp_path / "s").mkdir()
    found = service.entities(h, c, q, n, Replies(counting(tmp_path / "s")))
    service.answers(q, found).collect()
    found.collect()
    assert len(list((tmp_path / "s").iterdir())) == 2
    s = spark.createDataFrame([(i, "d", "c", m, "HP:1") for i, m in enumerate(("big ears or feet", "feet small", "toe"))], "row_id int, dataset string, context string, mention string, gold_id string")
    for name, v in pipeline.VARIANTS.items():
        folder = tmp_path / name
        folder.mkdir()
        v = pipeline.variant(name, high=2.0 * v.points, fuzzy_high=2.0)
        out = pipeline.run(s, n, v, Replies(counting(folder)))
        out.collect()
        asked = pipeline.report(out).where("dataset = '_GLOBAL'").first() and out.where("best_id is not null" + (" and recalled" if v.restrict_to_recalled else "")).count()
        assert len(list(folder.iterdir())) == (asked if v.refiner in ("llm", "fuzzy_llm") else 0), name


def test_fused_variant_prunes_and_reranks(spark):
    n = ontology.nodes(spark.createDataFrame([("HP:1", "Ear", None, None, None, [], ["HP:2"]), ("HP:2", "Big ear", None, None, None, ["HP:1"], []), ("HP:3", "Foot", None, None, None, [], [])], "hpo_id string, hpo_name string, hpo_synonyms array<string>, hpo_def string, alt_ids array<string>, father array<string>, child array<string>"))
    got = pipeline.retrieve(spark.createDataFrame([("big ear",)], "mention string"), n, pipeline.VARIANTS["fused"]).orderBy("rank").collect()
    # the parent falls: its descendant is kept with a score that is no lower
    assert [r["concept_id"] for r in got][0] == "HP:2" and "HP:1" not in [r["concept_id"] for r in got]


def test_batches_and_taggers(spark):
    from termloom.plans.providers import BatchReplies, tagged_spans

    def call(ps):
        if any("bad" in p for p in ps):
            raise ValueError("no")
        return [p.upper() for p in ps]

    df = spark.createDataFrame([("a",), ("a",), ("bb",), (None,), ("bad",)], "p string").coalesce(1)
    got = sorted((r["p"] or "", r["reply"], r["error"]) for r in BatchReplies(call, 2).over(df, "p").collect())
    assert got == [("", None, None), ("a", "A", None), ("a", "A", None), ("bad", "", "ValueError: no"), ("bb", "BB", None)]

    def tag(t):
        return ([(0, 0), (0, 2), (3, 7), (7, 8), (0, 0)], [4, 0, 1, 3, 4])  # special tokens at both ends

    from termloom.sources.config import LABELS

    rows = tagged_spans(spark.createDataFrame([(1, "an earl,"), (2, None)], "k int, t string"), "k", "t", tag, LABELS).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 8, "earl")]


def test_spans_and_near(spark):
    df = spark.createDataFrame([(1, -2, 3), (1, 0, 3), (1, 4, 4), (1, 2, 99), (2, 5, 3)], "d int, c0 int, c1 int")
    assert sorted(map(tuple, spans.valid_spans(df, "c0", "c1", F.lit(10), "d").collect())) == [(1, 0, 3), (1, 2, 10)]
    pairs, _, _ = tree(spark)
    c = spark.createDataFrame([("a11", "a2"), ("b", "a2"), ("a2", "a2")], "concept_id string, target string").withColumn("g", F.lit(1))
    assert {(r["concept_id"], r["distance"]) for r in hierarchy.near(c, "g", "target", pairs, 3).collect()} == {("a11", 3), ("b", 3), ("a2", 0)}


def test_shared_folder_is_required_on_a_cluster():
    import pytest

    from termloom.session import shared_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getConf, getCheckpointDir = Conf, lambda self: None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
