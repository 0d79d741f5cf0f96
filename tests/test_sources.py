"""Ontology files, annotation files and sinks."""

import json

from pyspark.sql import functions as F

from termloom.operators import hierarchy
from termloom.sources import annotations, ontology, sinks

DAG = {
    "HP_0000001": {"Name": ["All"]},
    "HP_0000002": {"Name": "Alpha", "Synonym": ["first"], "Father": {"HP_0000001": {}}},
    "HP:0000003": {"Id": "HP:0000003", "Name": ["Beta"], "Synonym": "second", "Alt_id": ["HP_0000009"], "Def": "Some text.", "Father": ["HP:0000001"]},
    "HP_0000004": {"Name": ["Gamma"], "Def": ["G."], "Father": {"HP_0000002": {}, "HP_0000009": {}}},
}


def read(spark, tmp_path, data):
    (tmp_path / "o.json").write_text(json.dumps(data, indent=1))
    return ontology.read_json(spark, str(tmp_path / "o.json"))


def test_ontology_object(spark, tmp_path):
    n = read(spark, tmp_path, DAG)
    rows = {r["id"]: r for r in n.collect()}
    assert sorted(rows) == [f"HP:000000{i}" for i in (1, 2, 3, 4)]
    assert rows["HP:0000003"]["definition"] == "Some text." and rows["HP:0000004"]["definition"] == "G."
    assert rows["HP:0000003"]["synonyms"] == ["second"] and rows["HP:0000001"]["synonyms"] == []
    e = ontology.edges(n)
    assert sorted(map(tuple, e.collect())) == [("HP:0000001", "HP:0000002"), ("HP:0000001", "HP:0000003"), ("HP:0000002", "HP:0000004"), ("HP:0000003", "HP:0000004")]
    pairs = ontology.closure(e)
    assert {(r["ancestor"][-1], r["descendant"][-1]): r["steps"] for r in pairs.collect()} == {("1", "2"): 1, ("1", "3"): 1, ("2", "4"): 1, ("3", "4"): 1, ("1", "4"): 2}
    assert sorted((r["id"][-1], r["depth"]) for r in ontology.depths(n, pairs).collect()) == [("1", 0), ("2", 1), ("3", 1), ("4", 2)]
    ids = spark.createDataFrame([(1, "HP_0000002"), (1, "hp:0000004"), (1, "HP:0000009"), (2, None), (3, "HP:0000077")], "g int, x string")
    r = ontology.resolved(ids, "x", n)
    assert sorted((x["g"], x["concept_id"]) for x in hierarchy.most_specific(r, "g", pairs).collect()) == [(1, "HP:0000004"), (3, "HP:0000077")]
    assert sorted(x["id"] for x in ontology.clones(n).collect())[-1] == "HP:0000009"
    assert ("first", "HP:0000002") in set(map(tuple, ontology.lexicon(n).collect()))


def test_ontology_list(spark, tmp_path):
    n = read(spark, tmp_path, [{"id": "HP:1", "label": "L", "synonyms": ["s"], "def": "d"}, {"hpo_id": "HP_2", "preferred_label": "P"}, {"name": "no id"}])
    assert sorted(((r["id"], r["name"], r["definition"]) for r in n.collect()), key=str) == [("HP:1", "L", "d"), ("HP:2", "P", None)]


def test_cycle_ends(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    assert ontology.closure(e).count() == 9
    assert ontology.closure(e.limit(0)).count() == 0
    small = sorted(map(tuple, ontology.closure(e.unionByName(e.selectExpr("child parent", "'d' child"))).collect()))
    monkeypatch.setattr(ontology, "SMALL_GRAPH", -1)
    assert ontology.closure(e).count() == 9
    assert ontology.closure(e.limit(0)).count() == 0
    assert sorted(map(tuple, ontology.closure(e.unionByName(e.selectExpr("child parent", "'d' child"))).collect())) == small


def test_long_chain(spark, monkeypatch):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)], "parent string, child string")
    assert ontology.closure(e).agg(F.count("*"), F.max("steps")).first()[:] == (5050, 100)
    n = spark.createDataFrame([(f"HP:{i}",) for i in range(3)], "id string")
    p = ontology.closure(spark.createDataFrame([("HP:0", "HP:1"), ("HP:1", "HP:2")], "parent string, child string"))
    assert sorted((r["id"], r["depth"]) for r in ontology.depths(n, p, "hp_1").collect()) == [("HP:0", 0), ("HP:1", 0), ("HP:2", 1)]
    monkeypatch.setattr(ontology, "SMALL_GRAPH", -1)
    e = e.where("length(parent) = 2")
    assert ontology.closure(e).agg(F.count("*"), F.max("steps")).first()[:] == (55, 10)


def test_config(tmp_path):
    import pytest

    from termloom.sources import config

    (tmp_path / "p.txt").write_text("Ask {{mention}}\n")
    assert config.load_prompt(str(tmp_path / "p.txt")) == "Ask {{mention}}\n"
    with pytest.raises(FileNotFoundError):
        config.load_prompt(str(tmp_path / "none"))
    (tmp_path / "l.json").write_text(json.dumps({"id2label": {"0": "O", "1": "S-X"}}))
    assert config.load_labels(str(tmp_path / "l.json")) == {0: "O", 1: "S-X"}
    (tmp_path / "l.json").write_text("{}")
    assert config.load_labels(str(tmp_path / "l.json")) == config.load_labels(None) == config.LABELS


def test_annotation_lines(spark):
    rows = [("t", 0, ""), ("t", 1, "88\t115\tdecrease in fetal movements\tHP:0001558"), ("t", 2, "no line"), ("t", 3, "1 5 abc hp_0000002"), ("b", 0, "[27::42]  HP_0000110 | renal dysplasia"), ("b", 1, "88 115 x HP:0000001")]
    got = annotations.parse_lines(spark.createDataFrame(rows, "doc string, pos int, line string"))
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(1, 5, "abc", "HP:0000002"), (27, 42, "renal dysplasia", "HP:0000110"), (88, 115, "decrease in fetal movements", "HP:0001558")]


def test_corpus(spark, tmp_path):
    for d in ("ann", "corpus"):
        (tmp_path / d).mkdir()
    (tmp_path / "ann/a").write_text("0 2 ab HP:0000001\n3 5 cd HP:0000002\n")
    (tmp_path / "ann/b").write_text("[1::2] HP_0000003 | y\n")
    (tmp_path / "ann/b~").write_text("[1::2] HP_0000003 | y\n")
    (tmp_path / "ann/lost").write_text("0 1 x HP:0000001\n")
    (tmp_path / "corpus/a").write_text("ab cd ef")
    (tmp_path / "corpus/b.txt").write_text("xyz")
    c = annotations.read_corpus(spark, str(tmp_path))
    assert sorted((r["base"], r["text"][r["c0"] : r["c1"]], r["concept_id"]) for r in c.collect()) == [("a", "ab", "HP:0000001"), ("a", "cd", "HP:0000002"), ("b", "y", "HP:0000003")]
    p = annotations.span_pairs(c, 1).where("base = 'a'").orderBy("c0").collect()
    assert [(r["left_text"], tuple(r["left_span"])) for r in p] == [("ab ", (0, 2)), (" cd ", (1, 3))]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", 2, 0.5), (None, 4, 0.25)], "dataset string, n int, top1 double")
    assert "| _GLOBAL | 4 | 0.2500 |" in sinks.markdown(m, "T")
    assert json.loads(sinks.metrics_json(m))["_GLOBAL"] == {"n": 4, "top1": 0.25}
    assert {(r["tag"], r["value"]) for r in sinks.scalars(m).collect()} == {("a/n", 2), ("a/top1", 0.5), ("_GLOBAL/n", 4), ("_GLOBAL/top1", 0.25)}
    sinks.write_jsonl(m, str(tmp_path / "j"), 1, ["n"])
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    r = sinks.response(m.withColumn("e", F.when(F.col("n") > 2, "empty text")), "dataset", "n", error="e").collect()
    assert sorted(x["status"] for x in r) == [200, 400]
