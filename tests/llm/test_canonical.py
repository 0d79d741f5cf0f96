"""Typed values: the join against brute force, readings, and whole cases."""

import random

import pytest

from termloom.llm import canonical as c

NAMES = [("1", "Congenital atrophy of the vrelpecrus"), ("1", "Congenital vrelpecric atrophy"), ("2", "Hyperplasia of the glomasmum"), ("2", "Glomasmal hyperplasia"), ("3", "Atrophy of the vrelpecrus"), ("4", "High β-drimglozase"), ("5", "High α-drimglozase"), ("6", "Shaking glomasmum"), ("7", "Hypoplasia of the vrelpecrus")]
CASES = {
    "congenital ATROPHY of the vrelpecrus": "1", "Vrelpecrus, congenital atrophy": "1", "marked congenital atrofy of vrelpecrus, noted today": "1", "congenital vrelpecricatrophy": "1", "congenital vrelpecr. atroph.": "1", "congenital atrophies (vrelpecrus)": "1",
    "glomasmum - hyperplasia": "2", "? hyperplasias of glomasmum": "2", "glomasmum hyperpalsia": "2", "hypoplasia of the glomasmum": "UNMATCHED", "hyperplasia of the vrelpecrus": "UNMATCHED", "atrophy_of_the_vrelpecrus": "3", "аtrорhy of the vrel­pecrus": "3",
    "HIGH Β-DRIMGLOZASE": "4", "high α-drimglozase": "5", "high γ-drimglozase": "UNMATCHED", "vrelpecrus": "UNMATCHED", "Unchanged": "UNMATCHED", "-": "UNMATCHED", "": "UNMATCHED", "   ": "UNMATCHED", "shaking glomasmum (severe)": "6", "symmetric atrophy of the vrelpecrus": "UNMATCHED",
    "x" * 5000: "UNMATCHED", "tremor " * 2000: "UNMATCHED",
}


def test_cases(spark):
    values = spark.createDataFrame([(v, "x") for v in [*CASES, *list(CASES)[:3], None]], "value string, phrase string")
    names = spark.createDataFrame([*NAMES, NAMES[0], (None, "nothing"), ("8", None)], "entry_id string, name string")
    got = {r["value"]: r["entry_id"] for r in c.best_entries(values, names).collect()}
    assert got == CASES
    assert c.best_entries(values.limit(0), names).count() == 0
    assert {r["entry_id"] for r in c.best_entries(values, names.limit(0)).collect()} == {"UNMATCHED"}


def test_join_is_exact():
    rng = random.Random(2)
    make = lambda: sorted({"".join(rng.choice("abc") for _ in range(2)) for _ in range(rng.randint(0, 9))})
    entries, values = [make() for _ in range(60)], [make() + ["zz"] * rng.randint(0, 1) for _ in range(60)]
    rarity = {g: sum(g in x for x in entries + values) for x in entries for g in x}
    for t in (0.3, 0.5, 0.8):
        v, e, j = c.PrefixIndex(entries, rarity, t).join(values)
        want = {}
        for i, x in enumerate(values):
            for k, y in enumerate(entries):
                n = len(set(x) & set(y))
                if n and n / len(set(x) | set(y)) >= t - 1e-9:
                    want[i, k] = n / len(set(x) | set(y))
        got = {(int(a), int(b)): float(s) for a, b, s in zip(v, e, j)}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_frequent_word_is_its_own(spark):
    values = spark.createDataFrame([(f"hyperplasia of the glomasnum {'' if i % 2 else '.'}".strip(),) for i in range(40)] + [("hyperplasia of the glomasmum",)] * 40, "value string")
    got = {r["entry_id"] for r in c.best_entries(values, spark.createDataFrame(NAMES, "entry_id string, name string")).where("value like '%glomasnum%'").collect()}
    assert got == {"UNMATCHED"}


@pytest.mark.parametrize("copies", [1, 6, 1000])
def test_copies_of_a_slip_are_no_evidence(spark, copies):
    slips = {"hyperplasia of the glomasnum": "2", "Shaking of the glomasnum": "6", "congenital atrofy of the vrelpecrus": "1"}
    right = ["hyperplasia of the glomasmum", "shaking glomasmum", "glomasmum, shaking", "atrophy of the vrelpecrus"]
    values = spark.createDataFrame([(v,) for v in slips for _ in range(copies)] + [(v,) for v in right], "value string")
    names = spark.createDataFrame(NAMES, "entry_id string, name string")
    got = {r["value"]: r["entry_id"] for r in c.best_entries(values, names).collect()}
    assert {v: got[v] for v in slips} == slips
    alone = values.where("value like 'hyper%snum'").unionAll(values.selectExpr("upper(value)").where("value like 'hyper%snum'"))
    assert {r["entry_id"] for r in c.best_entries(alone, names).collect()} == {"2"}


def test_chunks(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 2)
    values = spark.createDataFrame([(v,) for v in CASES], "value string")
    got = {r["value"]: r["entry_id"] for r in c.best_entries(values, spark.createDataFrame(NAMES, "entry_id string, name string")).collect()}
    assert got == CASES
