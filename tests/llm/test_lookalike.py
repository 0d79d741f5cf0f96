"""Canonical forms: the distributed operator, its one-machine twin, and cases."""

import random
import unicodedata

from termloom.llm import chars, lookalike

SAME = [
    ("Congenital atrophy", "Cοngenitаl atr​ophy"), ("full", "ｆｕｌｌ"), ("ṩ", "ṩ"), ("fist", "ﬁﬆ"), ("カガ", "ｶｶﾞ"), ("a-b", "a‑b"), ("K Ω μ", "K Ω µ"),
    ("生", "⽣"), ("éx", "éx"), ("soft", "so­ft"), ("12", "１２"), ("ئا", "ﯪ"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("2", "²"), ("o", "ø"), ("ss", "ß"), ("α", "a"), ("n", "ñ"), ("a b", "ab"), ("β", "ß")]


def test_pairs():
    for a, b in SAME:
        assert chars.canonical(a) == chars.canonical(b), (a, b)
    for a, b in DIFFERENT:
        assert chars.canonical(a) != chars.canonical(b), (a, b)


def test_stable():
    for cp in list(chars.table()):
        once = chars.canonical(chr(cp))
        assert chars.canonical(once) == once


def test_spark_gives_the_same(spark):
    rng = random.Random(4)
    pool = [chr(c) for c in chars.table()] + list("abc \n") * 200 + ["̣", "̇", "́", "‍", "ั", "่", "゙", "가", "ᄀ", "ᅡ", "中", "😀"] * 60
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(600)] + [x for p in SAME + DIFFERENT for x in p] + ["", "​", "x" * 30_000 + "ﬁ"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, texts[0], None])], "i int, t string, form0 string")
    got = {r["i"]: r["f"] for r in lookalike.with_forms(df, "t", "f").collect()}
    assert got.pop(len(texts) + 1) is None and len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i] == chars.canonical(t), ascii(t)
        assert unicodedata.normalize("NFC", got[i]) == got[i]


def test_disguised(spark, tmp_path):
    spark.createDataFrame([("HP:1", "Wet ear", ["Éar β", None])], "hpo_id string, hpo_name string, hpo_synonyms array<string>").write.parquet(str(tmp_path / "concepts.parquet"))
    m = [(1, "Wet ear", 1), (2, "Wet ear", 1), (3, "wet ear", 1), (4, "Éar β", 1), (5, None, 1), (6, "", 1), (7, "other", 1), (7, "Wet еar", 2)]
    spark.createDataFrame(m, "sample_id long, mention string, loaded_at long").write.parquet(str(tmp_path / "samples.parquet"))
    q = [(1, " a b ", 1), (2, "a b", 1), (3, "a b", 1), (4, "A b", 1), (5, "  ", 1), (6, None, 1), (7, "​", 1), (8, "c", 1), (8, "c", 2)]
    spark.createDataFrame(q, "req_id long, src string, loaded_at long").write.parquet(str(tmp_path / "requests.parquet"))
    got = sorted((r["field"], r["row_id"]) for r in lookalike.disguised(spark, str(tmp_path)).collect())
    assert got == [("mention", 1), ("mention", 4), ("mention", 7), ("src", 1), ("src", 2), ("src", 3)]
