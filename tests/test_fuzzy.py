"""Scores against their definitions by brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.functions import fuzzy
from termloom.operators import retrieval

TEXT = st.text("ab c", max_size=12)


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_scores(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)
    for f in fuzzy.SCORERS.values():
        assert 0 <= f(a, b) <= 100 + 1e-9
    n = len(a) + len(b)
    assert fuzzy.indel_ratio(a, b) == (200 * slow_lcs(a, b) / n if n else 100)
    short, long = sorted((a, b), key=len)
    if short:
        best = max(200 * slow_lcs(short, long[i:j]) / (len(short) + j - i) for i in range(len(long)) for j in range(i + 1, min(len(long), i + len(short)) + 1))
        assert fuzzy.partial_ratio(a, b) <= best + 1e-9


@settings(max_examples=100, deadline=None)
@given(TEXT, st.lists(TEXT, min_size=1, max_size=8))
def test_all_keys_at_once(text, keys):
    assert np.allclose(fuzzy.TokenSetScorer(keys).scores(text), [fuzzy.token_set_ratio(text, k) for k in keys])


@pytest.mark.parametrize("scorer", ["partial", "weighted"])
@settings(max_examples=200, deadline=None)
@given(text=TEXT, keys=st.lists(TEXT, min_size=1, max_size=8))
def test_partial_and_weighted_at_once(scorer, text, keys):
    assert np.allclose(fuzzy.AT_ONCE[scorer](keys).scores(text), [fuzzy.SCORERS[scorer](text, k) for k in keys])


@pytest.mark.parametrize("scorer", ["partial", "weighted"])
def test_long_text_at_once(scorer):
    t, keys = "abc da " * 40, ["abc", "cab d" * 60, "x", "", "da abc"]
    for a in (t, "bca"):
        assert np.allclose(fuzzy.AT_ONCE[scorer](keys).scores(a), [fuzzy.SCORERS[scorer](a, k) for k in keys])


def test_without_limit_ties_are_by_concept(spark):
    keys = [(f"k{9 - i} ab", f"c{i}") for i in range(9)] + [("zz", "c0")]
    got = retrieval.fuzzy_top_k(spark.createDataFrame([("ab",)], "t string"), "t", spark.createDataFrame(keys, "key string, concept_id string"), 3, None, "partial")
    assert [(r["concept_id"], r["score"]) for r in got.orderBy("rank").collect()] == [("c0", 100.0), ("c1", 100.0), ("c2", 100.0)]


def test_long_text():
    t, keys = "abc " * 30, ["abc", "cab " * 40]
    assert np.allclose(fuzzy.TokenSetScorer(keys).scores(t), [fuzzy.token_set_ratio(t, k) for k in keys])


def test_known_values():
    assert fuzzy.token_set_ratio("a b", "b a c") == 100
    assert fuzzy.partial_ratio("bcd", "abcde") == 100
    assert fuzzy.weighted_ratio("", "a") == 0
    assert fuzzy.sequence_ratio("abcd", "bcde") == 75


@pytest.mark.parametrize("scorer", ["token_set", "indel"])
def test_fuzzy_top_k(spark, scorer):
    rng = random.Random(1)
    words = ["ab", "abc", "cb", "ba", "ca", "bb"]
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    keys = sorted({(phrase(), f"c{i % 7}") for i in range(30)})
    texts = sorted({phrase() for _ in range(12)})
    got = retrieval.fuzzy_top_k(spark.createDataFrame([(t,) for t in [*texts, texts[0], None, ""]], "t string"), "t", spark.createDataFrame(keys, "key string, concept_id string"), 3, 10, scorer)
    f = fuzzy.SCORERS[scorer]
    want = []
    for t in texts:
        limited = sorted({(-round(f(t, k), 6), k) for k, _ in keys})[:10]
        best = {}
        for s, k in limited:
            for kk, c in keys:
                if kk == k:
                    best[c] = min(best.get(c, 0), s)
        want += [(t, c, -s, r) for r, (s, c) in enumerate(sorted((s, c) for c, s in best.items())[:3])]
    assert sorted((r["text"], r["concept_id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
