"""Containers and mixtures: constraints hold, results are near the optimum."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import mixing, packing, tokens


def check(sizes, capacity):
    bins = packing.bin_completion(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= len(packing.best_fit_decreasing(sizes, capacity))
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=9))
def test_optimal_on_small_sets(sizes):
    n = check(sizes, 20)

    def fits(k):
        return any(all(sum(s for s, b in zip(sizes, a) if b == j) <= 20 for j in range(k)) for a in itertools.product(range(k), repeat=len(sizes)))

    if sizes and len(sizes) <= 6:
        assert n == next(k for k in range(1, len(sizes) + 1) if fits(k))


def test_beats_best_fit():
    # best-fit decreasing takes three containers, two are enough
    assert len(packing.best_fit_decreasing([6, 5, 5, 4, 4, 3, 3], 15)) >= check([6, 5, 5, 4, 4, 3, 3], 15) == 2
    rng = random.Random(1)
    check([rng.randint(1, 2047) for _ in range(500)], 2048)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 10, 700, 2048, 5000, rng.randint(1, 2000)]), "x") for i in range(400)] + [(None, 5, "x"), (900, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, tokens int, container string")
    got = packing.pack(df, "doc_id", "tokens", 2048, block=50).collect()
    used, parts = {}, {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["t1"] - r["t0"]
        parts.setdefault(r["doc_id"], []).append((r["t0"], r["t1"]))
    assert max(used.values()) <= 2048
    for d, n, _ in rows[:400]:
        p = sorted(parts[d])
        assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:])) and (n <= 2048) == (len(p) == 1)
    assert set(parts) == set(range(400))
    together = sum(n // 2048 for _, n, _ in rows[:400]) + len(packing.best_fit_decreasing([n % 2048 for _, n, _ in rows[:400]], 2048))
    assert len(used) <= 1.03 * together + 1
    assert packing.pack(df.limit(0), "doc_id", "tokens", 2048).count() == 0


def test_flight_keeps_the_sums():
    rng = random.Random(3)
    s = [float(rng.randint(1, 900)) for _ in range(300)]
    p = [rng.random() for _ in s]
    q = mixing.flight(p, s, rng)
    assert sum(1 for x in q if 0 < x < 1) <= 2
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, s)) - sum(a * b for a, b in zip(p, s))) < 1e-4
    mean = [0.0] * 5
    for t in range(3000):
        for i, x in enumerate(mixing.flight([0.3, 0.5, 0.2, 0.7, 0.3], [1.0, 2.0, 3.0, 4.0, 5.0], random.Random(t))):
            mean[i] += x / 3000
    assert all(abs(a - b) < 0.03 for a, b in zip(mean, [0.3, 0.5, 0.2, 0.7, 0.3]))
    assert mixing.flight([], [], rng) == []


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 8 + ["b"] * 3 + ["c"]), rng.randint(50, 400), "x") for i in range(3000)] + [(5000, None, 10, "x"), (5001, "a", 0, "x"), (5002, "zz", 10, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int, copies string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    used = {}
    for r in mixing.mix(df, t, block=200).collect():
        assert 1 <= r["copies"] <= {"a": 2, "b": 2, "c": 3}[r["source"]]
        used[r["source"]] = used.get(r["source"], 0) + r["copies"] * r["tokens"]
    total = sum(used.values())
    assert all(abs(used[s] / total - w) < 0.002 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    whole = {s: sum(n for _, x, n, _ in rows if x == s) for s in "abc"}
    assert total > 0.98 * min(whole["a"] * 2 / 0.5, whole["b"] * 2 / 0.3, whole["c"] * 3 / 0.2)
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t.limit(0)).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("two words",), ("",), (None,), ("中文" * 20_000,)], "t string")
    n = [r[0] for r in df.select(tokens.token_count(df["t"], tokens.TOKENIZER)).collect()]
    assert n[:3] == [2, 0, 0] and n[3] > 20_000
