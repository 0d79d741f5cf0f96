"""Shared spans against brute force."""

import random

import numpy as np
import pytest

from termloom.llm import spans


def brute(docs, size):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - size + 1):
            seen.setdefault(t[i : i + size], set()).add(d)
    out = []
    for d, t in docs:
        cover = None
        for i in range(len(t or "") - size + 1):
            if len(seen[t[i : i + size]]) > 1:
                if cover and i <= cover[1]:
                    cover[1] = i + size
                else:
                    cover = [i, i + size]
                    out.append((d, cover))
    return sorted({(d, *c) for d, c in out})


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcd é😀") for _ in range(rng.randint(10, 70))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))), p[a : a + rng.randint(5, 70)]]
        docs.append((i, "".join(parts)))
    return docs + [(1000, None), (1001, ""), (1002, "a" * 90), (1003, "b" + "a" * 50), (1004, docs[3][1])]


def test_against_brute_force(spark):
    for seed, batches, fan_in, crowd in ((1, 1, 4, 4096), (2, 5, 2, 4096), (3, 2, 4, 2)):
        spans.MOST_TOGETHER = crowd
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, fp string")
        got = sorted(tuple(r) for r in spans.shared_spans(df, "doc_id", "text", 20, batches, fan_in).collect())
        assert got == brute(docs, 20), (seed, batches)
    spans.MOST_TOGETHER = 4096


def test_many_copies_and_empty(spark):
    docs = [(i, "the very same passage stands here " * 2 + str(i % 3)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in spans.shared_spans(df, "doc_id", "text", 20).collect())
    assert got == brute(docs, 20)
    assert spans.shared_spans(df.limit(0), "doc_id", "text", 20).count() == 0


@pytest.mark.parametrize("fan_in", [2, 4])
def test_index_is_kept_and_opened_again(spark, tmp_path, fan_in):
    rng = random.Random(3)
    batches = [[(rng.randint(1, 40), 100 * b + rng.randint(0, 9), 0) for _ in range(30)] for b in range(5)]
    path = f"file://{tmp_path}/index"
    seen = {}
    for b, rows in enumerate(batches):
        index = spans.FingerprintIndex(spark, path, fan_in=fan_in, buckets=3)  # each delivery by another session
        for _, name in index.runs:
            spark.sql(f"drop table if exists {index._name(name)}")
        got = {r["fp"] for r in index.add(spark.createDataFrame(rows, spans.PRINTS)).collect()}
        for fp, i, _ in rows:
            seen.setdefault(fp, set()).add(i)
        assert got == {fp for fp, _, _ in rows if len(seen[fp]) > 1}, b
    index = spans.FingerprintIndex(spark, path)
    assert sorted(level for level, _ in index.runs) == [0, 2 if fan_in == 2 else 1] and index.buckets == 3  # five batches: one run of four, one of one
    assert index.entries().count() == 150
    old = {}
    for rows in batches[:4]:
        for fp, i, _ in rows:
            old.setdefault(fp, []).append(i)
    merged = max(index.runs)[1]
    assert sorted(map(tuple, index.run(merged).collect())) == sorted((fp, min(x), max(x)) for fp, x in old.items())
    assert len(list((tmp_path / "index" / merged).glob("*.parquet"))) == 3
    # history is neither shuffled nor sorted again
    with spans.ordered_buckets(spark):
        plan = index.joined(index.run(min(index.runs)[1]), [merged])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_winnowing_reaches_every_span():
    rng = random.Random(7)
    k, w = 10, 11
    for _ in range(50):
        common = "".join(rng.choice("ab") for _ in range(k + w - 1))
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + common + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        owner, _, fp = spans.winnow([a, b], k, w)
        assert set(fp[owner == 0]) & set(fp[owner == 1])
    h = spans.window_hashes(spans.codes("abcabc"), 3)
    assert h[0] == h[3] and len(np.unique(h)) == 3
