"""Cross-split pairs against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from termloom.llm import overlap


def test_index_finds_all_places():
    rng = random.Random(1)
    docs = [np.array([rng.randint(1, 5) for _ in range(rng.randint(0, 30))], dtype=np.int64) for _ in range(20)]
    index = overlap.TextIndex.of(docs)
    again = overlap.TextIndex(index.symbols, index.starts, index.lengths)
    for d, t in enumerate(docs):
        assert again.text[again.offsets[d] : again.offsets[d] + len(t)].tolist() == t.tolist()
    for n in (1, 2, 4, 9):
        for _ in range(60):
            p = np.array([rng.randint(0, 5) for _ in range(n)], dtype=np.int64)
            want = sorted((d, i) for d, t in enumerate(docs) for i in range(len(t) - n + 1) if (t[i : i + n] == p).all())
            lo, hi = again.search(p, np.array([0]), np.array([n]))
            assert sorted((int(again.owner[r]), int(again.place[r])) for r in range(lo[0], hi[0])) == want
    copies = overlap.TextIndex.of([docs[3]] * 50)
    assert len(copies.symbols) <= len(docs[3]) + 2  # copies add no runs
    assert overlap.TextIndex.of([]).n == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_words():
    rng = random.Random(4)
    for top in (8, 64, 65, 200):
        rows = [([rng.randint(1, 9) for _ in range(rng.randint(0, top))], [rng.randint(1, 9) for _ in range(rng.randint(0, top))]) for _ in range(12)]
        pad = lambda xs: np.array([x + [0] * (top - len(x)) for x in xs], dtype=np.int64)
        n = lambda xs: np.array([len(x) for x in xs], dtype=np.int64)
        a, b = zip(*rows)
        assert overlap.common_words(pad(a), n(a), pad(b), n(b)).tolist() == [lcs(x, y) for x, y in rows]


def matched(evals, trains):
    """Pairs of texts of words, by the matcher and by comparing all."""
    number = {w: i + 1 for i, w in enumerate(sorted({w for t in evals for w in t}))}
    m = overlap.Matcher(overlap.TextIndex.of([np.array([number[w] for w in t], dtype=np.int64) for t in evals]))
    t, e = m.pairs([np.array([number.get(w, 0) for w in x], dtype=np.int64) for x in trains])
    want = {(i, j) for i, x in enumerate(trains) for j, y in enumerate(evals) if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * lcs(x, y) >= 4 * max(len(x), len(y), 1)}
    got = list(zip(t.tolist(), e.tolist()))
    assert len(got) == len(set(got))
    return set(got), want


@pytest.mark.parametrize("at_once", [1_000_000, 50])
def test_hard_texts(monkeypatch, at_once):
    monkeypatch.setattr(overlap, "AT_ONCE", at_once)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 30)}" for _ in range(60)]
    evals, trains = [], []
    for k in range(60):
        n = rng.choice([1, 3, 5, 9, 10, 11, 25, 60])
        t = base[:n]
        kind = k % 4
        if kind == 0:  # every fifth word differs
            u = [f"x{i}" if i % 5 == k % 5 else w for i, w in enumerate(t)]
        elif kind == 1:  # words taken out and put in at different places
            u = [x for i, w in enumerate(t) for x in (([] if i % 10 == 3 else [w]) + (["y"] if i % 10 == 8 else []))]
        elif kind == 2:
            u = edited(rng, t, 0.3)
        else:
            u = [f"w{rng.randint(0, 30)}" for _ in range(n)]
        (evals if rng.random() < 0.5 else trains).append(u)
        trains.append(t)
    got, want = matched([e for e in evals if e], trains)
    assert got == want and len(want) > 20


@pytest.mark.parametrize("n", [8, 9, 20, 300])
def test_templates(n):
    evals = [[*(f"w{i}" for i in range(9)), f"own{k}"] for k in range(n)]
    got, _ = matched(evals[:3], evals[:3])
    trains = [[*(f"w{i}" for i in range(5)), f"other{k}", *(f"w{i}" for i in range(5, 9))] for k in range(2)]
    number = {w: i + 1 for i, w in enumerate(sorted({w for t in evals for w in t}))}
    m = overlap.Matcher(overlap.TextIndex.of([np.array([number[w] for w in t], dtype=np.int64) for t in evals]))
    t, _ = m.pairs([np.array([number.get(w, 0) for w in x], dtype=np.int64) for x in trains])
    assert len(t) == 2 * n and len(got) == 9


def test_shard_is_stored():
    rows = pd.DataFrame({"k1": [1, 2, 2], "k2": [5, 6, 6], "concept": ["c"] * 3, "mention": ["m", "", ""], "text": ["a b", "é", "é"]})
    s = overlap.Shard.from_bytes(overlap.Shard.of(rows).to_bytes())
    assert s.pairs(pd.DataFrame({"k1": [7], "k2": [8], "concept": ["c"], "mention": ["n"], "text": ["a b"]})).to_numpy().tolist() == [[7, 8, 1, 5]]
    assert not len(s.pairs(pd.DataFrame({"k1": [7], "k2": [8], "concept": ["d"], "mention": ["m"], "text": ["a b"]})))


def test_slips():
    assert [overlap.slips("abcd", x, 2) for x in ("abcd", "abdc", "abd", "bacde", "xyzw", "abcdefgh")] == [0, 1, 1, 2, 3, 3]


def edited(rng, ws, share):
    out = []
    for w in ws:
        x = rng.random()
        if x < share / 2:
            continue
        out.append(w)
        if x > 1 - share / 2:
            out.append("extra")
    return out


def data(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.5:
            c, m, ws = rng.choice(base)
            ws = edited(rng, ws, rng.choice([0, 0.05, 0.1, 0.5]))
        else:
            c, m, ws = rng.choice("XXXY"), rng.choice(["cleft lip", "large ears"]), [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40, 60]))]
            base.append((c, m, ws))
        m = m if rng.random() < 0.7 else m.upper().replace(" ", " ") if rng.random() < 0.5 else m[1:]
        rows.append((i, rng.choice(["train", "train", "val", "test"]), " ".join(ws), m, c))
    return rows


def brute(rows, gold):
    out = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] in ("val", "test") and gold(a[4]) and gold(a[4]) == gold(b[4]):
                x, y = overlap.words(a[2]), overlap.words(b[2])
                if x and y and 5 * lcs(x, y) >= 4 * max(len(x), len(y)) and overlap.slips(overlap.plain(a[3]), overlap.plain(b[3]), 2) <= 2:
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs(spark):
    concepts = spark.createDataFrame([("HP:0000001", ["HP:0000009"]), ("HP:0000002", None)], "hpo_id string, alt_ids array<string>")
    spell = {"X": ["HP:0000001", "hp_0000001", "HP:0000009"], "Y": ["HP:0000002"]}
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = data(seed)
        raw = [(i, s, c, m, rng.choice(spell[g]), 1, "x") for i, s, c, m, g in rows]
        raw += [(raw[0][0], *raw[0][1:5], 2, "x"), (900, "train", rows[0][2], "m", None, 1, "x"), (901, "val", None, "m", "HP:0000001", 1, "x"), (902, "val", "", "m", "HP:0000001", 1, "x"), (903, None, "a", "m", "HP:0000001", 1, "x"), (904, "val", rows[0][2], rows[0][3], "HP:0000077", 1, "x")]
        df = spark.createDataFrame(raw, "sample_id long, split string, context string, mention string, gold_id string, loaded_at int, concept string")
        for shard, block in ((10_000, 10_000), (7, 20)):
            got = {(r[0], r[1]) for r in overlap.cross_split_pairs(df, concepts, shard, block).collect()}
            assert got == brute(rows, lambda g: g), (seed, shard)
    assert overlap.cross_split_pairs(df.limit(0), concepts).count() == 0


def test_links(spark):
    concepts = spark.createDataFrame([("HP:0000001", None)], "hpo_id string, alt_ids array<string>")
    rows = [(i, "train" if i < 40 else "val", "a b c d e f", "lip", "HP:0000001", 1) for i in range(50)] + [(90, "test", "A b, c d e f", "LIP", "HP:0000001", 1), (91, "test", "q r", "lip", "HP:0000001", 1), (92, "train", " ... ", "lip", "HP:0000001", 1)]
    df = spark.createDataFrame(rows, "sample_id long, split string, context string, mention string, gold_id string, loaded_at int")
    members, pairs = overlap.overlapping_classes(df, concepts)
    assert pairs.count() == 1
    got = {r["sample_id"]: (r["class_id"], r["links"]) for r in overlap.linked(members, pairs).collect()}
    assert got == {**{i: (0, 11) for i in range(40)}, **{i: (40, 40) for i in range(40, 50)}, 90: (40, 40), 91: (91, 0), 92: (92, 0)}
