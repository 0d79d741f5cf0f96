"""Pieces keep the limits, cover the text and end at boundaries."""

from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import splitting


@settings(max_examples=300, deadline=None)
@given(st.text("ab .,\n。é", max_size=300), st.integers(2, 40), st.data())
def test_limits(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    parts = splitting.split_text(text, size, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b - a <= size for a, b, _ in parts)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(parts, parts[1:]))
    places = set(splitting.boundaries(text)[0])
    for (a, b, hard), after in zip(parts, parts[1:]):
        assert hard == (b not in places)
        if hard:  # then no boundary was in reach
            earlier = a + overlap if a else 0
            assert not any(earlier < p <= min(a + size, len(text) - 1) and p - overlap > a for p in places) or overlap


def test_forced_only_for_long_runs():
    words = "word " * 400
    assert not any(h for _, _, h in splitting.split_text(words, 100, 8)) and not splitting.has_long_run(words, 100)
    run = "x" * 101
    assert splitting.has_long_run(run, 100) and not splitting.has_long_run("x" * 100 + " y", 100) and not splitting.has_long_run("x" * 60 + "。" + "x" * 60, 100)
    assert any(h for _, _, h in splitting.split_text(run + " end", 100, 8))


def test_strong_boundary_wins():
    t = "a" * 45 + ". " + "b" * 10 + " " + "c" * 50
    assert splitting.split_text(t, 80, 0)[0][1] == 47


def test_balanced():
    sizes = [b - a for a, b, _ in splitting.split_text("ab " * 400, 1000, 80)]
    assert len(sizes) == 2 and abs(sizes[0] - sizes[1]) <= 6


def test_frame(spark):
    rows = [(1, "ab " * 40, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (None, "z" * 90, "x")]
    df = spark.createDataFrame(rows, "k long, t string, piece string")
    got = splitting.split_items(df, "k", "t", 50, 5).collect()
    assert {r["k"] for r in got} == {1, None} and all(len(r["text"]) <= 50 for r in got)
    assert {r["k"]: r["forced"] for r in got} == {1: 0, None: 1}
    assert splitting.split_items(df.limit(0), "k", "t", 50, 5).count() == 0
