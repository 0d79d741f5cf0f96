"""Text, protocol and span functions on small fixtures and against plain Python."""

import random
import re
import time
from datetime import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from termloom.functions import prompts, protocol, text, vectors
from termloom.operators import chunking, spans
from termloom.plans import q_text


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([Row(**values)], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'int'}" for n in names)).select(column.alias("x")).first()[0]


def lit(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_norm_and_slices(spark):
    assert one(spark, text.norm("t"), t="  A  b\n\tC ") == "a b c"
    assert one(spark, text.norm("t"), t=None) is None
    assert one(spark, text.norm_id("t"), t=" hp_0000001 ") == "HP:0000001"
    assert one(spark, text.norm_id("t"), t="  ") is None
    assert one(spark, text.strip_span("t"), t=" (a.b); ") == "a.b"
    assert one(spark, text.safe_slice("t", "a", "b"), t="😀abc", a=9, b=-3) == "😀abc"
    assert one(spark, text.safe_slice("t", "a", "b"), t="😀abc", a=3, b=1) == "ab"
    w = one(spark, text.context_window("t", "a", "b", 2), t="0123456789", a=4, b=6)
    assert (w["text"], w["c0"], w["c1"]) == ("234567", 2, 4)
    assert one(spark, text.tag("t"), t="a b/c_d") == "a_b_c_d"


def test_simple_sentences(spark):
    def split(t):
        return [(r["src"], r["c0"], r["c1"]) for r in one(spark, text.simple_sentences("t"), t=t)]

    assert [s for s, _, _ in split("Wait... is it 2.5?! Yes.")] == ["Wait.", " is it 2.", "5?", " Yes."]
    assert split("") == [] and split(" \n ") == []
    rng = random.Random(3)
    for _ in range(5):
        t = "".join(rng.choice("ab .!?\n。；😀") for _ in range(60))
        got = split(t)
        assert all(t[a:b] == s for s, a, b in got)
        want = [x for x in re.findall(text.PIECES, t) if x.strip() and not re.fullmatch("[。！？；!?;.]", x)]
        assert [s for s, _, _ in got] == want


def test_approx_tokens_like_python(spark):
    for t in ("Ab-c d, 中文。x's", "", "é ü² – ok", None):
        assert one(spark, text.approx_tokens("t"), t=t) == (chunking.approx_tokens(t.replace("²", "")) + 1 if t and "²" in t else chunking.approx_tokens(t or ""))


def test_token_windows(spark):
    for n, size, stride in ((0, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (11, 4, 2)):
        got = lit(spark, text.token_windows(F.array(*[F.lit(i) for i in range(n)]).cast("array<int>"), size, stride))
        want, s = [], 0
        while n:
            want.append((s, list(range(n))[s : s + size]))
            if s + size >= n:
                break
            s += size - stride
        assert [(r["start"], r["tokens"]) for r in got or []] == want


def test_chunks():
    assert chunking.chunk("") == []
    t = "word " * 300
    parts = chunking.chunk(t)
    assert parts[0][0] == 0 and parts[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(chunking.approx_tokens(t[a:b]) <= 100 for a, b in parts)
    t = ", ".join(f"part {i} of it" for i in range(80))
    assert all(chunking.approx_tokens(t[a:b]) <= 100 and t[:b].rstrip().endswith(",") for a, b in chunking.chunk(t)[:-1])


def test_parse_indices(spark):
    for reply, want in (("0", [0]), ("-1", []), ("2,2,9,1", [2, 1]), ("[0]", []), ("", []), ("1,,x", []), ("3,-2", [3]), ("\n0", [0]), ("\t2\u00a0\r\n", [2]), (None, [])):
        assert one(spark, protocol.parse_indices("t", F.lit(5)), t=reply) == want


def test_polarity(spark):
    for word, want in (("present\t", "present"), ("\u00a0Denied\n", "absent"), ("maybe", "uncertain"), (None, "uncertain")):
        assert one(spark, text.polarity("t"), t=word) == want
    assert one(spark, text.polarity("t", None), t=" maybe\t") == "maybe"


def test_many_pieces(spark):
    t = "ab. " * 3000
    got = one(spark, text.simple_sentences("t"), t=t)
    assert len(got) == 3000 and all(t[r["c0"] : r["c1"]] == r["src"] and r["sid"] == i for i, r in enumerate(got))
    assert len(one(spark, spans.tokens(F.col("t")), t=t)) == 6000


def test_refine_choice(spark):
    ids = F.array(F.lit("HP:0000001"), F.lit("HP:0000002"))
    for reply, want in (("INDEX: 7", 7), ("take HP:0000002", 1), ("HP:0000009 or so", 9), ("number 3", 3), ("none", None), ("index = -1", -1)):
        assert one(spark, protocol.refine_choice("t", ids), t=reply) == want


def test_protocol(spark):
    def parse(t, dialect, **o):
        return one(spark, protocol.parse_protocol("t", dialect, **o), t=t)

    r = parse("SENT_EN\tHe sat.\nHINT\tcleft lip\tdenied\tPheno\nHINT\tlow\tmaybe\t", "tab")
    assert r["ok"] and r["sentence_en"] == "He sat." and r["saw_end"]
    assert [(h["hint_en"], h["polarity"]) for h in r["hints"]][0] == ("cleft lip", "absent")
    r = parse("hint: big ears present pheno\nEN: It is so\nEND.\nHINT\ta\tyes\tb", "loose")
    assert [(h["hint_en"], h["polarity"], h["type"]) for h in r["hints"]] == [("big ears", "present", "pheno")]
    assert parse("noise\nEN\tx\nEND", "loose")["n_bad"] == 0 and parse("noise\nEN\tx\nEND", "tab")["n_bad"] == 1
    assert not parse(None, "tab")["ok"] and not parse("HINT\ta\tyes\tb", "tab")["ok"]
    assert not parse("EN\tx", "tab", repair=False)["saw_end"]
    assert parse("HINT\ta\tyes\nEN\tx\nEND", "tab")["n_bad"] == 1


def test_json(spark):
    r = one(spark, protocol.parse_json_hints("t"), t='well {"sentence_en": "s", "hints": ["a", {"hint_en": "b", "polarity": "no"}, ""]} end')
    assert r["ok"] and [(h["hint_en"], h["polarity"]) for h in r["hints"]] == [("a", "uncertain"), ("b", "absent")]
    assert not one(spark, protocol.parse_json_hints("t"), t="nothing")["ok"]


def test_bioes(spark):
    labels = F.array(*[F.lit(x) for x in "B I E O S O B O E".split()])
    assert [(r["i0"], r["i1"]) for r in lit(spark, protocol.bioes_spans(labels))] == [(0, 2), (4, 4)]
    t = "An old, very old tree fell."
    toks = one(spark, spans.tokens(F.col("t")), t=t)
    assert [(r["token"], t[r["c0"] : r["c1"]]) for r in toks] == [(x, x) for x in re.findall(r"\w+|[^\w\s]", t)]
    s = F.array(F.struct(F.lit(3).alias("c0"), F.lit(6).alias("c1")), F.struct(F.lit(8).alias("c0"), F.lit(21).alias("c1")))
    assert one(spark, spans.bioes_labels(spans.tokens(F.col("t")), s), t=t) == ["O", "S-PHENO", "O", "B-PHENO", "I-PHENO", "E-PHENO", "O", "O"]
    assert one(spark, spans.bioes_labels(spans.tokens(F.col("t")), F.expr("cast(array() as array<struct<c0:int,c1:int>>)")), t=t) == ["O"] * 8
    r = one(spark, spans.token_range(spans.tokens(F.col("t")), F.lit(3), F.lit(7)), t=t)
    assert (r["i0"], r["i1"]) == (1, 2)


def test_bioes_round_trip(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [
        (1, "old", 0, 3, at(1)), (1, "An old, very old tree.", 8, 16, at(2)),  # the later delivery
        (2, "old", 0, 3, at(1)), (2, None, 0, 3, at(2)),  # its text is gone
        (3, "a  b", 1, 2, at(1)), (4, " \n ", 0, 1, at(1)), (5, "a", 1, 1, at(1)), (6, "a", None, 1, at(1)), (None, "a", 0, 1, at(1)),
        (7, "x " * 5000, 9000, 9003, at(1)),
    ]
    spark.createDataFrame(rows, "sample_id long, context string, c0 int, c1 int, loaded_at timestamp").write.parquet(f"{tmp_path}/samples.parquet")
    df = q_text.bioes_round_trip(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 7, 3, 4, 8, 16), (3, 2, None, None, None, None), (7, 5000, 4500, 4501, 9000, 9003)]
    above, below = df._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
    assert "regexp_extract_all" in below and "regexp_extract_all" not in above and "context" not in above  # texts are not shuffled


def test_tokens_take_little_more_than_their_pattern(spark):
    d = spark.range(8000).select(F.concat(F.repeat(F.lit("An old, very old tree fell. "), 20), F.col("id").cast("string")).alias("t")).localCheckpoint()

    def seconds(c):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            d.select(c).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    # pieces that are gathered in an aggregate are copied at each step: over thirty times as long
    assert seconds(F.size(spans.tokens(F.col("t")))) < 12 * seconds(F.size(F.regexp_extract_all("t", F.lit(r"(?U)\s+|\w+|[^\w\s]"), F.lit(0))))


def test_prompts(spark):
    n = spark.createDataFrame([("HP:1", "Name", ["a", "a", " ", "b", "c", "d"], None)], "id string, name string, syn array<string>, d string")
    assert n.select(prompts.gold_text("name", "d", "syn")).first()[0] == "Name. Synonyms: a, b, c, d."
    assert n.select(prompts.tagged_text("id", "name", "syn", "d")).first()[0] == "[HPO_ID] HP:1\n[NAME] Name\n[SYN] a; b; c"
    m = spark.createDataFrame([("HP:1", None, ["a"], None, "model", "more"), ("HP:2", "N", None, "d", "d", " ")], "id string, name string, syn array<string>, d string, m string, e string").orderBy("id")
    tagged = lambda most: [r[0] for r in m.select(prompts.tagged_text("id", "name", "syn", "d", "e", most, "m")).collect()]
    assert tagged(3) == ["[HPO_ID] HP:1\n[NAME] HP:1\n[SYN] a\n[LLM_DEF] model\n[ADD_DEF] more", "[HPO_ID] HP:2\n[NAME] N\n[DEF] d"]
    assert tagged(None)[1] == "[HPO_ID] HP:2\n[NAME] N\n[DEF] d"
    r = n.select(prompts.prompt_info(F.create_map(F.lit("label"), F.array("name"), F.lit("synonym"), F.col("syn")), "id").alias("x")).first()["x"]
    assert (r["hpo_id"], r["hpo_name"], r["hpo_def"], r["hpo_synonyms"]) == ("HP:1", "Name", "", ["a", "a", "b", "c", "d"])
    assert n.select(prompts.rerank_pair("I", "name", F.col("d"))).first()[0] == "<Instruct>: I\n<Query>: Name\n<Document>: "
    assert tuple(n.select(prompts.name_span(F.lit("no such"), "name")).first()[0]) == (0, 7)
    assert one(spark, prompts.rendered("Q {{text}} {x}", text=F.col("t"), x=F.lit(1)), t="a") == "Q a 1"
    assert one(spark, prompts.rendered("Q", text=F.col("t")), t="a") == "Q\na"


def test_vectors(spark):
    a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in ((3, 4), (4, 3)))
    assert lit(spark, vectors.dot(a, b)) == 24 and abs(lit(spark, vectors.cosine(a, b)) - 0.96) < 1e-12
    assert lit(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert lit(spark, vectors.mean_pool(F.array(a, b), F.lit(0), F.lit(1))) == [3.5, 3.5]
