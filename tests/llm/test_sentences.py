"""Sentence units on written cases; the model is trained on them without their boundaries."""

from termloom.llm import sentences as s

CASES = [
    ["Dr. Aster of Mevird Ward saw Fig. 4 and noted approx. 9.5 mg.", "It fell from 7.1 to 6.2 points."],
    ["The nurse wrote: \"It is warm. It measures 4.1 mm.\" and ordered rest on March 9.", "Was it better?", "pH was 7.1 at noon."],
    ["Doses were given b.i.d. by the team, i.e. 4 mg vs. 5 mg before.", "The boy kept rest, etc.", "Then he went."],
    ["« Le bras est froid. Il mesure 4 mm. », a écrit Mme Roux.", "M. Roux a noté, p. ex. à la fig. 2, une raideur."],
    ["Seit dem 2. Mai nahm er z. B. Tee (4,5 ml).", "Lt. Dr. Kern sind es ca. 5 ml, d. h. mehr als in Abb. 5 bzw. Nr. 7."],
    ["Проф. Зорин отметил (см. рис. 7) отёк.", "К 3 мая 2031 г. он спал.", "«Рука тёплая. Её размер 4 мл.» — записала сестра."],
    ["护士说：“手很冷。现在有4.5毫米。”随后患儿服用了8毫克。", "他好了吗？", "出生第5周，患儿的手……仍有水肿。"],
    ["看護師は「手が冷たい。今は4.5です。」と話した。", "彼は治ったのか？"],
    ["डॉ. वेलुनर ने दवा दी।", "नर्स ने कहा, \"पलक गंभीर है। माप 8 है।\" और लौट गई।"],
    ["ذكر د. كورفين أن المعصم مزمن.", "هل كانت رجفة؟"],
    ["แพทย์พบการสั่นบริเวณข้อมือ 42 ตำแหน่งในวันที่ 152 หลังให้ยา 497 ซม.", "มารดาแจ้งว่าเด็กมีการบวมมา 20 วันในวันที่ 3"],
]
JOIN = {6: "", 7: ""}


def text_of(i):
    return JOIN.get(i, " ").join(CASES[i])


def test_units():
    m = s.train([text_of(i) for i in range(len(CASES))] * 3)
    for i, want in enumerate(CASES):
        t = text_of(i)
        assert [t[a:b] for a, b in m.units(t)] == want


def test_layout():
    m = s.train([text_of(i) for i in range(len(CASES))] * 3)
    t = "  Findings:\n\n1. Red eye\n2. Big ear\n• Toe\n\nThe child was\nseen today. He slept\n \nPlan\n\n"
    assert [t[a:b] for a, b in m.units(t)] == ["Findings:", "1. Red eye", "2. Big ear", "• Toe", "The child was\nseen today.", "He slept", "Plan"]
    for blank in ("", " \n\n "):
        assert m.units(blank) == []
    long = "One is here. " * 3000
    assert len(m.units(long)) == 3000
    assert m.units("x" * 20_000) == [(0, 20_000)]


def test_viterbi_is_the_best():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(1, 7)
        e, places = [rng.uniform(-2, 2) for _ in range(n)], sorted(rng.sample(range(1, 90), n))
        pair = {(a, b, r): rng.uniform(-1, 1) for a in (False, True) for b in (False, True) for r in "1234"}

        def score(tags):
            total, before, prev = 0.0, True, 0
            for x, p, tag in zip(e, places, tags):
                total += x * tag + pair[before, tag, s.reach(p - prev)]
                before, prev = tag, p
            return total

        best = max(score(t) for t in itertools.product((False, True), repeat=n))
        assert abs(score(s.decode(e, places, 0, pair)) - best) < 1e-9


def test_frame(spark):
    rows = [(i, text_of(i % len(CASES)), "x") for i in range(40)] + [(90, None, "x"), (91, " \n", "x"), (92, "", "x")]
    df = spark.createDataFrame(rows, "req_id long, src string, sid string")
    got = {}
    for r in s.sentence_units(df, "req_id", "src").orderBy("req_id", "sid").collect():
        got.setdefault(r["req_id"], []).append(rows[r["req_id"]][1][r["c0"] : r["c1"]])
        assert r["sid"] == len(got[r["req_id"]]) - 1
    assert all(got[i] == CASES[i % len(CASES)] for i in range(40)) and len(got) == 40
    assert s.sentence_units(df.limit(0), "req_id", "src").count() == 0
