import math
import random

import numpy as np

from logquarry.llm import language_id as li

R = random.Random(5)
WORDS = {k: ["".join(R.choice(a) for _ in range(R.randrange(2, 8))) for _ in range(80)] for k, a in {"aa": "abcdeé", "bb": "bcdefß", "cc": "aeioumn"}.items()}


def say(lang, n=60):
    return " ".join(R.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def greedy(sample, text, size=li.PIECE):
    n = 0
    for p in range(0, len(text), size):
        piece, i = text[p : p + size], 0
        while i < len(piece):
            j = i + 1
            while j < len(piece) and piece[i : j + 1] in sample:
                j += 1
            i, n = j, n + 1
    return n


def test_automaton_parse_equals_greedy_search():
    samples = {k: " ".join(say(k) for _ in range(5)) for k in WORDS}
    p = li.Parser(samples)
    texts = [p.symbols(t.lower()) for t in [say("aa"), say("bb", 400), "x", "zz abc zz", say("cc") + say("aa")]]
    as_text = lambda s: "".join(chr(65 + c) for c in s)
    count, lack = p.phrases(texts)
    got = count + lack
    for j, k in enumerate(p.languages):
        sample = as_text(p.symbols(samples[k].lower()))
        assert [greedy(sample, as_text(t)) for t in texts] == got[:, j].tolist()


def test_language_and_score_equal_a_plain_computation():
    samples = {"aa": say("aa", 900), "bb": say("bb", 300), "cc": say("cc", 40), "dd": "1 2", "ee": "q"}
    texts = [say(k, n) for k in WORDS for n in (1, 3, 40, 500)] + ["qqq", "Zz abc ñ", "x", "12", None]
    p = li.Parser(samples)
    known = {k: p.symbols(samples[k].lower()).tolist() for k in ("aa", "bb", "cc", "ee")}
    width = {k: math.log2(max(4096, len(s))) for k, s in known.items()}
    for text, (lang, score, bits) in zip(texts, p.judge(texts), strict=True):
        s = p.symbols((text or "").lower()).tolist()
        if not any(s):
            assert (lang, score, bits) == ("und", 0.0, 0.0)
            continue
        cost = {}
        for k, sample in known.items():
            whole = "".join(map(chr, sample))
            lacks = sum(c not in sample for c in s)
            phrases = greedy(whole, "".join(map(chr, s)))
            cost[k] = (phrases - lacks) * width[k] + lacks * (max(width.values()) + math.log2(p.alphabet))
        best = min(cost, key=lambda k: (cost[k], k))
        assert lang == best and abs(score - 1 / sum(2 ** ((cost[best] - c) * li.TEMPER) for c in cost.values())) < 1e-9


def test_a_label_of_one_tiny_or_letterless_text_takes_nothing(spark):
    rows = [(i, say(k := R.choice(list(WORDS))), k) for i in range(200)]
    for odd in ("123", "hello.", "a", "é b"):
        labelled = spark.createDataFrame([*rows, (900, odd, "zz")], "doc_id long, text string, lang string")
        p = li.Parser(li.samples_of(labelled, "doc_id", "text", "lang"))
        told = [(say(k, n), k) for k in WORDS for n in (8, 60) for _ in range(30)]
        assert np.mean([x[0] == k for x, (_, k) in zip(p.judge([t for t, _ in told]), told, strict=True)]) >= 0.98
        assert ("zz" in p.languages) == (odd != "123")


def test_columns_with_odd_names_and_a_text_named_as_an_added_one(spark):
    df = spark.createDataFrame([(1, say("aa"), 7), (1, say("aa"), 7)], "doc_id long, score string, `a-b c` long")
    got = li.identify(spark, df.selectExpr("doc_id", "score", "struct(`a-b c`) as `x y`"), "score", {k: say(k, 300) for k in WORDS}).collect()
    assert [(r["x y"]["a-b c"], r.lang_pred) for r in got] == [(7, "aa")] * 2 and all(isinstance(r.score, float) for r in got)


def test_frame(spark):
    rows = [(i, say(k := R.choice(list(WORDS))), k, 0.5) for i in range(300)]
    rows += [(900, None, "aa", 0.1), (901, "", None, 0.1), (902, "12 -- 3!", "bb", 0.1), (903, say("aa", 5000), None, 0.1), (903, say("cc"), None, 0.1), (None, say("bb"), None, 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    samples = li.samples_of(df.where(~li.held_out("doc_id")), "doc_id", "text", "lang")
    got = li.identify(spark, df, "text", samples).collect()
    assert len(got) == len(rows)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    assert np.mean([r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 900]) > 0.98
    assert [r.lang_pred for r in got if r.doc_id == 903] == ["aa", "cc"]
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert li.samples_of(df, "doc_id", "text", "lang") == {}
    assert li.identify(spark, df, "text", {}).first().lang_pred == "und"
    assert li.identify(spark, df.limit(0), "text", {}).count() == 0


def test_every_language_is_learned_and_large_alphabets_are_told_apart(spark):
    r = random.Random(3)
    rows = []
    for k in range(100):
        words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)]
        rows += [(f"l{k:02}", " ".join(r.choice(words) for _ in range(40))) for _ in range(4)]
    for k, lo, n in (("zh", 0x4E00, 3000), ("ko", 0xAC00, 150), ("hi", 0x20000, 150)):
        words = ["".join(chr(lo + r.randrange(n)) for _ in range(4)) for _ in range(30 if n < 3000 else 700)]
        rows += [(k, " ".join(r.choice(words) for _ in range(30 if n < 3000 else 400))) for _ in range(4)]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string")
    samples = li.samples_of(df, "doc_id", "text", "lang")
    assert len(samples) == 103
    assert [x[0] for x in li.Parser(samples).judge([t for _, t in rows])] == [k for k, _ in rows]


def test_long_texts_are_sampled_all_over(spark):
    df = spark.createDataFrame([(1, "a" * 9000 + "b" * 9000 + "c" * 9000, "x")], "doc_id long, text string, lang string")
    assert set("abc") <= set(li.samples_of(df, "doc_id", "text", "lang")["x"])
