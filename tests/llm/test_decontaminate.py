import random
import re

from logquarry.llm import decontaminate as d


def brute(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w, hit, found = word.findall(low(text)), set(), set()
    for name, t in items:
        v = word.findall(low(t))
        for i in range(max(1, len(v) - 12)) if v else ():
            g = v[i : i + 13]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def cases():
    r = random.Random(3)
    v = ["Ab", "b", "É", "ccc", "7", "ß"]
    say = lambda n: "".join(r.choice(v) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(12)] + [(50, None), (51, "...")]
    docs = [(i, "".join(r.choice([say(20), items[r.randrange(12)][1] or ""]) for _ in range(4))) for i in range(40)]
    return docs + [(90, None), (91, ""), (92, "b"), (92, "b")], items


def test_frame_equals_brute_force_in_one_block_and_in_several(spark):
    docs, items = cases()
    df = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    for size in (1 << 20, 60):
        got = d.judged(d.find_passages(spark, df, "doc_id", "text", bench, block_bytes=size)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_offsets_of_the_original():
    text = "Wörter: ÜBER A-b c! 1 2 3 4 5 6 7 8 9 10 end"
    block = d.Block([("1", "a b c 1 2 3 4 5 6 7 8 9 10".encode())])
    spans, items = block.hits(d.words_of(text.encode()))
    assert [text[s:e] for s, e in d.char_spans(text.encode(), d.merged(spans))] == ["A-b c! 1 2 3 4 5 6 7 8 9 10"] and items == {"1"}


def test_one_item_larger_than_a_segment_and_a_large_benchmark(spark):
    """An item of 60,000 words, cut into segments and blocks, and 20,000 further items: every window is still found."""
    r = random.Random(5)
    w = [f"w{r.randrange(20_000)}" for _ in range(60_000)]
    items = [(1, " ".join(w))] + [(2 + i, " ".join(f"v{r.randrange(5000)}" for _ in range(20))) for i in range(20_000)]
    cuts = [0, d.SEGMENT_WORDS - 6, d.SEGMENT_WORDS - 12, 2 * d.SEGMENT_WORDS - 1, 60_000 - 13, 777]
    docs = [(i, " ".join(["x"] + w[c : c + 13] + ["y"] * i)) for i, c in enumerate(cuts)] + [(10, " ".join(w[5:17])), (11, items[400][1]), (12, " ".join(w))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(i, len(t.split()), 13) for i, t in docs[:6]] + [(10, 12, 0), (11, 20, 20), (12, 60_000, 60_000)]
    for size in (d.BLOCK_BYTES, 200_000):
        got = d.judged(d.find_passages(spark, df.coalesce(2), "doc_id", "text", bench, block_bytes=size)).orderBy("doc_id").collect()
        assert [(r.doc_id, r.n_words, r.n_hit) for r in got] == want
        assert got[7]["items"] == ["401"] and got[8]["items"] == ["1"]


def test_struct_ids_with_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "`a-b` long, text string").selectExpr("struct(`a-b`, `a-b` as `c d`) as `x y`", "text")
    bench = spark.createDataFrame([(None, "b")], "item_id long, text string")
    got = d.judged(d.find_passages(spark, df, "x y", "text", bench)).orderBy("n_words").collect()
    assert [(r["x y"]["c d"], r.n_hit, r["items"]) for r in got] == [(2, 0, []), (1, 1, [""])]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.find_passages(spark, df, "doc_id", "text", bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.judged(d.find_passages(spark, one, "doc_id", "text", bench)).first().contaminated is False
