import random
import re
from itertools import combinations

import pytest

import corpus_pipeline as cp
from logquarry.llm import language_id, packing

R = random.Random(9)
WORDS = {k: ["".join(R.choice(a) for _ in range(R.randrange(3, 8))) for _ in range(300)] for k, a in {"aa": "abcdeghi", "bb": "klmnopqrs"}.items()}


def say(lang, n):
    return " ".join(R.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    items = [(i, say("aa", 30)) for i in range(5)] + [(9, None)]
    passage = say("aa", 60)
    rows = []
    for i in range(120):
        lang = R.choice(["aa", "bb"])
        rows.append((i, "\n".join(say(lang, R.randrange(5, 40)) for _ in range(R.randrange(1, 6))), lang))
    rows += [(200 + i, f"{say('aa', 20)}\n{passage}\n{say('aa', 20)}", "aa") for i in range(6)]
    rows += [(300, rows[3][1], "aa"), (301, rows[3][1], "aa"), (302, items[2][1], "aa"), (303, f"{say('aa', 50)} {items[1][1]}", None)]
    rows += [(310 + i, " ".join(x if j != 7 * i else "zz" for j, x in enumerate(passage.split()[:40])), "aa") for i in range(5)]
    rows += [(400, None, "aa"), (401, "", None), (402, "12 34 !", "bb"), (403, say("bb", 6000), "bb")]
    docs = spark.createDataFrame([(*r, "s", None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def brute(spark, d, rows, items):
    """The documents that stay and their texts, stage by stage."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    parser = language_id.Parser(language_id.samples_of(docs.where(~language_id.held_out("doc_id")), "doc_id", "text", "lang"))
    judged = parser.judge([r[1] for r in rows])
    kept = {r[0]: r[1] for r, (lang, _, _) in zip(rows, judged, strict=True) if lang != "und"}
    seen, texts = set(), {}
    for i in sorted(kept):
        lines, gone = kept[i].split("\n"), set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= 50 and run in seen:
                    gone |= set(range(a, b + 1))
                seen.add(run)
        text = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        if not gone or text.split():
            texts[i] = text
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.lower().split())}
    drop = {}
    for i, j in combinations(sorted(sets), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            drop.setdefault(j, drop.get(i, i))
    texts = {i: t for i, t in texts.items() if i not in drop}
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [word.findall((t or "").lower())] if w for k in range(max(1, len(w) - 12))}
    out = {}
    for i, t in texts.items():
        w, hit = word.findall(t.lower()), set()
        for g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
        if not hit or 20 * len(hit) < len(w):
            out[i] = t
    return out


def test_equals_brute_force(spark, folder):
    d, rows, items = folder
    want = brute(spark, d, rows, items)
    got = cp.run(spark, d).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len(t.split()) + 1 for i, t in want.items()}
    lots = packing.best_fit(sorted((r.n_tokens for r in got), reverse=True))
    assert sum({r.bin_id: r.bin_size for r in got}.values()) == sum(s for s, _ in lots)
    assert not {300, 301, 302, 303, 400, 401, 402} & set(want) and {0, 200, 403} <= set(want)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.dtypes == docs.dtypes
        docs = out


def test_repeated_and_null_ids(spark, folder):
    text = say("aa", 30)
    rows = [(1, text), (1, text), (None, text), (2, say("bb", 30)), (2, say("aa", 30))]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_copies(spark, docs, folder[0])
    assert out.count() == 3 and out.where("doc_id = 2").count() == 2
    hit = spark.read.parquet(f"{folder[0]}/benchmark.parquet").where("item_id = 2").first().text
    more = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(1, hit, None, None, None), (None, hit, "aa", None, 1), (None, "- 7", "aa", "s", 3), (None, None, None, None, None)], docs.schema))
    assert cp.known_language(spark, more, folder[0]).count() == 7
    lines = cp.repeated_lines(spark, more, folder[0])
    assert lines.dtypes == more.dtypes and lines.count() == 9
    clean = cp.benchmark_passages(spark, more, folder[0])
    assert clean.count() == 7 and clean.where("doc_id is null").count() == 3
    assert cp.sequences(spark, clean, folder[0]).count() == 6


def test_extra_columns_with_names_of_the_operators_stay(spark, folder):
    names = ["a-b", "a b", "__row", "row_number_0", "row", "id", "raw", "score", "lang_pred", "uid", "runs", "n", "key", "starts", "items", "kept", "component_id"]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    docs = docs.select(*docs.columns, *((docs.doc_id * 10 + i).alias(c) for i, c in enumerate(names)))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
    got = docs.collect()
    assert len(got) > 50 and all(r[c] == r.doc_id * 10 + i for r in got for i, c in enumerate(names))
    assert cp.STAGES[-1][1](spark, docs, folder[0]).count() >= len(got)


def test_empty_documents_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0
