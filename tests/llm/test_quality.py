import random

import numpy as np

from logquarry.llm import quality as q
from logquarry.llm.words import WordHashes

R = random.Random(7)


def good():
    return " ".join(R.choice(["the", "river", "stone", "walks", "green", "hill", "over", "and"]) + R.choice(["", "", ","]) for _ in range(60)).capitalize() + "."


def bad():
    return R.choice([" | ".join(R.choice(["buy", "now", "cheap"]) for _ in range(50)), good().upper() + "!!!", "Wher. " * 60])


def rows(n=400):
    data = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]
    return [d[:2] for d in data], [(d[0], d[2]) for d in data]


def test_sum_of_squares_identity_equals_all_pairs():
    m = q.Machine()
    m.w += np.random.default_rng(1).normal(size=m.w.shape).astype(np.float32)
    at, x = q.features(b"Some words, some more words | here!", WordHashes())
    pairs = sum(float(m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.margin(at, x) - (m.b + m.w[at] @ x + pairs)) < 1e-4


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = rows()
    docs += [(1000, None), (1001, ""), (1002, good() * 3000), (1003, bad()), (1003, good()), (None, good())]
    labels += [(5, None), (None, 1), (3, 1), (2000, 0), (7, 9)]
    df = spark.createDataFrame([(*d, "en", 0.1) for d in docs], "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int")
    got = q.score(spark, df, "doc_id", "text", q.fit(df, lab, "doc_id", "text", "quality")).collect()
    truth = dict(rows_ := [x for x in labels if x[0] is not None and x[0] < 400 and x[1] is not None and x[0] not in (3, 5, 7)])
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(rows_) > 300 and np.mean([a == b for a, b in held]) > 0.95
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len([r for r in got if r.doc_id == 1003]) == 2


def test_scores_equal_a_plain_computation_over_all_pairs(spark):
    docs, labels = rows(90)
    docs += [(500, None), (501, good() * 40), (502, "x")]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "`a-b` long, text string, score long")
    m = q.fit(df, spark.createDataFrame(labels, "`a-b` long, quality int"), "a-b", "text", "quality")
    got = {r["a-b"]: r.score for r in q.score(spark, df, "a-b", "text", m).collect()}
    for i, t in docs:
        at, x = q.features((t or "").encode(), WordHashes())
        gram = (m.v[at] * x[:, None]).astype(float)
        gram = gram @ gram.T
        z = float(m.b) + float(m.w[at].astype(float) @ x) + (gram.sum() - np.trace(gram)) / 2
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_ties_do_not_change_what_is_learned(spark):
    """Ids with two labels or texts, in any order of rows and partitions; a bound on features takes whole rows."""
    docs, labels = rows(120)
    twice = [(i, t[::-1]) for i, t in docs[:50]]
    wrong = [(i, 1 - y) for i, y in labels[50:70]]
    learned = []
    for seed, parts in ((1, 1), (2, 5)):
        r = random.Random(seed)
        d, lab = docs + twice, labels + wrong + labels[:10]
        r.shuffle(d)
        r.shuffle(lab)
        df = spark.createDataFrame(d, "doc_id long, text string").repartition(parts)
        lf = spark.createDataFrame(lab, "doc_id long, quality int").repartition(parts)
        learned.append(q.fit(df, lf, "doc_id", "text", "quality"))
    assert (learned[0].v == learned[1].v).all() and (learned[0].w == learned[1].w).all()
    least = [(i, min(t, dict(twice).get(i, t), key=str.encode)) for i, t in docs if not 50 <= i < 70]
    plain = q.fit(spark.createDataFrame(least, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id", "text", "quality")
    assert (plain.v == learned[0].v).all()
    few = q.fit(df, lf, "doc_id", "text", "quality", most=1)
    assert 0 < (few.w != 0).sum() < (plain.w != 0).sum() / 2


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.score(spark, df, "doc_id", "text", q.fit(df, none, "doc_id", "text", "quality")).first().score == 0.5
    m = q.fit(df.limit(0), none, "doc_id", "text", "quality")
    assert q.score(spark, df.limit(0), "doc_id", "text", m).count() == 0
