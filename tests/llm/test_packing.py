import random
from collections import defaultdict

from pyspark.sql import functions as F

from logquarry.llm import packing as p


def slow(lengths, sizes, overhead):
    """Best fit by looking at every open bin, for each rule of opening."""
    plans = []
    for only in (None, *sorted(sizes)):
        bins = []
        for k, n in enumerate(lengths):
            open_ = [b for b in bins if b[0] - sum(b[1]) >= n]
            if open_:
                b = min(open_, key=lambda b: (b[0] - sum(b[1]), bins.index(b)))
            else:
                fits = [s for s in sorted(sizes) if s >= n]
                if only:
                    s = next((s for s in fits if s >= only), fits[0])
                else:
                    s = min(fits, key=lambda s: ((s + overhead) / min(s, sum(lengths[k:])), s))
                bins.append(b := [s, [], []])
            b[1].append(n)
            b[2].append(k)
        plans.append([(min(s for s in sizes if s >= sum(b[1])), b[2]) for b in bins])
    return min(plans, key=lambda x: (sum(s + overhead for s, _ in x), len(x)))


def test_equals_brute_force():
    r = random.Random(1)
    for _ in range(60):
        sizes = r.choice([(8,), (4, 16), (5, 9, 20)])
        lengths = sorted((r.randrange(1, max(sizes) + 1) for _ in range(r.randrange(0, 60))), reverse=True)
        got, want = p.best_fit(lengths, sizes, 2), slow(lengths, sizes, 2)
        cost = lambda plan: sum(s + 2 for s, _ in plan)
        assert cost(got) == cost(want) and sorted(map(str, got)) == sorted(map(str, want))


def test_two_sizes_beat_either_alone():
    lengths = [9] * 10 + [4] * 5
    cost = lambda sizes: sum(s + 1 for s, _ in p.best_fit(lengths, sizes, 1))
    assert cost((9, 4)) < min(cost((9,)), cost((13,)))


def test_frame_covers_every_token_once(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 30, 100, 333, 2500]), "q") for i in range(500)] + [(900, None, "q"), (901, 40, "q"), (901, 40, "q"), (None, 7, "q")]
    df = spark.createDataFrame(rows, "doc_id long, n int, bin_id string")
    got = p.pack(df, "doc_id", F.col("n"), (128, 512, 1024), lot=150).collect()
    assert sorted(map(str, got)) == sorted(map(str, p.pack(df.repartition(7), "doc_id", F.col("n"), (128, 512, 1024), lot=150).collect()))
    tokens, bins = defaultdict(int), defaultdict(list)
    for x in got:
        tokens[x.doc_id] += x.n_tokens
        bins[x.bin_id].append(x)
    want = defaultdict(int)
    for i, n, _ in rows:
        want[i] += n or 0
    assert dict(tokens) == {i: n for i, n in want.items() if n}
    for b in bins.values():
        b.sort(key=lambda x: x.position)
        assert len({x.bin_size for x in b}) == 1
        end = 0
        for x in b:
            assert x.position == end
            end += x.n_tokens
        assert b[0].bin_size == min(s for s in (128, 512, 1024) if s >= end)
    waste = 1 - sum(tokens.values()) / sum(b[0].bin_size for b in bins.values())
    assert waste < 0.1


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", F.col("n")).count() == 0
