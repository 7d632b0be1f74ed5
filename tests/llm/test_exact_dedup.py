from collections import defaultdict
import hashlib
import random

from logquarry.llm.exact_dedup import ContentTable, exact_groups, grace_groups


def test_grace_recursion_with_a_tiny_table():
    r = random.Random(2)
    texts = [b"%d" % r.randrange(300) * r.randrange(1, 30) for _ in range(3000)]
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    got = {t: (k, n, sorted(m)) for _, t, k, n, m in grace_groups(([hashlib.sha256(t).digest(), t, i, 1, [i]] for i, t in enumerate(texts)), memory=2000)}
    assert got == {t: (max(m), len(m), m) for t, m in want.items()}


def test_equal_digests_compare_contents():
    same = b"\0" * 32
    got = {t: n for _, t, _, n, _ in grace_groups(([same, t, 1, 1, [1]] for t in [b"a", b"b", b"a", b"c"]), memory=1)}
    assert got == {b"a": 2, b"b": 1, b"c": 1}
    held = ContentTable()
    held.add([same, b"a"])
    assert held.find(same, b"b") is None and held.find(same, b"a")


def test_hot_group_nulls_ties_and_tiny_memory(spark):
    rows = [(i, "hot" * 50 if i % 3 == 0 else f"t{i % 40}" * (i % 7), "x") for i in range(600)]
    rows += [(700, None, "x"), (701, "", "x"), (None, "only", "x"), (702, "twice", "x"), (702, "twice", "x"), (703, "long" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(5)
    got = exact_groups(df, "doc_id", "text", local_bytes=2000, bucket_bytes=3000).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(df, "doc_id", "text").collect() == []
