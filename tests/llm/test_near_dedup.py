import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.llm import near_dedup as nd
from logquarry.llm.components import components
from logquarry.llm.words import WordHashes


def brute(rows, size):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            label[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def cases(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉfg") for _ in range(r.randrange(1, 5)))
    rows = []
    for _ in range(n // 10):
        base = [word() for _ in range(r.choice([1, 2, 6, 40, 120]))]
        for _ in range(10):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 8))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, rows[3][1]), (903, rows[3][1]), (None, rows[45][1]), (904, "One"), (905, "oNE"), (None, "lonely words here"), (906, "long " + " ".join(map(str, range(30_000))))]


def test_components_equal_brute_force(spark):
    for seed, size in ((1, 2), (2, 5)):
        rows = cases(seed)
        df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, n string").repartition(4)
        got = nd.near_groups(df, "doc_id", "text", size).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, size)


@pytest.mark.parametrize("block", [512, 7])
def test_a_chain_and_a_hot_group_connect(spark, monkeypatch, block):
    """Neighbours of a chain link, its ends don't; many near copies of one text link through each other."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "BLOCK_ROOT", 0)
    r = random.Random(4)
    chain = [" ".join(f"c{i}" for i in range(9 * k, 9 * k + 120)) for k in range(40)]
    base = [f"w{i}" for i in range(100)]
    hot = []
    for i in range(300):
        w = list(base)
        for p in r.sample(range(100), 6):
            w[p] = f"x{i}_{p}"
        hot.append(" ".join(w))
    rows = list(enumerate(chain + hot))
    got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 2).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2)


def test_every_pair_of_a_key_meets_in_one_unit(spark, monkeypatch):
    """Searched with blocks of any size, a key gives the same pairs."""
    monkeypatch.setattr(nd, "BLOCK_ROOT", 0)
    sets = [np.sort(np.random.default_rng(i % 9).integers(0, 1 << 63, 60 + i % 3, np.uint64) * np.uint64(2)) for i in range(60)]
    sig = np.stack([nd.signature(s) for s in sets])
    classes = spark.createDataFrame([(i, nd.halves(s).tobytes(), len(s), sig[i].tobytes()) for i, s in enumerate(sets)], "cid long, fine binary, n long, sig binary")
    members = spark.createDataFrame([(int(k), i) for i, row in enumerate(nd.keys(sig).view(np.int64)) for k in row], "key long, a long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "node long, label long")
    none = spark.createDataFrame([], "a long, b long")
    found = []
    for block in (512, 4, 2, 1):
        monkeypatch.setattr(nd, "BLOCK", block)
        pairs = [(r.a, r.b) for r in nd._between(members, classes, labels, none, 0.8, 1000).collect()]
        found.append(set(pairs))
        assert len(pairs) == len(found[-1])
    label = lambda i: i % 2 if i < 30 else i
    assert found[0] == found[1] == found[2] == found[3] == {(j, i) for i, j in combinations(range(60), 2) if i % 9 == j % 9 and label(i) != label(j) and (nd.keys(sig[[i, j]])[0] == nd.keys(sig[[i, j]])[1]).any()}
    assert len(found[0]) > 50


def test_a_tested_pair_still_tells_that_its_key_has_more(spark):
    sets = [np.sort(np.random.default_rng(i % 9).integers(0, 1 << 63, 60 + i % 3, np.uint64) * np.uint64(2)) for i in range(30)]
    sig = np.stack([nd.signature(s) for s in sets])
    classes = spark.createDataFrame([(i, nd.halves(s).tobytes(), len(s), sig[i].tobytes()) for i, s in enumerate(sets)], "cid long, fine binary, n long, sig binary")
    members = spark.createDataFrame([(int(k), i) for i, row in enumerate(nd.keys(sig).view(np.int64)) for k in row], "key long, a long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "node long, label long")
    none = spark.createDataFrame([], "a long, b long")
    first = nd._between(members, classes, labels, none, 0.8, 1).collect()
    assert any(r.more for r in first)
    tested = spark.createDataFrame([(r.a, r.b) for r in first], "a long, b long")
    again = nd._between(members, classes, labels, tested, 0.8, 1).collect()
    assert {(r.a, r.b) for r in again} == {(r.a, r.b) for r in first if r.more} and all(r.more and r.done for r in again)


def test_units_of_a_hot_key_are_bounded(spark):
    """20,000 members that nothing links yet, and as many with a large component: rows sent, and rows of a task."""
    members = spark.range(20_000).selectExpr("1L as key", "id as a")
    none = spark.createDataFrame([], "node long, label long")
    half = spark.range(15_000).selectExpr("id as node", "0L as label")
    size = int(nd.BLOCK_ROOT * 20_000**0.5)
    for labels, most in ((none, 20_000 * (20_000 // size + 2)), (half, 15_000 * 5 + 5000 * (15_000 // size + 6))):
        rows = nd._units(members, labels)
        assert rows.count() <= most < 400_000
        assert rows.groupBy("unit").count().agg({"count": "max"}).first()[0] < 2.5 * size
    several = nd._units(members.where("a < 100"), none)
    assert several.count() == 100 and several.select("unit").distinct().count() == 1


def test_parities_never_refute_a_link():
    r = np.random.default_rng(5)
    for n in (1, 5, 40, 320):
        for _ in range(50):
            u = np.unique(r.integers(0, 1 << 63, n + n // 5, np.uint64) * np.uint64(2))
            x, y = u[: len(u) - len(u) // 10], u[len(u) // 10 :]
            fine = nd.Fine([nd.halves(x).tobytes(), nd.halves(y).tobytes()], np.array([len(x), len(y)]))
            both = len(np.intersect1d(x, y))
            link = both / (len(x) + len(y) - both) >= 0.8
            assert (len(fine.survivors(np.array([0]), np.array([1]), 0.8)[0]) == 1) == link


def test_empty_table(spark):
    assert nd.near_groups(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, nd.SYMBOLS - 1), max_size=(nd.ERRORS + 1) * nd.CHUNKS - 1, unique=True))
def test_pigeonhole_guarantee(errors):
    a = np.arange(nd.SYMBOLS, dtype=np.uint16)
    b = a.copy()
    b[errors] += 1000
    k = nd.keys(np.stack([a, b]))
    assert (k[0] == k[1]).any()


def test_signature_estimates_similarity():
    h = WordHashes()
    a = " ".join(map(str, range(1000))).encode()
    b = " ".join(map(str, range(100, 1100))).encode()
    x, y = (nd.shingle_set(t, 2, h) for t in (a, b))
    assert abs((nd.signature(x) == nd.signature(y)).mean() - 0.818) < 0.2


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_fine_sketch_passes_links_and_stops_most_others():
    r = np.random.default_rng(3)
    for n in (60, 300, 2000):
        passed = {}
        for share in (0.8, 0.6):
            both = int(n * 2 * share / (1 + share) + 0.999)
            hits = 0
            for _ in range(300):
                u = r.integers(0, 1 << 63, 2 * n - both, np.uint64) * np.uint64(2)
                x, y = np.unique(u[:n]), np.unique(np.r_[u[:both], u[n:]])
                a, b = nd.halves(x), nd.halves(y)
                exact = nd.linked_halves([a, b], np.array([len(a), len(b)]), np.array([0]), np.array([1]), 0.8)[0]
                assert exact == (share == 0.8)
                few = nd.may_link(nd.bins(a)[None, :64], nd.bins(b)[None, :64], np.array([2 * n]), 0.8)[0]
                assert few or share < 0.8
                hits += nd.may_link(nd.bins(a)[None], nd.bins(b)[None], np.array([2 * n]), 0.8)[0]
            passed[share] = hits / 300
        assert passed[0.8] == 1 and passed[0.6] < (0.6 if n < 100 else 0.15), (n, passed)
