import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from logquarry.llm import bloom_lm as lm
from logquarry.llm.words import mixed


def rows():
    texts = [f"The Cat sat {i % 5} É\tmat {'x' * (i % 3)} zebra{i}" for i in range(60)]
    return [*enumerate(texts), (60, None), (61, ""), (62, "again again"), (62, "again again"), (None, "the cat")]


def brute(data):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None]
    c = Counter(w for i, t in data if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(w := words(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 8)) for i, t in data]


def test_base_equals_brute_force_with_and_without_rare_words(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, n_tokens int").repartition(3)
    want = sorted(brute(rows()), key=str)
    for hot in (1 << 19, 3, 0):
        got = lm.score_documents(df, "doc_id", "text", hot_words=hot, fold=100).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got), key=str) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def plain_scores(data, count):
    """Model scores from exact counts c, each seen as count(c)."""
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    pairs = lambda w: list(zip(["<s>", *w], w, strict=False))
    one = Counter(x for i, t in data if not held(i) for x in words(t))
    two = Counter(x for i, t in data if not held(i) for x in pairs(words(t)))
    n1, n2 = (sum(v == k for v in two.values()) for k in (1, 2))
    discount, total = n1 / max(1, n1 + 2 * n2), sum(one.values()) + len(one) + 1
    out = []
    for i, t in data:
        score = 0.0
        for a, b in pairs(words(t)):
            own, both, seen = count(one[b]), count(two[a, b]), count(one[None if a == "<s>" else a])
            p = (1 - lm.BIGRAM_WEIGHT) * (own + 1) / total + lm.BIGRAM_WEIGHT * max(0, both - discount) / max(seen, both, 1)
            score += math.log10(min(p, 1))
        out.append((i, len(words(t)), score))
    return out


def test_scores_equal_brute_force(spark):
    """With bits enough the scores are those of levels of exact counts; with BITS_PER_ENTRY they are near those of the counts themselves."""
    data = rows() + [(100 + i, " ".join(f"w{(i * 37 + j * j) % 300}" for j in range(60))) for i in range(300)]
    df = spark.createDataFrame(data, "`a-b` long, text string").repartition(3)
    level = lambda c: float(lm.level_count(lm.levels(np.array([c])))[0]) if c else 0.0
    found = {}
    for bits, count, most in ((60, level, 1e-3), (lm.BITS_PER_ENTRY, float, 0.12)):
        got = sorted(((r["a-b"], r.n_tokens, r.score) for r in lm.score_documents(df, "a-b", "text", chunk_text=4000, bits_per_entry=bits).collect()), key=str)
        for (i, n, x), (j, m, y) in zip(got, sorted(plain_scores(data, count), key=lambda r: str(r)), strict=False):
            found.setdefault(bits, []).append(abs(x - y) / n)
            assert (i, n) == (j, m) and x <= 0
        assert np.mean(found[bits]) <= most, (bits, np.mean(found[bits]))


def test_a_crowded_filter_keeps_scores_log_probabilities(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    assert all(r.score <= 0 and math.isfinite(r.score) for r in lm.score_documents(df, "doc_id", "text", bits_per_entry=0.3).collect())


def test_likely_text_scores_higher(spark):
    df = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(100)] + [(1000, "mat the on sat cat the"), (1001, "unseen words only here and there")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(df, "doc_id", "text").collect()}
    assert got[5] > got[1000] > got[1001]


def test_a_bigram_seen_once_counts(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    data = [(i, f"w{i} v{i}") for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    a, b = data[0][0], data[1][0]
    data += [(i, f"p{i // 2} q{i // 2}") for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    data += [(held[0], f"w{a} v{a}"), (held[1], f"w{a} v{b}")]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_forgetting_words_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    sent = []
    monkeypatch.setattr(lm.LanguageModel, "scores", lambda self, docs: sent.append(self.sent.value) or docs)
    lm.score_documents(df, "doc_id", "text")
    texts = [(t or "").encode() for _, t in rows()]
    once = lm.Scorer(*sent[0]).scores(texts)
    monkeypatch.setattr(lm, "REMEMBERED", 2)
    again = lm.Scorer(*sent[0])
    for i, t in enumerate(texts):
        one = again.scores([t])
        assert [x[0] for x in one[:4]] == [x[i] for x in once[:4]]


def test_answers_are_as_exact_with_any_number_of_buckets(monkeypatch):
    """Bits an entry don't depend on the number of entries, and no bucket holds more than its share."""
    texts = [" ".join(f"w{(i * 37 + j * j) % 900}" for j in range(60)).encode() for i in range(300)]
    docs = pa.record_batch([pa.array(texts, pa.binary()), pa.array([i % 7 == 2 for i in range(300)])], names=["raw", "held_out"])
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    chunks = list(lm._cut(iter([docs.slice(0, 110), docs.slice(110)]), 2000))
    assert len(chunks) > 30 and [x for c in chunks for x in lm._docs(c["docs"][0].as_py())["raw"].to_pylist()] == texts
    tokens = [lm.doc_hashes(t, lm.WordHashes()) for t in texts]
    train = [t for i, t in enumerate(tokens) if i % 7 != 2]
    pair = lambda t: lm.bigram_keys(np.r_[lm._START, t[:-1]], t).tolist()
    c = Counter(x for t in train for x in (*lm.unigram_keys(t).tolist(), *pair(t)))
    for bits, share in ((60, 0.001), (12, 0.03)):
        for buckets in (16, 256):
            asked = pa.Table.from_batches(lm._asked(iter(chunks), buckets))
            parts = [asked.filter(pa.compute.equal(asked["bucket"], i)) for i in range(buckets)]
            answers = pa.concat_tables(lm._answer(x, bits) for x in parts if len(x)).sort_by([("chunk", "ascending"), ("bucket", "ascending")])
            keys = np.frombuffer(b"".join(asked.sort_by([("chunk", "ascending"), ("bucket", "ascending")])["keys"].to_pylist()), np.uint64)
            level = np.frombuffer(b"".join(answers["levels"].to_pylist()), np.uint8)
            true = np.array([lm.levels(np.array(c[k])) if c[k] else 0 for k in keys.tolist()])
            assert (level >= true).all() and (level > true).mean() <= share
            assert max(map(len, parts)) <= len(chunks)


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_filter_never_underestimates_and_rarely_overestimates():
    keys = mixed(np.arange(20_000, dtype=np.uint64))
    counts = 1 + (np.arange(20_000) % 300)
    level = lm.levels(counts)
    parts = [keys[(keys & np.uint64(3)) == b] for b in range(4)]
    segments = [lm.segment(p, level[(keys & np.uint64(3)) == b], 12) for b, p in enumerate(parts)]
    held = lm.Filter(b"".join(segments), np.array([len(x) for x in segments], np.int64))
    assert (held.level(keys) >= level).all()
    assert (held.level(keys) == level).mean() > 0.95
    assert (held.level(mixed(keys + np.uint64(1))) > 0).mean() < 0.05
