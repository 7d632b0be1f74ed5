"""Language-model scores from a log-frequency Bloom filter.

Documents are dealt into chunks of a few million bytes, which are stored. Each
chunk sends its distinct one-word and two-word sequences, as 64-bit hashes with
their counts in training documents, to buckets by hash. A bucket sums them and
builds its own segment of the filter: a sequence of count c has level 1 +
floor(log2 c) and enters once for each level up to its own; its level is read
back by probing level after level until a probe fails. The bucket answers each
chunk with one byte for each sequence sent, and the chunk's task scores its
documents with the answers. Every sequence enters, also a bigram seen once. As
many of those are chance, bigrams' counts are lessened by Ney's absolute
discount n1 / (n1 + 2 n2), from the numbers of bigrams seen once and twice.

The filter has BITS_PER_ENTRY bits an entry whatever the size of the corpus,
as no task holds more than a bucket's segment: the number of buckets grows
with the text, and nothing of the filter is broadcast or collected.

Base scores need exact counts. Words above a count threshold, chosen so that
at most HOT_WORDS are above it, are broadcast; the other words of a document
are joined with the whole table of counts. As such a word is rare in training,
its key is no hot key. A word's key is a 64-bit hash: among ten million
distinct words two share one with a probability of 3e-6.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import CRC_SQL, release, stored, text_bytes
from logquarry.llm.words import REMEMBERED, WordHashes, mixed, pair_hash, split_words

BITS_PER_ENTRY = 12
PROBES = 3
HOT_WORDS = 1 << 19
#: Tokens that a scan task holds before it folds them.
FOLD_TOKENS = 1 << 21
#: Text bytes that share a bucket.
BUCKET_TEXT = 8 << 20
#: Text bytes of a chunk; a longer text is one of its own.
CHUNK_TEXT = 4 << 20
#: Weight of the bigram estimate against the one-word estimate.
BIGRAM_WEIGHT = 0.6

_END = np.uint64(0xE0F1D2C3B4A59687)
_START = np.uint64(0x51A7B6C5D4E3F201)
_UNIGRAM = np.uint64(0x0123456789ABCDEF)
_scorers: dict[str, Scorer] = {}


def doc_hashes(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """A document's tokens: its words and one end."""
    return np.append(hashes.of(split_words(raw)), _END)


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    """Odd keys."""
    return mixed(tokens ^ _UNIGRAM) | np.uint64(1)


def bigram_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Even keys."""
    return pair_hash(before, tokens) & ~np.uint64(1)


def sequences(tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of ``size`` tokens, back to back: sorted keys, and the places in them of each token's word and bigram."""
    before = np.concatenate((tokens[-1:], tokens[:-1]))
    before[np.cumsum(size) - size] = _START
    words, word = np.unique(tokens, return_inverse=True)
    pairs, pair = np.unique(bigram_keys(before, tokens), return_inverse=True)
    every = np.concatenate((unigram_keys(words), pairs))
    order = np.argsort(every)
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    return every[order], place[word], place[len(words) + pair]


def levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log2(counts))).astype(np.uint8)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range on a log scale, 0 for none."""
    return np.where(level > 0, np.where(level == 1, 1.0, 1.5 * np.exp2(level - 1.0)), 0.0)


class Filter:
    """Segments of bits, one for each bucket of keys, back to back."""

    def __init__(self, joined: bytes, size: np.ndarray):
        self.bytes = np.frombuffer(joined, np.uint8)
        self.bits, self.start = (8 * size).astype(np.uint64), 8 * (np.cumsum(size) - size)
        self.mask = np.uint64(len(size) - 1)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which every level of a key is in the filter; never below the true one."""
        out, alive, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(alive) and level < 64:
            level += 1
            k = keys[alive]
            x, y = _starts(k, level)
            b = (k & self.mask).astype(np.int64)
            for i in range(PROBES):
                at = ((x + np.uint64(i) * y) % self.bits[b]).astype(np.int64) + self.start[b]
                ok = (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                alive, x, y, b = alive[ok], x[ok], y[ok], b[ok]
            out[alive] = level
        return out


def _starts(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return x, mixed(x) | np.uint64(1)


def segment(keys: np.ndarray, level: np.ndarray, bits_per_entry: float) -> bytes:
    """The bits of one bucket."""
    size = max(8, math.ceil(int(level.sum()) * bits_per_entry / 8))
    bits = np.zeros(8 * size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        x, y = _starts(keys[level >= j], j)
        for i in range(PROBES):
            bits[((x + np.uint64(i) * y) % np.uint64(8 * size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text mod 7 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _runs(buckets: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """The buckets that occur in a sorted array, and what cuts arrays of its length into their bytes; the work follows the array, not the number of buckets."""
    full, at = np.unique(buckets, return_index=True)
    at = [*at, len(buckets)]
    return full, lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in itertools.pairwise(at)], pa.binary())


def _folded(batches: Iterator[pa.RecordBatch], keys_of, buckets: int, fold: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, counts), each packed as little-endian integers."""
    hashes, held, size = WordHashes(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        b = (keys & np.uint64(buckets - 1)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        full, cut = _runs(b[order])
        yield pa.record_batch([pa.array(full, pa.int32()), cut(keys[order]), cut(counts[order].astype(np.uint32))], names=["bucket", "keys", "counts"])

    for b in batches:
        for raw in b.column(0):
            held.append(keys_of(doc_hashes(raw.as_py(), hashes)))
            size += len(held[-1])
            if size >= fold:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()
    hashes.clear()
    held.clear()
    release()


def _summed(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of one bucket."""
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in part["keys"]])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in part["counts"]])
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _counted(training: DataFrame, keys_of, buckets: int, fold: int, out, shape: str) -> DataFrame:
    packed = training.select("raw").mapInArrow(lambda batches: _folded(batches, keys_of, buckets, fold), "bucket int, keys binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(out, shape)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, docs): some documents as a compressed stream."""
    chunk = TaskContext.get().partitionId() << 33
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for x in held:
                w.write_batch(x)
        return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

    for b in batches:
        long = np.array([len(x.as_buffer()) for x in b.column("raw")], np.int64)
        at = 0
        for i, n in enumerate(long):
            if size and size + n > most:
                if i > at:
                    held.append(b.slice(at, i - at))
                yield packed()
                held, size, at, chunk = [], 0, i, chunk + 1
            size += n + 1
        if b.num_rows > at:
            held.append(b.slice(at))
    if held:
        yield packed()


def _docs(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bucket, keys, counts): a chunk's distinct sequences and how often training documents in it have them."""
    hashes = WordHashes()
    for b in batches:
        for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("docs"), strict=True):
            docs = _docs(packed.as_buffer())
            texts = [doc_hashes(x.as_py(), hashes) for x in docs["raw"]]
            size = np.array([len(t) for t in texts])
            keys, word, pair = sequences(np.concatenate(texts), size)
            train = np.repeat(~np.array(docs["held_out"].to_pylist(), bool), size)
            counts = np.bincount(np.concatenate((word[train], pair[train])), minlength=len(keys)).astype(np.uint32)
            full, cut = _runs(keys >> np.uint64(64 - int(math.log2(buckets))))  # in the order of the keys
            yield pa.record_batch([pa.array([chunk] * len(full), pa.int64()), pa.array(full.astype(np.int32)), cut(keys), cut(counts)], names=["chunk", "bucket", "keys", "counts"])
            del docs, texts, keys, word, pair, counts, cut
            release()
    hashes.clear()
    release()


def _answer(part: pa.Table, bits_per_entry: float = BITS_PER_ENTRY) -> pa.Table:
    """Rows (chunk, bucket, levels) of one bucket: a byte for each key that the chunk sent; the first row has the numbers of bigrams seen once and twice."""
    keys, counts = _summed(part)
    known, pairs = counts > 0, counts[keys & np.uint64(1) == 0]
    bits = segment(keys[known], levels(counts[known]), bits_per_entry)
    level = Filter(bits, np.array([len(bits)])).level(keys)
    out = [level[np.searchsorted(keys, np.frombuffer(k.as_buffer(), np.uint64))].tobytes() for k in part["keys"]]
    return pa.table({"chunk": part["chunk"], "bucket": part["bucket"], "levels": pa.array(out, pa.binary()), **{k: pa.array([int((pairs == c).sum())] + [0] * (len(out) - 1), pa.int64()) for k, c in (("once", 1), ("twice", 2))}})


class LanguageModel:
    """Counts of a training table: a table of word counts and frequent words."""

    def __init__(self, training: DataFrame, text_bytes_total: int, hot_words: int = HOT_WORDS, fold: int = FOLD_TOKENS, chunk_text: int = CHUNK_TEXT, bucket_text: int = BUCKET_TEXT, bits_per_entry: float = BITS_PER_ENTRY):
        spark = training.sparkSession
        self.buckets = buckets = 1 << max(4, math.ceil(math.log2(1 + text_bytes_total / bucket_text)))
        self.chunk_text, self.bits_per_entry = chunk_text, bits_per_entry

        def words(part: pa.Table) -> pa.Table:
            keys, counts = _summed(part)
            return pa.table({"word": keys.view(np.int64), "c": counts})

        self.words = stored(_counted(training, lambda t: t, buckets, fold, words, "word long, c long"))
        total = self.words.agg(F.sum("c"), F.count("*")).first()
        self.tokens, self.vocabulary = total[0] or 0, total[1]
        self.key = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast((*self._frequent(hot_words), self.tokens, self.vocabulary))

    def _frequent(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Words over the least count that leaves at most ``most`` of them, by key, with their counts."""
        steps = self.words.groupBy(F.floor(8 * F.log2("c")).alias("s")).count().orderBy(F.desc("s")).collect()
        least, n = None, 0
        for s, k in steps:
            n += k
            if n > most:
                break
            least = s
        if least is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows = self.words.where(F.floor(8 * F.log2("c")) >= least).toArrow()
        keys, counts = rows["word"].to_numpy().view(np.uint64), rows["c"].to_numpy()
        order = np.argsort(keys)
        return keys[order], counts[order]

    def scores(self, docs: DataFrame) -> DataFrame:
        """Per row of docs (id, held_out, raw): id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        key, sent, n, v = self.key, self.sent, self.tokens, self.vocabulary
        keep = [c for c in docs.columns if c != "raw"]

        most, buckets, bits = self.chunk_text, self.buckets, self.bits_per_entry

        def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
            if key not in _scorers:
                _scorers.clear()
                _scorers[key] = Scorer(*sent.value)
            chunk, part = asked["chunk"][0].as_py(), _docs(asked["docs"][0].as_buffer())
            level = np.frombuffer(b"".join(answers.sort_by("bucket")["levels"].to_pylist()), np.uint8)
            size, known, base, score, cut, rare, tf = _scorers[key].scores([x.as_py() for x in part["raw"]], level, discount)
            release()
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (rare, tf)]
            names = ["chunk", "place", *keep, "n_tokens", "known", "base", "score", "rare", "tfs"]
            return pa.table([pa.array([chunk] * len(size), pa.int64()), pa.array(np.arange(len(size), dtype=np.int32)), *(part[c] for c in keep), pa.array(size), pa.array(known), pa.array(base), pa.array(score), *lists], names=names)

        chunks = stored(docs.mapInArrow(lambda batches: _cut(batches, most), "chunk long, docs binary"))
        asked = chunks.mapInArrow(lambda batches: _asked(batches, buckets), "chunk long, bucket int, keys binary, counts binary")
        answers = stored(asked.groupBy("bucket").applyInArrow(lambda part: _answer(part, bits), "chunk long, bucket int, levels binary, once long, twice long"))
        once, twice = (x or 0 for x in answers.agg(F.sum("once"), F.sum("twice")).first())
        discount = once / max(1, once + 2 * twice)
        together = chunks.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "levels").groupBy("chunk"))
        numbers = {"n_tokens": T.LongType(), "known": T.LongType(), "base": T.DoubleType(), "score": T.DoubleType(), "rare": T.ArrayType(T.LongType()), "tfs": T.ArrayType(T.IntegerType())}
        shape = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("place", T.IntegerType()), *(docs.schema[c] for c in keep), *(T.StructField(c, k) for c, k in numbers.items())])
        first = stored(together.applyInArrow(run, shape))
        rest = (
            first.select("chunk", "place", F.explode(F.arrays_zip("rare", "tfs")).alias("x")).select("chunk", "place", F.col("x.rare").alias("word"), F.col("x.tfs").alias("tf"))
            .join(self.words, "word", "left").groupBy("chunk", "place")
            .agg(F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("add"))
        )
        return first.join(rest, ["chunk", "place"], "left").select(*keep, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"), "score")


class _Numbers(dict):
    """Words by number, from 1, in the order in which they are met; 0 is the end."""

    def __init__(self):
        self.hashes = [int(_END)]

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return i


class Scorer:
    """Scores documents in a worker; what it looks up for a word it remembers for a while."""

    def __init__(self, hot: np.ndarray, hot_counts: np.ndarray, n: int, v: int):
        self.hot, self.hot_counts, self.total = hot, hot_counts, n + v + 1.0
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.hash, self.log, self.is_hot = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)

    def _look_up(self) -> None:
        """For the words that are new: hash and exact log probability if frequent."""
        new = np.array(self.numbers.hashes[len(self.hash) :], np.uint64)
        is_hot, log = np.zeros(len(new), bool), np.zeros(len(new))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, new), len(self.hot) - 1)
            is_hot = self.hot[at] == new
            log[is_hot] = np.log10((self.hot_counts[at[is_hot]] + 1.0) / self.total)
        self.hash, self.log, self.is_hot = (np.concatenate(x) for x in zip((self.hash, self.log, self.is_hot), (new, log, is_hot), strict=True))

    def scores(self, texts: list[bytes], level: np.ndarray | None = None, discount: float = 0.0) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, frequent ones, their base, model score; then its other words as (offsets, hashes, counts).

        ``level`` has a level for each of the texts' ``sequences``; without it none was seen in training.
        """
        if len(self.numbers) > REMEMBERED:
            self._forget()
        tokens, size = [], np.zeros(len(texts), np.int64)
        for i, raw in enumerate(texts):
            words = split_words(raw)
            tokens += (np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32))
            size[i] = len(words) + 1
        self._look_up()
        every, doc = np.concatenate(tokens), np.repeat(np.arange(len(texts)), size)
        is_hot = self.is_hot[every]
        known = np.bincount(doc, is_hot, len(texts)).astype(np.int64)
        base = np.bincount(doc, self.log[every], len(texts))
        rare = ~is_hot
        pairs, tf = np.unique(doc[rare] * (1 << 32) + every[rare], return_counts=True)
        cut = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)).astype(np.int32)
        return size, known, base, self._model(self.hash[every], doc, size, level, discount), cut, self.hash[pairs & (1 << 32) - 1].view(np.int64), tf.astype(np.int32)

    def _model(self, tokens: np.ndarray, doc: np.ndarray, size: np.ndarray, level: np.ndarray | None, discount: float) -> np.ndarray:
        """log10 of the product over tokens of the two estimates' mixture."""
        keys, word, pair = sequences(tokens, size)
        count = level_count(np.zeros(len(keys), np.uint8) if level is None else level)
        if len(count) != len(keys):
            raise ValueError("a chunk's answers don't fit its sequences")
        own, together = count[word], count[pair]
        # the end stands before a document's first token as well: it is as frequent as the start
        seen = np.concatenate((own[-1:], own[:-1]))
        chain = np.maximum(together - discount, 0.0) / np.maximum(seen, np.maximum(together, 1.0))
        p = (1 - BIGRAM_WEIGHT) * (own + 1.0) / self.total + BIGRAM_WEIGHT * chain
        # a level stands for counts of up to a half more, and a probe may say yes by chance
        return np.bincount(doc, np.log10(np.minimum(p, 1.0)), len(size))


def score_documents(docs: DataFrame, id_col: str, text_col: str, **limits: float) -> DataFrame:
    """Trains on the rows that are not held out and scores all of them, whole texts.

    A null text counts as empty and has one token, the end. Rows that repeat
    an id stay apart. Without any training row N and V are 0 and every token
    has a base probability of 1. Whole texts are scored, one of more than
    CHUNK_TEXT bytes in a chunk of its own; an empty table has no rows. Columns
    besides id and text are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(F.col(f"`{text_col}`")).alias("raw")).withColumn("held_out", held_out("id"))
    training = rows.where(~F.col("held_out"))
    total = training.agg(F.sum(F.length("raw"))).first()[0] or 0
    return LanguageModel(training, total, **limits).scores(rows).withColumnRenamed("id", id_col)


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")



def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that exact counts decide."""
    return op10_bloom_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


SQL = rf"""
WITH d AS (SELECT doc_id, {CRC_SQL.format("doc_id")} % 7 = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' '] AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 5) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""
