"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document is the set of its word shingles; two link when their Jaccard
similarity reaches the threshold. Documents of equal sets form one class.

Signatures have CHUNKS chunks of CHUNK symbols of SYMBOL_BITS bits. If two
signatures differ in fewer than (ERRORS + 1) * CHUNKS symbols, some chunk has
ERRORS errors at most (pigeonhole), so they agree on one of the keys made by
leaving out ERRORS symbols of a chunk: all such pairs meet, for certain. Of
pairs exactly at similarity 0.8 all but one in nine million meet.

Pairs that meet are not all written down. Each key links its classes to its
least one, first within a batch of a scan task, then among the least ones of
batches, so a key that many share is a short list everywhere. Links whose
signatures differ too much are dropped, the closest of each class is confirmed
on full sets, and what it connects is found. Then rounds follow over keys that
still hold more than one component: pairs of two components that a finer
sketch of the sets can't tell from links are confirmed, closest first, more of
them each round, until every pair of a common key is either inside one
component or refuted. So of pairs that meet, no link between components is lost.

A key with many members is cut into blocks of them, and each pair of blocks is
compared by itself, so a task holds two blocks whatever the size of the key.

The finer sketch of a set of EXACT shingles or fewer is the set itself, in
halved hashes, which can refute a link but never loses one; before that, sets
are compared by the parities of their numbers of members in BINS bins, as no
more of those can differ than members do. Of a larger set the sketch is one
hash dealt out to BINS bins, of which each keeps a byte of its least value;
pairs within DEVIATIONS of the threshold pass.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import broadcast_if_small, release, stored, text_bytes
from logquarry.llm.components import components
from logquarry.llm.words import WordHashes, mixed, pair_hash, split_words

CHUNKS, CHUNK, ERRORS, SYMBOL_BITS = 12, 5, 1, 16
SYMBOLS = CHUNKS * CHUNK
#: Members of a star that one task confirms.
STAR = 256
#: Members of a key in a block: the third times the square root of all, so that copies stay few, between the first and the second.
BLOCK, LARGEST_BLOCK, BLOCK_ROOT = 512, 8192, 8
#: Keys of classes that a task brings together, of 16 bytes each.
PART_KEYS = 4_000_000
#: Pairs of two components that the first round confirms, that the first search takes from a key, and by what later ones take more.
FIRST_PAIRS, KEY_PAIRS, MORE_PAIRS = 4, 64, 8
BINS, DEVIATIONS, EXACT = 512, 5.0, 384

_r = np.random.default_rng(20240229)
_XOR = _r.integers(0, 1 << 32, SYMBOLS, np.uint32)
_TIMES = _r.integers(0, 1 << 32, SYMBOLS, np.uint32) | np.uint32(1)


def shingle_set(raw: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of fewer words the whole sequence is one."""
    words = split_words(raw)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - size + 1)
    out = h[:n]
    for i in range(1, min(size, len(h))):
        out = pair_hash(out, h[i : i + n])
    # a short sequence is no shingle of a longer text
    return np.unique(out if len(h) >= size else mixed(out ^ np.uint64(len(h))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS numbers of 16 bits: of the least value of each permutation, some mixed bits."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        least = np.minimum(least, ((low[None, i : i + 4096] ^ _XOR[:, None]) * _TIMES[:, None]).min(1))
    return (mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def halves(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of sorted hashes."""
    return (shingles >> np.uint64(32)).astype(np.uint32)


def bins(half: np.ndarray) -> np.ndarray:
    """A byte of the least hash in each bin, 0 for an empty one."""
    out = np.zeros(BINS, np.uint8)
    of = half >> np.uint32(32 - int(math.log2(BINS)))
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    out[of[first]] = half[first] % np.uint32(255) + np.uint32(1)
    return out


def packed_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of sorted halves: bins, and a bit for each bin that has an odd number of members.

    Bits of two sets differ in no more places than the sets have members of their own.
    """
    out, every = np.zeros((len(sets), BINS), np.uint8), np.concatenate([*sets, np.zeros(0, np.uint32)])
    at = np.repeat(np.arange(len(sets)) * BINS, [len(x) for x in sets]) + (every >> np.uint32(32 - int(math.log2(BINS))))
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out.ravel()[at[first]] = every[first] % np.uint32(255) + np.uint32(1)
    odd = (np.bincount(at, minlength=out.size) & 1).astype(np.uint8).reshape(out.shape)
    return out, np.packbits(odd, axis=1).view(np.uint64)


def linked_halves(halves_of: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets x[i] and y[i] link as far as halved hashes tell, which take no common shingle for a different one."""
    order = np.argsort(x, kind="stable")
    out = np.zeros(len(x), bool)
    for part in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else ():
        own, others = halves_of[x[part[0]]], [halves_of[j] for j in y[part]]
        every = np.concatenate(others)
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        of = np.repeat(np.arange(len(part)), [len(o) for o in others])
        both = np.bincount(of[own[at] == every], minlength=len(part))
        out[part] = (1 + threshold) * both >= threshold * (n[x[part]] + n[y[part]]) - 1e-6
    return out


def may_link(x: np.ndarray, y: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """Whether bins x and y of pairs, with ``total`` shingles in both sets together, can belong to a link.

    x and y may be some of the bins. At the threshold the union has total /
    (1 + threshold) members; the bins in use are a sample of it without
    replacement, of which the threshold's share agrees, within DEVIATIONS.
    """
    same = ((x == y) & (x > 0)).sum(1)
    used = ((x | y) > 0).sum(1)
    union = total / (1 + threshold)
    spread = threshold * (1 - threshold) * used * np.clip(1 - used / np.maximum(union, 1), 0.02, 1)
    return same >= threshold * used - DEVIATIONS * np.sqrt(spread) - 1


def keys(signatures: np.ndarray) -> np.ndarray:
    """[document, key]: each chunk with each choice of ERRORS symbols left out."""
    out = []
    for c in range(CHUNKS):
        for left in itertools.combinations(range(CHUNK), CHUNK - ERRORS):
            k = np.full(len(signatures), 1 + len(out), np.uint64)
            for s in left:
                k = mixed(k * np.uint64(0x9E3779B97F4A7C15) ^ signatures[:, c * CHUNK + s].astype(np.uint64))
            out.append(k)
    return np.stack(out, 1)


def most_errors(threshold: float) -> int:
    """Differing symbols of a pair at the threshold: the mean and six deviations."""
    return int(SYMBOLS * (1 - threshold) + 6 * math.sqrt(SYMBOLS * threshold * (1 - threshold)))


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """Per row its id, number of shingles, digest of the set and signature."""
    shape = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("digest", "sig", "fine"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, digest, sig, fine = [], [], [], []
            for raw in b.column("raw"):
                s = shingle_set(raw.as_py(), size, hashes)
                n.append(len(s))
                fine.append((halves(s) if len(s) <= EXACT else bins(halves(s))).tobytes() if len(s) else None)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(fine, pa.binary())], names=["id", "n", "digest", "sig", "fine"])
        hashes.clear()
        release()

    return rows.mapInArrow(run, shape)


def _grouped(key: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by key and class; also the start of each row's key and the size of each row's key."""
    order = np.lexsort((cid, key))
    key, cid = key[order], cid[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[new, len(key)])
    return key, cid, np.repeat(new, size), np.repeat(size, size)


def _met(classes: DataFrame, parts: int) -> DataFrame:
    """Rows (key, a, b): b is null for a member a of a key that several share; else a link of a to b, the least of the key."""
    names, none = ["part", "keys", "a", "b"], pa.binary()

    def links(key, cid, start, size) -> tuple[bytes, bytes, bytes]:
        many = size > 1
        return key[many].tobytes(), cid[many].tobytes(), cid[start][many].tobytes()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            key = keys(sig)
            cid = np.repeat(b.column("cid").to_numpy(), key.shape[1])
            key, cid, start, size = _grouped(key.ravel(), cid)
            first = np.flatnonzero(start == np.arange(len(key)))
            key1, cid1 = key[first], cid[first]
            part = (key1 % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            full, at = np.unique(part[order], return_index=True)
            cut = list(zip(at, [*at[1:], len(order)], strict=True))
            own = links(key, cid, start, size)
            cols = ([key1[order[lo:hi]].tobytes() for lo, hi in cut], [cid1[order[lo:hi]].tobytes() for lo, hi in cut])
            to = int(b.column("cid")[0].as_py()) % parts
            yield pa.record_batch([pa.array([*full, to], pa.int32()), *(pa.array([*c, o], none) for c, o in zip((*cols, [None] * len(full)), own, strict=True))], names=names)

    def out(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        is_link = a != b
        for x, y in ((a, None), (a[is_link], b[is_link])):
            k = key if y is None else key[is_link]
            for i in range(0, len(x), 100_000):
                s = slice(i, i + 100_000)
                yield pa.record_batch([pa.array(k[s].view(np.int64)), pa.array(x[s]), pa.nulls(len(x[s]), pa.int64()) if y is None else pa.array(y[s])], names=["key", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed rows of one part."""
        held: tuple[list, list] = [], []
        for b in batches:
            for k, a, c in zip(*(b.column(n) for n in names[1:]), strict=True):
                k, a = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(a.as_py(), np.int64)
                if c.is_valid:
                    yield from out(k, a, np.frombuffer(c.as_py(), np.int64))
                else:
                    held[0].append(k)
                    held[1].append(a)
        if held[0]:
            key, cid, start, size = _grouped(*map(np.concatenate, held))
            many = size > 1
            yield from out(key[many], cid[many], cid[start][many])
        held[0].clear()
        held[1].clear()
        release()

    packed = classes.select("cid", "sig").mapInArrow(fold, "part int, keys binary, a binary, b binary")
    return packed.repartitionById(parts, "part").mapInArrow(meet, "key long, a long, b long")


def _close(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, d): the pairs whose signatures and sizes allow a link, with their distance."""
    most = most_errors(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("x", "y"))
            d = (x != y).sum(1)
            ok = d <= most
            yield pa.record_batch([pa.array(b.column("a").to_numpy()[ok]), pa.array(b.column("b").to_numpy()[ok]), pa.array(d[ok].astype(np.int32))], names=["a", "b", "d"])

    side = lambda c, s, n: classes.select(F.col("cid").alias(c), F.col("sig").alias(s), F.col("n").alias(n))
    joined = pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b")
    return joined.where(F.least("na", "nb") >= F.lit(threshold - 1e-9) * F.greatest("na", "nb")).select("a", "b", "x", "y").mapInArrow(run, "a long, b long, d int")


def _sifted(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, d) that the finer sketches can't refute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = np.concatenate([b.column(c).to_numpy() for c in ("na", "nb")])
                fine = Fine([*b.column("x").to_pylist(), *b.column("y").to_pylist()], n)
                x = np.arange(b.num_rows)
                ok = np.zeros(b.num_rows, bool)
                ok[fine.survivors(x, x + b.num_rows, threshold)[0]] = True
                yield pa.record_batch([pa.array(b.column(c).to_numpy()[ok]) for c in ("a", "b", "d")], names=["a", "b", "d"])

    side = lambda c, s, n: classes.select(F.col("cid").alias(c), F.col("fine").alias(s), F.col("n").alias(n))
    return pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b").mapInArrow(run, "a long, b long, d int")


class Fine:
    """The finer sketches of some sets, by place."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        self.n, self.known = n, n <= EXACT
        self.sets = [np.frombuffer(f, np.uint32 if k else np.uint8) for f, k in zip(raw, self.known, strict=True)]
        self.bins, self.odd = packed_sketches([f if k else f[:0].view(np.uint32) for f, k in zip(self.sets, self.known, strict=True)])
        large = np.flatnonzero(~self.known)
        if len(large):
            self.bins[large] = np.stack([self.sets[i] for i in large])

    def survivors(self, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (x[i], y[i]) that may link."""
        known = self.known[x] & self.known[y]
        a, b = x[known], y[known]
        near = np.bitwise_count(self.odd[a] ^ self.odd[b]).sum(1) <= (self.n[a] + self.n[b]) * ((1 - threshold) / (1 + threshold)) + 1e-6
        a, b = a[near], b[near]
        near = linked_halves(self.sets, self.n, a, b, threshold)
        a, b = a[near], b[near]
        x, y = x[~known], y[~known]
        for width in (BINS // 8, BINS):
            near = may_link(self.bins[x, :width], self.bins[y, :width], self.n[x] + self.n[y], threshold)
            x, y = x[near], y[near]
        return np.concatenate((a, x)), np.concatenate((b, y))

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((self.bins[x] != self.bins[y]).sum(1) * 1000 // np.maximum(1, self.n[x] + self.n[y])).astype(np.int32)


def _confirm(rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) for each pair (a, b), judged on full sets.

    Members a of a star b are dealt out in salted shares of about STAR, each
    with a copy of b's set. Texts are fetched by the id of a class's row and
    checked by the digest of their set, as ids may repeat.
    """
    star = pairs.select("a", "b", (F.xxhash64("a") % 4096).alias("salt"))
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("shares"))
    star = stored(star.join(counts, "b").select("a", "b", F.pmod("salt", "shares").alias("share")))
    need = star.select(F.col("a").alias("cid"), "b", "share", F.lit(1).alias("member")).unionByName(star.select(F.col("b").alias("cid"), "b", "share", F.lit(0).alias("member")).distinct())
    need = stored(need.join(classes.select("cid", "key_id", "digest"), "cid"))
    wanted = rows.join(broadcast_if_small(need, need.count(), 400_000), "key_id")
    shape = "b long, share long, member int, cid long, shingles binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            last, out = (None, None, None), []
            for raw, digest, *key in zip(*(b.column(c).to_pylist() for c in ("raw", "digest", "b", "share", "member", "cid")), strict=True):
                if raw != last[0]:
                    s = shingle_set(raw, size, hashes)
                    last = raw, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes()
                if last[1] == digest:
                    out.append((*key, last[2]))
                if len(out) == 256:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    def packed(out):
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["b", "share", "member", "cid", "shingles"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, done = None, None, None
        for b in batches:
            out = []
            for star, share, member, cid, raw in zip(*(b.column(c).to_pylist() for c in ("b", "share", "member", "cid", "shingles")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if not member:
                    at, centre, done = (star, share), s, None
                elif (star, share) == at and cid != done:
                    both = len(np.intersect1d(s, centre, assume_unique=True))
                    out.append((cid, star, 100 * both >= percent * (len(s) + len(centre) - both)))
                    done = cid
            if out:
                a, c, ok = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(ok)], names=["a", "b", "linked"])

    found = wanted.select("raw", "digest", "b", "share", "member", "cid").mapInArrow(sets, shape)
    return found.repartition("b", "share").sortWithinPartitions("b", "share", "member", "cid").mapInArrow(judge, "a long, b long, linked boolean")


def _units(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, unit, a, label, side): the members of keys that hold several components, dealt out to units in which all pairs of different components meet once.

    A key of few members is one unit, side 0. Else members of its largest
    component, which need not meet each other, and all others are cut into
    blocks. A unit is a block of the one (side 1) with one of the other (side
    2), two blocks of others (1 and 2), or one of others (0); so a member has
    as many copies as there are blocks to meet.
    """
    own = members.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    counts = own.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels"))
    size = F.least(F.lit(LARGEST_BLOCK), F.greatest(F.lit(BLOCK), (BLOCK_ROOT * F.sqrt("m")).cast("int")))
    several = counts.where("labels > 1").select("key", F.col("top.label").alias("top"), (F.col("m") <= 2 * size).alias("one"), F.ceil(F.col("top.m") / size).alias("tops"), F.ceil((F.col("m") - F.col("top.m")) / size).alias("others"))
    # written first: a join of two plain exchanges is one that Spark can split at a key of many members
    rows = own.join(stored(several), "key").withColumn("is_top", F.col("label") == F.col("top"))
    block = F.pmod(F.xxhash64("a"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others")))
    rows = rows.withColumn("block", F.when(F.col("one"), F.lit(0)).otherwise(block))
    unit = lambda i, side: F.struct(i.cast("long").alias("unit"), side.alias("side"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    mine, tops, others = F.col("block"), F.col("tops"), F.col("others")
    top = F.transform(each(others), lambda o: unit(mine * others + o, F.lit(1)))
    with_tops = F.transform(each(tops), lambda t: unit(t * others + mine, F.lit(2)))
    with_others = F.transform(each(others), lambda o: unit((tops + F.least(o, mine)) * others + F.greatest(o, mine), F.when(o == mine, 0).when(mine < o, 1).otherwise(2)))
    dealt = F.when(F.col("one"), F.array(unit(F.lit(0), F.lit(0)))).when(F.col("is_top"), top).otherwise(F.concat(with_tops, with_others))
    return rows.withColumn("u", F.explode(dealt)).select("key", "u.unit", "a", "label", "u.side")


def _between(members: DataFrame, classes: DataFrame, labels: DataFrame, tested: DataFrame, threshold: float, take: int) -> DataFrame:
    """Pairs (a, b, d, key, more, done) of different components that share a key and may link.

    A pair comes from the least of the keys that it shares, ``key``. Of two components
    a unit of a key gives the closest ``take`` pairs; ``more`` tells that it
    had others. Pairs tested before (``done``) come only to tell that.
    """
    rows = _units(members, labels).join(classes.select(F.col("cid").alias("a"), "fine", "n", "sig"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, label, n, side, raw, sig in _whole(batches):
            fine = Fine(raw, n)
            found = [x for i in range(0, len(cid), 512) for j in range(i, len(cid), 4096) for x in pairs_of(cid, label, n, side, fine, i, j)]
            if not found:
                continue
            x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
            first = _least_shared_key(sig, x, y) == key
            x, y, d = x[first], y[first], d[first]
            if not len(x):
                continue
            lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            order = np.lexsort((cid[x], cid[y], d, hi, lo))
            x, y, d, lo, hi = (v[order] for v in (x, y, d, lo, hi))
            new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            last = np.r_[new[1:], True]
            ok, more = place < take, place == take - 1
            more &= ~last
            yield pa.record_batch([pa.array(cid[y[ok]]), pa.array(cid[x[ok]]), pa.array(d[ok].astype(np.int32)), pa.array(np.full(int(ok.sum()), key)), pa.array(more[ok])], names=["a", "b", "d", "key", "more"])
        release()

    def pairs_of(cid, label, n, side, fine, i, j):
        """Pairs of rows i to i + 512 with rows j to j + 4096."""
        rows, other = slice(i, i + 512), slice(j, j + 4096)
        size, against = n[rows, None], n[None, other]
        ok = (label[rows, None] != label[None, other]) & (cid[rows, None] < cid[None, other])
        ok &= (side[rows, None] == 0) | (side[rows, None] != side[None, other])
        ok &= np.minimum(size, against) >= (threshold - 1e-9) * np.maximum(size, against)
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 20_000):
            xi, yi = fine.survivors(x[k : k + 20_000] + i, y[k : k + 20_000] + j, threshold)
            if len(xi):
                yield xi, yi, fine.distance(xi, yi)

    dealt = rows.select("key", "unit", F.col("a").alias("cid"), "label", "n", "side", "fine", "sig").repartition("key", "unit").sortWithinPartitions("key", "unit", "cid")
    pairs = dealt.mapInArrow(run, "a long, b long, d int, key long, more boolean").groupBy("a", "b").agg(F.min("d").alias("d"), F.first("key").alias("key"), F.max("more").alias("more"))
    pairs = pairs.join(tested.select("a", "b", F.lit(True).alias("done")).distinct(), ["a", "b"], "left")
    return pairs.withColumn("done", F.coalesce("done", F.lit(False))).where("more or not done")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The key and columns (cid, label, n, side, fine, sig) of one unit of a key after the other, from rows sorted by both."""
    held: list[tuple] = []
    at = None
    for b in batches:
        key, unit = b.column("key").to_numpy(), b.column("unit").to_numpy()
        cols = [b.column(c).to_numpy() for c in ("cid", "label", "n", "side")]
        cols += [np.array(b.column("fine").to_pylist(), object), np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]) if len(key) else []
        for lo, hi in zip(new, [*new[1:], len(key)], strict=True):
            if (key[lo], unit[lo]) != at and held:
                yield at[0], *(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            at = key[lo], unit[lo]
            held.append([c[lo:hi] for c in cols])
    if held:
        yield at[0], *(np.concatenate(x) for x in zip(*held, strict=True))


def _least_shared_key(sig: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows of signatures that share a key, the least one as a signed number."""
    used, at = np.unique(np.r_[x, y], return_inverse=True)
    every = keys(sig[used]).view(np.int64)
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 20_000):
        s = slice(i, i + 20_000)
        a, b = every[at[: len(x)][s]], every[at[len(x) :][s]]
        out[s] = np.where(a == b, a, np.iinfo(np.int64).max).min(1)
    return out


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with those as la and lb, the lesser first."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    found = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b"))
    return found.where("la <> lb").withColumns({"la": F.least("la", "lb"), "lb": F.greatest("la", "lb")})


def _closest(pairs: DataFrame, take: int) -> DataFrame:
    """Of any two components the closest ``take`` pairs."""
    rank = F.row_number().over(Window.partitionBy("la", "lb").orderBy("d", "a", "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= take).select("a", "b").distinct()


def near_groups(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, progress: Callable[[str, int], None] | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    component_id is the least id of the documents reachable by links, itself
    included. Null texts and texts without words have no shingles, link with
    nothing and stay, with their own id. Rows that repeat an id are judged by
    their own texts and all kept if that id is the least of its component. A
    null id is greater than any other: such a row is kept only when all ids of
    its component are null, which then has a null component_id. Whole texts
    count, however long; an empty table has no rows; other columns of ``df``
    are not looked at.
    """
    spark = df.sparkSession
    percent = round(100 * threshold)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_bytes(F.col(f"`{text_col}`")).alias("raw"))
    sketched = stored(_sketches(rows, shingle))
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key_id"), "raw")
    classes = sketched.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("fine").alias("fine"))
    classes = stored(classes.withColumn("key_id", F.coalesce(F.col("id").cast("string"), F.lit(""))).withColumn("cid", F.monotonically_increasing_id()))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = stored(_met(classes, max(least, -(-classes.count() * CHUNKS * math.comb(CHUNK, ERRORS) // PART_KEYS))))
    links = met.where("b is not null").select("a", "b").distinct()
    close = stored(_sifted(stored(_close(links, classes, threshold)), classes, threshold))
    members = stored(met.where("b is null").select("key", "a").distinct())
    best = close.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    judged, labels, todo, per_key = None, None, stored(best), KEY_PAIRS

    def confirm(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All verdicts so far, and the components that they make: those known, joined by the new links."""
        new = stored(_confirm(rows, classes, pairs, shingle, percent))
        links = new.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if judged is None:
            return new, components(links)
        return judged.unionByName(new), components(links.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))

    judged, labels = confirm(todo)
    while True:
        tested = judged.select("a", "b")
        rest = close.join(tested, ["a", "b"], "left_anti").withColumns({"key": F.lit(None).cast("long"), "more": F.lit(False), "done": F.lit(False)})
        found = stored(_apart(rest.unionByName(_between(members, classes, labels, tested, threshold, per_key)), labels).select("a", "b", "d", "key", "more", "done"))
        left, take = found.where("not done"), FIRST_PAIRS
        todo = stored(_closest(_apart(left, labels), take))
        while (n := todo.count()) > 0:
            if progress:
                progress("pairs to confirm", n)
            judged, labels = confirm(todo)
            take *= MORE_PAIRS
            left = stored(_apart(left.join(todo, ["a", "b"], "left_anti"), labels).select("a", "b", "d"))
            todo = stored(_closest(_apart(left, labels), take))
        again = stored(_apart(found.where("more"), labels).select("key").distinct())
        if not again.head(1):
            break
        # of the other keys every pair is tested, refuted or inside a component
        members, per_key = stored(members.join(again, "key")), per_key * MORE_PAIRS
    named = classes.select("cid", "digest", "id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    # written first, so that Spark can split the join at a component of many classes
    least = stored(named.groupBy("label").agg(F.min("id").alias("component_id")))
    of = named.join(least, "label").select("digest", "component_id")
    out = sketched.join(of, "digest", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", shingle=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || chr(32) || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
