"""Quality classifier: a factorisation machine over hashed words and the text's structure.

The score of a text with features x is
    b + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
so all pairs of features interact at a cost linear in the number of features.
Features are the words of the whole text, hashed, with damped and normalised
counts, and metadata computed from the text alone: lengths and shares of
characters, words and lines of some kinds, each in a few soft bins.

The machine learns on a bounded sample of labelled rows: TRAIN_ROWS at most,
and no more once they have TRAIN_FEATURES features together. A row that is
learned is learned whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import stored, text_bytes
from logquarry.llm.words import WordHashes, split_words

TRAIN_ROWS = 6000
#: 8 bytes each; about 300 a row in prose of ordinary length.
TRAIN_FEATURES = 8_000_000
WORD_BITS = 15
RANK = 8
EPOCHS = 12
BATCH = 64
THRESHOLD = 0.3

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "stop": b".", "comma": b",", "loud": b"!?", "bar": b"|", "odd": b"#$%&*+/<=>@\\^_`{}~", "bracket": b"()[]"}
_DROP = {k: bytes(b for b in range(256) if b not in v) for k, v in _CLASSES.items()}
_LINE = re.compile(rb"[^\n]+")
#: Structure statistics and the points between their soft bins.
STATS = {
    "log_chars": [3.0, 4.5, 5.5, 6.5, 7.5, 8.5, 10.0],
    "word_length": [2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0],
    "distinct": [0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 1.0],
    "top_word": [0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "line_chars": [10.0, 30.0, 60.0, 120.0, 250.0, 500.0, 1500.0],
    "distinct_lines": [0.05, 0.2, 0.4, 0.6, 0.8, 0.95, 1.0],
    "ends_well": [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0],
    **{k: [0.0, 0.003, 0.01, 0.03, 0.08, 0.2, 0.5] for k in _CLASSES},
    "high_bytes": [0.0, 0.003, 0.01, 0.03, 0.08, 0.2, 0.5],
}
_EDGES = np.array(list(STATS.values()))
N_STATS = _EDGES.size
N_FEATURES = (1 << WORD_BITS) + N_STATS
_machines: dict[str, Machine] = {}


def structure(raw: bytes, words: list[bytes], distinct: int, top: int) -> np.ndarray:
    n, lines = max(1, len(raw)), [x.strip() for x in _LINE.findall(raw)]
    count = {k: len(raw.translate(None, drop)) / n for k, drop in _DROP.items()}
    return np.array(
        [
            np.log1p(len(raw)), sum(map(len, words)) / max(1, len(words)), distinct / max(1, len(words)), top / max(1, len(words)),
            len(raw) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
            *count.values(), 1 - len(raw.decode("utf-8", "replace")) / n,
        ]
    )


def soft_bins(stats: np.ndarray) -> np.ndarray:
    """Each statistic lies between two points and weighs on both, by nearness."""
    out = np.zeros_like(_EDGES)
    for i, (x, e) in enumerate(zip(stats, _EDGES, strict=True)):
        j = int(np.clip(np.searchsorted(e, x) - 1, 0, len(e) - 2))
        t = float(np.clip((x - e[j]) / (e[j + 1] - e[j]), 0, 1))
        out[i, j], out[i, j + 1] = 1 - t, t
    return out.ravel()


def features(raw: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and values; words' values have a norm of one together."""
    words = split_words(raw)
    at, tf = np.unique(hashes.of(words) >> np.uint64(64 - WORD_BITS), return_counts=True)
    stats = soft_bins(structure(raw, words, len(at), int(tf.max(initial=0))))
    value = 1 + np.log(tf)
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    full = np.flatnonzero(stats)
    return np.concatenate([full, at.astype(np.int64) + N_STATS]).astype(np.int32), np.concatenate([stats[full], value]).astype(np.float32)


class Machine:
    """Weights b, w and V; they learn by Adagrad on the logistic loss."""

    def __init__(self, seed: int = 1):
        self.b = 0.0
        self.w = np.zeros(N_FEATURES, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (N_FEATURES, RANK)).astype(np.float32)

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at] * x[:, None]
        return float(self.b + self.w[at] @ x + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The margin of each row; every row has a feature, as the statistics give some."""
        size = np.array([len(a) for a, _ in rows])
        out = np.empty(len(rows))
        part = np.cumsum(size) // (1 << 18)  # rows of about as many features at once
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            at, x = (np.concatenate([rows[i][k] for i in mine]) for k in (0, 1))
            start = np.cumsum(size[mine]) - size[mine]
            vx = self.v[at] * x[:, None]
            total = np.add.reduceat(vx, start)
            out[mine] = self.b + np.add.reduceat(self.w[at] * x, start) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), start))
        return out

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = 0.1, decay: float = 1e-5) -> None:
        r = np.random.default_rng(2)
        gb, gw, gv = 1e-6, np.full(N_FEATURES, 1e-6, np.float32), np.full((N_FEATURES, RANK), 1e-6, np.float32)
        for _ in range(EPOCHS):
            order = r.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                at = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                size = [len(rows[i][0]) for i in part]
                start = np.r_[0, np.cumsum(size)[:-1]]
                vx = self.v[at] * x[:, None]
                total = np.add.reduceat(vx, start)
                margin = self.b + np.add.reduceat(self.w[at] * x, start) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), start))
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
                e = np.repeat(error, size) * x
                used, to = np.unique(at, return_inverse=True)
                dw = np.bincount(to, e, len(used)) + decay * self.w[used]
                dv = np.stack([np.bincount(to, e * (np.repeat(total[:, f], size) - vx[:, f]), len(used)) for f in range(RANK)], 1) + decay * self.v[used]
                gb += float(error.sum()) ** 2
                self.b -= rate * float(error.sum()) / gb**0.5
                gw[used] += dw**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                gv[used] += dv**2
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS, most: int = TRAIN_FEATURES) -> Machine:
    """From the ``rows`` labelled rows, not held out, whose salted ids hash lowest, as long as they have ``most`` features.

    Labels other than 0 and 1, null ids and ids with labels of both kinds teach
    nothing; a label that is repeated counts once. Of several texts with one id
    the least in byte order is learned; null counts as an empty text. Whole
    texts count, however long.
    """
    picked = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id").agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("other")).where((F.col("label") == F.col("other")) & ~held_out("id"))
        .select("id", "label", F.xxhash64(F.lit(11), "id").alias("h")).orderBy("h", "id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            at, x = zip(*(features(r.as_py(), hashes) for r in b.column("raw")), strict=True) if b.num_rows else ((), ())
            yield pa.record_batch([b.column("id"), b.column("label"), b.column("h"), pa.array([len(a) for a in at], pa.int64()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([a.tobytes() for a in x], pa.binary())], names=shape.names)

    # at most ``rows`` narrow rows: a broadcast of proven size
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(F.col(f"`{text_col}`")).alias("raw"))
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())])
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.first("label").alias("label"), F.first("h").alias("h"), F.min("raw").alias("raw"))
    found = stored(found.select("id", "label", "h", "raw").mapInArrow(run, shape))
    before = F.sum("n").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))  # of at most ``rows`` rows
    found = found.join(F.broadcast(found.select("id", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < most)), "id").orderBy("h", "id").toArrow()
    machine = Machine()
    label = found["label"].to_numpy().astype(np.float32)
    if len(label):
        machine.b = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
        machine.learn([(np.frombuffer(a.as_py(), np.int32), np.frombuffer(x.as_py(), np.float32)) for a, x in zip(found["at"], found["x"], strict=True)], label)
    else:
        machine.v[:] = 0
    return machine


def score(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, machine: Machine) -> DataFrame:
    """Per row of docs: id, held_out, score, predicted. Null counts as empty, and empty texts get a score too.

    Whole texts are scored, however long. Rows that repeat an id stay apart and
    an empty table has none. With no training row every score is 0.5. Other
    columns of docs are not looked at.
    """
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast((machine.b, machine.w, machine.v))
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _machines:
            _machines.clear()
            m = _machines[key] = Machine.__new__(Machine)
            m.b, m.w, m.v = sent.value
        m, hashes = _machines[key], WordHashes()
        for b in batches:
            z = m.margins([features(r.as_py(), hashes) for r in b.column("raw")]) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column("id"), b.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=shape.names)

    own = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("id"), held_out(f"`{id_col}`").alias("held_out"), text_bytes(F.col(f"`{text_col}`")).alias("raw"))
    return rows.mapInArrow(run, shape).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(spark, docs, "doc_id", "text", fit(docs, labels, "doc_id", "text", "quality"))
