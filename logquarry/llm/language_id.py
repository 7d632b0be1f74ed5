"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut
into the longest phrases that occur in that sample, one after another; a text
of the same language needs fewer of them. A phrase costs as many bits as a
position in the sample, LEAST_SAMPLE positions at least, which makes samples of
unequal size comparable and a tiny one no bargain; a symbol that the sample
lacks costs the same whatever the language, more than any phrase. The language
of the least bits per letter wins.

Every language with a labelled text that has a letter is learned, from a sample
bounded for each: up to SAMPLE_ROWS texts, until they have LANGUAGE_CHARS
characters; of a text of more than ROW_CHARS characters ROW_PIECES pieces from
all over it. The LETTERS most frequent letters are a symbol each, any other is
its code point in three symbols of 6 bits, so no two letters are the same.
Texts are read whole, in pieces of PIECE characters that many lanes of arrays
parse at once; a phrase ends where a piece ends, for every language alike.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import CRC_SQL, release

SAMPLE_ROWS = 64
ROW_CHARS, ROW_PIECES = 4000, 8
#: Of each language.
LANGUAGE_CHARS = 80_000
PIECE = 512
#: Texts that are parsed at once.
SLICE = 1000
LETTERS = 120
#: Positions of a sample that a phrase's bits reckon with at least.
LEAST_SAMPLE = 4096
UNKNOWN = "und"
#: Bits are scaled by this before they become a score, as phrases of one text aren't independent.
TEMPER = 0.05

#: Marks a letter of three symbols.
_CODED = 255
_parsers: dict[str, Parser] = {}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state, of all substrings. State 0 is the empty string."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def double_array(step: list[dict[int, int]], alphabet: int) -> np.ndarray:
    """Transitions in one array: at base + symbol stand the base that owns the place and the base of the next state.

    Bases name states and differ; that of state 0 is 0. A place without an owner has -1.
    """
    room = 8 * sum(map(len, step)) + len(step) + 1000 * alphabet
    used, taken, base = bytearray(room), bytearray(room), [0] * len(step)
    at, degree, top = 0, None, 0
    for s in sorted(range(len(step)), key=lambda s: (s > 0, -len(step[s]))):
        symbols = sorted(step[s]) or [0]
        if len(symbols) != degree:
            at, degree = used.find(0), len(symbols)
        p = symbols[0] if s == 0 else at
        while (b := p - symbols[0]) < 0 or taken[b] or any(used[b + c] for c in symbols):
            p = used.find(0, p + 1)
        for c in step[s]:
            used[b + c] = 1
        taken[b], base[s], top = 1, b, max(top, b)
        at = at if s == 0 else p
    out = np.full(top + alphabet + 1, -1 << 32, np.int64)
    for s, d in enumerate(step):
        for c, t in d.items():
            out[base[s] + c] = base[s] << 32 | base[t]
    return out


class Parser:
    """Automata of several languages over one alphabet: 0 between words, 1.. for letters, the last 64 for the parts of other letters."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(k for k, t in samples.items() if any(map(str.isalpha, t)))
        letters = Counter(c for k in self.languages for c in samples[k].lower() if c.isalpha())
        known = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS] if ord(c) < 65536]
        self.coded = len(known) + 1
        self.alphabet = self.coded + 64
        self.symbol = np.zeros(65536, np.uint8)
        for cp in range(65536):
            if unicodedata.category(chr(cp))[0] == "L":
                self.symbol[cp] = _CODED
        for i, c in enumerate(known):
            self.symbol[ord(c)] = i + 1
        self.steps, self.roots, self.bits = [], [], []
        for name in self.languages:
            s = self.symbols(samples[name].lower())
            table = double_array(suffix_automaton(s.tolist()), self.alphabet)
            # Where a phrase can't go on it ends, and a new one starts with the same symbol;
            # a symbol that the sample lacks is a phrase of its own.
            first = table[: self.alphabet]
            lacks = first >> 32 != 0
            self.steps.append(table)
            self.roots.append((np.where(lacks, 0, first), lacks))
            self.bits.append(math.log2(max(LEAST_SAMPLE, len(s))))
        #: Of a symbol that a sample lacks: a position in the largest sample, and which symbol it is.
        self.lack = max(self.bits, default=0.0) + math.log2(self.alphabet)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a lower-cased text; what lies between words is one 0."""
        if not text:
            return np.zeros(0, np.uint8)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol[np.minimum(cp, 65535)]
        if len(high := np.flatnonzero(cp > 65535)):
            s[high] = [_CODED if chr(c).isalpha() else 0 for c in cp[high]]
        keep = (s != 0) | np.r_[True, s[:-1] != 0]
        s, cp = s[keep], cp[keep]
        coded = s == _CODED
        if coded.any():
            size = np.where(coded, 3, 1)
            at, c = (np.cumsum(size) - size)[coded], cp[coded]
            s = np.repeat(s, size)
            for i in range(3):
                s[at + i] = self.coded + (c >> (12 - 6 * i) & 63)
        return s

    def phrases(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language]: number of phrases, and of symbols that the language's sample lacks."""
        pieces = [(i, p) for i, t in enumerate(texts) for p in range(0, len(t), PIECE)]
        out = np.zeros((2, len(texts), len(self.languages)), np.int64)
        size = np.array([min(PIECE, len(texts[i]) - p) for i, p in pieces])
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            n = size[part]
            lanes = np.zeros((int(n[0]), len(part)), np.int32)
            for k, j in enumerate(part):
                i, p = pieces[j]
                lanes[: n[k], k] = texts[i][p : p + PIECE]
            active = np.searchsorted(-n, -np.arange(len(lanes)), "left")  # lanes longer than each position
            doc = np.array([pieces[j][0] for j in part])
            for l, (step, (again, lacks)) in enumerate(zip(self.steps, self.roots, strict=True)):
                state, count, lack = np.zeros(len(part), np.int64), np.zeros(len(part), np.int32), np.zeros(len(part), np.int32)
                for pos, m in enumerate(active):
                    v = step[state[:m] + lanes[pos, :m]]
                    ends = np.flatnonzero(v >> 32 != state[:m])
                    c = lanes[pos, ends]
                    count[ends] += state[ends] != 0
                    lack[ends] += lacks[c]
                    v[ends] = again[c]
                    state[:m] = v & (1 << 32) - 1
                np.add.at(out[0, :, l], doc, count + (state != 0))
                np.add.at(out[1, :, l], doc, lack)
        return out[0], out[1]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits per letter) of each text; und and 0 for one without a letter."""
        symbols = [self.symbols((t or "").lower()) for t in texts]
        symbols = [s if s.any() else s[:0] for s in symbols]
        count, lack = self.phrases(symbols)
        bits = count * np.array(self.bits) + lack * self.lack
        out = []
        for s, b in zip(symbols, bits, strict=True):
            if not len(s) or not len(b):
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            best = int(b.argmin())
            share = np.exp2((b[best] - b) * TEMPER)
            letters = len(s) - int((s >= self.coded).sum()) * 2 // 3
            out.append((self.languages[best], float(1 / share.sum()), float(b[best] / letters)))
        return out


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text mod 3 is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def samples_of(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """The bounded training sample: the rows of each language whose salted ids hash lowest."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    first = Window.partitionBy("lang").orderBy("h", "text")
    n = F.length("text")
    pieces = [F.substring("text", (F.lit(i) * (n - ROW_CHARS // ROW_PIECES) / (ROW_PIECES - 1)).cast("int") + 1, F.lit(ROW_CHARS // ROW_PIECES)) for i in range(ROW_PIECES)]
    picked = (
        rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(7), F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
        .withColumn("text", F.when(n > ROW_CHARS, F.concat_ws("\n", *pieces)).otherwise(F.col("text")))
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_ROWS)
        .withColumn("before", F.sum(F.length("text") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < LANGUAGE_CHARS)
        .orderBy("lang", "n").collect()
    )
    out: dict[str, list[str]] = {}
    for r in picked:
        out.setdefault(r.lang, []).append(r.text)
    return {lang: "\n".join(texts) for lang, texts in out.items()}


def identify(spark: SparkSession, df: DataFrame, text_col: str, samples: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and bits_per_letter to the rows of ``df``, or to its columns ``keep``, from the text alone.

    A null text, one without a letter, or any text when nothing was learned,
    is ``und`` with score 0. Whole texts are read, however long. Ties go to the
    language that sorts first. All rows stay, repeated ones too, and an empty
    table has none. All columns stay, whatever their names, but those named as
    the added ones, which give way; one of them may be the text.
    """
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(samples)
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "bits_per_letter": T.DoubleType()}
    stays = [c for c in (df.columns if keep is None else keep) if c not in added]
    shape = T.StructType([*(df.schema[c] for c in stays), *(T.StructField(c, k) for c, k in added.items())])
    read = stays if text_col in stays else [*stays, text_col]
    df = df.select(*(F.col(f"`{c}`") for c in read))
    at, n = read.index(text_col), len(stays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(sent.value)
        parser = _parsers[key]
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                lang, score, bits = zip(*parser.judge(part.column(at).to_pylist()), strict=True)
                yield pa.record_batch([*part.columns[:n], pa.array(lang), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=shape.names)
        release()

    return df.mapInArrow(run, shape)


def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    samples = samples_of(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(spark, rows, "text", samples, ["doc_id", "held_out"])


def language_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are held out and which have a language."""
    return op2_cross_parsing(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") != UNKNOWN).alias("known"))


SQL = rf"SELECT doc_id, {CRC_SQL.format('doc_id')} % 3 = 1 AS held_out, regexp_matches(coalesce(text, ''), '\p{{L}}') AS known FROM documents"
