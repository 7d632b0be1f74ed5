"""Benchmark decontamination with an Aho-Corasick automaton over word numbers.

A document word is hit when it lies in WINDOW consecutive words that also
follow each other in a benchmark item, or in the words of a shorter item. The
automaton's letters are words, by number. Of a long item it holds every ANCHOR
words from a multiple of ANCHOR on: each window has one of these inside, so an
occurrence of an anchor is compared with the item around it, WINDOW - ANCHOR
words to both sides, and what agrees over WINDOW words or more is hit. That is
a node for each word of the benchmark, where whole windows would take WINDOW.
A text is read once, and word numbers map back to offsets of the original.

The benchmark is the stated query set. It is cut into segments that overlap by
a window less a word and stored in files of about BLOCK_BYTES; tasks read these
from the shared folder. A benchmark of one file, the usual case, is one
automaton that a worker builds once. Of a larger one a task holds HELD_BYTES of
documents and takes them through one automaton after the other, so documents
are scanned once, nothing is broadcast, and memory does not grow with the
benchmark; only time does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import release, text_bytes, work_dir

WINDOW = 13
ANCHOR = (WINDOW + 1) // 2
#: Bytes of benchmark text in one automaton, which is some 30 times as large, and words of a segment.
BLOCK_BYTES, SEGMENT_WORDS = 8 << 20, 1 << 14
#: Bytes of documents that a task holds while it goes through several automata.
HELD_BYTES = 64 << 20

#: Maps A-Z to a-z and every ASCII byte that is neither letter nor digit to a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
#: The block that a worker built last.
_built: dict[str, Block] = {}


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_NORMAL).split()


def segments_of(raw: bytes, size: int = SEGMENT_WORDS) -> Iterator[bytes]:
    """The words of an item in pieces that hold all its windows; no words, no piece."""
    w = words_of(raw)
    for i in range(0, max(1, len(w) - WINDOW + 1), size):
        if w:
            yield b" ".join(w[i : i + size + WINDOW - 1])


class Block:
    """The automaton of some segments (item, words). Its values: for an anchor's or a short item's occurrence, where it stands in ``words`` and in which items."""

    def __init__(self, segments: Iterable[tuple[str, bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.words = [-1] * WINDOW
        # pattern -> (words around it, if it is an anchor) -> [place, items]
        patterns: dict[tuple, dict[tuple, list]] = {}
        for item, text in segments:
            w = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in text.split()]
            first, short = len(self.words), len(w) < WINDOW
            self.words += (*w, *[-1] * WINDOW)
            for i in (0,) if short else range(0, len(w) - ANCHOR + 1, ANCHOR):
                at = first + i
                around = () if short else tuple(self.words[at + ANCHOR - WINDOW : at + WINDOW])
                patterns.setdefault(tuple(w if short else w[i : i + ANCHOR]), {}).setdefault(around, [None if short else at, set()])[1].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, uses in patterns.items():
            self.automaton.add_word(key, (len(key), list(uses.values())))
        if patterns:
            self.automaton.make_automaton()

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words of a text (end exclusive, unordered) and the items found."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not len(self.automaton) or not w:
            return spans, items
        seq, own = tuple(map(self.numbers.get, w, repeat(0))), self.words
        for end, (length, uses) in self.automaton.iter(seq):
            start, stop = end - length + 1, end + 1
            for at, names in uses:
                lo, hi = start, stop
                if at is not None:
                    far = at - start
                    while lo > 0 and start - lo < WINDOW - ANCHOR and seq[lo - 1] == own[far + lo - 1]:
                        lo -= 1
                    while hi < len(seq) and hi - stop < WINDOW - ANCHOR and seq[hi] == own[far + hi]:
                        hi += 1
                    if hi - lo < WINDOW:
                        continue
                spans.append((lo, hi))
                items |= names
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def char_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted word spans as code-point offsets of the original text."""
    if not spans:
        return []
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_NORMAL))]
    out, byte, point = [], 0, 0
    for edge in (x for s, e in spans for x in (at[s][0], at[e - 1][1])):
        point += len(raw[byte:edge].decode())
        byte = edge
        out.append(point)
    return list(zip(out[::2], out[1::2], strict=True))


def _stored_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> str:
    """The folder of the files of segments (item, words)."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), text_bytes(F.col(f"`{text_col}`")).alias("raw"))
    total = rows.agg(F.sum(F.length("raw"))).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column("item").to_pylist(), b.column("raw"), strict=True):
                found = list(segments_of(raw.as_py()))
                yield pa.record_batch([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item", "words"])

    folder = work_dir(spark)
    rows.mapInArrow(cut, "item string, words binary").repartition(-(-total // block_bytes) or 1).write.parquet(folder)
    return folder


def _block(folder: str, name: str) -> Block:
    key = f"{folder}/{name}"
    if key not in _built:
        _built.clear()
        where, root = pafs.FileSystem.from_uri(folder)
        t = pq.read_table(f"{root}/{name}", filesystem=where)
        _built[key] = Block(zip(t["item"].to_pylist(), t["words"].to_pylist(), strict=True))
    return _built[key]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def find_passages(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """Per document: its id (with ``whole`` all its columns, none of which may be named as an added one), n_words, spans of hit words, their character offsets (flat: start, end, start, ...), items found.

    Whole texts are read, long ones as well; a null or empty text has no
    words. An empty benchmark hits nothing, an empty table has no rows. An
    item with a null id is named "", and items that share an id count as one.
    Spans that overlap or touch are one, and so ties cannot arise. Two rows
    with one document id stay two rows. Other columns are not looked at, and
    without ``whole`` not read.
    """
    folder = _stored_blocks(spark, benchmark, item_col, item_text_col, block_bytes)
    ints = T.ArrayType(T.IntegerType())
    keep = docs.columns if whole else [id_col]
    at = [*keep, text_col].index(text_col)
    shape = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("starts", ints), T.StructField("ends", ints), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("chars", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        names = sorted(f.base_name for f in where.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
        for group in _held(batches, HELD_BYTES if len(names) > 1 else 0):
            texts = [raw for b in group for raw in b.column(at).cast(pa.binary()).fill_null(b"")]
            n, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for name in names:
                block = _block(folder, name)
                for i, raw in enumerate(texts):
                    w = words_of(raw.as_py())
                    n[i], found = len(w), block.hits(w)
                    spans[i] += found[0]
                    items[i] |= found[1]
            names = names[::-1]  # the next group begins with the automaton that is there
            done = 0
            for b in group:
                part = slice(done, done + b.num_rows)
                done += b.num_rows
                words = [merged(s) for s in spans[part]]
                chars = [[p for se in char_spans(raw.as_py(), s) for p in se] if s else [] for raw, s in zip(texts[part], words, strict=True)]
                lists = pa.list_(pa.int32())
                yield pa.record_batch([*b.columns[: len(keep)], pa.array(n[part], pa.int64()), pa.array([[x for x, _ in s] for s in words], lists), pa.array([[x for _, x in s] for s in words], lists), pa.array([sorted(x) for x in items[part]], pa.list_(pa.string())), pa.array(chars, lists)], names=shape.names)
        release()

    read = keep if text_col in keep else [*keep, text_col]
    return docs.select(*(F.col(f"`{c}`") for c in read)).mapInArrow(run, shape)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated: some word is hit, and at least a twentieth of all are."""
    n = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", n).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return judged(find_passages(spark, docs, "doc_id", "text", bench)).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '{_CLASS}'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_FOLD.format("text")}, '{_CLASS}') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g FROM bi),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
da AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, i, k FROM (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g FROM da) x JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS all_items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
