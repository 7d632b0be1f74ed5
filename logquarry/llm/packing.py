"""Best-fit packing of token sequences into bins of several permitted sizes.

Documents are cut into pieces of the largest size at most. A task takes its
pieces in bounded lots. In a lot the longest piece comes first and goes into
the open bin that it leaves the least room in; if it fits none, a bin of the
size that costs least per token it can expect to hold is opened. At the end
every bin shrinks to the smallest size that holds its contents. A lot is also
packed with each single size that its pieces allow as the only one opened, and
the plan of least total cost is taken, so the sizes are weighed together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.llm.common import stored

SIZES = (512, 1024, 2048, 4096)
#: What a bin costs besides its size, in tokens.
OVERHEAD = 16
#: Pieces that are packed together.
LOT = 20_000
#: Tokens that a task packs: the first as long as this makes few tasks, else up to the second.
TASK_TOKENS, FEW_TASKS, MOST_TASK_TOKENS = 20_000_000, 1000, 1_000_000_000

Plan = list[tuple[int, list[int]]]


def cost(size: int, overhead: int = OVERHEAD) -> int:
    return size + overhead


def _packed(lengths: Sequence[int], sizes: Sequence[int], overhead: int, only: int | None) -> Plan:
    """Bins (size, numbers of pieces) for lengths in descending order."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    left = sum(lengths)
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fits = [s for s in sizes if s >= max(n, only or 0)] or [s for s in sizes if s >= n]
            free = fits[0] if only else min(fits, key=lambda s: (cost(s, overhead) / min(s, left), s))
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (free - n, b))
        left -= n
    return [(next(s for s in sizes if s >= sum(lengths[i] for i in b)), b) for b in bins]


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> Plan:
    """The cheapest of the plans; lengths descend and none is above the largest size."""
    sizes = sorted(sizes)
    plans = [_packed(lengths, sizes, overhead, only) for only in (None, *sizes)]
    return min(plans, key=lambda p: (sum(cost(s, overhead) for s, _ in p), len(p)))


def pack(df: DataFrame, id_col: str, tokens: F.Column, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, lot: int = LOT) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin_id, bin_size, position (of its first token in the bin).

    ``tokens`` gives the length of a row; null counts as 0. A row without
    tokens has no piece. Pieces of the largest size fill bins of their own.
    The same rows give the same bins whatever their order: they are dealt out
    by hashed id and sorted; rows that repeat an id and a length are alike.
    A text of any length is cut into as many pieces as it needs, an empty table
    has none, and of other columns only what ``tokens`` names is read, once.
    """
    largest, kind = max(sizes), df.schema[id_col].dataType
    rows = stored(df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n")).where("n > 0"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = min(total // TASK_TOKENS + 1, max(FEW_TASKS, total // MOST_TASK_TOKENS + 1))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(largest).cast("long"))).alias("start")
    pieces = rows.select("id", "n", cut).select("id", (F.col("start") / largest).cast("int").alias("piece"), "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal first
            rows = sorted(rows, key=lambda r: -r[3])
            out = []
            for size, bin_ in best_fit([r[3] for r in rows], sizes, overhead):
                at = 0
                for i in bin_:
                    out.append((*rows[i], first, size, at))
                    at += rows[i][3]
                first += 1
            cols = zip(*out, strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "piece", "start", "n_tokens", "bin_id", "bin_size", "position"])

        types = None
        for b in batches:
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(held) >= lot:
                yield packed(held[:lot])
                held = held[lot:]
        if held:
            yield packed(held)

    dealt = pieces.repartition(int(tasks), F.xxhash64("id", "piece")).sortWithinPartitions("id", "piece", "n_tokens")
    columns = {"id": kind, "piece": T.IntegerType(), "start": T.LongType(), "n_tokens": T.LongType(), "bin_id": T.LongType(), "bin_size": T.IntegerType(), "position": T.IntegerType()}
    out = dealt.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in columns.items()]))
    return out.withColumnRenamed("id", id_col)


def word_tokens(text_col: str) -> F.Column:
    """Words and one end; 0 for a text that is null or empty."""
    return F.when(F.length(text_col) > 0, F.regexp_count(text_col, F.lit(r"\S+")) + 1)


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", word_tokens("text"))


def packed_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each packed document its tokens and pieces, from the bins; no bin holds more than its size, nor twice the same place."""
    packed = op1_best_fit(spark, sf_dir)
    # a piece begins where those before it in its bin end
    before = F.sum("n_tokens").over(Window.partitionBy("bin_id").orderBy("position"))
    fits = (F.col("position") == before - F.col("n_tokens")) & (before <= F.col("bin_size")) & (F.col("start") == F.col("piece") * max(SIZES))
    return packed.withColumn("fits", fits).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.min("fits").alias("fits"))


SQL = rf"""
SELECT doc_id, n AS n_tokens, (n + {max(SIZES) - 1}) // {max(SIZES)} AS n_pieces, true AS fits
FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents WHERE text <> '')
"""
