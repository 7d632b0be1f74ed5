"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes it as Parquet and reads it for the
next. All stages but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, rows that
repeat an id or all of a row, ids that are null, empty tables, and extra columns
with any names, which stay. Rows that repeat an id are judged each by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from logquarry.llm.common import broadcast_if_small, discard, scratch, stored
from logquarry.workfolder import work_folder


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Columns by number, out of the way of columns that operators add, and which of them is the text."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language, the likeliest of those learned; those without a letter go."""
    samples = language_id.samples_of(docs.where(~language_id.held_out("doc_id")), "doc_id", "text", "lang")
    rows, text = _numbered(docs)
    return _named(language_id.identify(spark, rows, text, samples).where(F.col("lang_pred") != language_id.UNKNOWN), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs of 50 words or more; a document of which no word is left by that goes."""
    out = line_dedup.dedup_lines(docs, "doc_id", "text")
    text = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    stays = F.col("runs").isNull() | F.col("text").rlike(r"\S")
    return out.where(stays).select(*(F.when(F.col("runs").isNull(), F.col(f"row.`{c}`")).otherwise(text[c]).alias(c) if c in text else F.col(f"row.`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8): the first by id."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        rows, key = docs, "doc_id"
    else:  # ids that repeat or are null can't tell rows apart
        names = {c.lower() for c in docs.columns}
        key = next(k for i in range(len(names) + 1) if (k := f"row_number_{i}") not in names)
        rows = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    gone = stored(near_dedup.near_groups(rows, key, "text").where("not kept").select(key))
    return rows.join(broadcast_if_small(gone, gone.count()), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words are benchmark passages."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, text = _numbered(docs)
    found = decontaminate.judged(decontaminate.find_passages(spark, rows, text, text, bench, whole=True))
    return _named(found.where("not contaminated"), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in bins."""
    return packing.pack(docs, "doc_id", packing.word_tokens("text"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_passages),
    ("pack", sequences),
]

#: Several stages have no SQL form; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = work_folder(spark)
        with scratch(spark):
            done = stored(stage(spark, docs, sf_dir), folder)
        if last:
            discard(spark, last)
        docs, last = done, folder
    return STAGES[-1][1](spark, docs, sf_dir)
