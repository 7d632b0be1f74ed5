"""Removal of repeated line runs by a suffix array over line numbers, in DataFrame operations only.

Lines that occur once end every run, so only repeated lines get a number, and
only positions in runs of MIN_WORDS words or more go on. Prefix doubling then
ranks the suffixes of these sequences by their first 2, 4, 8, ... lines: a
suffix's new rank is the place of (its rank, the rank of the suffix as many
lines on) among all distinct pairs in global order. Suffixes of one rank are an
interval of the suffix array whose longest common prefix is at least as long;
an interval of one suffix repeats nothing, and its position is dropped.

A maximal repeated run of MIN_WORDS words or more is the union of its shortest
pieces of so many words, read forwards from each of its lines and backwards
from each. So the pieces decide: one whose content begins earlier elsewhere
(by document id, then position) is deleted, and by that exactly the later
copies of all such maximal runs. A piece is named by its number of lines and
two overlapping prefixes of the largest power of two that it holds, both of
them intervals. A position is ranked by no more lines than a piece around it
can have, which is some twice as many as make up MIN_WORDS words.

Distinct pairs are ranked, not positions, so a line or run that very many
documents hold is one row there; joins back to positions have such a key on
one side only, where Spark splits it. What is exchanged is narrow: hashes,
numbers and places of lines. Texts are scanned, for each of line counts,
positions and results, and not copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.common import discard, stored, work_dir

MIN_WORDS = 50


def _lines(rows: DataFrame) -> DataFrame:
    """(key, pos, line, h, g): two independent hashes name a line, 128 bits."""
    lines = rows.select("key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("key", "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _ranked(repeated: DataFrame, by: list[str], folder: str) -> DataFrame:
    """What occurs more than once of the columns ``by``, with a number that grows in its global order."""
    often = repeated.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    return stored(often.orderBy(*by).withColumn("number", F.monotonically_increasing_id()), folder)


def _joined(positions: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    # never a broadcast, as ranks grow with the corpus; a sort-merge join is one that Spark splits at a hot key
    return positions.join(ranks.hint("merge"), by)


def _places(at: DataFrame, least: int) -> DataFrame:
    """(key, pos, number, most, ts) of the lines in runs of ``least`` words, from (key, pos, words, number).

    ts has the numbers of lines of the pieces that begin there: the fewest with
    ``least`` words from a line on, and the fewest up to a line. No piece around
    the line needs it ranked by more than ``most`` lines.
    """
    doc = Window.partitionBy("key").orderBy("pos")
    at = at.withColumn("gap", F.col("pos") - F.row_number().over(doc))
    run = Window.partitionBy("key", "gap")
    # words of the run up to the line and before it
    at = at.withColumn("upto", F.sum("words").over(run.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("words"))
    at = at.withColumns({"first": F.min("pos").over(run), "last": F.max("pos").over(run), "all": F.sum("words").over(run)}).where(F.col("all") >= least)
    end = F.min("pos").over(run.orderBy("before").rangeBetween(least, Window.unboundedFollowing)) - 1
    start = F.max("pos").over(run.orderBy("upto").rangeBetween(Window.unboundedPreceding, -least)) + 1
    at = at.withColumn("end", F.coalesce(end, F.when(F.col("all") - F.col("before") >= least, F.col("last"))))
    at = at.withColumn("start", F.coalesce(start, F.when(F.col("upto") >= least, F.col("first"))))
    reach = F.coalesce("end", "last")
    at = at.withColumn("most", F.greatest(reach, F.lead(reach).over(run.orderBy("pos"))) - F.col("pos") + 1)
    own = F.struct(F.col("pos").alias("place"), F.col("number"), F.col("most"), (F.col("end") - F.col("pos") + 1).alias("t"))
    back = F.struct(F.col("start").alias("place"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("int").alias("most"), (F.col("pos") - F.col("start") + 1).alias("t"))
    both = at.select("key", F.explode(F.array(own, back)).alias("x")).select("key", "x.*").where("place is not null")
    return both.groupBy("key", F.col("place").alias("pos")).agg(F.max("number").alias("number"), F.max("most").alias("most"), F.collect_set("t").alias("ts"))


def _compared(at: DataFrame, k: int) -> DataFrame:
    """(key, pos, r, s, t, most, ts): pieces of k to 2k - 1 lines, and with null t what 2k lines are ranked by.

    r and s are the ranks by k lines at the two places that decide. ``at`` is
    (key, pos, number, most, ts); all lookups stay in a document.
    """
    ahead = F.max("number").over(Window.partitionBy("key").orderBy("pos").rangeBetween(k, k))
    pieces = F.transform(F.filter("ts", lambda t: (t >= k) & (t < 2 * k)), lambda t: F.struct((F.col("pos") + t - k).alias("place"), t.alias("t")))
    own = F.array(F.struct(F.col("pos").alias("place"), F.lit(None).cast("int").alias("t")))
    rows = at.withColumn("ahead", ahead).withColumn("q", F.explode(F.concat(own, pieces)))
    rows = rows.select("key", "pos", F.col("number").alias("r"), "ahead", "most", "ts", "q.place", "q.t")
    there = F.max(F.when(F.col("t").isNull(), F.col("r"))).over(Window.partitionBy("key", "place"))
    rows = rows.withColumn("s", F.when(F.col("t").isNull(), F.when(F.col("most") >= 2 * k, F.col("ahead"))).otherwise(there)).where("s is not null")
    return rows.select("key", "pos", "r", "s", "t", "most", F.when(F.col("t").isNull(), F.filter("ts", lambda t: t >= 2 * k)).alias("ts"))


def repeated_runs(rows: DataFrame, least: int) -> DataFrame:
    """(key, runs): the lines to delete of each row of (key, text) that has any, as an array of (start, end), end exclusive.

    Keys are unique, not null, and in the order in which copies come first.
    """
    spark = rows.sparkSession
    folder = work_dir(spark)
    ranks = _ranked(_lines(rows), ["h", "g"], folder)
    lines = _lines(rows).select("key", "pos", F.regexp_count("line", F.lit(r"\S+")).alias("words"), "h", "g")
    at, k, pieces = _places(_joined(lines, ranks, ["h", "g"]), least), 1, None
    while True:
        level = stored(_compared(at, k), folder)
        found = level.where("t is not null").select("key", "pos", "t", "r", "s")
        pieces = found if pieces is None else pieces.unionByName(found)
        if not level.where("t is null and size(ts) > 0").head(1):  # no piece has so many lines
            break
        ranks = _ranked(level.where("t is null"), ["r", "s"], folder)
        at, k = _joined(level.where("t is null"), ranks, ["r", "s"]).select("key", "pos", "number", "most", "ts"), 2 * k
    place = F.struct("key", "pos")
    # written first: a join of two plain exchanges is one that Spark can split at a run of many copies
    first = stored(pieces.groupBy("t", "r", "s").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), folder)
    later = _joined(pieces, first, ["t", "r", "s"]).where(place != F.col("first"))
    # islands of overlapping or touching pieces
    later = later.select("key", F.col("pos").alias("start"), (F.col("pos") + F.col("t")).alias("end"))
    doc = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    later = later.withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    islands = later.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = stored(islands.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")))
    discard(spark, folder)
    return runs


def _without(lines: F.Column, runs: F.Column) -> F.Column:
    """The lines outside sorted runs that don't touch: a slice before each run and one after the last."""
    end = lambda i: F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))
    stop = lambda i: F.coalesce(F.get(runs, i)["start"], F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(lines, end(i) + 1, stop(i) - end(i))))


def dedup_lines(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``df`` as (row, text, n_lines, runs): row is the struct of the input's columns, text what stays.

    Lines end at a line feed; a text without one is one line, and so is an
    empty text. A null text stays null and has no lines. A line run counts as
    repeated when it holds ``min_words`` words (runs of non-blank characters)
    or more and the same lines in the same order begin earlier: at a smaller
    id, in an earlier row of the same id, or higher up in the text, overlaps
    included. A null id comes after all others. runs lists the deleted lines as
    (start, end), null if there are none; a text that loses all lines is empty.
    Extra columns, whatever their names, are kept inside row. An empty table
    gives no rows.

    ``df`` is read several times and must give the same rows each time. Only if
    ids repeat or are null it is written down first, to tell its rows apart.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    own = F.col(f"row.`{id_col}`")
    n, ids = rows.agg(F.count("*"), F.count_distinct(own)).first()
    if n == ids:
        rows = rows.withColumn("key", own)
    else:
        rows = stored(rows.withColumn("key", F.struct(own.isNull().alias("null"), own.alias("id"), F.monotonically_increasing_id().alias("at"))))
    runs = repeated_runs(rows.select("key", F.col(f"row.`{text_col}`").alias("text")), min_words)
    out = rows.join(runs, "key", "left")
    lines = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    text = F.when(F.col("runs").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.concat_ws("\n", _without(lines, F.col("runs"))))
    return out.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), "runs")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    deleted = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"]), F.lit(0))
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"), "text")


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '\\S+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
f AS (SELECT a.doc_id, a.pos AS start, min(b.pos) AS stop FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY ALL),
g AS (SELECT b.doc_id, max(a.pos) AS start, b.pos AS stop FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY b.doc_id, b.pos),
p AS (SELECT * FROM f UNION SELECT * FROM g),
k AS (SELECT p.doc_id, start, stop, list_slice(ls, start, stop) AS piece FROM p JOIN d USING (doc_id)),
o AS (SELECT piece, min((doc_id, start)) AS first FROM k GROUP BY piece),
x AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM k JOIN o USING (piece) WHERE (doc_id, start) <> first),
r AS (SELECT w.doc_id, count(x.pos) AS n_deleted, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY w.pos) FILTER (WHERE x.pos IS NULL) AS kept
  FROM w LEFT JOIN x ON w.doc_id = x.doc_id AND w.pos = x.pos GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM documents LEFT JOIN r USING (doc_id)
"""
