"""Line dedup: later copies of repeated runs of lines are deleted.

The documents are sequences of line ids; their suffixes are sorted by prefix doubling, restricted at
every step to suffixes whose prefix is repeated (all others are already in their place): the rank of
the first 2 ** (j + 1) lines follows from the ranks of the first and the next 2 ** j. Ranks keep the
order of the suffix array, and the suffixes of equal rank at step j are its intervals of longest
common prefix of at least 2 ** j lines. Every place takes the longest interval of at least `min_lines` lines in
which it is not the first occurrence (by id, then place), and the run of that length is deleted there.
A maximal repeated run of another length is covered by such runs that overlap, and nothing else is:
what precedes a deleted line's copy in its run also precedes its earlier occurrence. With more than one, repeated lines whose neighbours differ
stay, and so do all copies of shorter documents.

An interval is aggregated before it is joined back. Those that hold more than one in `HEAVY` of all
places, at most `HEAVY` intervals, are broadcast, so that a line of a third of all documents meets in no single task.

Lines are what line ends separate; lines without a word are no part of a run and always stay. They
are compared by 96-bit hashes.

Defined results: null and empty texts have no lines and stay; of rows that are repeated the first in
order of id (null first) and of a hash of the text stays, wholly equal rows count as one; an empty table gives no
rows; very long texts are sequences like all others; columns other than doc_id and the text are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._store import spill

SOLID = r"[^\x20\x09-\x0D]"
#: Intervals of more than one in so many of all repeated places are joined by broadcast: there are fewer of them.
HEAVY = 10_000


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Classes of equal `by` that occur more than once, with a rank in the order of `by` and their first occurrence."""
    classes = rows.groupBy(*by).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "key", "p")).alias("first")).filter("copies > 1")
    # ids of sorted partitions rise with the order; they are fixed by writing them
    return spill(classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")[0]


def _placed(rows: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """The rows of repeated classes with their rank; whether they are not the first of their class."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    heavy = classes.filter(HEAVY * F.col("copies") > total).select(*by, F.col("rank").alias("h_rank"), F.col("first").alias("h_first"))
    rest = classes.filter(HEAVY * F.col("copies") <= total).select(*[F.col(c).alias(f"r_{c}") for c in by], "rank", "first", F.lit(True).alias("r_open"))
    # rows that have found their class are dealt by their own place and match no other
    found = rows.join(F.broadcast(heavy), by, "left").withColumn("open", F.col("h_rank").isNull())
    found = found.withColumn("deal", F.when(F.col("open"), F.col(by[0]).cast("bigint")).otherwise(F.xxhash64("key", "p")))
    match = (F.col("deal") == F.col(f"r_{by[0]}")) & (F.col(by[1]) == F.col(f"r_{by[1]}")) & (F.col("open") == F.col("r_open"))
    found = found.join(rest, match, "left").withColumn("rank", F.coalesce("h_rank", "rank")).withColumn("first", F.coalesce("h_first", "first")).filter("rank is not null")
    first = (F.col("first.key") == F.col("key")) & (F.col("first.p") == F.col("p"))
    return spill(found.select("doc_id", "key", "p", "i", "rank", (~first).alias("later")), "line-suffixes")[0]


def repeated_runs(docs: DataFrame, min_lines: int = 1) -> tuple[DataFrame, DataFrame]:
    """Occurrences of repeated runs, and the places of all repeated lines.

    The first: key, p, lines (the length, doubling from min_lines), later (not the first occurrence). The
    second: key, p (number among the lines with a word), i (number among all lines). `docs` has
    doc_id, key and text.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("a"), F.hash(x).alias("b"), x.rlike(SOLID).alias("solid")))
    rows = docs.select("doc_id", "key", F.posexplode(F.filter(lines, lambda x: x["solid"])).alias("p", "x"))
    rows = rows.select("doc_id", "key", "p", F.col("x.i").alias("i"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    level = _placed(rows, _ranked(rows, ["a", "b"]), ["a", "b"])
    places, length = level.select("key", "p", "i"), 1
    found = level.filter(F.lit(min_lines <= 1)).select("key", "p", F.lit(1).alias("lines"), "later")
    while not level.isEmpty():
        # the run that follows; on the way to min_lines the last two overlap
        step = length if length >= min_lines else min(length, min_lines - length)
        ahead = Window.partitionBy("key").orderBy("p").rangeBetween(step, step)
        pairs = level.select("doc_id", "key", "p", "i", F.col("rank").alias("low"), F.max("rank").over(ahead).alias("high")).filter("high is not null")
        level = _placed(pairs, _ranked(pairs, ["low", "high"]), ["low", "high"])
        length += step
        if length >= min_lines:
            found = found.unionByName(level.select("key", "p", F.lit(length).alias("lines"), "later"))
    return found, places


def dedup_lines(docs: DataFrame, min_lines: int = 1, column: str = "text") -> DataFrame:
    """`docs` with the text without later copies, and _l_lines, _l_removed (numbers of lines with a word), _l_run (most neighbouring ones deleted)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    rows = docs.select(whole.alias("_l_row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("_l_text")).withColumn("_l_key", F.xxhash64("doc_id", "_l_text"))
    short = rows.select("doc_id", F.col("_l_key").alias("key"), F.col("_l_text").alias("text"))
    found, places = repeated_runs(short, min_lines)
    # at each place the run of the longest interval in which it is not the first; all deleted lines are repeated ones
    runs = found.filter("later").groupBy("key", "p").agg(F.max("lines").alias("lines"))
    before = Window.partitionBy("key").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = places.distinct().join(runs, ["key", "p"], "left").withColumn("end", F.max(F.col("p") + F.col("lines")).over(before)).filter("end > p")
    # lines in a row have the same distance from their number among the deleted ones
    gone = gone.withColumn("stretch", F.col("p") - F.row_number().over(Window.partitionBy("key").orderBy("p")))
    gone = gone.groupBy("key", "stretch").agg(F.collect_list("i").alias("at"), F.count("*").alias("lines"))
    gone = gone.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("_l_gone"), F.max("lines").alias("_l_run")).withColumnRenamed("key", "_l_key")  # lines of one document
    out = rows.join(gone, "_l_key", "left").withColumn("_l_all", F.split("_l_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l_all") - 1), F.col("_l_gone"))
    text = F.when(F.col("_l_gone").isNull(), F.col(f"_l_row.`{column}`")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_l_all", i)), "\n"))
    counts = [
        F.size(F.filter("_l_all", lambda x: x.rlike(SOLID))).cast("bigint").alias("_l_lines"),
        F.coalesce(F.size("_l_gone"), F.lit(0)).cast("bigint").alias("_l_removed"),
        F.coalesce("_l_run", F.lit(0)).cast("bigint").alias("_l_run"),
    ]
    return out.select(*[(text if c == column else F.col(f"_l_row.`{c}`")).alias(c) for c in docs.columns], *counts)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT a.doc_id, a.p, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.p) AS n
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.p = a.p + 1),
d AS (
  SELECT doc_id, p FROM w WHERE n > 1 UNION SELECT doc_id, p + 1 FROM w WHERE n > 1),
k AS (
  SELECT l.doc_id, count(s.p) AS n_lines, count(d.p) AS n_removed,
         sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE d.p IS NULL), '')) AS kept_sha256
  FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.i = s.i
         LEFT JOIN d ON s.doc_id = d.doc_id AND s.p = d.p
  GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, kept_sha256 FROM k
"""
