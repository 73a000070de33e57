"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

A document is the sequence of its lines that are not blank. Prefix doubling
ranks all suffixes by their first 1, 2, 4, ... lines: the rank of a longer
prefix is that of the pair of ranks half as far apart. Only repeated prefixes
are ranked; the others end no interval of interest and drop out, so each round
is smaller than the one before. Ranks keep the order of the pairs: they number
the rows of a range-partitioned, sorted table.

Suffixes of one rank after d lines form the intervals of the suffix array whose
longest common prefix has d lines or more. Ranks are doubled from ``min_lines``
on until no suffix is tied. In text order, all but an interval's first suffix
begin a later copy of d lines. Suffixes that follow one another in their text,
and whose intervals begin at places that do so too, join into one run: as the
next suffix is tied no more at d lines, the last one's d lines end where the
common prefix ends, so the run has its full length although only powers of two
are ranked. Every run of ``min_lines`` or more lies in the runs of the first of
these rounds, which are deleted; the later rounds tell how long they are. A
single repeated line is a run of its own if it has ``min_chars`` characters.

Rows equal in id and text give each line twice, at one place; that makes no
copy of it, as only a line's first place counts.

Every aggregation combines on the map side and every join has one row for each
rank on one side, so a line that is a third of all rows is only split, never
gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

MIN_LINES = 2
MIN_CHARS = 20
DOC = ("id", "h")


def _lines(docs: DataFrame) -> DataFrame:
    """(id, h, s, i, l1, l2, chars): line i of the text is the s-th that is not blank."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    rows = docs.select(*DOC, F.posexplode(F.filter(numbered, lambda x: F.trim(x["line"]) != "")).alias("s", "x"))
    line = F.col("x.line")
    return rows.select(*DOC, "s", F.col("x.i").alias("i"), F.xxhash64(line).alias("l1"), F.xxhash64(line, F.lit(1)).alias("l2"), F.length(line).alias("chars"))


def _ranks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, rank, first): the repeated pairs, numbered in their order, and where each occurs first."""
    repeated = rows.groupBy(a, b).agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "s")).alias("first")).filter("n > 1").drop("n")
    return cut(repeated.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id()))


def _ranked(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.join(_ranks(rows, a, b), [a, b]).withColumn("later", F.struct(*DOC, "s") > F.col("first")).drop(a, b).withColumnRenamed("rank", "r")


def _ahead(rows: DataFrame, by: int) -> DataFrame:
    """Adds the rank ``by`` lines further on; drops suffixes that have none."""
    w = Window.partitionBy(*DOC).orderBy("s").rangeBetween(by, by)
    return rows.select(*DOC, "s", "r", F.first("r").over(w).alias("r2")).filter("r2 is not null")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h, removed, n_runs, longest_run): the lines of each document of ``docs`` (id, h, text) that are later copies."""
    if min_lines < 2:
        raise ValueError("min_lines is 2 or more; single lines go by min_chars")
    single = cut(_ranked(_lines(docs), "l1", "l2"))
    suffixes, depth = single.select(*DOC, "s", "r"), 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        suffixes = cut(_ranked(_ahead(suffixes, step), "r", "r2"))
        depth += step
    copies, deeper = [], suffixes
    while True:
        copies.append(deeper.filter("later").select(*DOC, "s", F.lit(depth).alias("lines"), F.struct("first.id", "first.h", (F.col("first.s") - F.col("s")).alias("shift")).alias("way")))
        deeper = cut(_ranked(_ahead(deeper.select(*DOC, "s", "r"), depth), "r", "r2"))
        if deeper.isEmpty():
            break
        depth *= 2
    starts = suffixes.filter("later").select(*DOC, "s", F.lit(None).cast("int").alias("i"), F.lit(False).alias("alone"), F.lit(1).alias("starts"))
    marks = single.select(*DOC, "s", "i", (F.col("later") & (F.col("chars") >= min_chars)).alias("alone"), F.lit(0).alias("starts")).unionByName(starts)
    w = Window.partitionBy(*DOC).orderBy("s")
    covered = marks.withColumn("in_run", F.max("starts").over(w.rangeBetween(1 - min_lines, 0)) == 1).filter("i is not null and (in_run or alone)")
    begins = F.lag("s").over(w).isNull() | (F.lag("s").over(w) < F.col("s") - 1)
    # one line after another of a document: its lines that go, and of its copies of more lines the longest
    lines = covered.select(*DOC, "i", begins.cast("long").alias("begins"), F.lit(1).alias("run"))
    runs = _runs(copies).select(*DOC, F.lit(None).cast("int").alias("i"), F.lit(0).cast("long").alias("begins"), "run")
    return lines.unionByName(runs).groupBy(*DOC).agg(F.collect_set("i").alias("removed"), F.sum("begins").alias("n_runs"), F.max("run").cast("long").alias("longest_run"))


def _runs(copies: list[DataFrame]) -> DataFrame:
    """(id, h, run): the lengths of the runs that later copies (id, h, s, lines, way) join into; ``way`` tells where the first copy lies."""
    every = copies[0]
    for more in copies[1:]:
        every = every.unionByName(more)
    w = Window.partitionBy(*DOC).orderBy("lines", "way", "s")
    same = (F.lag("lines").over(w) == F.col("lines")) & (F.lag("way").over(w) == F.col("way")) & (F.lag("s").over(w) >= F.col("s") - 1)
    begun = every.withColumn("begun", F.when(~F.coalesce(same, F.lit(False)), F.col("s")))
    return begun.select(*DOC, (F.col("s") - F.last("begun", True).over(w) + F.col("lines")).cast("int").alias("run"))


def deduplicate(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (id, text, ...) with kept, n_lines, n_removed, n_runs, longest_run; nothing else is changed and no row is lost.

    ``n_runs`` counts blocks of deleted lines, ``longest_run`` the lines of the
    longest later copy of a run whose first place is the same for all of it.

    "Later" is by id (nulls first), then line. Rows equal in id and text are
    one document: each keeps and loses the same lines. Null texts stay null
    and have no lines; empty ones have one, blank, line. Blank lines are never
    deleted and separate nothing. An empty table gives an empty result.
    """
    keyed = docs.withColumn("h", F.xxhash64("text"))
    gone = later_copies(keyed.select(*DOC, F.col("text").cast("string").alias("text")), min_lines, min_chars)
    gone = gone.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "removed", "n_runs", "longest_run").hint("shuffle_hash")
    joined = keyed.join(gone, keyed["id"].eqNullSafe(gone["_id"]) & (keyed["h"] == gone["_h"]), "left")
    # the split text is a column of its own, for it is looked into line by line
    split = joined.select(*[keyed[c] for c in docs.columns], F.split(keyed["text"], "\n", -1).alias("__lines"), "removed", F.coalesce("n_runs", F.lit(0).cast("long")).alias("__n_runs"), F.coalesce("longest_run", F.lit(0).cast("long")).alias("__longest"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    return split.select(
        *docs.columns, kept.alias("kept"), F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.col("__n_runs").alias("n_runs"), F.col("__longest").alias("longest_run"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """documents with the later copies taken out of their texts; all rows and columns stay."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    inner = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"), F.struct(*[docs[c].alias(n) for c, n in zip(docs.columns, names)]).alias("row"))
    return deduplicate(inner).select(*[(F.col("kept") if c == "text" else F.col(f"row.{n}")).alias(c) for c, n in zip(docs.columns, names)])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l WHERE trim(line, ' ') <> ''
), p AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM n
), c AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, s) > 1 AND length(line) >= 20 AS alone,
    next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, s) > 1 AS starts
  FROM p
), r AS (
  SELECT *, alone OR starts OR coalesce(lag(starts) OVER (PARTITION BY doc_id ORDER BY s), false) AS gone FROM c
), b AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), false) AS begins FROM r
), v AS (
  SELECT doc_id, s, CAST(1 AS BIGINT) AS d, dense_rank() OVER (ORDER BY line) AS r, doc_id AS fd, s AS fs FROM n QUALIFY count(*) OVER (PARTITION BY line) > 1
  UNION ALL
  SELECT a.doc_id, a.s, 2 * a.d, dense_rank() OVER (ORDER BY a.r, b.r), first_value(a.doc_id) OVER (PARTITION BY a.r, b.r ORDER BY a.doc_id, a.s), first_value(a.s) OVER (PARTITION BY a.r, b.r ORDER BY a.doc_id, a.s)
  FROM v a JOIN v b ON b.doc_id = a.doc_id AND b.s = a.s + a.d QUALIFY count(*) OVER (PARTITION BY a.r, b.r) > 1
), w AS (
  SELECT doc_id, d, fd, fs - s AS shift, s - row_number() OVER (PARTITION BY doc_id, d, fd, fs - s ORDER BY s) AS island FROM v WHERE d >= 2 AND (doc_id > fd OR doc_id = fd AND s > fs)
), g AS (
  SELECT doc_id, max(n + d - 1) AS longest_run FROM (SELECT doc_id, d, count(*) AS n FROM w GROUP BY doc_id, d, fd, shift, island) GROUP BY doc_id
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(b.gone, false)) AS n_removed, count(*) FILTER (WHERE coalesce(b.begins, false)) AS n_runs,
    string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE NOT coalesce(b.gone, false)) AS kept
  FROM l LEFT JOIN b USING (doc_id, i) GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, CAST(greatest(coalesce(longest_run, 0), CASE WHEN n_removed > 0 THEN 1 ELSE 0 END) AS BIGINT) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""
