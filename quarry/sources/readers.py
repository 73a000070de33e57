"""Readers. Each has a part that works on a DataFrame of lines, so it can be used on any source of them.

Tab-separated lines are split on tabs only: there are no quotes, and no header
unless said. ``lines`` frames have columns value and, where order matters,
line_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema as S


def in_order(read, *paths: str, name: str = "line_no") -> DataFrame:
    """``read(path)`` of all ``paths`` together, with ``name``: a struct that grows along the lines.

    Paths count in the order given, the files of one by their names, then the
    splits of a file and the rows of a split. Spark itself deals splits by size.
    """
    place = lambda p: F.struct(
        F.lit(p).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    parts = [read(path).select("*", place(p).alias(name)) for p, path in enumerate(paths)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, line_no); ``line_no`` grows along the lines."""
    return in_order(spark.read.text, *paths)


def _fields(line: Column) -> Column:
    return F.split(line, "\t", -1)


def _fail(what: str, line: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), line)).cast("string")


def parse_collection(lines: DataFrame) -> DataFrame:
    """(id, contents, title) from lines of 2 (id, text) or 3 (id, text, title) fields; any other count is an error."""
    f, n = _fields(F.col("value")), F.size(_fields(F.col("value")))
    bad = _fail("expected 2 or 3 fields", F.col("value"))
    return lines.select(F.when((n == 2) | (n == 3), F.get(f, F.lit(0))).otherwise(bad).alias("id"), F.get(f, F.lit(1)).alias("contents"), F.coalesce(F.get(f, F.lit(2)), F.lit("")).alias("title"))


def parse_queries(lines: DataFrame) -> DataFrame:
    """(id, text) from lines of exactly 2 fields."""
    f = _fields(F.col("value"))
    return lines.select(F.when(F.size(f) == 2, F.get(f, F.lit(0))).otherwise(_fail("expected 2 fields", F.col("value"))).alias("id"), F.get(f, F.lit(1)).alias("text"))


def parse_trec_qrels(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance) from lines of exactly 4 fields; relevance must be a whole number, below 1 is dropped."""
    f = _fields(F.col("value"))
    rows = lines.select(F.when(F.size(f) == 4, F.get(f, F.lit(0))).otherwise(_fail("expected 4 fields", F.col("value"))).alias("query_id"), F.get(f, F.lit(2)).alias("doc_id"), F.trim(F.get(f, F.lit(3))).cast("int").alias("relevance"))
    return rows.filter("relevance >= 1")


def parse_beir_qrels(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance) from lines of query-id, corpus-id, score.

    A header names query-id and corpus-id; shorter lines are skipped; a score
    is cut toward zero, anything else counts as 0; below 1 is dropped.
    """
    f = _fields(F.col("value"))
    score = F.coalesce(F.get(f, F.lit(2)).try_cast("double").try_cast("int"), F.lit(0))
    header = F.contains(F.col("value"), F.lit("query-id")) & F.contains(F.col("value"), F.lit("corpus-id"))
    rows = lines.filter(~header & (F.size(f) >= 3)).select(F.get(f, F.lit(0)).alias("query_id"), F.get(f, F.lit(1)).alias("doc_id"), score.alias("relevance"))
    return rows.filter("relevance >= 1")


def parse_dev_top(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank) from lines of qid, pid, query, passage; rank is the order of lines."""
    f = _fields(F.trim(F.col("value")))
    rows = lines.select(F.when(F.size(f) == 4, F.get(f, F.lit(0))).otherwise(_fail("expected 4 fields", F.col("value"))).alias("query_id"), F.get(f, F.lit(1)).alias("doc_id"), "line_no")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("line_no"))).drop("line_no")


def parse_training(lines: DataFrame) -> DataFrame:
    """(line_no, query, positive, negative) from lines of exactly 3 fields."""
    f = _fields(F.trim(F.col("value")))
    return lines.select("line_no", F.when(F.size(f) == 3, F.get(f, F.lit(0))).otherwise(_fail("expected 3 fields", F.col("value"))).alias("query"), F.get(f, F.lit(1)).alias("positive"), F.get(f, F.lit(2)).alias("negative"))


def grouped_in_order(ranked: DataFrame) -> DataFrame:
    """(query_id, doc_ids): each query's documents in rank order."""
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``; combined on the map side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_collection_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_collection(spark.read.text(list(paths)))


def read_queries_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_queries(spark.read.text(list(paths)))


def read_trec_qrels(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_trec_qrels(spark.read.text(list(paths)))


def read_beir_qrels(spark: SparkSession, folder: str) -> DataFrame:
    """All .tsv files of a folder together."""
    return parse_beir_qrels(spark.read.option("pathGlobFilter", "*.tsv").text(folder))


def read_dev_top(spark: SparkSession, path: str) -> DataFrame:
    return parse_dev_top(text_lines(spark, path))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return parse_training(text_lines(spark, path))


def read_collection(spark: SparkSession, *paths: str, unique: bool = True) -> DataFrame:
    """JSON Lines documents; of a repeated id the last line stays, unless ``unique`` is false."""
    read = spark.read.schema(S.DOCUMENT).json
    return last_wins(in_order(read, *paths, name="_n"), "id", "_n").drop("_n") if unique else read(list(paths))


def read_queries(spark: SparkSession, *paths: str, unique: bool = True) -> DataFrame:
    read = spark.read.schema(S.QUERY).json
    return last_wins(in_order(read, *paths, name="_n"), "id", "_n").drop("_n") if unique else read(list(paths))


def read_qrels(spark: SparkSession, *paths: str, positive: bool = True) -> DataFrame:
    rows = spark.read.schema(S.QREL).json(list(paths))
    return rows.filter("relevance > 0") if positive else rows


def numbered_qrels(spark: SparkSession, *paths: str) -> DataFrame:
    """Judgements with ``line_no``, which grows along the lines."""
    return in_order(spark.read.schema(S.QREL).json, *paths)


def read_triples(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(S.TRIPLE).json(list(paths))


def read_triple_candidates(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(S.TRIPLE_CANDIDATES).json(list(paths))


def read_exported_queries(spark: SparkSession, *paths: str) -> DataFrame:
    """Queries exported with a ``question`` field."""
    return spark.read.schema(S.EXPORTED_QUERY).json(list(paths)).select("id", F.col("question").alias("text"))


def read_exported_qrels(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(S.QREL).json(list(paths)).filter("relevance >= 1")


def normalise_beir_corpus(rows: DataFrame) -> DataFrame:
    """(id, contents, title): ``_id``, else ``id``, else "None"; missing title and text are empty."""
    return rows.select(F.coalesce("_id", "id", F.lit("None")).alias("id"), F.coalesce("text", F.lit("")).alias("contents"), F.coalesce("title", F.lit("")).alias("title"))


def normalise_beir_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("_id", "id", F.lit("None")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def beir_parts(spark: SparkSession, folder: str) -> list[str]:
    """Which of a BEIR folder's corpus, queries and qrels are missing."""
    return [name for name in ("corpus.jsonl", "queries.jsonl", "qrels") if not exists(spark, f"{folder}/{name}")]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_answered(spark: SparkSession, *paths: str) -> DataFrame:
    """Exported questions with their answers: (id, text, answers); a missing answer is an empty array."""
    rows = spark.read.schema(S.ANSWERED_QUERY).json(list(paths))
    return rows.select("id", F.col("question").alias("text"), F.coalesce("answer", F.array().cast("array<string>")).alias("answers"))


def read_beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and qrels of a BEIR folder."""
    corpus = normalise_beir_corpus(spark.read.schema(S.BEIR_DOCUMENT).json(f"{folder}/corpus.jsonl"))
    queries = normalise_beir_queries(spark.read.schema(S.BEIR_QUERY).json(f"{folder}/queries.jsonl"))
    return corpus, queries, read_beir_qrels(spark, f"{folder}/qrels")


def read_dev(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank) from one JSON object of query to documents."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", S.DEV)).alias("query_id", "docs"))
    return entries.select("query_id", F.posexplode("docs").alias("_p", "doc_id")).select("query_id", "doc_id", (F.col("_p") + 1).alias("rank"))


def best_checkpoint(names: DataFrame, pattern: str = r"val_mrr_10=([0-9]+\.[0-9]+)") -> DataFrame:
    """One row (name): of file names (name), the one with the largest value in its name, the first of equals; null without any."""
    value = F.expr(f"try_cast(regexp_extract(name, r'{pattern}', 1) as double)")
    scored = names.select("name", value.alias("v")).filter("v is not null")
    return scored.agg(F.min_by("name", F.struct(-F.col("v"), F.col("name"))).alias("name"))


def line_count(lines: DataFrame) -> DataFrame:
    """One row (n): lines that are not blank."""
    return lines.filter(F.trim("value") != "").agg(F.count("*").alias("n"))


def token_stream(passages: DataFrame, parts: int | None = None) -> DataFrame:
    """(pid, pos, v) from ``passages`` (pid, vs: an array of token vectors): ids repeat with their vectors, in order of pid.

    A null or empty array gives no row. Each partition is a shard, and shards
    follow one another by pid.
    """
    ordered = passages.repartitionByRange(*([parts] if parts else []), "pid").sortWithinPartitions("pid")
    return ordered.select("pid", F.posexplode("vs").alias("pos", "v"))


def read_vectors(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, v) rows of vector shards; parquet folders need no offsets."""
    return spark.read.parquet(*paths)
