"""Command line: ``python -m quarry COMMAND ...``; see ``--help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encoders, indexes, lexical, metrics, mining, sparse
from .sources import readers, sinks


def _queries(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_queries(spark, path).withColumnRenamed("id", "query_id")


def collection(spark, a):
    sinks.write_jsonl(readers.read_collection_tsv(spark, *a.input), a.out)


def queries(spark, a):
    sinks.write_jsonl(readers.read_queries_tsv(spark, *a.input), a.out)


def qrels(spark, a):
    sinks.write_jsonl(readers.read_trec_qrels(spark, *a.input), a.out)


def exported(spark, a):
    sinks.write_jsonl(readers.read_exported_queries(spark, a.queries), f"{a.out}/queries")
    sinks.write_jsonl(readers.read_exported_qrels(spark, a.qrels), f"{a.out}/qrels")


def beir(spark, a):
    """One folder to ``out``; of several, each to a folder of its name there. Incomplete ones are skipped, and what is there already unless told."""
    for folder in sorted(a.folder):
        out = a.out if len(a.folder) == 1 else f"{a.out}/{folder.rstrip('/').rpartition('/')[2]}"
        names = ("collection", "queries", "qrels")
        if missing := readers.beir_parts(spark, folder):
            print(f"skipped {folder}: no {', '.join(missing)}")
        elif not a.overwrite and all(readers.exists(spark, f"{out}/{name}") for name in names):
            print(f"skipped {folder}: {out} is complete")
        else:
            for name, rows in zip(names, readers.read_beir(spark, folder)):
                sinks.write_jsonl(rows, f"{out}/{name}")


def dev(spark, a):
    sinks.write_run(readers.read_dev_top(spark, a.input), a.out)


def index(spark, a):
    lexical.write(lexical.build(readers.read_collection(spark, a.collection)), a.out)


def search(spark, a):
    run = lexical.search(lexical.load(spark, a.index), _queries(spark, a.queries), a.k, a.k1, a.b)
    run.write.mode("overwrite").parquet(f"{a.out}/run")
    run = spark.read.parquet(f"{a.out}/run")
    sinks.write_run(run, f"{a.out}/run_json")
    if a.qrels:
        sinks.write_metrics(metrics.evaluate(run, readers.read_qrels(spark, a.qrels)), f"{a.out}/metrics")


def _encoded(kind: str, rows: DataFrame, name: str, a) -> DataFrame:
    """Texts (id, text) as the rows of an index of that kind, by the model-free encoder, with the id called ``name``."""
    rows = rows.withColumnRenamed("id", name)
    if kind == "sparse":
        counts = lexical.term_counts(rows, name, "text")
        return sparse.prune(counts.select(name, F.col("term").alias("token"), F.log1p(F.col("tf").cast("double")).alias("weight")), a.terms, name)
    encoder = encoders.HashingEncoder(a.dims)
    return encoders.encode_tokens(rows, encoder, name) if kind == "late" else encoders.encode(rows, encoder, name)


def index_vectors(spark, a):
    """An index of one of ``indexes.KINDS``."""
    texts = lexical.with_fields(readers.read_collection(spark, a.collection), ("title", "contents")).withColumnRenamed("contents", "text")
    indexes.write(indexes.known(a.kind), _encoded(a.kind, texts, "doc_id", a), a.out, a.lists or None, a.nbits)


def _searched(spark, a):
    index = indexes.load(spark, a.index)
    asked = _encoded(index.kind, readers.read_queries(spark, a.queries), "query_id", a)
    return indexes.search(index, asked, a.k, a.nprobe, a.metric)


def search_vectors(spark, a):
    _searched(spark, a).write.mode("overwrite").parquet(f"{a.out}/run")
    run = spark.read.parquet(f"{a.out}/run")
    sinks.write_run(run, f"{a.out}/run_json")
    if a.qrels:
        sinks.write_metrics(metrics.evaluate(run, readers.read_qrels(spark, a.qrels)), f"{a.out}/metrics")


def mine_vectors(spark, a):
    found = mining.hard_negatives(_searched(spark, a), readers.numbered_qrels(spark, a.qrels), a.k)
    sinks.write_jsonl(found.withColumnRenamed("query_id", "qid"), a.out)


def mine(spark, a):
    run = lexical.search(lexical.load(spark, a.index), _queries(spark, a.queries), a.k)
    lines = readers.numbered_qrels(spark, a.qrels)
    found = mining.hard_negatives(run, lines, a.k).withColumnRenamed("query_id", "qid")
    sinks.write_jsonl(found, a.out)


def evaluate(spark, a):
    metrics.evaluate(spark.read.parquet(a.run), readers.read_qrels(spark, a.qrels)).show(100, False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *options, **kinds):
        c = sub.add_parser(f.__name__)
        for o in options:
            c.add_argument(f"--{o.rstrip('?')}", required=o[-1] != "?")
        for o, default in kinds.items():
            c.add_argument(f"--{o}", type=type(default), default=default)
        c.set_defaults(function=f)
        return c

    for f in (collection, queries, qrels):
        command(f, "out").add_argument("--input", nargs="+", required=True)
    command(exported, "queries", "qrels", "out")
    c = command(beir, "out")
    c.add_argument("--folder", nargs="+", required=True)
    c.add_argument("--overwrite", action="store_true")
    command(dev, "input", "out")
    command(index, "collection", "out")
    command(search, "index", "queries", "qrels?", "out", k=1000, k1=lexical.K1, b=lexical.B)
    command(mine, "index", "queries", "qrels", "out", k=100)
    command(evaluate, "run", "qrels")
    command(index_vectors, "collection", "kind", "out", dims=64, terms=200, lists=0, nbits=2)
    command(search_vectors, "index", "queries", "qrels?", "out", k=1000, nprobe=32, metric="ip", dims=64, terms=200)
    command(mine_vectors, "index", "queries", "qrels", "out", k=100, nprobe=32, metric="ip", dims=64, terms=200)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"quarry {a.command}").getOrCreate()
    a.function(spark, a)


if __name__ == "__main__":
    main()
