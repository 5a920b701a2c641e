"""Command lines: ``python -m folioflow chunks|index|qa|check|ask|ablation --help``.

Models are named as ``module:factory`` (a function of no arguments that makes one); without
a name the offline defaults answer.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioflow import lineage, schemas
from folioflow.functions import text as X
from folioflow.operators import acquisition, judging, models, qa, quality, retrieval, runs
from folioflow.sources import readers, writers


def made(name: str | None, otherwise):
    if not name:
        return otherwise
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def chunks(spark: SparkSession, a: argparse.Namespace) -> None:
    parser = made(a.parser, None)
    if parser is None:
        from folioflow.operators.adapters import PdfFile as parser
    pages, tables = readers.pdf_pages(spark, a.pdf, parser), readers.pdf_tables(spark, a.pdf, parser)
    if a.limit:
        names = [r.file for r in readers.listing(spark, a.pdf, limit=a.limit).collect()]
        pages, tables = (t.where(F.col("doc_id").isin(names)) for t in (pages, tables))
    good = lambda t: t.where("error is null").drop("error")
    writers.per_document(runs.corpus(good(pages), good(tables), a.chunk_chars), a.out)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    factory = made(a.encoder, models.hashing_embedder)
    records = models.embedded(readers.chunk_records(spark, a.chunks), "text", factory) if a.json else runs.index(spark.read.parquet(a.chunks), factory=factory)
    writers.vector_index(records, a.out, a.encoder or "hashing", "company" if a.by_company else None)


def questions_of(spark: SparkSession, a: argparse.Namespace) -> None:
    c = spark.read.parquet(a.chunks)
    if a.max_chunks:
        c = c.where(F.col("chunk_id") <= a.max_chunks)
    if a.limit:
        names = [r[0] for r in c.select("doc_id").distinct().orderBy("doc_id").limit(a.limit).collect()]
        c = c.where(F.col("doc_id").isin(names))
    done = f"{a.out}/done"
    if readers.exists(spark, done) and not a.fresh:
        c = c.join(spark.read.parquet(done), "doc_id", "left_anti")
    pairs, status = runs.question_set(c, X.company_label(F.col("doc_id").cast("string")), made(a.generator, models.echo_generator), a.merge_chars, a.qa_per, workers=a.workers)
    pairs = pairs.orderBy("doc_id", "group_id", "pos")
    mode = "overwrite" if a.fresh else "append"
    pairs.write.mode(mode).json(f"{a.out}/alpaca")
    qa.sharegpt(pairs).write.mode(mode).json(f"{a.out}/sharegpt")
    whole = status.groupBy("doc_id").agg(F.count("error").alias("failed")).where("failed = 0").select("doc_id")
    whole.write.mode(mode).parquet(done)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = readers.json_or_empty(spark, a.qa, schemas.QA)
    writers.report(quality.qa_report(pairs))
    writers.report(acquisition.hash_sample(pairs, "instruction", a.sample, a.seed))


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    records, _ = readers.vector_index(spark, a.index)
    cfg = ("hr" if a.rerank else "hybrid") if a.hybrid or a.rerank else "vec"
    embedder, generator = made(a.encoder, models.hashing_embedder)(), made(a.generator, models.echo_generator)()

    def answer(question: str) -> str:
        got = runs.asked(spark, records, question, generator, embedder, cfg, not a.no_route, a.k, a.candidates)
        if a.show_hits:
            for h in got["hits"]:
                print(f"[{h['rank']}] {h.company} {h.file} {h.chunk_idx}: {h.text[:60]!r}")
        print(" | ".join(f"{x} {got[x]:.2f}s" for x in ("route", "recall", "rerank", "generate", "total")))
        return got["answer"]

    for said in [answer(a.question)] if a.question else readers.chat(iter(sys.stdin.readline, ""), answer):
        print(said)


def ablation(spark: SparkSession, a: argparse.Namespace) -> None:
    records, _ = readers.vector_index(spark, a.index)
    items = readers.json_or_empty(spark, a.qa, schemas.QA).withColumn("line", F.monotonically_increasing_id())
    picked = acquisition.drawn(items, "line", a.limit, a.seed).select(F.col("draw").cast("long").alias("qid"), F.col("instruction").alias("question"), F.col("output").alias("reference"))
    asked = runs.routed(models.embedded(picked, "question", made(a.encoder, models.hashing_embedder), True), records)
    done = f"{a.out}/reports"
    if a.fresh:
        lineage.removed(spark, a.out)
    earlier = spark.read.parquet(done).withColumn("partial", F.lit(False)) if readers.exists(spark, done) else None
    out = runs.ablation(asked, records, made(a.judge, judging.overlap_judge), made(a.generator, models.echo_generator), a.configs.split(","), earlier, k=a.k, candidates=a.candidates, workers=a.workers, store=f"{a.out}/answers")
    writers.report(out)
    out.write.mode("append").parquet(done)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioflow", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(f, help: str, **options) -> None:
        c = commands.add_parser(f.__name__ if f is not questions_of else "qa", help=help)
        c.set_defaults(run=f)
        for name, default in options.items():
            flag = ("-" if len(name) == 1 else "--") + name.replace("_", "-")
            names = [flag, "-q"] if name == "question" else [flag]
            if default is ...:
                c.add_argument(*names, required=True)
            elif default is False:
                c.add_argument(*names, action="store_true")
            elif isinstance(default, type):
                c.add_argument(*names, type=default)
            else:
                c.add_argument(*names, type=type(default), default=default)

    command(chunks, "clean and chunk PDFs", pdf=..., out=..., limit=int, chunk_chars=1000, parser=str)
    command(index, "index chunks", chunks=..., out=..., encoder=str, json=False, by_company=False)
    command(questions_of, "make question/answer pairs", chunks=..., out=..., generator=str, merge_chars=8000, qa_per=6, workers=2, limit=int, max_chunks=int, fresh=False)
    command(check, "report on a question set", qa=..., sample=5, seed=42)
    command(ask, "answer one question, or questions line by line", index=..., question=str, k=6, candidates=20, hybrid=False, rerank=False, no_route=False, show_hits=False, encoder=str, generator=str)
    command(ablation, "compare retrieval configurations", index=..., qa=..., out=..., limit=100, seed=42, configs=",".join(retrieval.CONFIGS), k=6, candidates=20, workers=8, fresh=False, encoder=str, generator=str, judge=str)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("folioflow").getOrCreate(), a)


if __name__ == "__main__":
    main()
