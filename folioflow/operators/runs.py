"""Whole runs put together from the operators: corpora, question sets, evaluations, timings."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.lineage import numbered, written

from . import cleaning, evaluate, incremental, judging, models, qa, retrieval, routing, sections, tables


def corpus(pages: DataFrame, found_tables: DataFrame | None = None, size: int = 1000) -> DataFrame:
    """Chunks (``doc_id, chunk_id, text, is_table``) of paged documents and the tables found in them."""
    return sections.build_chunks(cleaning.clean_pages(pages), tables.labelled(found_tables) if found_tables is not None else None, size, size)


def index(chunks: DataFrame, file: str = "doc_id", factory: Callable = models.hashing_embedder) -> DataFrame:
    """``rec_id, company, file, chunk_idx, text, embedding``; ``rec_id`` follows file and chunk."""
    rows = chunks.select(F.col(file).cast("string").alias("file"), (F.col("chunk_id") - 1).alias("chunk_idx"), "text")
    rows = numbered(rows, ["file", "chunk_idx"], "rec_id").select("rec_id", X.company_label(F.col("file")).alias("company"), "file", "chunk_idx", "text")
    return models.embedded(rows, "text", factory)


def question_set(chunks: DataFrame, company: Column, factory: Callable, budget: int = 8000, per_group: int = 6, **options) -> tuple[DataFrame, DataFrame]:
    """``(pairs, status)``: question/answer pairs of every group of chunks, and each group's outcome.

    The replies are written once, as asking again would cost and might answer otherwise. ``status``
    (``doc_id, group_id, n_pairs, error``) leaves a document whose groups failed to be asked again.
    """
    groups = qa.packed(chunks, budget).withColumn("prompt", qa.prompt(company, F.col("text"), per_group))
    replies = written(models.generated(groups.select("doc_id", "group_id", "prompt"), "prompt", factory, **options), "replies")
    status = replies.select("doc_id", "group_id", F.size(qa.parse_pairs(F.col("reply"))).alias("n_pairs"), "error")
    return qa.alpaca(replies), status


def routed(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``questions`` with ``scope``, the company that each one means (null: none known)."""
    r = routing.route(questions, routing.companies(records), routing.codes(records))
    return questions.join(r.withColumnRenamed("routed", "scope"), "qid", "left")


def answered(questions: DataFrame, records: DataFrame, cfg: str, generator: Callable = models.echo_generator, guard: bool = False, k: int = 6, candidates: int = 20, store: str | None = None, every: int | None = 20, **options) -> DataFrame:
    """``questions`` (``qid, question, scope, embedding``) with ``cfg, ctx, answer, error``.

    With ``store``, a folder, answers are kept there as they come, ``every`` so many questions, and a later
    run asks only for those that are missing or failed (see :func:`incremental.resumed`).
    """
    r = records.withColumn("scope", F.col("company"))

    def work(asked: DataFrame) -> DataFrame:
        found = retrieval.hits(retrieval.retrieve(cfg, r, asked, k=k, candidates=candidates), records.select("rec_id", "text"))
        p = retrieval.answer_prompt(F.coalesce("ctx", F.lit("")), F.col("question"))
        prompts = asked.drop("embedding").join(retrieval.context(found), "qid", "left").withColumn("__prompt", F.concat(p, F.lit(judging.GUARD)) if guard else p)
        out = models.generated(prompts, "__prompt", generator, out="answer", **options).drop("__prompt")
        return out.withColumn("error", F.col("error").isNotNull()).withColumn("cfg", F.lit(cfg))

    return work(questions) if store is None else incremental.resumed(questions, f"{store}/{cfg}{'-guard' if guard else ''}", "qid", work, every)


def ablation(questions: DataFrame, records: DataFrame, judge: Callable, generator: Callable = models.echo_generator, configs=retrieval.CONFIGS, done: DataFrame | None = None, **options) -> DataFrame:
    """The report of every configuration that ``done`` (reports of earlier runs) lacks.

    ``questions`` has ``qid, question, reference, scope, embedding``. Answers are written before
    they are judged, so generating and judging are separate jobs and neither is repeated; with
    ``store`` they outlive a run that breaks off.
    """
    if done is not None:
        have = {r.cfg for r in done.where(~F.coalesce(F.col("partial"), F.lit(False))).select("cfg").distinct().collect()}
        configs = [c for c in configs if c not in have]
    out = None
    for cfg in configs:
        a = answered(questions, records, cfg, generator, **options)
        a = a if options.get("store") else written(a, "answers")
        a = a.withColumn("evidence", X.evidence(F.col("reference"), F.coalesce("ctx", F.lit(""))))
        a = a.withColumn("routed", F.col("scope") if cfg == "hr_route" else F.lit(None).cast("string"))
        part = judging.judged(a, judge, "reference").select("cfg", "judge", "evidence", "routed", "error")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("every configuration has its report")
    return evaluate.ablation(out)


def recall(items: DataFrame, records: DataFrame, configs=retrieval.CONFIGS, ks: tuple[int, ...] = (6, 20), candidates: int = 20) -> DataFrame:
    """Document and chunk recall of every configuration; ``items`` has ``qid, question, scope, embedding, source, output``."""
    if max(ks) > candidates:
        raise ValueError("k is larger than the number of candidates")
    r = records.withColumn("scope", F.col("company"))
    ranked = retrieval.retrieve_all(configs, r, items, k=candidates, candidates=candidates)
    return evaluate.recall(ranked, evaluate.gold_of(items), records, ks)


def refusal(questions: DataFrame, records: DataFrame, judge: Callable, generator: Callable = models.echo_generator, guard: bool = False, cfg: str = "hr_route", **options) -> DataFrame:
    """Shares of refusals, inventions and vague answers to questions without an answer, by type."""
    a = written(answered(questions, records, cfg, generator, guard, **options), "answers")
    return evaluate.scopes(judging.triaged(a, judge), "label", "type")


def robustness(questions: DataFrame, records: DataFrame, judge: Callable, generator: Callable = models.echo_generator, cfg: str = "hr_route", **options) -> DataFrame:
    """The same questions in other words against their earlier verdict (``qid, question, reference, orig_judge``)."""
    a = written(answered(questions, records, cfg, generator, **options), "answers")
    return evaluate.paired(judging.judged(a, judge, "reference"), "qid", "orig_judge", "judge")


def seen_and_unseen(sides: dict[str, tuple[DataFrame, DataFrame]], judge: Callable, closed: Callable, generator: Callable = models.echo_generator, **options) -> DataFrame:
    """Accuracy of a closed-book model and of retrieval on questions of several corpora.

    ``sides`` maps a name to its questions and records.
    """
    out = None
    for side, (questions, records) in sides.items():
        rag = answered(questions, records, "vec", generator, **options).select("question", "answer", "error").withColumn("method", F.lit("rag"))
        ft = models.generated(questions.select("question"), "question", closed, out="answer").withColumn("error", F.col("error").isNotNull()).withColumn("method", F.lit("ft"))
        both = rag.unionByName(ft).withColumn("side", F.lit(side))
        out = both if out is None else out.unionByName(both)
    return evaluate.two_by_two(judging.judged(written(out, "answers"), judge))


def asked(spark: SparkSession, records: DataFrame, question: str, generator: models.TextGenerator, embedder: models.Embedder, cfg: str = "vec", route: bool = True, k: int = 6, candidates: int = 20) -> dict:
    """One question with its ``scope``, ``hits``, ``answer`` and the seconds of route, recall, rerank, generate and total."""
    times, began = {}, time.perf_counter()

    def lap(name: str) -> None:
        times[name] = time.perf_counter() - began - sum(times.values())

    q = spark.createDataFrame([(0, question, [float(x) for x in embedder([question], True)[0]])], "qid long, question string, embedding array<float>")
    scope = routed(q, records).first()["scope"] if route else None
    q, r = q.withColumn("scope", F.lit(scope).cast("string")), records.withColumn("scope", F.col("company"))
    lap("route")
    arms = retrieval.Arms(r, q, max(k, candidates) if cfg == "vec" else candidates, "scope")
    first = arms.vector(True) if cfg == "vec" else arms.fused(candidates if cfg in ("hr", "hr_route") else k, True)
    first = written(first.where(F.col("rank") <= (k if cfg == "vec" else candidates)).select("qid", "rec_id", "rank"), "recalled")
    lap("recall")
    best = retrieval.rerank(first, records, q, k) if cfg in ("hr", "hr_route") else first
    hits = retrieval.hits(best, records.select("rec_id", "company", "file", "chunk_idx", "text")).orderBy("rank").collect()
    lap("rerank")
    prompt = "\n".join(f"[{n}] {h.text}" for n, h in enumerate(hits, 1))
    answer = generator(f"{prompt}\n\nQuestion: {question}")
    lap("generate")
    return {"question": question, "scope": scope, "hits": hits, "answer": answer} | times | {"total": time.perf_counter() - began}


def timed(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], repeats: int = 1, warm_up: int = 1) -> DataFrame:
    """``stage, run, seconds`` of running each stage to its end; warm-up runs are not counted."""
    rows = []
    for name, stage in stages.items():
        for n in range(-warm_up, repeats):
            began = time.perf_counter()
            stage().write.format("noop").mode("overwrite").save()
            if n >= 0:
                rows.append((name, n, time.perf_counter() - began))
    return spark.createDataFrame(rows, "stage string, run int, seconds double")
