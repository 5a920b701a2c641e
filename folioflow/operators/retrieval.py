"""Retrieval configurations over one index: vector, hybrid, reranked, routed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.lineage import written

from . import fusion, models, text_index, vector

CONFIGS = ("vec", "hybrid", "hr", "hr_route")


def hits(ranked: DataFrame, records: DataFrame) -> DataFrame:
    """Ranked ids with the records they stand for."""
    return ranked.join(records.drop("embedding"), "rec_id")


class Arms:
    """The ranked lists of both arms over one index; those that several configurations use are computed and written once.

    The vectors may come from a table of their own (``rec_id, embedding`` and the scope); with ``both``, the words are
    sought in all records and in the scopes at one go.
    """

    def __init__(self, records: DataFrame, queries: DataFrame, candidates: int = 20, scope: str | None = None, vectors: DataFrame | None = None, both: bool = False):
        self.records, self.queries, self.candidates, self.scope = records, queries, candidates, scope
        self.vectors, self.both = records if vectors is None else vectors, both and scope is not None
        self._index: text_index.TextIndex | None = None
        self._done: dict[tuple, DataFrame] = {}
        self._texts: tuple[set, DataFrame | None] = set(), None

    def vector(self, scoped: bool = False) -> DataFrame:
        return self._once("vector", scoped, lambda scope: vector.search(self.vectors, self.queries, self.candidates, scope))

    def words(self, scoped: bool = False) -> DataFrame:
        if self._index is None:
            self._index = text_index.indexed(self.records, scope=self.scope)
        if self.both:
            if ("words",) not in self._done:
                self._done["words",] = written(text_index.search(self._index, self.queries, self.candidates, self.scope, both=True), "words")
            return self._done["words",].where(F.col("scoped") == scoped).drop("scoped")
        return self._once("words", scoped, lambda scope: text_index.search(self._index, self.queries, self.candidates, scope))

    def _once(self, arm: str, scoped: bool, made: Callable) -> DataFrame:
        if (arm, scoped) not in self._done:
            self._done[arm, scoped] = made(self.scope) if scoped else written(made(None), arm)
        return self._done[arm, scoped]

    def best(self, k: int, scoped: bool = False) -> DataFrame:
        """The fused list, written."""
        if ("best", k, scoped) not in self._done:
            self._done["best", k, scoped] = written(self.fused(k, scoped).select("qid", "rec_id", "rank"), "fused")
        return self._done["best", k, scoped]

    def texts(self, k: int, *scoped: bool) -> DataFrame:
        """``rec_id, text`` of the records in these fused lists: one reading of all texts, the lists' size decides how they meet."""
        lists = {(k, s) for s in scoped}
        if not lists <= self._texts[0]:
            ids = None
            for s in scoped:
                part = self.best(k, s).select("rec_id")
                ids = part if ids is None else ids.union(part)
            self._texts = lists, written(self.records.select("rec_id", "text").join(written(ids.distinct(), "found"), "rec_id", "left_semi"), "texts")
        return self._texts[1]

    def fused(self, k: int, scoped: bool = False, rrf_k: int = 60) -> DataFrame:
        return fusion.fuse(self.vector(scoped), self.words(scoped), k, rrf_k)


def hybrid(records: DataFrame, queries: DataFrame, k: int = 6, candidates: int = 20, scope: str | None = None, rrf_k: int = 60) -> DataFrame:
    """Both arms fetch ``candidates`` each; the k best of their fusion stay."""
    return Arms(records, queries, candidates, scope).fused(k, scope is not None, rrf_k)


def lexical_overlap(query: F.Column, text: F.Column) -> F.Column:
    """The default score of a query and a text, as an expression: shared distinct tokens over the query's."""
    q = F.array_distinct(X.tokens(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, X.tokens(text))) / F.size(q), 9)).otherwise(0.0)


def rerank(ranked: DataFrame, records: DataFrame, queries: DataFrame, k: int = 6, factory: Callable | None = None) -> DataFrame:
    """``ranked`` (``qid, rec_id, rank``) in the order of a reranker's score, ties by the rank before; the k best.

    The candidates were cut before this: the score is computed for them alone. Without
    a factory the lexical overlap is used, which stays in the JVM.
    """
    pairs = ranked.select("qid", "rec_id", F.col("rank").alias("rank_before")).join(records.select("rec_id", "text"), "rec_id").join(queries.select("qid", "question"), "qid")
    if factory is None:
        pairs = pairs.withColumn("rerank_score", lexical_overlap(F.col("question"), F.col("text")))
    else:
        pairs = models.scored(pairs, "question", "text", factory)
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank_before")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rec_id", "rerank_score", "rank_before", "rank")


def retrieve(cfg: str, records: DataFrame, queries: DataFrame, k: int = 6, candidates: int = 20, scope: str = "scope", factory: Callable | None = None, arms: Arms | None = None) -> DataFrame:
    """``cfg, qid, rec_id, rank`` by one of the configurations.

    ``queries`` has ``qid, question, embedding`` and, for the routed one, ``scope``.
    """
    if cfg not in CONFIGS:
        raise ValueError(f"no such configuration: {cfg}")
    arms = arms or Arms(records, queries, max(k, candidates) if cfg == "vec" else candidates, scope if cfg == "hr_route" else None)
    if cfg == "vec":
        out = arms.vector().where(F.col("rank") <= k)
    elif cfg == "hybrid":
        out = arms.fused(k)
    else:
        scoped = cfg == "hr_route"
        out = rerank(arms.best(candidates, scoped), arms.texts(candidates, scoped), queries, k, factory)
    return out.select(F.lit(cfg).alias("cfg"), "qid", "rec_id", "rank")


def retrieve_all(configs, records: DataFrame, queries: DataFrame, k: int = 6, candidates: int = 20, scope: str = "scope", factory: Callable | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The configurations side by side; what they share is computed once."""
    configs = list(configs)
    arms = Arms(records, queries, max(k, candidates), scope if "hr_route" in configs else None, vectors, bool({"hybrid", "hr"} & set(configs)))
    if lists := [cfg == "hr_route" for cfg in configs if cfg in ("hr", "hr_route")]:
        arms.texts(candidates, *lists)
    out = None
    for cfg in configs:
        part = retrieve(cfg, records, queries, k, candidates, scope, factory, arms)
        out = part if out is None else out.unionByName(part)
    return out


def groups(records: DataFrame, by: str = "company") -> DataFrame:
    """``company, rec_ids``: the records of each group in order; for groups that a row can hold."""
    return records.groupBy(by).agg(F.array_sort(F.collect_list("rec_id")).alias("rec_ids"))


def context(found: DataFrame, order: str = "rank", text: str = "text", count: str | None = None) -> DataFrame:
    """``qid, ctx``: hits in order, one line each, numbered from 1; ``count`` names a column for their number."""
    parts = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    ctx = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x[text])), "\n")
    return parts.select("qid", ctx.alias("ctx"), *([F.size("p").alias(count)] if count else []))


def answer_prompt(ctx: F.Column, question: F.Column) -> F.Column:
    return F.format_string("Answer from the numbered excerpts alone; say so if they do not hold the answer.\n\n%s\n\nQuestion: %s", ctx, question)


def answers(questions: DataFrame, contexts: DataFrame, factory: Callable = models.echo_generator, **options) -> DataFrame:
    """Questions with a generated answer; a failed call leaves a null answer and an error."""
    p = questions.join(contexts, "qid", "left").withColumn("prompt", answer_prompt(F.coalesce("ctx", F.lit("")), F.col("question")))
    return models.generated(p, "prompt", factory, out="answer", **options).drop("prompt")
