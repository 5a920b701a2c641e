"""BM25: records are analysed once, the queries go to them in blocks, top hits leave each task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.lineage import written

from . import topk

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query tokens that go to the executors at once, and scores, or products of a record's token and a query, that a task holds at a time.
BLOCK_TOKENS, BLOCK_SCORES = 1_000_000, 1 << 20


@dataclass
class TextIndex:
    """The analysed records (``rec_id, tokens[, scope]``), the corpus's statistics and ``token, idf``."""

    tokens: DataFrame
    n_docs: int
    avgdl: float
    idf: DataFrame


def analyzed(records: DataFrame, analyzer=X.tokens, text: str = "text", scope: str | None = None) -> DataFrame:
    """``rec_id, tokens`` (an empty array for a null text), with ``scope`` if there is one."""
    more = [F.col(scope).cast("string").alias("scope")] if scope else []
    return records.select(F.col("rec_id").cast("long").alias("rec_id"), F.coalesce(analyzer(F.col(text)), F.array().cast("array<string>")).alias("tokens"), *more)


def weights(df: DataFrame, n_docs: int, epsilon: float = EPSILON) -> DataFrame:
    """``token, idf``; a negative idf becomes ``epsilon`` times the mean idf of all tokens."""
    raw = df.select("token", (F.ln(F.lit(n_docs) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf")).first()[0]
    return raw.select("token", F.when(F.col("idf") < 0, epsilon * F.lit(mean)).otherwise(F.col("idf")).alias("idf"))


def indexed(records: DataFrame, analyzer=X.tokens, scope: str | None = None) -> TextIndex:
    """Analyse the records, once; the statistics are those of the whole corpus."""
    t = written(analyzed(records, analyzer, scope=scope), "tokens")
    n, avgdl = t.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    df = written(t.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    return TextIndex(t, n, avgdl or 1.0, weights(df, n))


def search(records: DataFrame | TextIndex, queries: DataFrame, candidates: int = 20, scope: str | None = None, analyzer=X.tokens, k1: float = K1, b: float = B, digits: int = 9, block_tokens: int = BLOCK_TOKENS, both: bool = False) -> DataFrame:
    """``qid, rec_id, score, rank`` of the best records that share a token with the query; ties (to ``digits`` digits) by rec_id.

    A query's tokens count with their multiplicity. With ``scope``, a column of both sides, a query that has a value
    there sees only the records that share it, scored with the statistics of the whole corpus. The score of a record is
    summed over its own tokens alone and within its row, so no posting is shuffled; each task keeps the
    best per query as it goes. With ``both``, the queries are held against all records as well, in the same pass;
    ``scoped`` then tells the two lists apart.
    """
    index = records if isinstance(records, TextIndex) else indexed(records, analyzer, scope)
    more = [F.col(scope).cast("string").alias("scope")] if scope else []
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.coalesce(analyzer(F.col("question")), F.array().cast("array<string>")).alias("asked"), *more)
    found = index.tokens.selectExpr("rec_id as qid", "rec_id", "0d as score", "false as scoped").where("false")
    total = q.agg(F.sum(F.size("asked"))).first()[0] or 0
    for rows in topk.blocks(q, total // block_tokens + 1):
        spark = q.sparkSession
        tokens = sorted({t for r in rows for t in r.asked})
        if tokens:
            known = spark.createDataFrame(pa.table({"token": tokens}))
            idf = {r.token: r.idf for r in index.idf.join(F.broadcast(known), "token").collect()}
            scopes = [r.scope for r in rows] if scope else None
            part = topk.within(index.tokens if scope else index.tokens.select("rec_id", "tokens"), None if both else scopes)
            ways = [None, scopes] if both and scope else [scopes]
            found = found.unionByName(_scan(part, rows, idf, ways, candidates, index.avgdl, k1, b, digits))
    return topk.ranked(found, "score", candidates, "scoped") if both else topk.ranked(found.drop("scoped"), "score", candidates)


def _scan(tokens: DataFrame, rows: list, idf: dict[str, float], ways: list[list | None], k: int, avgdl: float, k1: float, b: float, digits: int) -> DataFrame:
    names = sorted(idf)
    at = {t: i for i, t in enumerate(names)}
    entries = sorted((at[t], j, n) for j, r in enumerate(rows) for t, n in Counter(r.asked).items() if t in at)
    which, query, times = (np.array(x, np.int64) for x in zip(*entries, strict=True)) if entries else (np.empty(0, np.int64),) * 3
    weight = times * np.array([idf[t] for t in names])[which] if entries else np.empty(0)
    first = np.searchsorted(which, np.arange(len(names) + 1))
    held = tokens.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), names, first, query, weight, [topk.grouped(scopes) for scopes in ways]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, names, first, query, weight, ways = held.value
        positive, asks = bool((weight > 0).all()), np.diff(first)
        known, bests = pa.array(names, pa.string()), [topk.Best(qids, k, digits) for _ in ways]
        for whole in batches:
            for batch in _bounded(whole):
                dl, row, code, tf = _counted(batch.column(1), known)
                value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                at = np.searchsorted(row, np.arange(len(dl) + 1))
                products = np.append(0, np.cumsum(asks[code]))[at]  # of all records before
                ids = batch.column(0).to_numpy()
                own = batch.column(2) if batch.num_columns > 2 else None
                for r0, r1 in _records(products, len(qids)):
                    part = slice(at[r0], at[r1])
                    n = asks[code[part]]
                    pair = np.repeat(np.arange(part.start, part.stop), n)
                    entry = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[code[pair]]
                    cell, size = (row[pair] - r0) * len(qids) + query[entry], (r1 - r0) * len(qids)
                    sums = np.bincount(cell, value[pair] * weight[entry], size)
                    hit = sums > 0 if positive else np.bincount(cell, minlength=size) > 0
                    scores = np.where(hit, sums, -np.inf).reshape(r1 - r0, len(qids))
                    for best, asked in zip(bests, ways, strict=True):
                        if asked is None:
                            best.add(ids[r0:r1], scores)
                        else:
                            for r, j in topk.meetings(own[r0:r1], asked, r1 - r0, len(qids)):
                                best.add(ids[r0:r1][r], scores[np.ix_(r, j)], j)
        for best, asked in zip(bests, ways, strict=True):
            out = best.batch("score")
            yield out.append_column("scoped", pa.array([asked is not None] * out.num_rows, pa.bool_()))

    return tokens.mapInArrow(run, "qid long, rec_id long, score double, scoped boolean")


def _counted(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens each record has, and for known tokens: record, number and how often, in that order."""
    dl = np.diff(lists.offsets.to_numpy())
    code = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
    key = np.repeat(np.arange(len(dl)) * len(known), dl)[code >= 0] + code[code >= 0]
    if len(dl) * len(known) <= 16 * len(key):
        counts = np.bincount(key, minlength=len(dl) * len(known))
        key = np.flatnonzero(counts)
        tf = counts[key]
    else:
        key, tf = np.unique(key, return_counts=True)
    return dl, key // max(1, len(known)), key % max(1, len(known)), tf


def _records(products: np.ndarray, queries: int) -> Iterator[tuple[int, int]]:
    """Ranges of records with as many products and pairs as ``BLOCK_SCORES``, at least one; ``products`` counts those before."""
    load, at = products + np.arange(len(products)) * queries, 0
    while at < len(products) - 1:
        end = max(at + 1, int(np.searchsorted(load, load[at] + BLOCK_SCORES, "right")) - 1)
        yield at, end
        at = end


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of as many records as have ``BLOCK_SCORES`` tokens, at least one."""
    ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_SCORES, "right")))
        yield batch.slice(at, end - at)
        at = end
