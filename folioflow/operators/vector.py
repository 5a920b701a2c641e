"""Exact vector search: the queries go to the vectors in blocks, top hits leave each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import topk

#: Queries up to this many bytes of vectors go to the executors at once; more go in turns.
BLOCK_BYTES = 32 << 20


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of doubles; a vector that is null, of another length or holds nulls becomes NaNs."""
    out = np.full((len(column), dim), np.nan)
    good = np.diff(column.offsets.to_numpy()) == dim
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    if good.any():
        out[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 6, scope: str | None = None, digits: int = 9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``qid, rec_id, sim, rank``: the k vectors with the largest inner product per query.

    ``vectors`` has ``rec_id, embedding`` and ``queries`` ``qid, embedding``; with ``scope``, a column
    of both, a query with a null there searches everything and others only their own (vectors of
    scopes nobody asks for are not read if every query has one). Equal similarities (to
    ``digits`` digits) are ranked by rec_id. A null vector, one with null components, or of another length than the
    first is no hit; queries without a vector find nothing, and queries of another length are an error. The
    queries are counted first and taken in blocks of bounded size; every task keeps the k best per query as it
    goes and computes ``topk.PAIRS`` similarities at a time, so its memory grows with k times the queries of a block
    and not with the vectors; k rows per query and task meet in the final window.
    """
    text = [F.col(scope).cast("string").alias("scope")] if scope else []
    q = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding"), *text)
    v = vectors.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *text)
    sizes = {r["d"]: r["n"] for r in q.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = v.selectExpr("rec_id as qid", "rec_id", "0d as sim").where("false")
    first = v.where("embedding is not null").select(F.size("embedding").alias("d")).first()
    if first is not None and sizes:
        if set(sizes) != {first["d"]}:
            raise ValueError(f"queries have vectors of {sorted(sizes)} components, the records of {first['d']}")
        for rows in topk.blocks(q, sizes[first["d"]] * first["d"] * 8 // block_bytes + 1):
            rows = [r for r in rows if r.embedding is not None and None not in r.embedding]
            if rows:
                scopes = [r.scope for r in rows] if scope else None
                found = found.unionByName(_scan(topk.within(v, scopes), rows, scopes, k, digits))
    return topk.ranked(found, "sim", k)


def _scan(v: DataFrame, rows: list, scopes: list | None, k: int, digits: int) -> DataFrame:
    held = v.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), np.array([r.embedding for r in rows]), topk.grouped(scopes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix, asked = held.value
        best = topk.Best(qids, k, digits)
        finite = bool(np.isfinite(matrix).all())
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                m, ids = _matrix(batch.column(1), matrix.shape[1]), batch.column(0).to_numpy()
                odd = not (finite and np.isfinite(m).all())
                for r, j in topk.meetings(None if asked is None else batch.column(2), asked, len(m), len(qids)):
                    sims = m[r] @ matrix[j].T
                    if odd:
                        sims[np.isnan(sims)] = -np.inf
                    best.add(ids[r], sims, j)
        yield best.batch("sim")

    return v.mapInArrow(run, "qid long, rec_id long, sim double")
