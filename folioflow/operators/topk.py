"""The best records per query, kept task by task: what the exact searches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Pairs of a record and a query whose scores a task holds at a time.
PAIRS = 1 << 21


class Best:
    """For each query the k best of the records seen so far: by score, then by id.

    With ``digits``, scores come as they are and are rounded here, which only those near the k best need.
    """

    def __init__(self, qids: np.ndarray, k: int, digits: int | None = None):
        self.qids, self.k, self.digits = qids, k, digits
        self.ids = np.zeros((len(qids), k), np.int64)
        self.scores = np.full((len(qids), k), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, asked: np.ndarray | slice = slice(None)) -> None:
        """``scores`` has a row per record and a column per query, of all or of those ``asked``; -inf is no hit, none is NaN.

        Beside the scores it holds one byte for each, and what may be among the k best.
        """
        at = np.arange(len(self.qids))[asked]
        slack = 0.0 if self.digits is None else 2 * 10.0**-self.digits
        least = self.scores[at, -1] - slack
        near = _near(scores, least)
        if len(ids) > self.k and np.count_nonzero(near) > 4 * self.k * len(at):
            n = len(ids) - self.k
            for a in range(0, len(at), 64):  # copies of a few queries' scores at a time
                least[a : a + 64] = np.maximum(least[a : a + 64], np.partition(scores[:, a : a + 64], n, axis=0)[n] - slack)
            near = _near(scores, least)
        r, q = np.nonzero(near)
        s, q = scores[r, q], at[q]
        if self.digits is not None:
            s = np.round(s, self.digits)
        # A record that is no better than the last of k goes.
        low, last = self.scores[q, -1], self.ids[q, -1]
        better = (s > low) | ((s == low) & (ids[r] < last))
        r, q, s = r[better], q[better], s[better]
        if not len(q):
            return
        some = np.unique(q)
        q = np.concatenate([q, np.repeat(some, self.k)])
        s, i = np.concatenate([s, self.scores[some].ravel()]), np.concatenate([ids[r], self.ids[some].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        q, s, i, rank = (x[rank < self.k] for x in (q, s, i, rank))
        self.ids[q, rank], self.scores[q, rank] = i, s

    def batch(self, name: str) -> pa.RecordBatch:
        q, at = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.qids[q]), pa.array(self.ids[q, at]), pa.array(self.scores[q, at])], ["qid", "rec_id", name])


def _near(scores: np.ndarray, least: np.ndarray) -> np.ndarray:
    near = scores >= least
    if np.isneginf(least).any():
        near &= scores > -np.inf
    return near


def grouped(scopes: list | None) -> dict[str | None, np.ndarray] | None:
    """The numbers of the queries of each scope."""
    if scopes is None:
        return None
    out: dict[str | None, list[int]] = {}
    for j, s in enumerate(scopes):
        out.setdefault(s, []).append(j)
    return {s: np.array(j) for s, j in out.items()}


def meetings(own: pa.Array | None, asked: dict[str | None, np.ndarray] | None, n: int, queries: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which of n records and which queries are held against each other, ``most`` pairs or fewer at a time, each pair once.

    A query with a scope meets its own records alone. ``own`` holds the records' scopes, ``asked`` the queries of each.
    """
    if asked is None:
        yield from _portions(np.arange(n), np.arange(queries), most)
        return
    if None in asked:
        yield from _portions(np.arange(n), asked[None], most)
    codes = own.dictionary_encode()
    at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(len(codes.dictionary) + 1))
    for c, s in enumerate(codes.dictionary.to_pylist()):
        if s is not None and s in asked:
            yield from _portions(order[ends[c] : ends[c + 1]], asked[s], most)


def _portions(records: np.ndarray, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = max(1, min(len(queries), most // max(1, min(len(records), 1024))))
    high = max(1, most // wide)
    for a in range(0, len(records), high):
        for b in range(0, len(queries), wide):
            yield records[a : a + high], queries[b : b + wide]


def within(records: DataFrame, scopes: list | None) -> DataFrame:
    """``records`` of the scopes that are asked for; a table partitioned by scope then reads no others."""
    if scopes is None or any(s is None for s in scopes):
        return records
    return records.where(F.col("scope").isin(sorted(set(scopes))))


def blocks(queries: DataFrame, n: int, order: str = "qid"):
    """The queries in n parts on the driver, one at a time."""
    for b in range(n):
        if rows := queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b).orderBy(order).collect():
            yield rows


def ranked(found: DataFrame, score: str, k: int, *more: str) -> DataFrame:
    """k rows of every task meet here for each query (and value of ``more``)."""
    w = Window.partitionBy("qid", *more).orderBy(F.desc(score), "rec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
