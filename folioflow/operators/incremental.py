"""Resuming work: ledgers, keyed replacement and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.lineage import exists


def pending(items: DataFrame, done: DataFrame, on: list[str] | str) -> DataFrame:
    """Items that the ledger does not have."""
    return items.join(done, on, "left_anti")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without those whose key occurs anew, then the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def unfinished(reports: DataFrame, wanted: DataFrame, key: str = "cfg") -> DataFrame:
    """Wanted configurations that have no complete report."""
    return wanted.select(key).exceptAll(reports.where(~F.coalesce(F.col("partial"), F.lit(False))).select(key).distinct())


def complete(answers: DataFrame, key: str, answer: str, least: int) -> DataFrame:
    """Keys that have at least ``least`` answers, none of them empty."""
    there = F.coalesce(F.col(answer), F.lit("")) != ""
    return answers.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(there).alias("ok")).where((F.col("n") >= least) & F.col("ok")).select(key)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last."""
    fields = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(fields, order).alias("__r")).select(key, "__r.*")


def looked_up(questions: DataFrame, stored: DataFrame, on: str, value: str, order: str, error: str | None = None) -> DataFrame:
    """Questions with their stored answer (the last of repeated ones), null where it must be computed.

    ``error`` names a column (true, or what went wrong) of answers that do not count.
    """
    if error is not None:
        e = F.col(error)
        bad = e if dict(stored.dtypes)[error] == "boolean" else e.isNotNull() & (e.cast("string") != "")
        stored = stored.where(~F.coalesce(bad, F.lit(False)))
    return questions.join(last_wins(stored, on, order).select(on, value), on, "left")


def resumed(items: DataFrame, store: str, key: str, work: Callable[[DataFrame], DataFrame], every: int | None = None, error: str = "error") -> DataFrame:
    """``work`` on the items that the store does not hold; the store's rows of all items that did not fail.

    ``work`` maps items to rows with their key and a boolean ``error``. What it returns is appended in turns of about
    ``every`` items, each committed as a whole, so a run that breaks off goes on where it
    stopped; items that failed before are tried again.
    """
    spark = items.sparkSession
    todo = items
    if exists(spark, store):
        todo = pending(items, spark.read.parquet(store).where(~F.col(error)).select(key).distinct(), key)
    turns = -(-todo.count() // every) if every else 1
    for t in range(turns):
        work(todo.where(F.pmod(F.xxhash64(key), F.lit(turns)) == t)).write.mode("append").parquet(store)
    if not exists(spark, store):
        return work(items.limit(0))
    rows = spark.read.parquet(store)
    fields = F.struct(*[c for c in rows.columns if c != key])
    best = rows.groupBy(key).agg(F.min_by(fields, error).alias("__r")).select(key, "__r.*")
    return best.join(items.select(key).distinct(), key, "left_semi")
