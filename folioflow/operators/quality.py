"""Corpus checks: duplicates, lengths, formats, traces of the source in answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X


def duplicate_rate(df: DataFrame, key: Column) -> DataFrame:
    """``n, n_distinct, dup_rate``; exact, and one shuffle of a hash-sized key per distinct text."""
    per = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c"))
    out = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("k").alias("n_distinct"))
    return out.select("n", "n_distinct", F.when(F.col("n") > 0, F.round(1 - F.col("n_distinct") / F.col("n"), 6)).alias("dup_rate"))


def length_profile(df: DataFrame, length: Column, short: int = 15, long: int = 800) -> DataFrame:
    """``n, n_empty, n_short, n_long, min, median, max, mean`` of lengths.

    The median is the upper one and the mean is rounded down. Lengths are counted first,
    so the ordered window sees one row per length that occurs, not one per text.
    """
    per = df.groupBy(length.cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    per = per.withColumn("upto", F.sum("c").over(before)).withColumn("n", F.sum("c").over(total))
    when = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).alias
    return per.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), when(F.col("len") == 0)("n_empty"), when(F.col("len") < short)("n_short"), when(F.col("len") > long)("n_long"),
        F.min("len").alias("min_len"), F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("len"))).alias("median_len"), F.max("len").alias("max_len"),
        F.floor(F.sum(F.col("len") * F.col("c")) / F.sum("c")).alias("mean_len"),
    )


def short_answers(qa: DataFrame, below: int = 15) -> DataFrame:
    return qa.where(F.length("output") < below)


def alpaca_errors(qa: DataFrame) -> DataFrame:
    """How many rows lack a question or an answer."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return qa.agg(F.count(F.lit(1)).alias("n"), F.count_if(empty("instruction") | empty("output")).alias("errors"))


def roles_valid(roles: Column) -> Column:
    """At least two messages, the first from the user and the last from the assistant."""
    return F.coalesce((F.size(roles) >= 2) & (F.element_at(roles, 1) == "user") & (F.element_at(roles, -1) == "assistant"), F.lit(False))


def chunk_errors(chunks: DataFrame) -> DataFrame:
    keys = ("source", "chunk_id", "text", "is_table")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("errors"), F.count_if("is_table").alias("n_tables"), F.count_distinct("source").alias("n_sources"))


def trace_report(df: DataFrame, text: str = "text", pattern: str | None = None, wide: str = X.WIDE_TRACE, bare: Callable[[Column], Column] = X.strip) -> DataFrame:
    """``n, before, changed, after``: rows that show traces before and after cleaning, in one pass."""
    new = X.without_traces(F.col(text), pattern, bare)
    return df.select(F.col(text).alias("old"), new.alias("new")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("old").rlike(wide)).alias("before"), F.count_if(F.col("old") != F.col("new")).alias("changed"), F.count_if(F.col("new").rlike(wide)).alias("after")
    )


def trace_examples(df: DataFrame, order: str, text: str = "text", pattern: str | None = None, n: int = 6, bare: Callable[[Column], Column] = X.strip) -> DataFrame:
    """The first n rows that cleaning changes, before and after."""
    new = X.without_traces(F.col(text), pattern, bare)
    return df.select(order, F.col(text).alias("old"), new.alias("new")).where("old <> new").orderBy(order).limit(n)


def qa_report(qa: DataFrame, short: int = 15, long: int = 800) -> DataFrame:
    """One row on a question set (``instruction, output``): size, errors, duplicate rates, lengths of answers.

    Rates are exact: questions, and pairs of question and answer, are counted by their squeezed texts.
    """
    q, o = (X.squeeze(F.coalesce(c, F.lit(""))) for c in ("instruction", "output"))
    by = lambda name, df: df.select(F.col("dup_rate").alias(name))
    errors = alpaca_errors(qa)
    questions, pairs = by("question_dup_rate", duplicate_rate(qa, q)), by("pair_dup_rate", duplicate_rate(qa, F.concat_ws("\u0001", q, o)))
    lengths = length_profile(qa, F.length("output"), short, long).drop("n", "n_empty")
    return errors.join(F.broadcast(questions)).join(F.broadcast(pairs)).join(F.broadcast(lengths))
