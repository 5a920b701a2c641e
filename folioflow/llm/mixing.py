"""Mixing sources to target weights with DataFrame operations only.

Each source gets a share of the total by weight, at most ``max_epochs`` times its size;
what it cannot take goes to the others by weight until none is above. Within a source the
documents lie in the order of a hash-random key; distributed prefix sums of their sizes
tell where the budget that is left after whole epochs ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ranked, unused, written

WEIGHTS, TOTAL, MAX_EPOCHS = (3, 1, 2), 1.5, 2


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, source, size`` and the columns ``more``: the words of each whole text (null: none)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more,
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from one row ``(source, source_size)`` per source.

    Water-filling in closed form: with the sources in order of the level at which each is
    full, the common level is that of the first source which stays below its cap. One row
    per source meets in these windows, never a document.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs).withColumn("full_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("full_at", F.asc_nulls_last("source"))
    earlier, later = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(total) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later))
    s = s.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("full_at"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mixed(docs: DataFrame, split_last: bool = True, **options) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is the number of words the mix takes of the document, repeats counted: its
    size for every whole epoch and once more while the source's remaining budget lasts.
    The document at the budget's end gives just the words that are missing
    (``split_last``), or is taken whole if more than half of it fits. The key is a hash of
    doc_id, so reruns agree. A null text has no words and nothing is taken of it; a null
    source is a source of its own (last in order); a null doc_id lies in its place by a
    fixed key; equal keys lie by doc_id and size; repeated rows are documents of their own. Only the sizes of very long
    texts leave the scan. Other columns are not read; an empty table gives no rows.
    """
    return _planned(sized(docs), split_last, **options).select("doc_id", "source", "size", "source_size", "target", "taken")


def _planned(sizes: DataFrame, split_last: bool, **options) -> DataFrame:
    """``sizes (doc_id, source, size, ...)`` with ``source_size, target, taken``; further columns break ties."""
    d = written(sizes, "sizes")
    per_source = written(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "targets")
    key = F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rows = d.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("__source"), draw.alias("__draw"))
    rows = ranked(rows, ["__source"], "__draw", ["doc_id", "size", *d.columns[3:]], {"__start": "size"}, d.count())
    t = per_source.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("__source"), "source_size", "target")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    left = F.floor("target").cast("long") - epochs * F.col("source_size") - F.col("__start")
    part = F.greatest(F.lit(0).cast("long"), F.least(left, "size"))
    if not split_last:
        part = F.when(2 * part > F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    return rows.join(t, "__source").select(*d.columns, "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, whole each time.

    Every row is a document of its own, whatever its doc_id. A document without words (a null
    or empty text among them) adds nothing to any budget and is not taken. Sources weigh in the order of their
    names, a null source last; all columns are kept as they are, whatever their names; an empty
    table stays empty.
    """
    taken = ["doc_id", "source", "size", "source_size", "target", "taken"]
    row, times, copy = (unused([*docs.columns, *taken], x) for x in ("row", "times", "copy"))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    plan = _planned(sized(rows, row), False, **options)
    plan = plan.where("size > 0 and taken > 0").select(row, (F.col("taken") / F.col("size")).cast("int").alias(times))
    return rows.join(plan, row).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).drop(row, times, copy)
