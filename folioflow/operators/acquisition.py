"""From announcements to a manifest of files to fetch."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.lineage import numbered


def first_per_key(df: DataFrame, key: str, *order, keep: str | None = None) -> DataFrame:
    """The first row of each key in the given order; rows without a key are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def newest(df: DataFrame, time: str, n: int, *ties) -> DataFrame:
    """The n latest rows; a time that is null or no number counts as 0."""
    return df.orderBy(F.coalesce(F.col(time).try_cast("bigint"), F.lit(0)).desc(), *ties).limit(n)


def recent_reports(announcements: DataFrame, n: int = 50) -> DataFrame:
    """The newest annual report of each of the n companies that reported last.

    ``announcements`` carries ``seen``, the order in which pages delivered its rows: the first
    report of a company counts, as in a scan that remembers what it has seen.
    """
    reports = announcements.where(X.is_annual_report(F.col("announcementTitle")))
    return newest(first_per_key(reports, "secCode", "seen"), "announcementTime", n, "seen")


def manifest(reports: DataFrame, host: str) -> DataFrame:
    """``idx, code, name, title, date, url, file`` of the reports that have a file; ``idx`` counts all reports, newest first."""
    times = reports.withColumn("__age", -F.coalesce(F.col("announcementTime").try_cast("bigint"), F.lit(0)))
    r = numbered(times, ["__age", "seen"], "__at").withColumn("idx", (F.col("__at") + 1).cast("int")).where(F.trim(F.coalesce("adjunctUrl", F.lit(""))) != "")
    date = X.millis_to_date(F.col("announcementTime"))
    return r.select(
        "idx", F.col("secCode").alias("code"), F.col("secName").alias("name"), F.col("announcementTitle").alias("title"), date.alias("date"),
        F.concat(F.lit(host.rstrip("/") + "/"), F.ltrim(F.trim("adjunctUrl"), F.lit("/"))).alias("url"), X.report_file(F.col("idx"), F.col("secCode"), F.col("secName"), date).alias("file"),
    )


def fetch_report(fetched: DataFrame) -> DataFrame:
    """``n, ok, skipped, failed`` of fetched files: the manifest's count is ``ok``."""
    status = F.col("status")
    return fetched.agg(F.count(F.lit(1)).alias("n"), F.count_if(status == "ok").alias("ok"), F.count_if(status == "skipped").alias("skipped"), F.count_if(status.startswith("failed")).alias("failed"))


def redrawn(df: DataFrame, order: str, sizes: tuple[int, ...] = (100, 40), seeds: tuple[int, ...] = (42, 7)) -> DataFrame:
    """A draw from a draw, each with its seed: the later one picks from the rows as the earlier one ordered them."""
    out = drawn(df, order, sizes[0], seeds[0])
    for n, seed in zip(sizes[1:], seeds[1:]):
        out = drawn(out.withColumnRenamed("draw", "__draw"), "__draw", n, seed).drop("__draw")
    return out


def round_robin(df: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """n rows taken from the strata in turn: all firsts, then all seconds, strata in name order."""
    w = Window.partitionBy(stratum).orderBy(order)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).orderBy("pick", stratum).limit(n)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: reproducible, independent of partitions."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(draw, key).limit(n)


def drawn(df: DataFrame, order: str, n: int, seed: int = 42) -> DataFrame:
    """The rows that Python's ``random.Random(seed).sample`` would pick from the ordered rows.

    Only the n positions are drawn on the driver; the rows meet them by their position.
    """
    total = df.count()
    at = random.Random(seed).sample(range(total), min(n, total))
    picks = df.sparkSession.createDataFrame(list(enumerate(at)), "draw int, __at long")
    return numbered(df, [order], "__at").join(F.broadcast(picks), "__at").drop("__at").orderBy("draw")
