"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: Heading of a section in the Latin corpus: a short first word with a full stop that begins a line.
HEADING = r"(?m)^[A-Z][a-z]{1,5}\."
#: DuckDB: strip white space at both ends.
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
