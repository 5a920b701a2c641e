"""Sinks: every write is committed as a whole, per table or per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.lineage import exists


def overwrite(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replace a table; for JSON, one array of objects per part is left to :func:`json_array`."""
    df.write.mode("overwrite").format(format).save(path)


def json_array(df: DataFrame, path: str, order: list[str], most: int = 1_000_000) -> None:
    """A report as one JSON array in a text file, in the given order.

    One file is one task's work: more than ``most`` rows are an error, and belong into :func:`overwrite`.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a JSON array takes {most} rows at most")
    rows = df.select(F.struct(*order).alias("o"), F.to_json(F.struct(*df.columns)).alias("j"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("o", "j"))).alias("r"))
    one.select(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ",\n"), F.lit("]"))).write.mode("overwrite").text(path)


def per_document(df: DataFrame, path: str, doc: str = "doc_id") -> None:
    """Artefacts partitioned by document; only the documents at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(doc).parquet(path)


def vector_index(records: DataFrame, path: str, model: str, partition: str | None = None) -> None:
    """Records with vectors (partitioned, say by company, so that routing prunes) and the model's name."""
    w = records.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(f"{path}/records")
    records.sparkSession.createDataFrame([(model,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def backup_once(df: DataFrame, path: str) -> None:
    """Keep the raw rows the first time and never again."""
    if not exists(df.sparkSession, path):
        df.write.mode("ignore").parquet(path)


def append_done(done: DataFrame, ledger: str) -> None:
    done.write.mode("append").parquet(ledger)


def save(df: DataFrame, path: str, dry: bool = False) -> str:
    """Write, or only say what would be done."""
    if dry:
        return df._jdf.queryExecution().simpleString()
    overwrite(df, path)
    return path


def report(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=False)
