"""Scans: JSON arrays, chunk lists, PDFs, listings, a paged service, blobs, settings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioflow import schemas
from folioflow.functions import text as X
from folioflow.lineage import exists, numbered
from folioflow.operators.models import PdfParser


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file (or folder) of JSON arrays of objects; rows that cannot be read are null throughout."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_or_empty(spark: SparkSession, path: str, schema: str, fresh: bool = False) -> DataFrame:
    """The same, or no rows: when asked for, if there is no file, or where it is damaged."""
    if fresh or not exists(spark, path):
        return spark.createDataFrame([], schema)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    return json_objects(spark, path, schema).na.drop("all", subset=names)


def json_strings(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``file, ord, text`` of JSON arrays of strings or of objects with a ``text`` (and ``source``).

    Files that hold no array give no rows; blank texts go but keep their ordinal.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    items = raw.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("ord", "item"))
    o = F.from_json("item", "text string, source string")
    text = F.when(F.startswith(F.ltrim("item"), F.lit("{")), o["text"]).otherwise(F.col("item"))
    source = F.when(F.startswith(F.ltrim("item"), F.lit("{")), o["source"])
    return items.select("file", "ord", text.alias("text"), F.coalesce(source, "file").alias("source")).where(X.strip(F.coalesce("text", F.lit(""))) != "")


def chunk_records(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Index records of a folder of chunk files; ``rec_id`` follows file name and ordinal.

    In a merged file each item names its own source, which then gives the file and the company.
    """
    t = json_strings(spark, path, pattern)
    n = numbered(t, ["file", "ord"], "rec_id")
    source = F.when(F.col("source") != "", F.col("source")).otherwise(F.col("file"))
    return n.select("rec_id", X.company_label(source).alias("company"), source.alias("file"), F.col("ord").alias("chunk_idx"), "text")


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf", limit: int | None = None) -> DataFrame:
    """``file, path, size`` sorted by name; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    out = found.select(F.col("_metadata.file_name").alias("file"), "path", F.col("length").alias("size")).orderBy("file")
    return out.limit(limit) if limit else out


def pdf_pages(spark: SparkSession, folder: str, factory: Callable[[], PdfParser], pattern: str = "*.pdf") -> DataFrame:
    """``doc_id, page_no, text, error``: one row per page; a file that fails gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("_metadata.file_name").alias("doc_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = factory()
        for whole in batches:
            for k in range(whole.num_rows):
                doc, rows = whole.column(0)[k].as_py(), []
                try:
                    rows = [(doc, n, t or "", None) for n, t in enumerate(parser.pages(whole.column(1)[k].as_py()))]
                except Exception as e:
                    rows = [(doc, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    a, b, c, d = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.string())], ["doc_id", "page_no", "text", "error"])

    return files.mapInArrow(run, f"{schemas.PAGE}, error string")


def pdf_tables(spark: SparkSession, folder: str, factory: Callable[[], PdfParser], pattern: str = "*.pdf") -> DataFrame:
    """``doc_id, page_no, table_no, page_text, rows, error`` with pages counted from 1; a file that fails gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.col("_metadata.file_name").alias("doc_id"), "content")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.string())), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = factory()
        for whole in batches:
            for k in range(whole.num_rows):
                doc = whole.column(0)[k].as_py()
                try:
                    data = whole.column(1)[k].as_py()
                    pages = parser.pages(data)
                    rows = [(doc, p + 1, n, pages[p] or "", t, None) for n, (p, t) in enumerate(parser.tables(data))]
                except Exception as e:
                    rows = [(doc, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "page_no", "table_no", "page_text", "rows", "error"])

    return files.mapInArrow(run, f"{schemas.TABLE}, error string")


def fetched(manifest: DataFrame, fetch: Callable[[str], bytes], hosts: list[str], path: str = "adjunctUrl", wait: float = 0.3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``manifest`` with ``content, host, status``: each host is tried in turn, the first answer counts.

    After every row a task waits, so as not to press the service. Rows without a path are skipped, not failed; ``fetch`` is injected (nothing here opens a connection).
    """
    kept = manifest.columns
    schema = manifest.select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("status")).schema
    at = kept.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            content, used, status = [], [], []
            for p in whole.column(at).to_pylist():
                got, host, said = None, None, "skipped" if not p else "failed"
                for h in hosts if p else ():
                    try:
                        got, host, said = fetch(h.rstrip("/") + "/" + p.lstrip("/")), h, "ok"
                        break
                    except Exception as e:
                        said = f"failed: {e}"
                if p:
                    sleep(wait)
                content.append(got)
                used.append(host)
                status.append(said)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(content, pa.binary()), pa.array(used, pa.string()), pa.array(status, pa.string())], [*kept, "content", "host", "status"])

    return manifest.mapInArrow(run, schema)


class PagedSource(DataSource):
    """Announcements from a paged service, page after page.

    The scan stops at the first page that is empty or fails, or once ``companies`` (default
    50) companies have an annual report among the rows so far; a page that was begun is given whole. It is one input
    partition, as each page decides whether the next is asked for. Options: ``pages``
    (default 20, at most), ``companies``, ``wait`` in seconds between pages, and ``files``, a folder with one JSON page
    per file ``<n>.json``, which stands for the service where there is no network. ``fetch``
    may be replaced in a subclass to speak to a real one.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_announcements"

    def schema(self) -> str:
        return f"{schemas.ANNOUNCEMENT}, seen long"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, type(self).fetch)

    @staticmethod
    def fetch(options: dict, page: int) -> list[dict]:
        with open(f"{options['files']}/{page}.json", encoding="utf-8") as f:
            return json.load(f).get("announcements") or []


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable):
        self.options, self.fetch = dict(options), fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        seen: set[str] = set()
        for page in range(1, int(self.options.get("pages", 20)) + 1):
            try:
                rows = self.fetch(self.options, page)
            except Exception:
                rows = []  # as an empty page: what came before it counts
            for k, r in enumerate(rows):
                t = r.get("announcementTime")
                yield (r.get("secCode"), r.get("secName"), r.get("announcementTitle"), int(t) if t else None, r.get("adjunctUrl"), r.get("announcementId"), page * 10_000 + k)
                title = r.get("announcementTitle") or ""
                if r.get("secCode") and "年度报告" in title and "摘要" not in title and "英文" not in title:
                    seen.add(r["secCode"])
            if not rows or len(seen) >= int(self.options.get("companies", 50)):
                return
            time.sleep(float(self.options.get("wait", 0)))


def settings(lines: list[str], comments: bool = True) -> dict[str, str]:
    """``k=v`` lines as a dict; blank lines, lines without "=" and comments are skipped, quotes go."""
    out = {}
    for line in lines:
        s = line.strip()
        if s and "=" in s and not (comments and s.startswith("#")):
            k, _, v = s.partition("=")
            out[k.strip()] = v.strip().strip("\"'")
    return out


def vector_index(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """The records of an index with their vectors, and the name of the model that made them."""
    meta = f"{path}/model"
    model = spark.read.schema("value string").text(meta).first().value if exists(spark, meta) else None
    return spark.read.parquet(f"{path}/records"), model


def chat(lines: Iterator[str], answer: Callable[[str], str]) -> Iterator[str]:
    """Answers to questions until a blank line, "exit" or "quit"."""
    for line in lines:
        q = line.strip()
        if not q or q.lower() in ("exit", "quit"):
            return
        yield answer(q)
