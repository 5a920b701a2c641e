"""From pages to clean text: line normalisation, running headers and footers, reflow, contents lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X


def page_lines(pages: DataFrame, normalize: bool = True) -> DataFrame:
    """``doc_id, page_no, lines``: stripped lines of each page without page numbers.

    ``pages`` has ``doc_id, page_no, text``. NFKC runs in an Arrow UDF, everything else in the JVM.
    """
    lines = X.nfkc_lines("text") if normalize else F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), X.strip)
    return pages.select("doc_id", "page_no", F.filter(lines, lambda x: ~x.rlike(r"(?U)\A\d+\z")).alias("lines"))


def running_lines(lines: DataFrame, least: int = 3, longer_than: int = 2) -> DataFrame:
    """``doc_id, line, place, n``: first and last lines that recur on pages of a document."""
    ends = lines.where(F.size("lines") > 0).select(
        "doc_id", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.element_at("lines", k).alias("line")) for p, k in (("header", 1), ("footer", -1))])).alias("e")
    )
    found = ends.groupBy("doc_id", "e.place", "e.line").agg(F.count(F.lit(1)).alias("n"))
    return found.where((F.col("n") >= least) & (F.length("line") > longer_than)).select("doc_id", "line", "place", "n")


def without_running_lines(lines: DataFrame, **options) -> DataFrame:
    """Pages without their running header, and then without their running footer."""
    sets = running_lines(lines, **options).groupBy("doc_id").agg(*[F.collect_set(F.when(F.col("place") == p, F.col("line"))).alias(p) for p in ("header", "footer")])
    none = F.array().cast("array<string>")
    found = lines.join(sets, "doc_id", "left")
    cut = F.when((F.size("lines") > 0) & F.array_contains(F.coalesce("header", none), F.try_element_at("lines", F.lit(1))), F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines"))
    found = found.withColumn("lines", cut)
    cut = F.when((F.size("lines") > 0) & F.array_contains(F.coalesce("footer", none), F.try_element_at("lines", F.lit(-1))), F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines"))
    return found.withColumn("lines", cut).select("doc_id", "page_no", "lines")


def reflow(lines: DataFrame, endings: str = X.ENDINGS, short: int = 6, anchor: str = X.ANCHOR, joint: str = "") -> DataFrame:
    """``doc_id, para_no, text``: lines joined into paragraphs across pages.

    ``lines`` has ``doc_id, line_no, line`` in reading order. A paragraph ends after a line that
    ends a sentence, is short or is a heading, and at blank lines; so a line's paragraph
    is the number of ends before it, a running sum within the document.
    """
    blank = F.col("line") == ""
    ends = blank | (F.length("line") <= short) | F.col("line").rlike(f"[{endings}]\\z") | F.col("line").rlike(anchor.replace("(?md)", "(?d)\\A", 1) if anchor.startswith("(?md)") else f"\\A(?:{anchor})")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    island = F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0))
    numbered = lines.withColumn("island", island).where(~blank)
    paras = numbered.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    order = Window.partitionBy("doc_id").orderBy("island")
    return paras.select("doc_id", (F.row_number().over(order) - 1).alias("para_no"), F.array_join(F.transform("parts", lambda p: p["line"]), joint).alias("text"))


def document_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, line`` of texts."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def lines_without_contents(text: F.Column, sentence_marks: str = "。！？", entry: str = X.ENTRY) -> F.Column:
    """A text's lines without its contents lines; there may be none left, which the joined text does not tell from one empty line."""
    return F.filter(F.split(text, "\n"), lambda x: ~X.is_contents_line(x, sentence_marks, entry))


def without_contents(text: F.Column, sentence_marks: str = "。！？", entry: str = X.ENTRY) -> F.Column:
    """A text without its contents lines."""
    return F.array_join(lines_without_contents(text, sentence_marks, entry), "\n")


def clean_pages(pages: DataFrame, entry: str = X.ENTRY) -> DataFrame:
    """``doc_id, text``: the whole chain from pages to clean text."""
    body = without_running_lines(page_lines(pages))
    flat = body.select("doc_id", "page_no", F.posexplode("lines").alias("k", "line"))
    flat = flat.select("doc_id", F.struct("page_no", "k").alias("line_no"), "line")
    paras = reflow(flat)
    whole = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_no", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["text"]), "\n")
    every = pages.select("doc_id").distinct().join(whole, "doc_id", "left")
    return every.select("doc_id", without_contents(F.coalesce(text, F.lit("")), entry=entry).alias("text"))
