"""Sections and chunks of a text, as array expressions: no shuffle until chunks are deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as X


def split_sections(text: Column, anchor: str = X.ANCHOR) -> Column:
    """``array<struct<header, body>>``; null if there are fewer than two headings.

    What stands before the first heading belongs to no section.
    """
    heads = F.regexp_extract_all(text, F.lit(anchor), F.lit(0))
    bodies = F.split(text, anchor, -1)
    pairs = F.transform(heads, lambda h, i: F.struct(X.strip(h).alias("header"), X.strip(F.element_at(bodies, i + 2)).alias("body")))
    return F.when(F.size(heads) >= 2, pairs)


def reorder(text: Column, anchor: str = X.ANCHOR, rank=X.section_rank) -> Column:
    """The text with its sections in the order of their numbers; equal ones keep their order."""
    keyed = F.transform(split_sections(text, anchor), lambda s, i: F.struct(rank(s["header"]).alias("rank"), i.alias("at"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda x: F.concat(x["s"]["header"], F.lit("\n"), x["s"]["body"]))
    return F.coalesce(F.array_join(ordered, "\n"), text)


def dropped_chars(text: Column, anchor: str = X.ANCHOR) -> Column:
    """Characters before the first heading, which reordering loses."""
    heads = F.regexp_extract_all(text, F.lit(anchor), F.lit(0))
    return F.when(F.size(heads) >= 2, F.length(F.element_at(F.split(text, anchor, -1), 1))).otherwise(0)


def sliding(text: Column, size: int = 1000, step: int = 1000, longer_than: int = 50) -> Column:
    """Pieces of ``size`` characters every ``step``, stripped, without very short ones."""
    n = F.ceil(F.length(text) / F.lit(step)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: X.strip(F.substr(text, i * step + 1, F.lit(size))))
    return F.filter(pieces, lambda p: F.length(p) > longer_than)


def chunks(text: Column, size: int = 1000, step: int = 1000, longer_than: int = 50, anchor: str = X.ANCHOR) -> Column:
    """Sections with their headings, long ones cut further; windows if the text has no sections."""
    sections = F.transform(split_sections(text, anchor), lambda s: X.strip(F.concat(s["header"], F.lit("\n"), s["body"])))
    raw = F.coalesce(sections, sliding(text, size, step, longer_than))
    cut = F.flatten(F.transform(raw, lambda p: F.when(F.length(p) > size, sliding(p, size, step, longer_than)).otherwise(F.array(p))))
    return F.filter(cut, lambda p: F.length(p) > longer_than)


def deduplicated(chunks: DataFrame, doc: str | None = "doc_id", order: str = "chunk_id", length: int = 200) -> DataFrame:
    """Chunks without those whose first characters repeat an earlier chunk of the document.

    ``doc=None`` looks across documents; then the earliest in (doc_id, order) stays.
    """
    key = X.normalize_key(F.col("text"), length)
    if doc is None:  # a chunk that half the corpus shares: partial minima, not one task's window
        firsts = chunks.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*chunks.columns), F.struct("doc_id", order)).alias("c"))
        return firsts.select("c.*")
    w = Window.partitionBy(doc, key).orderBy(order)
    return chunks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def build_chunks(texts: DataFrame, tables: DataFrame | None = None, size: int = 1000, step: int = 1000) -> DataFrame:
    """``doc_id, chunk_id, text, is_table`` from ``doc_id, text`` and labelled tables.

    ``tables`` has ``doc_id, page_no, table_no, title, markdown``; tables follow the text, are
    never cut, and lose repeats like the rest. ``chunk_id`` counts the chunks that stay, from 1.
    """
    body = texts.select("doc_id", F.posexplode(chunks(reorder(F.col("text")), size, step)).alias("at", "text")).select("doc_id", F.lit(0).alias("kind"), F.struct(F.lit(0).alias("page_no"), F.col("at")).alias("at"), "text")
    if tables is not None:
        label = F.format_string("【%s 第%d页】\n%s", "title", "page_no", "markdown")
        body = body.unionByName(tables.select("doc_id", F.lit(1).alias("kind"), F.struct(F.col("page_no").cast("int").alias("page_no"), F.col("table_no").cast("int").alias("at")).alias("at"), label.alias("text")))
    kept = deduplicated(body.withColumn("place", F.struct("kind", "at")), order="place")
    order = Window.partitionBy("doc_id").orderBy("place")
    return kept.select("doc_id", F.row_number().over(order).alias("chunk_id"), "text", X.is_table(F.col("text")).alias("is_table"))


def retention(texts: DataFrame, anchor: str = X.ANCHOR, size: int = 1000) -> DataFrame:
    """Per document: headings, sections, chunks, characters kept, their share and mean digit ratio."""
    t = texts.withColumn("c", chunks(F.col("text"), size, size, anchor=anchor))
    kept = F.aggregate("c", F.lit(0), lambda a, x: a + F.length(x))
    ratio = F.aggregate("c", F.lit(0.0), lambda a, x: a + X.digit_ratio(x)) / F.size("c")
    return t.select(
        "doc_id", F.size(F.regexp_extract_all("text", F.lit(anchor), F.lit(0))).alias("n_anchors"), F.coalesce(F.size(split_sections(F.col("text"), anchor)), F.lit(0)).alias("n_sections"),
        F.size("c").alias("n_chunks"), kept.alias("kept_chars"), (kept / F.greatest(F.length("text"), F.lit(1))).alias("kept_ratio"), F.when(F.size("c") > 0, ratio).alias("mean_digit_ratio"),
    )
