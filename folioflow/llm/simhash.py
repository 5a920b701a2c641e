"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints: 64 bits over the XXH64 (seed 42) values of 3-word shingles. Two
fingerprints link when they differ in at most ``RADIUS`` = 2 bits.

Candidate tables come from a covering family: every bit position gets a non-zero vector
of F_2^3, and each of the 7 non-zero ``v`` of F_2^3 makes a mask of the positions whose
vector has inner product 1 with ``v``. Two differing positions span at most two
dimensions, so some ``v`` is orthogonal to both and that mask sees none of the
differences: every pair within the radius shares a masked value, with certainty.

A bucket of a few distinct fingerprints is compared pair by pair. A larger one is not:
two fingerprints differ in at most two bits exactly if they share a point at distance one
or less from both, so each fingerprint is sent to itself and its one-bit neighbours
(only at positions outside the mask, as the bucket agrees inside it) and everything that
meets there is tied to the smallest fingerprint there. That is exact, linear in
the bucket and needs no cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import jaccard
from .common import LOWER, by_batch, components, unused, written

SHINGLE, SEED, RADIUS, SMALL = 3, 42, 2, 32


def masks() -> list[int]:
    """The 7 masks of the covering family, positions dealt evenly over the 7 vectors."""
    return [sum(1 << i for i in range(64) if bin((i % 7 + 1) & v).count("1") % 2) for v in range(1, 8)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # bounded working memory for very long texts
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = [signed(fingerprint(x)) for x in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long."""
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id", "text"], _batch, "doc_id long, fp long")


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs within the radius.

    ``distinct`` has one row per fingerprint (``fp``).
    """
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks())])).alias("x")
    ).select("fp", "x.*")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keyed.join(sizes, ["t", "k"]), "buckets")
    few = met.where(F.col("n") <= small).select("t", "k", "fp")
    pairs = few.select("t", "k", F.col("fp").alias("u")).join(few.select("t", "k", F.col("fp").alias("v")), ["t", "k"]).where(
        (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    ).select("u", "v")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)])
    points = met.where(F.col("n") > small).select(
        "t", "k", "fp", F.explode(F.filter(flips, lambda b: b.bitwiseAND(F.col("m")) == 0)).alias("b")
    ).select("t", "fp", F.col("fp").bitwiseXOR(F.col("b")).alias("p"))
    least = points.groupBy("t", "p").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = points.join(least.select("t", "p", "u"), ["t", "p"]).where("u <> fp").select("u", F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest doc_id reachable over links, the document itself
    included. A null or empty text has fingerprint zero and links like any other; a null
    doc_id never becomes a component's id unless no member has one (then null). Repeated
    rows give repeated results. Very long texts are taken one by one, their shingles in bounded blocks. Columns
    other than doc_id and text are not read; an empty table gives no rows.
    """
    prints = written(fingerprints(docs), "fingerprints")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(firsts.select("fp")))
    joined = firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _prints_and_bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints, keys, bands = [], [], []
    for x in batch.column(2).to_pylist():
        codes = jaccard.shingles(x)
        prints.append(signed(fingerprint(x)))
        keys.append(jaccard.set_key(codes))
        bands.append(jaccard.bands(codes))
    return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["row", "doc_id", "fp", "s", "bands"])


def firsts(rows: DataFrame) -> DataFrame:
    """The ``row`` of the first of each group of near copies among ``rows (row, doc_id, text)``: by doc_id, nulls last, then by row.

    Near copies are texts whose fingerprints link and texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more.
    """
    prints = written(by_batch(rows, ["row", "doc_id", "text"], _prints_and_bands, "row long, doc_id long, fp long, s long, bands array<long>"), "fingerprints")
    sets = written(prints.groupBy("s").agg(F.min("row").alias("row"), F.min("fp").alias("fp")), "sets")
    banded = prints.join(sets.select("row"), "row", "left_semi").select("s", "row", "bands")
    alike = jaccard.links(banded, rows.select("row", "text"))
    of = sets.select("s", F.col("fp").alias("to"))
    # in terms of fingerprints: those of one set are tied to the set's first, linked sets by their firsts
    ties = prints.select("s", "fp").distinct().join(of, "s").where("fp <> to").select(F.col("fp").alias("u"), F.col("to").alias("v"))
    across = alike.join(of.select(F.col("s").alias("u"), F.col("to").alias("a")), "u").join(of.select(F.col("s").alias("v"), F.col("to").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(links(prints.select("fp").distinct()).union(ties).union(across))
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    each = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return each.select("first.row")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id.

    Rows are known by their place and not by doc_id: of repeated rows one stays, different
    texts under one doc_id are documents of their own, and a row without a doc_id stays
    only if its whole group has none, one of the group then. Null and empty texts are one group. All
    columns are kept as they are, whatever their names; very long texts are taken one by one; an
    empty table stays empty.
    """
    row = unused(docs.columns, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = firsts(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.join(found.withColumnRenamed("row", row), row, "left_semi").drop(row)
