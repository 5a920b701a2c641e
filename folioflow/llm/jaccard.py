"""Near copies by the Jaccard similarity of word shingles.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of ``LIKE`` or
more. Candidates share a band of ``DEEP`` MinHash values; a pair at ``LIKE`` shares none of
the ``BANDS`` with probability (1 - LIKE ** DEEP) ** BANDS, below 1e-4. Every candidate is
verified on the whole sets.

A bucket of a few sets is compared pair by pair. In a larger one all are compared with
``FIRST`` of them, drawn anew for each bucket. If it then holds several components, members
outside the one that has most of it are compared with more of that one, up to ``CENTRES`` in all.
Between these steps a component is held as a star, not by all its links. If a bucket still holds several components,
these are put together by the rarest shingles of their members: two sets at ``LIKE`` share one
of the rarest fifth of their shingles, whatever else they hold, so members of different
components are compared only where they do and where their sizes and the shingles behind it leave
room for it. That is exact, and links inside a component add nothing. What is left to compare is
members of a large group that are just not alike to others of it.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, by_batch, components, dropped, written

WORDS, LIKE, BANDS, DEEP, FEW, FIRST, CENTRES = 5, 0.8, 24, 5, 32, 1, 8
#: Words of a text that are taken up at a time.
BLOCK = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.array([xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)
_A = np.array([xxh64_intdigest(b"a%d" % i) | 1 for i in range(BANDS * DEEP)], np.uint64).astype(np.uint32)[:, None]
_B = np.array([xxh64_intdigest(b"b%d" % i) for i in range(BANDS * DEEP)], np.uint64).astype(np.uint32)[:, None]


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of the base modulo 2 ** 64, and their inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.array([1], np.uint64)
        for i in range(bits):
            p = np.concatenate([p, p * np.uint64(pow(base, 1 << i, 1 << 64))])
        out.append(p)
    return out[0], out[1]


def shingles(text: str | None) -> np.ndarray:
    """Ascending codes of the distinct shingles of a whole text; fewer than ``WORDS`` words are one shingle.

    A code is the polynomial hash of the shingle's bytes, read off the running hash of the
    words joined by single spaces.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) < WORDS:
        return np.array([xxh64_intdigest(b" ".join(words))], np.uint64)
    out = []
    for at in range(0, len(words) - WORDS + 1, BLOCK):
        whole = np.frombuffer(b" ".join(words[at : at + BLOCK + WORDS - 1]), np.uint8)
        up, down = _powers(max(16, len(whole).bit_length()))
        running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[whole] * up[: len(whole)])])
        spaces = np.flatnonzero(whole == 32)
        starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(whole)]])
        first, last = starts[: len(starts) - WORDS + 1], ends[WORDS - 1 :]
        h = (running[last] - running[first]) * down[first]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_BASE)
        out.append(np.unique(h ^ (h >> np.uint64(29))))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def set_key(codes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxh64_intdigest(codes.tobytes()))))


def bands(codes: np.ndarray) -> list[int]:
    """The keys of the buckets of a set of shingles, one for each band."""
    least = np.full(BANDS * DEEP, 0xFFFFFFFF, np.uint32)
    x = (codes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[None, at : at + 512] * _A + _B).min(axis=1), out=least)
    raw = least.tobytes()
    return np.array([xxh64_intdigest(raw[4 * DEEP * i : 4 * DEEP * (i + 1)], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def _sets(rows: DataFrame) -> DataFrame:
    """``s, codes`` of ``rows (s, text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x).view(np.int64) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["s", "codes"])

    return by_batch(rows, ["s", "text"], run, "s long, codes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs (u, v)`` that are alike."""
    a, b = (sets.select(F.col("s").alias(k), F.col("codes").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    both = pairs.join(a.withColumn("na", F.size("a")), "u").join(b.withColumn("nb", F.size("b")), "v")
    able = both.where(F.least("na", "nb") >= LIKE * F.greatest("na", "nb") - 1e-9)
    shared = F.size(F.array_intersect("a", "b"))
    return able.where(shared >= LIKE * (F.col("na") + F.col("nb") - shared) - 1e-9).select("u", "v")


def links(banded: DataFrame, texts: DataFrame, few: int = FEW, centres: int = CENTRES) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all candidates that are alike.

    ``banded`` has one row ``(s, row, bands)`` per distinct set of shingles, ``texts`` has ``(row, text)``.
    """
    keyed = banded.select("s", F.explode("bands").alias("k"))
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keyed.join(sizes, "k"), "bands")
    needed = banded.select("s", "row").join(met.select("s").distinct(), "s").select("s", "row")
    sets = written(_sets(texts.join(needed, "row").select("s", "text")), "sets")
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    small, large = met.where(F.col("n") <= few).select("k", "s"), met.where(F.col("n") > few).select("k", "s")
    pairs = small.withColumnRenamed("s", "u").join(small.withColumnRenamed("s", "v"), "k").where("u < v").select("u", "v")
    if large.isEmpty():
        return written(_verified(written(ordered(pairs), "pairs"), sets), "alike")
    tree, held = None, large.select("k", "s", F.col("s").alias("root"), F.lit(True).alias("main"))
    for at, end in pairwise(sorted({0, min(FIRST, centres), centres})):
        draws = [F.min(F.struct(F.xxhash64(F.lit(i), "k", "s").alias("h"), "s", "root")) for i in range(at, end)]
        drawn = held.where("main").groupBy("k").agg(F.array_distinct(F.array(*draws)).alias("c")).select("k", F.explode("c").alias("c")).select("k", F.col("c.s").alias("u"), F.col("c.root").alias("to"))
        stars = held.withColumnRenamed("s", "v").join(drawn, "k").where("root <> to").select("u", "v")
        found = _verified(written(ordered(stars if tree is not None else stars.union(pairs)), "pairs"), sets)
        roots = components(written(tree.union(found) if tree is not None else found, "alike"))
        tree = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v")  # a row for each node says as much as all links
        rooted = held.select("k", "s").join(roots.withColumnRenamed("node", "s"), "s", "left").select("k", "s", F.coalesce("root", "s").alias("root"))
        parts = rooted.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("parts"))
        held = written(rooted.join(parts.where("parts > 1"), "k").select("k", "s", "root", (F.col("root") == F.col("most")).alias("main")), "held")
    open_ = written(held.select("s", "root").distinct(), "open")
    keys = written(_prefixes(sets.join(open_, "s")), "prefixes")
    dropped(met, held, open_)
    a, b = (keys.select("c", *[F.col(x).alias(f"{x}_{k}") for x in ("s", "root", "n", "at")]) for k in "ab")
    # the first code that two alike sets have in common leaves enough codes behind it, and neither set is much larger
    near = F.least("n_a", "n_b") >= LIKE * F.greatest("n_a", "n_b") - 1e-9
    enough = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= LIKE / (1 + LIKE) * (F.col("n_a") + F.col("n_b")) - 1e-9
    across = a.join(b, "c").where((F.col("root_a") < F.col("root_b")) & near & enough).select(F.col("s_a").alias("u"), F.col("s_b").alias("v"))
    return tree.union(_verified(written(ordered(across), "across"), sets))


def _prefixes(sets: DataFrame) -> DataFrame:
    """``s, root, n, at, c``: of each of ``sets (s, codes, root)`` its rarest codes (``at`` from 0 among its ``n``), as many as an alike set cannot lack altogether.

    Two sets at ``LIKE`` have more than that share of the larger one's codes in common, so if all
    sets are ordered alike their first codes meet. First here are codes that only one component
    holds, which are counted and not given, as nothing is left to link there; the others follow
    by how many hold them.
    """
    codes = sets.select("s", "root", F.size("codes").alias("n"), F.explode("codes").alias("c"))
    often = codes.groupBy("c").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("c", "often")
    lists = codes.join(often, "c").groupBy("s", "root", "n").agg(F.array_sort(F.collect_list(F.struct("often", "c"))).alias("o"))
    before = F.col("n") - F.size("o")
    first = F.slice("o", F.lit(1), F.greatest(F.col("n") - F.ceil(F.lit(LIKE) * F.col("n") - 1e-9) + 1 - before, F.lit(0)).cast("int"))
    return lists.select("s", "root", "n", before.alias("before"), F.posexplode(first).alias("at", "x")).select("s", "root", "n", (F.col("before") + F.col("at")).alias("at"), "x.c")
