"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors are normalised and rotated by a random orthogonal matrix; the signs of the rotated
vector are its code, and the code's inner product with the vector it stands for is stored
as its correction factor. ``<code, other> / factor`` is an unbiased estimate of the cosine with
any other vector, with a confidence bound that depends on the factor and the dimension
alone; only pairs whose bound reaches the threshold are computed anew in double precision.

Candidates: the signs of further rotations are cut into ``tables`` keys of ``bits`` bits, so
many that a pair at the threshold misses all tables with a probability below ``MISS``. Each
label gets the numbers that cost least for its own vectors, by the sizes of the groups
that prefixes of their signs make: labels whose vectors crowd in one place get more bits.
A bucket that is large all the same is split into chunks of ``CHUNK`` classes (equal vectors are
one class throughout), each pair of chunks a unit of its own, so no task holds a large bucket.

Estimates come first: what travels to the units is ids, codes, factors and the rotated
vectors in 8 bits a component, whose rounding widens the bound. Classes with a pair inside the bound are then
sent to their units once more with the vectors themselves. Nothing but one row per class and unit leaves a unit: how
many vectors the class links to and a representative of its links there. A pair that meets
in several tables counts in the first alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, dropped, written

THRESHOLD, MISS, CHUNK, SURE = 0.98, 1e-4, 2048, 5.0
#: Numbers of bits that a label may get (``SPARE`` more than would leave one class to a bucket by chance, at most), and
#: what a class in a bucket costs in comparisons.
BITS, SPARE, PLACE = (4, 6, 8, 10, 12, 15, 18, 22, 27, 33, 40), 8, 1024


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, seed]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_of(bits: int, threshold: float = THRESHOLD) -> int:
    """Tables in which a pair at the threshold meets with a probability of 1 - ``MISS``."""
    alike = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(MISS) / math.log(1 - alike**bits))


def signs_of(unit: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) signs of unit vectors, from as many rotations as needed."""
    dim = unit.shape[1]
    return np.concatenate([unit @ rotation(dim, 1 + s) > 0 for s in range(math.ceil(n / dim))], axis=1)[:, :n]


def keys_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) bucket keys of unit vectors."""
    return signs_of(unit, bits * tables).reshape(len(unit), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and <code, vector> in (0, 1] of each."""
    r = unit @ rotation(unit.shape[1], 0)
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / math.sqrt(unit.shape[1])


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotated unit vectors in signed bytes, and the size of a step of each."""
    r = unit @ rotation(unit.shape[1], 0)
    step = np.abs(r).max(axis=1) / 127
    return np.rint(r / step[:, None]).astype(np.int8), step


def bounds(factor: np.ndarray, dim: int) -> np.ndarray:
    """How far each coded vector's estimates may be off."""
    return SURE * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(dim - 1, 1))


def estimates(code: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Estimated cosines of coded vectors (rows) with rotated ones (columns)."""
    dim = rotated.shape[1]
    signs = (np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    return (signs @ rotated.T.astype(np.float32)) / factor[:, None].astype(np.float32)


def candidates(code: np.ndarray, factor: np.ndarray, other: np.ndarray, step: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (coded vector, rounded vector) whose bound reaches the threshold.

    Rounding moves a component by half a step at most and the code's components are 1 / sqrt(dim) each.
    """
    dim = other.shape[1]
    estimate = estimates(code, factor, other * step[:, None].astype(np.float32))
    slack = bounds(factor, dim)[:, None] + (math.sqrt(dim) / 2) * step[None, :] / factor[:, None] + 1e-4
    return np.nonzero(estimate + slack >= threshold)


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines in doubles of the pairs (a[i], b[j]) of unit vectors."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return out


def _rows(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    """vec_id, label, key: the vector's bytes, null if the vector cannot link."""
    out = []
    for v in batch.column(2).to_pylist():
        x = None if v is None or any(y is None for y in v) else np.asarray(v, kind)
        good = x is not None and len(x) and np.isfinite(x).all() and x.any()
        out.append((x + 0).tobytes() if good else None)  # no negative zeros
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "key"])


def unit_vectors(keys: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(keys), kind).reshape(len(keys), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither squares that overflow nor that vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _each_pair(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows to be held against each other; in one chunk each pair once."""
    for k in range(0, len(left), 512):
        yield left[k : k + 512], right[k:] if same else right


UNIT = ["label", "dim", "t", "h", "i", "j"]
POSSIBLE = [*UNIT, "chunk", "cid", "bits"]


def _units(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each unit in batches that are sorted by units."""
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held) > 1:
            table = pa.Table.from_batches(held)
            if (found := work(table)) is not None:
                yield from found.combine_chunks().to_batches()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in UNIT:
            x = batch.column(c)
            if held:
                new[0] |= held[-1].column(c)[-1] != x[0]
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(False)
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for i, j in zip(cuts, cuts[1:]):
            if new[i]:
                yield from done()
                held = []
            if j > i:
                held.append(batch.slice(i, j - i))
    yield from done()


def _stacked(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind).reshape(table.num_rows, -1)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    chunk = table["chunk"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    return np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), i == j


def _possible(table: pa.Table, threshold: float) -> pa.Table:
    """The classes of a unit that have a pair inside the bound there."""
    code, other = _stacked(table, "code", np.uint8), _stacked(table, "rounded", np.int8)
    factor, step = (table[c].to_numpy().astype(np.float64) for c in ("factor", "step"))
    some = np.zeros(table.num_rows, bool)
    left, right, same = _sides(table)
    for a, b in _each_pair(left, right, same):
        i, j = candidates(code[a], factor[a], other[b], step[b], threshold)
        real = a[i] != b[j]
        some[a[i[real]]] = True
        some[b[j[real]]] = True
    return table.select(POSSIBLE).take(np.flatnonzero(some))


def _linked(table: pa.Table, kind: str, threshold: float) -> pa.Table | None:
    """``cid, links, root``: vectors linked and a representative, of the links in a unit that no earlier table has."""
    unit = unit_vectors(table["key"].to_pylist(), kind)
    code, factor = codes_of(unit)
    other, step = rounded(unit)
    bits, t = table["bits"][0].as_py(), table["t"][0].as_py()
    earlier = keys_of(unit, bits, t) if t else np.zeros((len(unit), 0), np.int64)
    n = table["n"].to_numpy()
    left, right, same = _sides(table)
    count, root = np.zeros(len(unit), np.int64), np.arange(len(unit))
    for x, y in _each_pair(left, right, same):
        i, j = candidates(code[x], factor[x], other[y], step[y], threshold)
        a, b = x[i], y[j]
        if same:
            a, b = a[a < b], b[a < b]
        hit = exact(unit, unit, a, b) >= threshold
        a, b = a[hit], b[hit]
        new = ~(earlier[a] == earlier[b]).any(axis=1)
        a, b = a[new], b[new]
        np.add.at(count, a, n[b])
        np.add.at(count, b, n[a])
        while len(a):  # smallest reachable position, by halving paths
            low = np.minimum(root[a], root[b])
            before = root.copy()
            for end in (a, b):
                np.minimum.at(root, root[end], low)
                np.minimum.at(root, end, low)
            root = root[root]
            if (root == before).all():
                break
    some = np.flatnonzero(count)
    if not len(some):
        return None
    ids = table["cid"].to_numpy()
    return pa.table({"cid": ids[some], "links": count[some], "root": ids[root[some]]})


def layouts(classes: DataFrame, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """``label, dim, bits`` with the least cost for each label (and length of vector) of ``classes``.

    A class is sent to ``tables_of(bits)`` buckets; how many others it is held against there
    is read off the groups that have the first ``bits`` signs in common.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                each, got = batch.column(1).to_pylist(), np.zeros(min(1024, whole.num_rows - k), np.int64)
                for size in {len(x) for x in each}:
                    at = [p for p, x in enumerate(each) if len(x) == size]
                    got[at] = signs_of(unit_vectors([each[p] for p in at], kind), BITS[-1]) @ (np.int64(1) << np.arange(BITS[-1], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in each], pa.int32()), pa.array(got)], ["label", "dim", "signs"])

    signs = classes.select("label", "key").mapInArrow(prefixes, "label string, dim int, signs long")
    most = classes.groupBy("label", F.length("key").alias("dim")).agg((F.log2(F.count(F.lit(1))) + SPARE).alias("most"))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.col("signs").bitwiseAND(F.lit((1 << b) - 1)).alias("h")) for b in BITS])).alias("x")
    cut = signs.join(most, ["label", "dim"]).select("label", "dim", "most", each).where((F.col("x.bits") <= F.col("most")) | (F.col("x.bits") == BITS[0]))
    sizes = cut.groupBy("label", "dim", "x.bits", "x.h").agg(F.count(F.lit(1)).alias("n"))
    tables = F.element_at(F.create_map(*[F.lit(x) for b in BITS for x in (b, tables_of(b, threshold))]), F.col("bits"))
    cost = sizes.groupBy("label", "dim", "bits").agg((F.sum(F.col("n") * F.col("n")) + PLACE * F.sum("n")).alias("c")).select("label", "dim", "bits", (F.col("c") * tables).alias("cost"))
    return cost.groupBy("label", "dim").agg(F.min(F.struct("cost", "bits"))["bits"].alias("bits"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their lengths are equal and
    their cosine is at least ``threshold``. A null, empty or zero vector, one with null or
    non-finite components, and a row without vec_id link with nothing (``component_id`` is the vec_id,
    ``kept`` true unless that is null). ``n_links`` counts the other rows linked, equal vectors
    included; vec_id should be unique, repeated rows link with each other. Other columns are
    not read; an empty table gives no rows.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), True) else "<f8"
    numbers = T.ArrayType(T.FloatType() if kind == "<f4" else T.DoubleType())
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(numbers).alias("embedding"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                yield _rows(whole.slice(k, 1024), kind)

    # a class is known by a 128-bit digest of its vector, so that vectors are shuffled once
    known = v.mapInArrow(digest, "vec_id long, label string, key binary").withColumn("digest", F.unhex(F.md5("key")))
    known = written(known, "vectors")
    able = F.col("label").isNotNull() & F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    classes = known.where(able).groupBy("label", "digest").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    classes = written(classes, "classes")
    layout = written(layouts(classes, kind, threshold), "layouts")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                each, bits = batch.column(1).to_pylist(), batch.column(3).to_pylist()
                got: list = [None] * len(each)
                for size, b in set(zip(map(len, each), bits)):
                    at = [p for p, x in enumerate(each) if len(x) == size and bits[p] == b]
                    unit = unit_vectors([each[p] for p in at], kind)
                    for p, code, factor, other, step, keys in zip(at, *codes_of(unit), *rounded(unit), keys_of(unit, b, tables_of(b, threshold))):
                        got[p] = (code.tobytes(), float(factor), other.tobytes(), float(step), keys)
                columns = zip(*got)
                types = (pa.binary(), pa.float32(), pa.binary(), pa.float32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in each], pa.int32()), batch.column(2), batch.column(3), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["label", "dim", "cid", "bits", "code", "factor", "rounded", "step", "keys"],
                )

    keyed = classes.select("label", "key", "cid", F.length("key").alias("dim")).join(layout, ["label", "dim"]).select("label", "key", "cid", "bits")
    codes = written(keyed.mapInArrow(coded, "label string, dim int, cid long, bits int, code binary, factor float, rounded binary, step float, keys array<long>"), "codes")
    bucket = UNIT[:4]
    places = codes.select("*", F.posexplode("keys").alias("t", "h")).drop("keys")
    large = places.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CHUNK).select(*bucket, F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    parts = places.join(large, bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    parts = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = parts.withColumn("i", F.least("chunk", "with")).withColumn("j", F.greatest("chunk", "with"))
    parts = parts.select(*UNIT, "chunk", "cid", "bits", "code", "factor", "rounded", "step").repartition(*UNIT).sortWithinPartitions(*UNIT)
    possible = parts.mapInArrow(lambda batches: _units(batches, lambda rows: _possible(rows, threshold)), "label string, dim int, t int, h long, i int, j int, chunk int, cid long, bits int")
    possible = written(possible, "possible")
    met = possible.join(classes.select("cid", "n", "key"), "cid").select(*POSSIBLE, "n", "key").repartition(*UNIT).sortWithinPartitions(*UNIT)
    tiles = written(met.mapInArrow(lambda batches: _units(batches, lambda rows: _linked(rows, kind, threshold)), "cid long, links long, root long"), "links")
    dropped(codes, layout, possible)
    links = tiles.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(tiles.select(F.col("cid").alias("u"), F.col("root").alias("v")).distinct())
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    named = roots.join(least, "root").select(F.col("node").alias("cid"), "component")
    whole = classes.select("label", "digest", "cid", "n").join(links, "cid", "left").join(named, "cid", "left")
    out = known.select("vec_id", "label", "digest").join(whole, ["label", "digest"], "left")
    there = F.col("vec_id").isNotNull()
    out = out.select(
        "vec_id", F.when(there, F.coalesce(F.col("links") + F.col("n") - 1, F.col("n") - 1)).otherwise(0).alias("n_links"),
        F.when(there, F.coalesce("component", "cid", "vec_id")).alias("component_id"),
    ).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
