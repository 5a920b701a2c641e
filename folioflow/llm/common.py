"""Helpers shared by the corpus operators: batches, running sums, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.lineage import dropped, fresh_path, written  # noqa: F401

#: ASCII bytes A-Z to a-z; everything else stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of texts that a Python worker takes up at a time.
PORTION = 4 << 20
#: Java form of a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portions(batch: pa.RecordBatch, size: int = PORTION, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes in all columns of texts together, of one row at least and ``rows`` at most.

    The session's batch size counts rows and a text may be very long, so this bounds what
    a worker holds besides the batch: a single very long text, or ``size`` bytes.
    """
    n = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            n += pc.fill_null(pc.binary_length(column), 0).to_numpy(False)
    ends, at = np.cumsum(n), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        end = min(end, at + rows)
        yield batch.slice(at, end - at)
        at = end


def by_batch(df: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns; ``function`` maps one record batch to one or none.

    Batches of texts are cut to :func:`portions` here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def unused(columns: list[str], name: str) -> str:
    """A column name that the table does not have, whatever its letters' case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fraction(*columns) -> F.Column:
    """A reproducible pseudo-random double in [0, 1) made from the columns' values."""
    return F.pmod(F.xxhash64(F.lit("draw"), *columns), F.lit(1 << 52)).cast("double") / float(1 << 52)


def ranked(df: DataFrame, groups: list[str], draw: str, ties: list[str], counts: dict[str, str], rows: int) -> DataFrame:
    """Exclusive running sums within each group, in the order of a uniform draw.

    ``draw`` names a column of uniform doubles in [0, 1), ``groups`` columns without nulls;
    ``counts`` maps output names to the summed columns; ``rows`` is the number of rows of
    ``df``. The draw is cut into about sqrt(rows) equal ranges, so a hot group becomes as
    many tasks; the sums of whole ranges give each range its offset and a window inside
    the range does the rest. No window gets more than about sqrt(rows) rows for each hot
    group, whatever the size.
    """
    cut = df.withColumn("__b", F.floor(F.col(draw) * max(1, math.isqrt(rows))).cast("int"))
    key = [*groups, "__b"]
    inside = Window.partitionBy(*key).orderBy(draw, *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = cut.groupBy(*key).agg(*[F.sum(c).alias(f"__s_{o}") for o, c in counts.items()])
    starts = sums.select(*key, *[zero(F.sum(f"__s_{o}").over(before)).alias(f"__o_{o}") for o in counts])
    each = cut.select("*", *[zero(F.sum(c).over(inside)).alias(f"__i_{o}") for o, c in counts.items()])
    return each.join(starts, key).select(*df.columns, *[(F.col(f"__o_{o}") + F.col(f"__i_{o}")).cast("long").alias(o) for o in counts])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges ``(u, v)`` of longs.

    Returns one row ``(node, root)`` per node that has an edge; nodes of one component
    share a root, itself a node of it. Contraction: in each round every node
    moves to the neighbour (or itself) of the lowest rank, edges between
    merged nodes go and the rest are rewritten. In every second round, the first among them, ranks are the nodes'
    numbers, which settles stars around their smallest node at once; in the others they are
    seeded hashes, so that the number of nodes falls by a constant
    factor in expectation whatever the shape, chains included. Every exchange
    carries partial minima, distinct pairs or a plain join that AQE may split, so a hub
    does not gather its neighbours in one task. Lineage is cut in every round.
    """
    e = edges.select("u", "v").where("u <> v")
    e = written(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = None
    for i in range(max_rounds):
        if e.isEmpty():
            break
        rank = lambda c, i=i: F.struct((F.xxhash64(F.lit(i), c) if i % 2 else F.col(c)).alias("h"), F.col(c).alias("n"))
        moved = e.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u")))["n"].alias("to"))
        moved = written(moved, "moves")
        a, b = moved.select(F.col("u"), F.col("to").alias("a")), moved.select(F.col("u").alias("v"), F.col("to").alias("b"))
        nxt = e.join(a, "u").select("a", "v").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        nxt = written(nxt.where("u <> v").distinct(), "edges")
        if roots is None:
            new = moved.select(F.col("u").alias("node"), F.col("to").alias("root"))
            roots = new
        else:
            r = moved.select(F.col("u").alias("root"), "to")
            new = written(roots.join(r, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            dropped(roots)
            roots = new
            dropped(moved)
        dropped(e)
        e = nxt
    else:
        raise RuntimeError(f"components are not closed after {max_rounds} rounds")
    if roots is None:
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).where("false")
    return roots
