"""Sharding by a k-d tree over text metadata, with DataFrame operations only.

A node is split along its widest dimension (range over the corpus-wide range) at the
weighted median, found by distributed histograms that are refined around the cut; a split
into uneven leaf counts cuts at the corresponding share. All dimensions are properties of
the text and ties are broken by the text's hash, so equal texts fall into one shard.

A group of equal texts heavier than 1/200 of a shard's target is placed before the
splits, heaviest first into the lightest shard, and the splits give the rest of each shard's
target; there are at most 200 such groups per shard. Only a group that
outweighs a whole shard is divided (by document), as no shard could hold it.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction, ranked, written

SHARDS, BINS, HEAVY, TOLERANCE = 8, 2048, 200, 2e-4


@dataclass
class Node:
    leaves: list[int]
    test: list = field(default_factory=list)  # (dim, cut, goes left) from the root down
    dim: str = ""
    low: float = 0.0
    high: float = 0.0
    base: float = 0.0
    goal: float = 0.0
    weight: float = 0.0
    cut: float | None = None

    def at(self, number: int) -> tuple[list, int]:
        return self.test, number


def _key(dim: str) -> F.Column:
    """A dimension's value made continuous by the tie-breaking fraction."""
    return F.col(dim).cast("double") + F.col("tie")


def _assign(paths: list[tuple[list, int]]) -> F.Column:
    """The number of the path whose tests a row meets."""
    out = F.lit(None).cast("int")
    for test, number in paths:
        met = F.lit(True)
        for dim, cut, left in test:
            met = met & ((_key(dim) < cut) if left else (_key(dim) >= cut))
        out = F.when(met, F.lit(number)).otherwise(out)
    return out


def tree(light: DataFrame, dims: list[str], room: dict[int, float]) -> list[tuple[list, int]]:
    """Paths from the root to each shard. ``room``: bytes that each shard has left."""
    whole = light.agg(*[F.min(_key(d)).alias(f"l_{d}") for d in dims], *[F.max(_key(d)).alias(f"h_{d}") for d in dims]).first()
    done, nodes = [], [Node(sorted(room))]
    while nodes:
        done += [n.at(n.leaves[0]) for n in nodes if len(n.leaves) == 1]
        nodes = [n for n in nodes if len(n.leaves) > 1]
        if not nodes:
            break
        here = light.withColumn("__node", _assign([n.at(i) for i, n in enumerate(nodes)])).where("__node is not null")
        stats = here.groupBy("__node").agg(F.sum("size").alias("w"), *[F.min(_key(d)).alias(f"l_{d}") for d in dims], *[F.max(_key(d)).alias(f"h_{d}") for d in dims])
        seen = {r["__node"]: r for r in stats.collect()}
        for i, n in enumerate(nodes):
            n.dim, n.cut = dims[0], 0.0
            if (r := seen.get(i)) is not None:
                wide = lambda d, r=r: (r[f"h_{d}"] - r[f"l_{d}"]) / ((whole[f"h_{d}"] - whole[f"l_{d}"]) or 1.0)
                n.dim, n.cut = max(dims, key=wide), None
                n.low, n.high, n.base, n.weight = r[f"l_{n.dim}"], math.nextafter(r[f"h_{n.dim}"], math.inf), 0.0, float(r["w"])
                half = n.leaves[: len(n.leaves) // 2]
                n.goal = n.weight * sum(room[k] for k in half) / (sum(room[k] for k in n.leaves) or 1.0)
        for _ in range(12):
            todo = [(i, n) for i, n in enumerate(nodes) if n.cut is None]
            if not todo:
                break
            which = F.lit(None).cast("int")
            for i, n in todo:
                inside = (F.col("__node") == i) & (_key(n.dim) >= n.low) & (_key(n.dim) < n.high)
                bin_ = F.least(F.lit(BINS - 1), F.floor((_key(n.dim) - n.low) / ((n.high - n.low) / BINS)).cast("int"))
                which = F.when(inside, F.lit(i * BINS) + bin_).otherwise(which)
            sums = {r["b"]: r["w"] for r in here.select(which.alias("b"), "size").where("b is not null").groupBy("b").agg(F.sum("size").alias("w")).collect()}
            for i, n in todo:
                step, at, b = (n.high - n.low) / BINS, n.base, 0
                while b < BINS - 1 and at + sums.get(i * BINS + b, 0) <= n.goal:
                    at, b = at + sums.get(i * BINS + b, 0), b + 1
                heavy = sums.get(i * BINS + b, 0)
                if heavy <= TOLERANCE * n.weight or step < 1e-9 * max(1.0, abs(n.low)):
                    n.cut = n.low + step * (b if n.goal - at <= at + heavy - n.goal else b + 1)
                else:
                    n.low, n.high, n.base = n.low + step * b, n.low + step * (b + 1), at
        for n in nodes:
            n.cut = n.low if n.cut is None else n.cut
        nodes = [
            Node(part, [*n.test, (n.dim, n.cut, left)])
            for n in nodes
            for part, left in ((n.leaves[: len(n.leaves) // 2], True), (n.leaves[len(n.leaves) // 2 :], False))
        ]
    return done


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: the shards' sizes (UTF-8 bytes plus one a document) are near equal.
    ``slot`` counts from 0 without gaps inside each shard, in a random order that depends
    on doc_id and text. A null text counts as an empty one (size 1); a null doc_id is
    carried; repeated rows get slots of their own. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_bytes = F.octet_length(text)
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (n_bytes + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        (n_bytes - F.length(text)).alias("wide"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"),
    )
    d = written(d, "sizes")
    rows, total = d.agg(F.count(F.lit(1)), F.sum("size")).first()
    goal = (total or 0) / shards
    groups = d.groupBy("group").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).where((F.col("w") > goal / HEAVY) & (F.col("n") > 1)).orderBy(F.desc("w"), "group").collect()
    load = [(0, k) for k in range(shards)]
    placed, parted = [], []
    for g in groups:  # at most HEAVY * shards
        if g["w"] > goal:
            parted.append(g["group"])
        else:
            w, k = heapq.heappop(load)
            placed.append((g["group"], k))
            heapq.heappush(load, (w + g["w"], k))
    values = ", ".join(f"({g}L, {k})" for g, k in [*placed, *((g, -1) for g in parted)]) or "(0L, -2)"
    known = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(group, place)")
    d = d.join(F.broadcast(known), "group", "left").withColumn("tie", F.when(F.col("place") == -1, fraction("doc_id", "group")).otherwise(fraction("group")))
    light = d.where("place is null or place < 0")
    paths = tree(light, ["size", "wide", "lines"], {k: max(goal - w, 0.0) for w, k in load}) if rows else [([], 0)]
    out = d.withColumn("shard", F.when(F.col("place") >= 0, F.col("place")).otherwise(_assign(paths)).cast("int"))
    out = out.withColumn("__draw", fraction("doc_id", "group", F.lit("slot"))).withColumn("__one", F.lit(1))
    out = ranked(out, ["shard"], "__draw", ["doc_id", "group"], {"slot": "__one"}, rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
