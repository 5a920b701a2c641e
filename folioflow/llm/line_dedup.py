"""Reversible line-level deduplication.

Lines are known by a 128-bit digest of their key (stripped, A-Z lower-cased). The exact
state is a reference-count table ``(a, b, docs)``: in how many documents the key with the
digest's halves a and b stands. Keys found in at least ``min_docs`` documents also stand in
cuckoo filters, one for each shard of the digest space. Inserting documents adds to the
counts and deleting takes away again; the keys that thereby become frequent, or are so no
longer, go into and out of the stored filters one by one. The state after any sequence of both is
that of the documents present.

A filter answers "surely not frequent" for almost every line; what it lets through is held
against the exact table, so a false positive never drops a line. Filters and exact digests
are broadcast where they, counted first, take at most ``FILTER_BYTES`` and ``EXACT_BYTES``. Beyond
that the lines travel to the filter of their shard (each document portion sends a key
once, and a shard's lines are dealt over ``SALTS`` tasks with a copy of the filter each,
so a key that is everywhere is no task's load), and suspects meet the exact table in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import LOWER, by_batch, dropped, portions, written

#: Shards hold about ``PER_SHARD`` keys at most, so a filter stays near a megabyte whatever their number.
MIN_DOCS, MIN_CHARS, SHARDS, PER_SHARD, SALTS = 10, 1, 16, 1 << 18, 8
FILTER_BYTES, EXACT_BYTES = 64 << 20, 16 << 20
SPACES = b" \t\n\x0b\x0c\r"
COUNTS, FILTERS = "a long, b long, docs long", "shard int, slots binary"


class CuckooFilter:
    """Cuckoo filter of 16-bit tags in buckets of four; insert, lookup and delete.

    Digests are rows ``(a, b)`` of unsigned 64-bit halves.
    """

    def __init__(self, entries: int, slots: bytes | None = None):
        n = 1
        while n * 4 * 0.85 < max(entries, 1):
            n *= 2
        self.slots = np.zeros((n, 4), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, 4).copy()

    def _places(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tag = np.maximum(d[:, 1] & np.uint64(0xFFFF), np.uint64(1)).astype(np.int64)
        first = (d[:, 0] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return tag, first, self._other(first, tag)

    def _other(self, at, tag):
        return (at ^ (tag * 0x5BD1E995)) & (len(self.slots) - 1)

    def insert(self, d: np.ndarray) -> None:
        """All rows of ``d``: free slots are filled at once, what finds none pushes others on."""
        tag, first, second = self._places(d)
        left = np.arange(len(d))
        for places in (first, second):
            left = left[np.argsort(places[left], kind="stable")]
            at = places[left]
            rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
            lanes = np.argsort(self.slots[at] != 0, axis=1, kind="stable")  # free ones first
            fits = rank < (self.slots[at] == 0).sum(axis=1)
            self.slots[at[fits], lanes[fits, rank[fits]]] = tag[left[fits]]
            left = left[~fits]
        for k in left:
            self._push(int(tag[k]), int(second[k]))

    def _push(self, tag: int, at: int) -> None:
        for kick in range(500):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = tag
                return
            tag, self.slots[at, kick % 4] = int(self.slots[at, kick % 4]), tag
            at = self._other(at, tag)
        raise OverflowError("the filter is full; build it anew for more entries")

    def delete(self, d: np.ndarray) -> int:
        """Take out rows that were inserted before; the number of those found."""
        found = 0
        for tag, *places in zip(*self._places(d)):
            for at in places:
                held = np.flatnonzero(self.slots[at] == tag)
                if len(held):
                    self.slots[at, held[0]] = 0
                    found += 1
                    break
        return found

    def maybe(self, d: np.ndarray) -> np.ndarray:
        """For each row whether it may be in the filter."""
        tag, first, second = self._places(d)
        return ((self.slots[first] == tag[:, None]) | (self.slots[second] == tag[:, None])).any(axis=1)


def build_filter(d: np.ndarray) -> CuckooFilter:
    """A filter that holds all rows, made larger until they fit."""
    room = len(d)
    while True:
        made = CuckooFilter(room)
        try:
            made.insert(d)
            return made
        except OverflowError:
            room = 2 * max(room, 1)


def _shard(b: np.ndarray, shards: int) -> np.ndarray:
    return ((b >> np.uint64(48)) % np.uint64(shards)).astype(np.int32)


def keys(text: str | None) -> list[bytes]:
    return [x.strip(SPACES) for x in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")]


def digest(key: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """None for keys that are too short to be dropped."""
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return xxh3_128_digest(key)


def _halves(digests: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def reference_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(a, b, docs)`` over the rows of ``docs``; each row is a document."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            seen.update({d for x in set(keys(text)) if (d := digest(x, min_chars))})
        d = _halves(seen).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(list(seen.values()), pa.int64())], ["a", "b", "docs"])

    one = by_batch(docs.select(F.col("text").cast("string").alias("text")), ["text"], count, COUNTS)
    return one.groupBy("a", "b").agg(F.sum("docs").alias("docs"))


@dataclass
class LineState:
    """Reference counts of the documents present and the filters over their frequent keys, both as written tables."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @property
    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("docs") >= self.min_docs).select("a", "b")


def started(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int = SHARDS, per_shard: int = PER_SHARD) -> LineState:
    """The state of these documents alone."""
    counts = written(reference_counts(docs, min_chars), "counts")
    n = counts.where(F.col("docs") >= min_docs).count()
    state = LineState(counts, counts, max(shards, -(-n // per_shard)), min_docs, min_chars)
    state.filters = written(_filtered(state, None, state.frequent.withColumn("kind", F.lit(INSERTED))), "filters")
    return state


def insert(state: LineState, docs: DataFrame) -> LineState:
    """The state after these documents came in."""
    return _changed(state, reference_counts(docs, state.min_chars))


def delete(state: LineState, docs: DataFrame) -> LineState:
    """The state after these documents (inserted before) went out."""
    return _changed(state, reference_counts(docs, state.min_chars).withColumn("docs", -F.col("docs")))


FILTER, DELETED, INSERTED = 0, 1, 2


def _changed(state: LineState, change: DataFrame) -> LineState:
    both = state.counts.select("a", "b", F.col("docs").alias("old"), F.lit(0).cast("long").alias("new")).unionByName(change.select("a", "b", F.lit(0).cast("long").alias("old"), F.col("docs").alias("new")))
    moved = written(both.groupBy("a", "b").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("new")).alias("docs")), "moved")
    was, now = F.col("old") >= state.min_docs, F.col("docs") >= state.min_docs
    crossed = moved.where(was != now).select("a", "b", F.when(now, INSERTED).otherwise(DELETED).alias("kind"))
    after = LineState(written(moved.where("docs > 0").select("a", "b", "docs"), "counts"), state.filters, state.shards, state.min_docs, state.min_chars)
    filters = written(_filtered(after, state.filters, crossed), "filters")
    full = filters.where("slots is null").select("shard")
    if not full.isEmpty():  # these are built anew from the exact table
        shard = F.pmod(F.shiftrightunsigned("b", 48), F.lit(state.shards)).cast("int")
        again = after.frequent.join(F.broadcast(full), shard == F.col("shard"), "left_semi").withColumn("kind", F.lit(INSERTED))
        filters = written(filters.where("slots is not null").unionByName(_filtered(after, None, again)), "filters")
    dropped(moved)
    after.filters = filters
    return after


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches that are sorted by their column ``shard``, which holds one value in each."""
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield int(shard[i]), batch.slice(i, j - i)


def _filtered(state: LineState, filters: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The filters after ``changes (a, b, kind)``; one that overflows has null slots."""
    shard = F.pmod(F.shiftrightunsigned("b", 48), F.lit(state.shards)).cast("int").alias("shard")
    rows = changes.select(shard, "kind", "a", "b", F.lit(None).cast("binary").alias("slots"))
    if filters is not None:
        rows = rows.unionByName(filters.select("shard", F.lit(FILTER).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "slots"))

    def made(shard: int, slots: bytes | None, gone: list[np.ndarray], come: list[np.ndarray]) -> pa.RecordBatch:
        d = np.concatenate(come) if come else np.empty((0, 2), np.uint64)
        if slots is None:
            slots = build_filter(d).slots.tobytes()
        else:
            f = CuckooFilter(0, slots)
            for x in gone:
                f.delete(x)
            try:
                f.insert(d)
                slots = f.slots.tobytes()
            except OverflowError:
                slots = None
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([slots], pa.binary())], ["shard", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, slots, gone, come = None, None, [], []
        for shard, part in _by_shard(batches):
            if shard != at:
                if at is not None:
                    yield made(at, slots, gone, come)
                at, slots, gone, come = shard, None, [], []
            kind = part.column(1).to_numpy()
            d = np.stack([part.column(2).to_numpy(), part.column(3).to_numpy()], axis=1).view(np.uint64)
            if (kind == FILTER).any():
                slots = part.column(4)[int(np.flatnonzero(kind == FILTER)[0])].as_py()
            gone.append(d[kind == DELETED])
            come.append(d[kind == INSERTED])
        if at is not None:
            yield made(at, slots, gone, come)

    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FILTERS)


def _listed(texts: list[str | None], min_chars: int) -> tuple[list[int], list[int], list[bytes]]:
    """Document, line and digest of every line that may be dropped."""
    found = [(k, i, d) for k, t in enumerate(texts) for i, x in enumerate(keys(t)) if (d := digest(x, min_chars))]
    return tuple(zip(*found)) if found else ((), (), ())


class Sharded:
    """The broadcast filters of all shards."""

    def __init__(self, slots: dict[int, bytes], shards: int):
        self.filters, self.shards = {k: CuckooFilter(0, v) for k, v in slots.items()}, shards

    def maybe(self, d: np.ndarray) -> np.ndarray:
        shard, out = _shard(d[:, 1], self.shards), np.zeros(len(d), bool)
        for k in np.unique(shard):
            if (f := self.filters.get(int(k))) is not None:
                at = np.flatnonzero(shard == k)
                out[at] = f.maybe(d[at])
        return out


def _kept(text: str | None, gone: frozenset | set) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if not gone:
        return len(lines), 0, text or ""
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _cleaned(ids: pa.Array, each: list[tuple[int, int, str]]) -> pa.RecordBatch:
    n, dropped_, text = zip(*each)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped_, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


SCHEMA = "doc_id long, n_lines long, n_dropped long, text string"


def clean(docs: DataFrame, state: LineState, filter_bytes: int = FILTER_BYTES, exact_bytes: int = EXACT_BYTES, salts: int = SALTS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` without the lines whose key is frequent in ``state``.

    All lines pass the filters first, whatever the size of the state.
    """
    d, sc = _plain(docs), docs.sparkSession.sparkContext
    n, held = state.frequent.count(), state.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
    sieve = sc.broadcast({r.shard: bytes(r.slots) for r in state.filters.collect()}) if held <= filter_bytes else None
    shards, min_chars = state.shards, state.min_chars

    def suspects(batch: pa.RecordBatch, front: Sharded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, line and digest of the lines that the filters let through."""
        k, i, x = _listed(batch.column(1).to_pylist(), min_chars)
        h = _halves(x)
        at = np.flatnonzero(front.maybe(h)) if len(h) else np.empty(0, np.int64)
        return np.array(k, np.int64)[at], np.array(i, np.int32)[at], h[at]

    if sieve is not None and n * 16 <= exact_bytes:
        exact = state.frequent.toArrow()
        exact = sc.broadcast(np.sort(np.stack([exact["a"].to_numpy(), exact["b"].to_numpy()], axis=1).reshape(-1, 2).view("S16").ravel()))

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            front, known = Sharded(sieve.value, shards), exact.value
            for whole in batches:
                for batch in portions(whole):
                    k, i, h = suspects(batch, front)
                    gone: dict[int, set[int]] = {}
                    if len(k):
                        x = np.ascontiguousarray(h).view("S16").ravel()
                        hit = known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)
                        for a, b in zip(k[hit].tolist(), i[hit].tolist()):
                            gone.setdefault(a, set()).add(b)
                    yield _cleaned(batch.column(0), [_kept(t, gone.get(a, ())) for a, t in enumerate(batch.column(1).to_pylist())])

        return d.mapInArrow(direct, SCHEMA)

    tagged = d.select(F.md5(F.to_json(F.struct("doc_id", "text"))).alias("row"), "text", "doc_id")
    lines = "row string, line int, a long, b long"

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = Sharded(sieve.value, shards)
        for whole in batches:
            for batch in portions(whole):
                k, i, h = suspects(batch, front)
                if len(k):
                    h = h.view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(i), pa.array(h[:, 0]), pa.array(h[:, 1])], ["row", "line", "a", "b"])

    found = tagged.select("row", "text")
    found = found.mapInArrow(passed, lines) if sieve is not None else _sifted(found, state, salts)
    verdicts = found.join(state.frequent, ["a", "b"], "left_semi").groupBy("row").agg(F.collect_set("line").alias("gone"))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _cleaned(batch.column(0), [_kept(t, frozenset(g or ())) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])

    return by_batch(tagged.join(verdicts, "row", "left"), ["doc_id", "text", "gone"], apply, SCHEMA)


def _sifted(texts: DataFrame, state: LineState, salts: int) -> DataFrame:
    """``row, line, a, b`` of the lines of ``texts (row, text)`` that the filter of their shard lets through."""
    shards, min_chars = state.shards, state.min_chars

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = batch.column(0).to_pylist()
        where: dict[bytes, list[tuple[str, int]]] = {}
        for k, i, x in zip(*_listed(batch.column(1).to_pylist(), min_chars)):
            where.setdefault(x, []).append((rows[k], i))
        if not where:
            return None
        d = _halves(where)
        salt = np.arange(len(d)) + int(rows[0][:8], 16)  # another one for the same key in another portion
        at = [[{"row": r, "line": i} for r, i in x] for x in where.values()]
        kind = pa.list_(pa.struct([("row", pa.string()), ("line", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(_shard(d[:, 1], shards)), pa.array((salt % salts).astype(np.int32)), pa.array(d[:, 0].view(np.int64)), pa.array(d[:, 1].view(np.int64)), pa.array(at, kind)], ["shard", "salt", "a", "b", "at"]
        )

    sent = by_batch(texts, ["row", "text"], listed, "shard int, salt int, a long, b long, at array<struct<row:string,line:int>>").withColumn("slots", F.lit(None).cast("binary"))
    copies = state.filters.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    copies = copies.select("shard", "salt", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("array<struct<row:string,line:int>>").alias("at"), "slots")
    both = sent.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("slots").isNull())

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, front = None, None
        for shard, part in _by_shard(batches):
            if shard != at:
                at, front = shard, None
            slots = part.column(5)
            if part.num_rows > slots.null_count:  # the filter comes before its lines
                front = CuckooFilter(0, slots.drop_null()[0].as_py())
                part = part.filter(slots.is_null())
            if front is not None and part.num_rows:
                d = np.stack([part.column(2).to_numpy(), part.column(3).to_numpy()], axis=1).view(np.uint64)
                if (hit := front.maybe(d)).any():
                    part = part.filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4)], ["a", "b", "at"])

    found = both.mapInArrow(sift, "a long, b long, at array<struct<row:string,line:int>>")
    return found.select("a", "b", F.explode("at").alias("at")).select("at.row", "at.line", "a", "b")


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256``.

    A null or empty text is one empty line, whose key is too short to drop. A document
    whose lines all go keeps the empty text. Repeated rows are documents of their own, a
    null doc_id is carried, and other columns are not read. Very long texts are taken one by one;
    ties cannot occur. An empty table gives no rows.
    """
    out = clean(docs, started(docs, min_docs, min_chars), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
