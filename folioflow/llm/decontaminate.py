"""Benchmark decontamination by canonical templates.

Words become templates: numbers, capitalised words inside a sentence and units after a
number are replaced by typed placeholders, everything else is lower-cased and stripped
of punctuation. Windows of five template words of the benchmark, at most two of
them placeholders, are hash-joined with the windows of every document, and so are the same
windows without placeholders, which meet copies whose names have lost their capitals.
Matches of one item are put together along the text; what stood in the placeholders
of an item must map to one value of the document each, else the contradicting windows go;
two values of the item may become one.
An item is found where the consistent windows are at least 0.8 of its windows, or where
so many follow each other that 13 words agree. An item of fewer than five words is found
where all its words stand one after another as they are.

An item that needs m of its windows meets every document that holds it in one of its
others even if its m - 1 most frequent windows (in the benchmark) are left aside, so
candidates come from the rarer ones alone and what many items begin with joins nothing.

A benchmark of at most ``BLOCK_BYTES`` of text is indexed once and broadcast. A larger one stays
a table of windows: a bit filter of bounded size is broadcast instead, the windows of documents that pass
it are joined with the table, and the pairs found are judged with their texts side by side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import by_batch, portions, unused, written

WINDOW, SLOTS, COVERAGE, RUN, CACHE = 5, 2, 0.8, 13, 150_000
#: Benchmarks up to this size are broadcast; the bit filter of larger ones has 2 ** SIEVE_BITS bits at most.
BLOCK_BYTES, SIEVE_BITS = 16 << 20, 29
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl dl l s sec secs min mins h hr hrs ms hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal pa kpa bar "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre "
    "kilometres mile miles gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degrees".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|" + "|".join(sorted(_UNITS, key=len, reverse=True)) + r")?")
_NUM, _NAME, _UNIT = (np.uint64(xxh64_intdigest(x)) for x in (b"<number>", b"<name>", b"<unit>"))
_P = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WINDOW)]
LITERAL, NUMBER, NAME, UNIT = range(4)


class Canon:
    """Word -> number of an entry in arrays of its properties; one per worker, bounded."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.code = np.zeros(1 << 16, np.uint64)
        self.flags = np.zeros(1 << 16, np.uint8)  # 1 number, 2 name, 4 unit, 8 ends a sentence, 16 no word

    def learn(self, new: list[str]) -> None:
        if self.size + len(new) > len(self.code):
            more = max(len(self.code), len(new))
            self.code, self.flags = np.r_[self.code, np.zeros(more, np.uint64)], np.r_[self.flags, np.zeros(more, np.uint8)]
        for w in new:
            core = _EDGES.sub("", w)
            flag = 16 * (not core) + 8 * (w.rstrip("\"')]»”")[-1:] in tuple(".!?:;"))
            if core:
                if core[0].isdigit() and _NUMBER.fullmatch(core):
                    flag |= 1
                elif len(core) > 1 and core[0].isupper() and core[1:].islower():
                    flag |= 2
                low = core.lower()
                flag |= 4 * (low in _UNITS)
                self.code[self.size] = xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
            self.flags[self.size] = flag
            self.known[w] = self.size
            self.size += 1


_canon = Canon()


def _windows(code: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A hash of every ``size`` neighbouring codes."""
    n = max(len(code) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h += code[i : n + i] * _P[i]
    return h ^ (h >> np.uint64(31))


class Words:
    """The template words of a batch of texts."""

    def __init__(self, texts: pa.Array):
        if _canon.size >= CACHE:
            _canon.clear()
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        self.surface = coded.dictionary
        names = coded.dictionary.to_pylist()
        _canon.learn([w for w in names if w not in _canon.known])
        entry = np.fromiter(map(_canon.known.__getitem__, names), np.int64, len(names))
        word = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        flags = _canon.flags[entry][word]
        keep = np.flatnonzero((flags & 16) == 0)
        ends = (flags & 8) > 0
        starts = np.r_[True, ends[:-1] | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
        self.doc, self.word, flags, starts = doc[keep], word[keep], flags[keep], starts[keep]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        number = (flags & 1) > 0
        name = ((flags & 2) > 0) & ~starts
        after = np.r_[False, number[:-1] & (self.doc[1:] == self.doc[:-1])] if len(number) else number
        unit = ((flags & 4) > 0) & after
        self.kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], LITERAL).astype(np.int8)
        self.code = _canon.code[entry][self.word]
        self.hash = _windows(np.select([number, unit, name], [_NUM, _UNIT, _NAME], self.code).astype(np.uint64))
        self.plain = _windows(self.code)
        n = len(self.hash)
        slots = np.zeros(n, np.int64)
        for i in range(WINDOW):
            slots += self.kind[i : n + i] > 0
        self.whole = self.doc[:n] == self.doc[WINDOW - 1 :]
        self.valid = self.whole & (slots <= SLOTS)

    def windows(self, first: int, last: int, able: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows that begin in [first, last): as templates where
        they hold few placeholders, and as they are where that differs. ``able``: of documents; an item
        has the latter for windows of few placeholders only, unless it has no others.
        """
        s = slice(first, min(last, len(self.hash)))
        template = np.flatnonzero(self.valid[s])
        plain = np.flatnonzero((self.whole[s] if able else self.valid[s]) & ((self.hash[s] != self.plain[s]) | ~self.valid[s]))
        return first + np.concatenate([template, plain]), np.concatenate([self.hash[s][template], self.plain[s][plain]])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and hash of every ``size`` neighbouring words, as they are."""
        n = max(len(self.code) - size + 1, 0)
        own = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n else np.empty(0, np.int64)
        return self.doc[own], _windows(self.code, size)[own]

    def text(self, at: int) -> str:
        return _EDGES.sub("", self.surface[int(self.word[at])].as_py()).lower()


class Index:
    """The windows of a block of the benchmark, as templates and as they are.

    An item whose windows all hold too many placeholders is known by its plain windows alone.
    """

    def __init__(self, ids: list, texts: list[str | None]):
        w = Words(pa.array(texts, pa.string()))
        self.ids = ids
        n = np.diff(w.first)
        self.windows = np.zeros(len(ids), np.int64)
        self.own: list[tuple[np.ndarray, np.ndarray]] = []  # of each item: hashes in ascending order, and their places in it
        for i in range(len(ids)):
            at, codes = w.windows(w.first[i], w.first[i + 1], False)
            if n[i] >= WINDOW and not len(at):
                at, codes = w.windows(w.first[i], w.first[i + 1], True)
            order = np.argsort(codes, kind="stable")
            self.own.append((codes[order], at[order] - w.first[i]))
            self.windows[i] = len(np.unique(at))
        self.slots = {(int(w.doc[i]), int(i - w.first[w.doc[i]])): (int(w.kind[i]), w.text(i)) for i in np.flatnonzero(w.kind)}
        self.need = np.minimum(np.ceil(COVERAGE * self.windows), RUN - WINDOW + 1).astype(np.int64)
        self._rare()
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, WINDOW):
            if len(few := np.flatnonzero(n == size)):
                codes = np.concatenate([_windows(w.code[w.first[i] : w.first[i] + size], size) for i in few])
                order = np.argsort(codes, kind="stable")
                self.short[size] = codes[order], few[order]

    def _rare(self) -> None:
        """``hash, item``: of each item all windows but the need - 1 most frequent ones."""
        every = np.concatenate([h for h, _ in self.own]) if self.own else np.empty(0, np.uint64)
        known, count = np.unique(every, return_counts=True)
        hashes, items = [], []
        for i, (h, pos) in enumerate(self.own):
            if len(h):
                often = np.zeros(int(pos.max()) + 1, np.int64)
                np.maximum.at(often, pos, count[np.searchsorted(known, h)])
                out = np.argsort(-often, kind="stable")[: max(int(self.need[i]) - 1, 0)]
                keep = ~np.isin(pos, out)
                hashes.append(h[keep])
                items.append(np.full(int(keep.sum()), i))
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.item = np.concatenate(items) if items else np.empty(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item = self.hash[order], self.item[order]
        self.sieve = np.zeros(1 << max(20, (16 * len(self.hash)).bit_length()), bool)
        self.sieve[self._bit(self.hash)] = True

    def _bit(self, codes: np.ndarray) -> np.ndarray:
        return (codes & np.uint64(len(self.sieve) - 1)).astype(np.int64)

    def hits(self, w: Words) -> list[tuple[int, int, float, int]]:
        """(document, item, coverage, longest run of words) of every item found in the batch."""
        out = self._short_hits(w)
        if not len(self.hash):
            return out
        n = len(w.hash)
        template = np.flatnonzero(w.valid & self.sieve[self._bit(w.hash)])
        other = np.flatnonzero(w.whole & ((w.hash != w.plain) | ~w.valid))
        other = other[self.sieve[self._bit(w.plain[other])]]
        doc, codes = np.concatenate([w.doc[:n][template], w.doc[:n][other]]), np.concatenate([w.hash[template], w.plain[other]])
        pairs = np.unique(np.stack([doc, codes.view(np.int64)], axis=1), axis=0) if len(doc) else np.empty((0, 2), np.int64)
        codes = pairs[:, 1].copy().view(np.uint64)
        low, high = np.searchsorted(self.hash, codes, "left"), np.searchsorted(self.hash, codes, "right")
        count = high - low
        if not count.sum():
            return out
        entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        key = np.unique(np.repeat(pairs[:, 0], count) * len(self.ids) + self.item[entry])
        last, at, own = -1, None, None
        for d, i in zip((key // len(self.ids)).tolist(), (key % len(self.ids)).tolist()):
            if d != last:
                at, own = w.windows(w.first[d], min(w.first[d + 1], n), True)
                last = d
            h, pos = self.own[i]
            a, b = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            m = b - a
            if int(m.sum()) >= self.need[i]:
                entry = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                coverage, run = self._judge(w, i, np.repeat(at, m), pos[entry])
                if coverage >= COVERAGE or run >= RUN:
                    out.append((d, i, coverage, run))
        return out

    def _short_hits(self, w: Words) -> list[tuple[int, int, float, int]]:
        out = set()
        for size, (known, items) in self.short.items():
            doc, codes = w.runs(size)
            low, high = np.searchsorted(known, codes, "left"), np.searchsorted(known, codes, "right")
            for k in np.flatnonzero(high > low):
                out.update((int(doc[k]), int(i), 1.0, size) for i in items[low[k] : high[k]])
        return sorted(out)

    def _judge(self, w: Words, item: int, at: np.ndarray, pos: np.ndarray) -> tuple[float, int]:
        """The best stretch of the text: matches whose offsets between text and item differ little."""
        shift = at - pos
        order = np.argsort(shift, kind="stable")
        slack = max(2, int(0.2 * self.windows[item]))
        best = (0.0, 0)
        for part in np.split(order, np.flatnonzero(np.diff(shift[order]) > slack) + 1):
            if len(part) < self.need[item]:
                continue
            pairs = {}
            for k in part:
                for j in range(WINDOW):
                    if (slot := self.slots.get((item, int(pos[k]) + j))) is not None:
                        pairs.setdefault(int(k), []).append((slot, w.text(int(at[k]) + j)))
            votes = Counter(x for each in pairs.values() for x in each)
            there = {}
            for (a, b), _ in votes.most_common():
                there.setdefault(a, b)
            kept = [k for k in part if all(there.get(a) == b for a, b in pairs.get(int(k), ()))]
            seen = np.unique(pos[kept])
            if not len(seen):
                continue
            runs = np.split(seen, np.flatnonzero(np.diff(seen) > 1) + 1)
            best = max(best, (len(seen) / int(self.windows[item]), max(map(len, runs)) + WINDOW - 1))
        return best


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _index(items: DataFrame, block_bytes: int) -> Index | None:
    """The index over the whole benchmark, or None if its texts take more than ``block_bytes``."""
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > block_bytes:
        return None
    rows = items.orderBy("item_id", "text").collect()
    return Index([r[0] for r in rows], [r[1] for r in rows])


FOUND = "doc_id long, item_id long, coverage double, run_words int"


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, coverage, run_words`` for every document and item found in it.

    Null and empty texts match nothing; a null doc_id or item_id is carried; repeated rows and
    items give rows each, and so do different items of one text. Without any benchmark there are no rows.
    Very long texts are taken one by one; columns other than doc_id, item_id and text are not read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    if (index := _index(items, block_bytes)) is None:
        found = _judged(d.select("text"), items.select("text"))
        found = found.join(d.select(F.md5("text").alias("row"), "doc_id"), "row").join(items.select(F.md5("text").alias("k"), "item_id"), "k")
        return found.select("doc_id", "item_id", "coverage", "run_words")
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not (found := held.value.hits(Words(batch.column(1)))):
            return None
        d, i, coverage, words = zip(*found)
        ids = pa.array([held.value.ids[x] for x in i], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), ids, pa.array(coverage, pa.float64()), pa.array(words, pa.int32())], ["doc_id", "item_id", "coverage", "run_words"])

    return by_batch(d, ["doc_id", "text"], run, FOUND)


def cleaned(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns as they are, without the documents that hold a benchmark item.

    Null and empty texts stay; repeated rows are decided alike; columns may have any names; an
    empty table or benchmark changes nothing.
    """
    items = _items(benchmark)
    if (index := _index(items, block_bytes)) is None:
        found = written(_judged(docs.select(F.col("text").cast("string").alias("text")), items.select("text")).select("row").distinct(), "found")
        row = unused(docs.columns, "row")
        kept = docs.withColumn(row, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        return kept.join(found.withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)
    held, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in held.value.hits(Words(batch.column(at).cast(pa.string())))]] = False
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _judged(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``row, k, coverage, run_words``: texts and items, both by the MD5 of their text, found in each other; any size of both."""
    spark = texts.sparkSession
    items = written(items.select(F.md5("text").alias("k"), "text").groupBy("k").agg(F.first("text").alias("text")), "items")

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ks, out = batch.column(0).to_pylist(), []
        index = Index(ks, batch.column(1).to_pylist())
        for i, (h, pos) in enumerate(index.own):
            out += [(ks[i], c, p, int(index.need[i])) for c, p in zip(h.view(np.int64).tolist(), pos.tolist())]
        for codes, few in index.short.values():
            out += [(ks[i], c, 0, 1) for c, i in zip(codes.view(np.int64).tolist(), few.tolist())]
        if not out:
            return None
        k, c, p, need = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(need, pa.int32())], ["k", "code", "pos", "need"])

    windows = written(by_batch(items, ["k", "text"], listed, "k string, code long, pos int, need int"), "windows")
    often = windows.join(windows.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code").groupBy("k", "pos").agg(F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "pos"))
    rare = windows.join(often.withColumn("rank", rank).drop("n"), ["k", "pos"]).where(F.col("rank") >= F.col("need")).select("code", "k").distinct()
    rare = written(rare, "rare")
    bits = min(SIEVE_BITS, max(20, (16 * rare.count()).bit_length()))
    words = rare.selectExpr(f"shiftright(code & {(1 << bits) - 1}L, 6) as at", "shiftleft(1L, cast(code & 63 as int)) as word")
    words = words.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    sieve = np.zeros(1 << (bits - 6), np.uint64)
    sieve[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(sieve)
    short = [r["n"] for r in windows.where("need = 1").select(F.lit(1).alias("n")).limit(1).collect()]  # items of one window, or too short for any

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, sieve = Words(batch.column(1)), held.value
        n = len(w.hash)
        other = np.flatnonzero(w.whole & ((w.hash != w.plain) | ~w.valid))
        doc, code = [w.doc[:n][w.valid], w.doc[:n][other]], [w.hash[w.valid], w.plain[other]]
        for size in range(1, WINDOW) if short else ():
            d, c = w.runs(size)
            doc.append(d)
            code.append(c)
        doc, code = np.concatenate(doc), np.concatenate(code)
        x = code & np.uint64((1 << bits) - 1)
        hit = (sieve[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) > 0
        pairs = np.unique(np.stack([doc[hit], code[hit].view(np.int64)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], ["row", "code"])

    rows = texts.where("text is not null").select(F.md5("text").alias("row"), "text")
    met = written(by_batch(rows, ["row", "text"], passed, "row string, code long").join(rare, "code").select("row", "k").distinct(), "pairs")
    own = rows.join(met.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    sides = met.join(own, "row").join(items.withColumnRenamed("text", "item"), "k").select("row", "k", "text", "item")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for row, k, text, item in zip(*(c.to_pylist() for c in batch.columns)):
            out += [(row, k, c, r) for _, _, c, r in Index([k], [item]).hits(Words(pa.array([text], pa.string())))]
        if not out:
            return None
        row, k, coverage, words = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(k), pa.array(coverage, pa.float64()), pa.array(words, pa.int32())], ["row", "k", "coverage", "run_words"])

    return written(by_batch(sides, ["row", "k", "text", "item"], judge, "row string, k string, coverage double, run_words int"), "judged")
