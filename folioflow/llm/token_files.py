"""Token-id files: Parquet list columns laid out for selective reads.

Layout of a file: ``shard int, doc_id long, at long, n_tokens int, ids array<int>``, in ascending
order of doc_id inside a file and from file to file. ``ids`` is dictionary encoded
(a corpus uses few of the vocabulary's ids, so an id takes 13 bits or so before
compression); the ascending metadata columns are delta encoded. Row groups and pages are
kept small and pages are indexed, so a range of doc_ids or the metadata alone can be
read without the tokens of the rest.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_batch, fresh_path, portions

TOKENIZER, END, CACHE, POOL = "word_bpe_49k.json", 2, 250_000, 4_000_000
SCHEMA = "shard int, doc_id long, at long, n_tokens int, ids array<int>"
#: Row groups of about 16 MB, pages of at most 64 KB or 2,000 rows.
LAYOUT = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": 16 << 20, "parquet.page.size": 64 << 10,
    "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": 1 << 20,
}
#: Latin-1 letters (and the lower-case ones among them), and what may follow them: ASCII marks, which are one unit to the tokenizer.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
LOWER_LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
#: Words in one string for the tokenizer; it takes longer over longer strings.
TOGETHER = 100
MARKS = r"[!-/:-@\[-`{-~]*$"


class WordEncoder:
    """Batches of texts to their ids; texts are words apart from white space.

    The tokenizer drops white space and never joins across it, so a text's ids are those
    of its words in turn, and the library need not see a word twice. A batch is split and its
    distinct words are found by Arrow. Words of Latin-1 letters that differ only in case or in the
    marks after them share a core, which is one unit to the tokenizer: new cores
    are encoded together and told apart by the ids that end a unit. The known cores' ids lie
    in one array, emptied when it holds ``CACHE`` cores or ``POOL`` ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks: dict[str, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.pool = np.empty(1 << 20, np.int32)
        self.lies = np.zeros(CACHE + (1 << 18), np.int64)  # where the n-th core's ids begin; it ends where the next begins
        self.used = 0

    def library(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _add(self, names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        n, at = len(self.known), self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(ids)), np.int32)])
        if n + len(names) + 1 > len(self.lies):
            self.lies = np.concatenate([self.lies, np.zeros(len(names) + len(self.lies), np.int64)])
        self.pool[at : at + len(ids)] = ids
        self.used = at + len(ids)
        self.lies[n + 1 : n + 1 + len(names)] = at + ends
        self.known = pa.concat_arrays([self.known, names])

    def _mark(self, text: str) -> np.ndarray:
        if len(text) > 8:
            return self.library(text)
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = self.library(text)
        return self.marks[text]

    def learn(self, new: pa.Array) -> None:
        """Add cores that are not known yet, those of letters a batch of words at a time."""
        letters = pc.match_substring_regex(new, LOWER_LETTERS)
        simple, other = new.filter(letters), new.filter(pc.invert(letters))
        if len(simple):
            words = simple.to_pylist()
            each = self.tokenizer.encode_batch_fast([" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)], add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, np.int32) for e in each])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(words):
                raise ValueError("the tokenizer does not keep words of letters apart")
            self._add(simple, ids, ends)
        if len(other):
            each = [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(other.to_pylist(), add_special_tokens=False)]
            self._add(other, np.concatenate(each), np.cumsum([len(x) for x in each]))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with ``end`` appended, and the number of each text's."""
        if len(self.known) >= CACHE or self.used >= POOL:
            self.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        plain = pc.match_substring_regex(words, LETTERS + MARKS)
        mark = pc.if_else(plain, pc.replace_substring_regex(words, LETTERS, ""), "").dictionary_encode()
        ids_of = [self._mark(x) for x in mark.dictionary.to_pylist()]
        core_of = pc.replace_substring_regex(words, MARKS, "")
        keys = pc.if_else(plain, pc.utf8_lower(core_of), words).dictionary_encode()
        names = keys.dictionary
        at = pc.index_in(names, self.known)
        if at.null_count:
            self.learn(names.filter(at.is_null()))
            at = pc.index_in(names, self.known)
        core = at.to_numpy().astype(np.int64)[keys.indices.to_numpy()]
        # each different word: its core's ids, then its mark's ("" occurs at the ends of a text); then the end id alone
        begin, size = self.lies[core], self.lies[core + 1] - self.lies[core]
        marks = mark.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(size + np.array([len(x) for x in ids_of], np.int64)[marks])])
        out = np.empty(int(total[-1]) + 1, np.int32)
        out[-1] = end
        first, own = total[:-1], np.cumsum(size)
        step = np.arange(int(own[-1]) if len(own) else 0)
        out[np.repeat(first - (own - size), size) + step] = self.pool[np.repeat(begin - (own - size), size) + step]
        marked = np.flatnonzero(first + size < total[1:])
        order = marked[np.argsort(marks[marked], kind="stable")]
        for where in np.split(order, np.flatnonzero(np.diff(marks[order])) + 1):
            if len(where):
                at = first[where] + size[where]
                for j, x in enumerate(ids_of[marks[where[0]]]):
                    out[at + j] = x
        different = pa.ListArray.from_arrays(pa.array(np.append(total, len(out)).astype(np.int32)), pa.array(out))
        taken = different.take(pa.array(np.insert(index, bounds[1:], len(words))))
        ends = taken.offsets.to_numpy()[bounds[1:] + np.arange(1, len(texts) + 1)]
        return taken.values.to_numpy(), np.diff(ends, prepend=0).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    if name not in _encoders:
        _encoders[name] = WordEncoder(name if "/" in name else public_tokenizers.path(name))
    return _encoders[name]


def write_tokens(docs: DataFrame, out: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Encode every whole text (null: empty), append ``end`` and write files under ``out``.

    Rows go to files by ranges of doc_id (nulls first); equal ids lie by the text's hash,
    so one repeated id does not have to fit one file.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = 0, encoder(tokenizer)
        for whole in batches:
            for batch in portions(whole, rows=1 << 20):
                flat, n = words.encode(batch.column(1), end)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2), batch.column(0), pa.array(at + ends - n), pa.array(n.astype(np.int32)), ids],
                    ["shard", "doc_id", "at", "n_tokens", "ids"],
                )
                at += int(ends[-1])
        pa.default_memory_pool().release_unused()  # the worker process lives on

    d.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each one.

    One sum per file is broadcast to the rows: as many rows as there are files, which the
    session's number of shuffle partitions bounds.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("first") + F.col("at")).drop("first")


def _crc(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column(3)
    offsets = ids.offsets.to_numpy()
    data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(crc, pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"],
    )


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows from :func:`read_tokens`."""
    return by_batch(tokens, ["doc_id", "start", "n_tokens", "ids"], _crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Write the token files into the shared folder and return what they hold per document.

    A null or empty text is the end id alone; a null doc_id comes first; equal ids lie by their
    text's hash; repeated rows are documents of their own; very long texts are taken one by
    one; other columns are not read; an empty table gives no rows.
    """
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end)
    return digests(read_tokens(docs.sparkSession, path))
