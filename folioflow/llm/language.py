"""Language identification with language-bitmask n-gram filters.

Training collects, per language, the letter n-grams (2 to 4 letters, words padded by a
space) with the share of sampled documents that hold them. An n-gram belongs to every
language where this share is at least ``SHARE`` of its highest share in any language and
``MIN_DOCS`` documents hold it. All languages are kept in one bit-sliced Bloom filter: a
table of words, one bit per language (a table for every 64); an n-gram sets its languages'
bits at ``HASHES`` places, and the AND of those places returns every language that contains
it, all at once. The filter is put together on the executors and takes all members; its size
follows from the largest language's.

Scoring counts, per language, the n-grams of the whole text that the filter gives to it and
corrects the count for false positives: with rate f of a language's filter and n n-grams of
which c hit, (c - n f) / (1 - f) are expected to be members. The highest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, dropped, fraction, portions, written

#: At most about this many different training texts per language.
SAMPLE = 3000
SIZES, HASHES, SHARE, MIN_DOCS = (2, 3, 4), 3, 0.4, 3
#: Letters of a text that are taken up at a time.
BLOCK = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Codes of all n-grams of the letters of a whole text, lower-cased, repeats included, in bounded arrays."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return
    # one space for each run of other characters between words, one before the first and one behind the last
    kept = np.where(letter, codes, 32)[letter | np.r_[False, letter[:-1]]]
    whole = np.r_[np.uint32(32), kept, np.full(int(letter[-1]), 32, np.uint32)]
    for at in range(0, len(whole), BLOCK):
        codes = whole[at : at + BLOCK + SIZES[-1] - 1].astype(np.uint64)
        space, out = codes == 32, []
        for n in SIZES:
            size = min(len(codes) - n + 1, BLOCK)
            if size > 0:
                h = codes[:size].copy()
                inner = np.zeros(size, bool)
                for i in range(1, n):
                    h = (h << np.uint64(16)) ^ (h >> np.uint64(48)) ^ codes[i : size + i]
                    if i < n - 1:
                        inner |= space[i : size + i]  # n-grams across words tell nothing
                out.append((h * np.uint64(8) + np.uint64(n))[~inner])
        yield np.concatenate(out) if out else np.empty(0, np.uint64)


def places(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where an n-gram's bits lie in a table of 2 ** bits words."""
    out = []
    for m in _MIX[:HASHES]:
        h = codes * m
        h ^= h >> np.uint64(29)
        out.append((h * _MIX[0]) >> np.uint64(64 - bits))
    return out


class Model:
    """The bit-sliced filter, its languages and their false-positive rates.

    ``slots`` has a row of 2 ** bits words for every 64 languages; ``prior`` is the language
    that is named where nothing speaks for any.
    """

    def __init__(self, languages: list[str], slots: np.ndarray, prior: str | None = None):
        self.languages, self.slots, self.prior = languages, slots, prior
        self.bits = slots.shape[1].bit_length() - 1
        self.learned = bool(slots.any())
        self.false = np.array([((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() ** HASHES for k in range(len(languages))])

    def slices(self, codes: np.ndarray) -> list[np.ndarray]:
        """Bit masks of languages for each n-gram, one array for every 64 languages."""
        at = places(codes, self.bits)
        out = []
        for slots in self.slots:
            mask = slots[at[0]]
            for x in at[1:]:
                mask = mask & slots[x]
            out.append(mask)
        return out

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """How many of the n-grams the filter gives to each language."""
        out = []
        for s, mask in enumerate(self.slices(codes)):
            here = min(64, len(self.languages) - 64 * s)
            if here <= 12:
                n = np.bincount(mask.astype(np.int64), minlength=1 << here)
                out.append(n @ ((np.arange(1 << here)[:, None] >> np.arange(here)) & 1))
            else:
                out.append(np.array([((mask >> np.uint64(k)) & np.uint64(1)).sum() for k in range(here)], np.int64))
        return np.concatenate(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the highest corrected count (the first by name of equals), and that count's share of the n-grams."""
        n, c = 0, np.zeros(len(self.languages), np.int64)
        for codes in grams(text):
            n += len(codes)
            if self.languages:
                c += self.counts(codes)
        if not n or not self.languages:
            return "und", 0.0
        sure = np.maximum(0.0, (c - n * self.false) / (1 - self.false))
        k = int(np.argmax(sure))
        return (self.languages[k], float(min(1.0, sure[k] / n))) if sure[k] > 0 else (self.prior, 0.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``docs`` (``text, lang``; nulls are left out).

    Each language gives a random sample of about ``sample`` different texts at most, chosen by
    a hash of the text. Their n-grams are counted and turned into the filter's words on the
    executors; what reaches the driver is one row per language and the words that are not
    zero, not the n-grams. All languages are learned.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64))
    shares = F.broadcast(spark.createDataFrame([(x, sample / n, k) for k, (x, n) in enumerate(sorted(counts.items()))], "lang string, share double, k int"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        seen: dict[int, list[np.ndarray]] = {}
        for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own := list(grams(text)):
                seen.setdefault(k, []).append(np.unique(np.concatenate([np.unique(x) for x in own])))
        if not seen:
            return None
        parts = [(k, len(each), *np.unique(np.concatenate(each), return_counts=True)) for k, each in seen.items()]
        first = [np.r_[n, np.zeros(len(codes) - 1, np.int64)] for _, n, codes, _ in parts]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([k for k, *_ in parts], [len(x[2]) for x in parts]).astype(np.int32)), pa.array(np.concatenate([x[2] for x in parts]).view(np.int64)), pa.array(np.concatenate([x[3] for x in parts])), pa.array(np.concatenate(first))],
            ["k", "gram", "docs", "texts"],
        )

    kept = d.where("text is not null").join(shares, "lang").where(fraction("text") < F.col("share")).select("text", "k").distinct()
    found = written(by_batch(kept, ["text", "k"], count, "k int, gram long, docs long, texts long"), "grams")
    sampled = F.broadcast(found.groupBy("k").agg(F.greatest(F.sum("texts"), F.lit(1)).alias("t")))
    per = found.groupBy("gram", "k").agg(F.sum("docs").alias("c")).join(sampled, "k").withColumn("rate", F.col("c") / F.col("t"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    members = per.withColumn("most", most).where((F.col("c") >= MIN_DOCS) & (F.col("rate") >= SHARE * F.col("most"))).select("k", "gram")
    members = written(members, "members")
    largest = members.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    bits = max(16, (16 * largest - 1).bit_length())
    prior = min(languages, key=lambda x: (-counts[x], x))
    model = Model(languages, _words(members, len(languages), bits), prior)
    dropped(found, members)
    return model


def _words(members: DataFrame, languages: int, bits: int) -> np.ndarray:
    """The filter's tables, put together from ``members (k, gram)``."""

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        k, codes = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().view(np.uint64)
        at = np.concatenate(places(codes, bits)).view(np.int64)
        word = np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(k // 64, HASHES).astype(np.int32)), pa.array(at), pa.array(np.tile(word, HASHES))], ["s", "at", "word"])

    words = by_batch(members, ["k", "gram"], placed, "s int, at long, word long").groupBy("s", "at").agg(F.bit_or("word").alias("word")).toArrow()
    slots = np.zeros((-(-languages // 64), 1 << bits), np.uint64)
    slots[words["s"].to_numpy(), words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return slots


def predict(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns of ``docs`` with ``lang_pred`` and ``score`` of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [held.value.predict(x) for x in batch.column(0).to_pylist()]
        pred, score = (list(x) for x in zip(*got))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    kept = docs.select(F.col("text").cast("string").alias("__text"), *columns)
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns] + ["lang_pred string", "score double"])
    return by_batch(kept, ["__text", *columns], run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    The model learns from the documents that are not held out (a null doc_id is not) and have
    a lang; predictions use the text alone. ``score`` is the share of the text's n-grams that
    the predicted language is expected to have. ``und`` with score 0 if the text is null or
    has no letter; a text of letters that no language knows gets the language with
    the most labelled rows and score 0; of languages with equal counts the first by name counts.
    Without any labelled row every prediction is ``und``. Very long texts are counted block by
    block; repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    return predict(d, train(d.where("not held_out")), ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without those that fit no learned language: no letters, or less than ``least`` of their n-grams known to the likeliest.

    Languages that share their n-grams do not take them from each other. Where nothing was
    learned only documents without letters go. The model learns from the rows that are not
    held out (those without doc_id among them); all columns are kept as they are, whatever their names. Null and empty
    texts go; a very long text is judged as a whole; each of repeated rows is decided alike; an empty table stays empty.
    """
    model = train(docs.where(~held_out()).select("text", "lang"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def fits(text: str | None) -> bool:
        if not held.value.learned:
            return any(len(x) for x in grams(text))
        lang, known = held.value.predict(text)
        return lang != "und" and known >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole):
                yield batch.filter(pa.array([fits(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
