"""Token counts by byte-pair merging with a heap and a linked list.

No identifiers are made: the count is the number of initial symbols minus the number of
merges (plus, with byte fallback, the further bytes of symbols that no piece covers).

The vocabulary is a SentencePiece BPE model. Two facts read from it keep the work small
and the result exact: characters that stand side by side in no piece can never be merged
across, so a text falls apart at such places; and equal fragments have equal counts, so
they are counted once per worker (in a cache of bounded size).
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

MODEL, LIMIT = "piece_bpe_32k.model", 4096
CACHE, LONGEST = 600_000, 48
SPACE = "▁"


def merges(ranks: dict[str, float], text: str) -> list[str]:
    """The symbols left of ``text`` when no adjacent pair makes a piece any more.

    The pair of lowest rank is merged first, the leftmost of equals.
    """
    part: list[str | None] = list(text)
    n = len(part)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    right[-1:] = [-1] * (n > 0)
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in ranks]
    heapify(heap)
    while heap:
        _, i, whole = heappop(heap)
        a = part[i]
        if a is None or (j := right[i]) < 0 or len(a) >= len(whole) or a + part[j] != whole:
            continue  # one of the two has been merged since
        part[i], part[j] = whole, None
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (p := whole + part[k]) in ranks:
                heappush(heap, (ranks[p], i, p))
        if (k := left[i]) >= 0 and (p := part[k] + whole) in ranks:
            heappush(heap, (ranks[p], k, p))
    return [x for x in part if x is not None]


class PieceCounter(dict):
    """Fragment of a text -> its number of tokens; fills itself, up to ``CACHE`` fragments."""

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        self.fallback = any(model.is_byte(i) for i in range(model.get_piece_size()))
        pairs = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}
        self.pairs = pairs
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ranks)
        line = any("\n" in p for p in self.ranks)
        self.units = re.compile(r"(?s).+" if inner or line else rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall

    def fragment(self, text: str) -> int:
        n = 0
        for x in merges(self.ranks, text):
            n += 1 if x in self.ranks or not self.fallback else len(x.encode("utf-8", "surrogatepass"))
        return n

    def __missing__(self, unit: str) -> int:
        pairs, at, n = self.pairs, 0, 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                n, at = n + self.part(unit[at:i]), i
        n += self.part(unit[at:])
        if len(unit) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = n
        return n

    def part(self, text: str) -> int:
        return got if (got := self.get(text)) is not None else self.fragment(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.units(SPACE + text.replace(" ", SPACE))))


_counters: dict[str, PieceCounter] = {}


def counter(name: str) -> PieceCounter:
    """One per worker process; ``name`` is a file of the tokenizer folder or a path."""
    if name not in _counters:
        _counters[name] = PieceCounter(name if "/" in name else public_tokenizers.path(name))
    return _counters[name]


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text counts as an empty one: no bytes, no tokens. A null doc_id is carried; repeated rows give
    repeated results; very long texts are taken one by one and counted fragment by fragment;
    other columns are not read; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(model).count
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n = [count(x) for x in texts]
        size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return by_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        ["doc_id", "text"], run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
