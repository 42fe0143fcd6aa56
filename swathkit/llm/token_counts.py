"""Token counts by heap-and-linked-list byte-pair merging.

count_tokens() adds the token count of each whole text. A worker cuts texts into
pretokens, merges each distinct pretoken once by popping the lowest-rank adjacent
pair, and keeps only counts (initial symbols minus merges); no token ids are made.
The operator is one narrow map over the scan: no shuffle, so hot keys cannot matter.

Null text counts as empty (0 tokens); null or repeated ids keep their rows; an empty
table gives an empty result; extra columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm import common

CACHE_WORDS, CACHE_LONGEST = 200_000, 64  #: counts kept by a worker before it starts anew, and bytes of the longest word kept


class MergeCounter:
    """Counts the tokens of pretokens for the vocabulary file of a byte-level BPE tokenizer (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.specials = tuple(t["content"].encode() for t in spec.get("added_tokens", ()))
        self.symbols = byte_symbols()
        self.counts: dict[bytes, int] = {s: 1 for s in self.specials}

    def of(self, word: bytes) -> int:
        """Tokens of one pretoken."""
        if (known := self.counts.get(word)) is None:
            if len(self.counts) >= CACHE_WORDS:
                self.counts = {s: 1 for s in self.specials}
            known = len(word) - self.merges(word)
            if len(word) <= CACHE_LONGEST:
                self.counts[word] = known
        return known

    def merges(self, word: bytes) -> int:
        """How many merges the pretoken takes: a linked list of symbols, a heap of (rank, left position)."""
        ranks, piece = self.ranks, [self.symbols[b] for b in word]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((piece[i], piece[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if piece[i] is None or j >= n or ranks.get((piece[i], piece[j])) != rank:
                continue  # a neighbour has been merged since
            piece[i], piece[j] = piece[i] + piece[j], None
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((piece[i], piece[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((piece[h], piece[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return done


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level BPE files: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@functools.lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for part in common.chunks(batch, "text", 2 << 20):
                data, offsets = common.buffer_of(part.column("text").to_pylist())
                words, index, first = common.words_of(data, offsets, count.specials)
                each = np.fromiter(map(count.of, words.to_pylist()), np.int64, len(words))
                total = np.r_[0, np.cumsum(each[index])]
                n = total[first[1:]] - total[first[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        common.tidy(run), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
