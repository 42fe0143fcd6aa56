"""Benchmark decontamination by pigeonhole edit matching.

A test item of n normalised characters (lower case, everything but letters and digits folded to one
blank) tolerates k = floor(error_rate x n) edits. It is split into k + 1 pieces: text within k edits of the
item holds one of them unchanged. The pieces of a block of items form one Aho-Corasick automaton; each piece
found in a document opens a window, and Myers' bit-parallel distance verifies the item there.

A piece that many items share (a common prompt line) would open a window for each of them wherever it stands. Such an
item is cut into more pieces, until those that few items share are k + 1 by themselves: k edits cannot touch all of
them, so the shared ones are left out and nothing is lost. Items that are nearly all shared text keep all their pieces.

Items are a stated query set, matched against all documents in blocks: a block holds at most BLOCK_CHARS
characters, is broadcast, and makes one narrow pass over the documents, so neither side is shuffled, no pair
is emitted before it is verified, and the broadcast does not grow with either table. After CHAIN blocks the rows are
written, so that a task has no more than CHAIN Python workers, and their broadcasts go. Every document is searched whole.

A null or empty text holds nothing. Items shorter than min_chars normalised characters match as whole words and
without edits (an edit more or less would make another short item); items without a letter or digit match nothing. An
item of any length is searched whole: its distance takes as many machine words as its length needs. Repeated items and documents give repeated rows; ties of distance go to the first
place. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from swathkit.llm import common

ERROR_RATE = 0.08  #: edits per character of an item
MIN_CHARS = 20  #: items of fewer characters match as whole words without an edit
BLOCK_CHARS = 2_000_000  #: characters of items per broadcast
CHAIN = 4  #: blocks of items that pass over the documents before these are written
SHARED, SHARE, SHORTEST = 16, 0.005, 5  #: items, and share of a block's, that make a piece a shared one; its characters at least

_folded = re.compile(r"[\W_]+").sub


def normalize(text: str | None) -> str:
    return _folded(" ", (text or "").lower()).strip()


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 spans that cover n characters, as even as can be."""
    cut = [n * j // (errors + 1) for j in range(errors + 2)]
    return [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any stretch of the text, and the first end where it is reached.

    anchored: to any stretch that starts where the text starts.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end, enters = m, 0, int(anchored)
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | minus
        eq |= (((eq & plus) + plus) ^ plus)
        up = minus | (~(eq | plus) & full)
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        up = ((up << 1) | enters) & full
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
    return best, end


class Matcher:
    """Items of one block and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        import ahocorasick

        self.items, self.errors = items, [int(len(t) * error_rate) for _, t in items]
        self.short = [len(t) < min_chars for _, t in items]  # whole words, no edits
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, own in enumerate(self.searched([0 if short else e for short, e in zip(self.short, self.errors, strict=True)])):
            for a, piece in own:
                owners.setdefault(piece, []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()

    def searched(self, errors: list[int]) -> list[list[tuple[int, str]]]:
        """Places and pieces to search for each item: more than errors that few items hold, if its text has as many, or all."""
        texts, grams = [t for _, t in self.items], Counter()
        for t in texts:
            grams.update({t[i : i + SHORTEST] for i in range(len(t) - SHORTEST + 1)})
        many, out = max(SHARED, int(SHARE * len(texts))), []
        for t, e, short in zip(texts, errors, self.short, strict=True):
            n, plain = e + 1, [(a, t[a:b]) for a, b in pieces(len(t), e)]
            cut = plain
            while True:
                # a piece of which every gram is in many items may be in as many, at whatever place
                rare = [(a, p) for a, p in cut if len(p) < SHORTEST or any(grams[p[i : i + SHORTEST]] <= many for i in range(len(p) - SHORTEST + 1))]
                more = min(n + e + 1 - len(rare), len(t) // SHORTEST)
                if short or len(rare) > e or more <= n:
                    break
                n = more
                cut = [(a, t[a:b]) for a, b in pieces(len(t), n - 1)]
            out.append(rare if len(rare) > e and not short else plain)
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start and end of the match) of each item found in a normalised text."""
        windows: dict[int, list[list[int]]] = {}
        whole: dict[int, int] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, a in where:
                begin = end + 1 - size - a
                if self.short[k]:
                    if (begin == 0 or text[begin - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                        whole.setdefault(k, begin)
                    continue
                left, right = max(0, begin - self.errors[k]), begin + len(self.items[k][1]) + self.errors[k]
                spans = windows.setdefault(k, [])
                if spans and left <= spans[-1][1] and left >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], right)
                else:
                    spans.append([left, right])
        found = [(k, 0, begin, begin + len(self.items[k][1])) for k, begin in whole.items()]
        for k, spans in windows.items():
            pattern = self.items[k][1]
            if (exact := text.find(pattern)) >= 0:
                found.append((k, 0, exact, exact + len(pattern)))
                continue
            best = min((d, left, left + e) for left, right in spans for d, e in [myers(pattern, text[left:right])])
            if best[0] <= self.errors[k]:
                distance, left, end = best
                _, back = myers(pattern[::-1], text[left:end][::-1], anchored=True)
                found.append((k, distance, end - back, end))
        return found


_matchers: dict[str, Matcher] = {}


def matcher_of(block: list[tuple[int, str]], digest: str, error_rate: float, min_chars: int) -> Matcher:
    """The automaton of a block, made once by a worker; it keeps one."""
    if digest not in _matchers:
        _matchers.clear()
        _matchers[digest] = Matcher(block, error_rate, min_chars)
    return _matchers[digest]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of BLOCK_CHARS; the driver holds a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalize(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(texts, pa.string())], ["i", "t"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, t string").where("t <> ''")
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():
        if block and size + len(row["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    if block:
        yield block


def mark_leaks(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """All columns of docs (but an earlier `leaks`) with leaks: an array of item_id, distance, match_start, match_end.

    Places are in the normalised text.
    """
    docs = docs.drop("leaks")
    plain, item = docs.schema, benchmark.schema[item_col].dataType
    hit = T.StructType(
        [T.StructField("item_id", item), *(T.StructField(x, T.IntegerType()) for x in ("distance", "match_start", "match_end"))]
    )
    out = docs.withColumn("leaks", F.array().cast(T.ArrayType(hit)))
    schema = T.StructType([*plain.fields, T.StructField("leaks", T.ArrayType(hit))])
    arrow = to_arrow_type(T.ArrayType(hit))
    chained = []
    for block in item_blocks(benchmark, item_col, item_text_col):
        if len(chained) == CHAIN:
            out = common.materialize(out, "leaks")
            while chained:
                chained.pop().destroy()
        digest = hashlib.sha256(repr((block, error_rate, min_chars)).encode("utf-8", "surrogatepass")).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        chained.append(shared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, digest=digest) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(shared.value, digest, error_rate, min_chars)
            for batch in batches:
                texts, before = batch.column(text_col), batch.column("leaks").to_pylist()
                found = []
                for k in range(batch.num_rows):
                    hits = matcher.find(normalize(texts[k].as_py()))
                    found.append(before[k] + [
                        {"item_id": matcher.items[i][0], "distance": d, "match_start": a, "match_end": z} for i, d, a, z in hits
                    ])
                kept = [batch.column(c) for c in plain.names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, arrow)], [*plain.names, "leaks"])

        out = out.mapInArrow(common.tidy(run), schema)
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end of every item found in a document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = mark_leaks(rows, benchmark, error_rate, min_chars, "text", item_col, item_text_col)
    return marked.select("doc_id", F.inline("leaks"))
