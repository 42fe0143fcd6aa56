"""Near-duplicates by SimHash fingerprints linked in BK-trees.

fingerprints() makes a 64-bit SimHash of each whole text: A-Z in lower case, words are runs of anything but
ASCII white space, shingles are `words` words joined by one blank (repeats count), each hashed by XXH64
(seed 42); a bit is 1 if it is set in over half the hashes. Without words it is 0.

link() finds all links at `radius` or fewer differing bits among the distinct fingerprints. The bits are cut
into BLOCKS blocks: two linked fingerprints agree in at least BLOCKS - radius whole blocks, so each choice of so
many blocks deals the fingerprints into shards that together see every link. A shard's fingerprints form a
BK-tree (children keyed by Hamming distance to the parent); a search follows only edges within the radius.
The trees stay where their shard was shuffled to: broadcast trees would grow with the corpus. Shards are
distinct fingerprints only, and one larger than SPLIT is dealt again by its free bits, exactly. A shard emits a
spanning set of its links, never all pairs; components.components() joins them.

Null text counts as empty. Null ids keep their rows and never become a component's id unless no member has
one. Repeated rows are members like any other. An empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm import common
from swathkit.llm.components import components

WORDS = 3
RADIUS = 2
BLOCKS = 5
SPLIT = 2_048  #: fingerprints in a tree
SEED = 42
CHUNK = 1 << 20  #: text bytes hashed at once


PIECE = 1 << 16  #: hashes looked at together


def word_spans(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts in lower case (A-Z only) with a blank after each, their starts and ends, and how many each text has."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8).copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    raw[blank] = 32
    after_word = np.r_[False, ~blank[:-1]]
    starts = np.flatnonzero(~blank & ~after_word)
    if not len(starts):
        return b"", starts, starts, np.zeros(len(parts), np.int64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    doc_start = np.r_[0, np.cumsum(size + 1)[:-1]]
    first = np.searchsorted(starts, np.r_[doc_start, len(raw)])  # word numbers
    keep = ~blank | after_word  # one blank after each word
    text = raw[keep].tobytes()
    begin = np.cumsum(keep)[starts] - 1
    return text, begin, np.r_[begin[1:], len(text)] - 1, np.diff(first)


def shingle_hashes(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and how many each text has."""
    import xxhash

    text, begin, end, n_words = word_spans(texts)
    n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    first, at = np.cumsum(n_words) - n_words, np.cumsum(n) - n
    digest, h = xxhash.xxh64_intdigest, np.empty(n.sum(), np.uint64)
    left = np.arange(len(h)) - np.repeat(at - first, n)
    right = np.minimum(left + words, np.repeat(first + n_words, n)) - 1
    for k in range(0, len(h), PIECE):
        a, b = begin[left[k : k + PIECE]].tolist(), end[right[k : k + PIECE]].tolist()
        h[k : k + PIECE] = [digest(text[x:y], SEED) for x, y in zip(a, b, strict=True)]
    return h, n


def majority_bits(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, with n hashes each, the bits set in over half of its hashes."""
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    doc = np.repeat(np.arange(len(n)), n)
    ones = np.zeros((len(n), 64), np.int64)
    for k in range(0, len(h), PIECE):
        bits = np.unpackbits(h[k : k + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = np.flatnonzero(np.r_[True, np.diff(doc[k : k + PIECE]) > 0])
        ones[doc[k : k + PIECE][head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhashes(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    return majority_bits(*shingle_hashes(texts, words))


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", CHUNK):
                fp = simhashes(part.column("text").to_pylist(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        common.tidy(run), f"doc_id {kind}, fp bigint"
    )


class BKTree:
    """Nodes [value, {distance: child}]."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def add(self, value: int) -> list[int]:
        """Insert a value and return those within the radius that were there before."""
        if self.root is None:
            self.root = (value, {})
            return []
        near, radius = [], self.radius
        todo = [self.root]
        while todo:
            other, children = todo.pop()
            d = (value ^ other).bit_count()
            if d <= radius:
                near.append(other)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            if (child := node[1].get(d)) is None:
                node[1][d] = (value, {})
                return near
            node = child


def masks(bits: list[int], blocks: int) -> list[int]:
    """Masks of even blocks of the given bit places."""
    cut = [len(bits) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]


def keep_masks(radius: int, blocks: int) -> list[int]:
    """Each choice of blocks - radius blocks of the 64 bits."""
    return [sum(m) for m in combinations(masks(list(range(64)), blocks), blocks - radius)]


def spanning_links(values: list[int], radius: int, free: int, split: int = SPLIT) -> list[tuple[int, int]]:
    """Links within the radius that connect what all such links connect; values differ in free bits only."""
    parent = {v: v for v in values}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))

    places = [b for b in range(64) if free >> b & 1]
    if len(values) <= split or len(places) <= radius:
        tree = BKTree(radius)
        for v in values:
            for w in tree.add(v):
                join(v, w)
        return out
    # radius + 1 blocks of the free bits: two linked values agree in one of them
    for mask in masks(places, radius + 1):
        shards: dict[int, list[int]] = {}
        for v in values:
            shards.setdefault(v & mask, []).append(v)
        for shard in shards.values():
            if len(shard) > 1:
                for a, b in spanning_links(shard, radius, free & ~mask, split):
                    join(a, b)
    return out


def link(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """u, v: spanning links among the distinct values of column fp (a table: it is read more than once)."""
    choices = keep_masks(radius, blocks)
    held = F.array(*(F.lit(signed(m)) for m in choices))
    dealt = distinct.select(
        "fp", F.posexplode(F.transform(held, lambda m: F.col("fp").bitwiseAND(m))).alias("choice", "shard")
    )
    # a shard too large for a tree is cut by blocks of its free bits: two linked values agree in one of them
    size = dealt.groupBy("choice", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split)
    hot = common.materialize(size.select("choice", "shard"), "hot-shards")
    if hot.isEmpty():
        return trees(dealt.withColumns({"part": F.lit(0), "bits": F.lit(0).cast("bigint")}), choices, radius, split)
    cut = [masks([b for b in range(64) if not m >> b & 1], radius + 1) for m in choices]
    parts = F.element_at(F.array(*(F.array(*(F.lit(signed(x)) for x in row)) for row in cut)), F.col("choice") + 1)
    cold = common.drop_keys(dealt, hot, ["choice", "shard"]).withColumns({"part": F.lit(0), "bits": F.lit(0).cast("bigint")})
    large = common.keep_keys(dealt, hot, ["choice", "shard"]).select(
        "fp", "choice", "shard", F.posexplode(F.transform(parts, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "bits")
    )
    return trees(cold.unionByName(large.withColumn("part", F.col("part") + 1)), choices, radius, split)


def trees(dealt: DataFrame, choices: list[int], radius: int, split: int) -> DataFrame:
    """u, v of the BK-tree of each (choice, shard, part, bits)."""
    key = ["choice", "shard", "part", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.whole_groups(batches, [*key, "fp"], len(key)):
            yield links_of(rows)

    def links_of(rows: np.ndarray) -> pa.RecordBatch:
        edges = np.r_[0, np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1, len(rows)]
        found: list[tuple[int, int]] = []
        for k in np.flatnonzero(np.diff(edges) > 1):
            values = rows[edges[k] : edges[k + 1], 4].copy().view(np.uint64).tolist()
            free = ~choices[rows[edges[k], 0]] & (2**64 - 1)
            found += spanning_links(values, radius, free, split)
        out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["u", "v"])

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(common.tidy(run), "u bigint, v bigint")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of all documents linked, itself included)."""
    marked = common.materialize(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    found = components(link(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return marked.join(named.select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
