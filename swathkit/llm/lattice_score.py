"""Language-model scores of texts by subword lattices: all segmentations of each word count, not only the best one.

The model draws the words of a document, then one end, from the document's class (a language of the training rows), and
sums the class out: P(document) = sum over classes of P(class) x product over tokens of P(token | class). A token's
lattice has an arc for every piece of an existing unigram vocabulary that lies in it, and arcs over the whole word:
    P(w | class) = (c(w, class) + T(class) B(w, class)) / (N(class) + T(class)),  B = (c(w) + T S(w, class)) / (N + T)
with c, N, T the training counts, tokens and distinct tokens, and S the sum over all segmentations of w into pieces: the
first piece begins the word, each other one follows with chance 1 - stop. S is found by the forward recursion in log
space. The vocabulary's scores seed the weights of its pieces (its scores are ranks below 0, so a piece weighs
1 / (ZIPF - score)); ROUNDS expectation steps, forward and backward over each distinct training word of a class once,
re-weight them for the class with PRIOR pseudo-counts of the seed. The vocabulary stays as it is. Every byte is a piece,
so every text has a score.

How it runs: tasks cut documents into blocks. A block keeps its documents as counts of its distinct words (one packed
row), and lists these words, with their training counts by class, in packed rows by a hash of the word. The lists are
sorted by part within partitions and merged as a stream into the word table (one row a part, each distinct word once).
The expectation steps and the totals read that table. Then table and lists meet again, sorted so that the table's part
comes first and its lists stream past it; each block gets the counts and S of its words and adds up its documents. A
frequent word costs one entry a block; no task holds more than a part of the table and one batch of lists, or a block.

Null text is empty: only the end. Rows with a null train flag do not train. A null class is the class ''. Beyond
MAX_CLASSES classes (those with the most training rows; ties by name) the rest share one. Null and repeated ids keep their
rows. Without training rows every count is 0 and S alone scores. An empty table gives an empty result. Extra columns are
dropped.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm import common, terms

BLOCK_BYTES = 8 << 20  #: text bytes of a block
PART_BYTES, LEAST_PARTS = 32 << 20, 64  #: text bytes per part of the word table, and parts at least
MAX_CLASSES = 16
ZIPF, PRIOR, STOP, ROUNDS = 50.0, 200.0, 0.3, 2  #: offset of ranks; pseudo-counts of the seed; chance that a word ends, before learning; steps
MERGE_ROWS, LIST_BYTES = 1_000_000, 16 << 20  #: entries merged at once; bytes of lists served at once
WORDS_AT_ONCE, LONG_WORD = 20_000, 200  #: words of one lattice; bytes from which a word is a lattice of its own
MICRO = 1_000_000  #: expected counts are added up in millionths, so that their order does not matter
INDEX = -1


class Pieces:
    """The byte strings of a vocabulary, as a trie in sorted arrays; words are written with a blank before them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores: dict[bytes, float] = {}
        lowest = 0.0
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece, score = model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i)
            if b" " in piece[1:] or not piece:
                continue
            scores[piece], lowest = score, min(lowest, score)
        for b in [bytes([c]) for c in range(256)]:
            scores.setdefault(b, lowest)
        self.names = sorted(scores)
        seed = np.array([1 / (ZIPF - scores[p]) for p in self.names])
        self.begins = np.array([p[:1] == b" " for p in self.names])
        self.seed = np.where(self.begins, seed / seed[self.begins].sum(), seed / seed[~self.begins].sum())
        nodes, edges = {b"": 0}, {}
        for p in self.names:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges[nodes[p[: k - 1]] << 8 | p[k - 1]] = nodes[p[:k]]
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.root = np.zeros(256, np.int64)
        self.root[[p[0] for p in nodes if len(p) == 1]] = [n for p, n in nodes.items() if len(p) == 1]
        self.piece = np.full(len(nodes), -1, np.int64)
        self.piece[[nodes[p] for p in self.names]] = np.arange(len(self.names))

    def weights(self, counts: np.ndarray | None = None, words: float = 0.0) -> tuple[np.ndarray, float]:
        """Log weight of each piece in the lattice, and of the end of a word."""
        counts = np.zeros(len(self.names)) if counts is None else counts
        begin, follow = np.where(self.begins, counts, 0), np.where(self.begins, 0, counts)
        stop = (words + PRIOR * STOP) / (words + follow.sum() + PRIOR)
        p = np.where(self.begins, (begin + PRIOR * self.seed) / (begin.sum() + PRIOR), (follow + PRIOR * self.seed) / (follow.sum() + PRIOR) * (1 - stop))
        return np.log(p), math.log(stop)


@functools.lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Arcs of all pieces in some words; node j of word k is place starts[k] + j, one node more than bytes."""

    def __init__(self, data: bytes, sizes: np.ndarray, pieces: Pieces):
        """data: the words end to end, without the blank."""
        sizes = sizes.astype(np.int64)
        n = sizes + 1  # with the blank
        ends = np.cumsum(n)
        raw = np.full(int(ends[-1]) if len(n) else 0, 0x20, np.uint8)
        blank = np.zeros(len(raw), bool)
        blank[ends - n] = True
        raw[~blank] = np.frombuffer(data, np.uint8)
        left = np.repeat(ends, n) - np.arange(len(raw))  # bytes from here to the end of the word
        word = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(raw)) - (ends - n)[word]
        at, node, size = np.arange(len(raw)), pieces.root[raw], 1
        src, piece, length = [], [], []
        while True:
            alive = node > 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            own = pieces.piece[node]
            src.append(at[own >= 0])
            piece.append(own[own >= 0])
            length.append(np.full(len(src[-1]), size))
            more = left[at] > size
            at, node = at[more], node[more]
            key = node << 8 | raw[at + size]
            found = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            node = np.where(pieces.keys[found] == key, pieces.child[found], 0)
            size += 1
        src, self.piece, length = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (src, piece, length))
        order = np.lexsort((length, offset[src]))
        src, self.piece, length = src[order], self.piece[order], length[order]
        step = offset[src] * 256 + length
        self.cuts = np.r_[0, np.flatnonzero(np.diff(step)) + 1, len(step)].tolist() if len(step) else [0]
        self.word = word[src]
        self.src, self.dst = src + self.word, src + length + self.word
        self.heads, self.tails = ends - n + np.arange(len(n)), ends + np.arange(len(n))
        self.nodes = int(ends[-1]) + len(n) if len(n) else 0

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log sum over all ways from a word's head to each node."""
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.heads] = 0
        w = weight[self.piece]
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):  # all arcs of one place and length: no two meet in a node
            to = self.dst[a:b]
            alpha[to] = np.logaddexp(alpha[to], alpha[self.src[a:b]] + w[a:b])
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.full(self.nodes, -np.inf)
        beta[self.tails] = 0
        w = weight[self.piece]
        for a, b in zip(self.cuts[-2::-1], self.cuts[:0:-1], strict=True):
            of = self.src[a:b]
            beta[of] = np.logaddexp(beta[of], beta[self.dst[a:b]] + w[a:b])
        return beta

    def expected(self, weight: np.ndarray, n_pieces: int) -> np.ndarray:
        """How often each piece is expected, summed over the words."""
        alpha, beta = self.forward(weight), self.backward(weight)
        share = np.exp(alpha[self.src] + weight[self.piece] + beta[self.dst] - alpha[self.tails][self.word])
        return np.bincount(self.piece, share, minlength=n_pieces)


def lattices(data: bytes, sizes: np.ndarray, pieces: Pieces) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices over words of like length; with each the places of its words."""
    order = np.argsort(sizes, kind="stable")
    edges = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    a = 0
    while a < len(order):
        b = a + 1 if sizes[order[a]] >= LONG_WORD else min(a + WORDS_AT_ONCE, int(np.searchsorted(sizes[order], LONG_WORD)))
        own = order[a:b]
        yield own, Lattice(b"".join(data[edges[i] : edges[i + 1]] for i in own.tolist()), sizes[own], pieces)
        a = b


def block_rows(batches: Iterator[pa.RecordBatch], n_parts: int, n_classes: int) -> Iterator[pa.RecordBatch]:
    """part, block, payload: a row of part INDEX for each block's documents, and a row for each part of its words."""
    number = TaskContext.get().partitionId() << 32
    for part, data, offsets in terms.lowered(batches, BLOCK_BYTES):
        begin, end, doc = terms.runs(data, offsets, terms.NOT_SPACE)
        coded = terms.pieces(data, begin, end).dictionary_encode()
        text, edges = common.buffer_of_array(coded.dictionary)
        size = max(len(coded.dictionary), 1)
        dealt = (common.stretch_hashes(text, edges[:-1], edges[1:]) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key, tf = terms.counted(doc * size + place[coded.indices.to_numpy()])
        of, word = key // size, key % size
        train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
        kind = part.column("class").to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros((n_classes, size), np.int64)
        np.add.at(counts, (kind[of][train[of]], word[train[of]]), tf[train[of]])
        sizes, dealt = np.diff(edges)[order], dealt[order]
        ids = common.to_stream(pa.table({"doc_id": part.column("doc_id")}))
        rows = [(INDEX, common.squeeze(ids, np.bincount(of, minlength=part.num_rows).astype(np.uint32), word.astype(np.uint32), tf.astype(np.uint32)))]
        cuts = np.r_[0, np.flatnonzero(np.diff(dealt)) + 1, len(dealt)].tolist() if len(dealt) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = b"".join(text[edges[i] : edges[i + 1]] for i in order[a:b].tolist())
            rows.append((int(dealt[a]), common.squeeze(sizes[a:b].astype(np.uint32), own, counts[:, a:b].astype(np.uint32))))
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "block", "payload"])
        number += 1


def merged(lists: list[pa.Table], names: list[str]) -> pa.Table:
    table = pa.concat_tables(lists).group_by("word").aggregate([(c, "sum") for c in names])
    return table.rename_columns([c.removesuffix("_sum") for c in table.column_names])


def word_table(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[pa.RecordBatch]:
    """A row a part: its distinct words in order with their training counts, from lists sorted by part."""
    names = [f"c{k}" for k in range(n_classes)]
    part, lists, held = None, [], 0

    def closed() -> pa.RecordBatch:
        table = merged(lists, names).sort_by("word")
        counts = np.stack([table.column(c).to_numpy() for c in names])
        text, edges = common.buffer_of_array(table.column("word"))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([common.squeeze(np.diff(edges).astype(np.uint32), text, counts)], pa.binary()),
                pa.array([counts.sum(axis=1).tolist()], pa.list_(pa.int64())), pa.array([(counts > 0).sum(axis=1).tolist()], pa.list_(pa.int64())),
                pa.array([int((counts.sum(axis=0) > 0).sum())], pa.int64()),
            ],
            ["part", "words", "tokens", "kinds", "known"],
        )

    for batch in batches:
        for own, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
            if own != part and lists:
                yield closed()
                lists, held = [], 0
            part = own
            sizes, text, counts = common.expand(payload.as_py(), np.uint32, np.uint8, np.uint32)
            words = common.slices(text.tobytes(), np.r_[0, np.cumsum(sizes, dtype=np.int64)])
            lists.append(pa.table({"word": words} | dict(zip(names, counts.reshape(n_classes, -1).astype(np.int64), strict=True))))
            held += len(words)
            if held > MERGE_ROWS:
                lists = [merged(lists, names)]
                held = -lists[0].num_rows if held < 0 else 0  # the next merge comes after as many new entries
    if lists:
        yield closed()


Weights = list[tuple[np.ndarray, float]]  #: of each class


def expectations(batches: Iterator[pa.RecordBatch], path: str, weights: Weights) -> Iterator[pa.RecordBatch]:
    """kind, piece, share: expected counts (in millionths) of the pieces over the distinct training words of each class."""
    pieces = pieces_of(path)
    share = np.zeros((len(weights), len(pieces.names)), np.int64)
    for batch in batches:
        for payload in batch.column("words"):
            sizes, text, counts = common.expand(payload.as_py(), np.uint32, np.uint8, np.int64)
            for k, some in enumerate(counts.reshape(len(weights), -1) > 0):
                for _, lattice in lattices(text[np.repeat(some, sizes)].tobytes(), sizes[some], pieces):
                    share[k] += np.rint(MICRO * lattice.expected(weights[k][0], share.shape[1])).astype(np.int64)
    kind, found = np.nonzero(share)
    columns = [pa.array(kind, pa.int64()), pa.array(found, pa.int64()), pa.array(share[kind, found], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["kind", "piece", "share"])


def served(batches: Iterator[pa.RecordBatch], path: str, weights: Weights) -> Iterator[pa.RecordBatch]:
    """block, part, payload: training counts and log S by class of each word of each list; a part's table comes before its lists."""
    pieces, part, words, counts, log_s = pieces_of(path), None, None, None, None

    def looked_up(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        lists = [common.expand(p, np.uint32, np.uint8, np.uint32)[:2] for _, p in rows]
        sizes = np.concatenate([x[0] for x in lists]).astype(np.int64)
        wanted = common.slices(np.concatenate([x[1] for x in lists]).tobytes(), np.r_[0, np.cumsum(sizes)])
        at = pc.index_in(wanted, value_set=words).to_numpy().astype(np.int64)
        ends = np.cumsum([len(x[0]) for x in lists])
        out = [common.squeeze(counts[:, own], log_s[:, own]) for own in np.split(at, ends[:-1])]
        columns = [pa.array([b for b, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(out, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "part", "payload"])

    for batch in batches:
        rows, held = [], 0
        for own, block, payload in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            if rows and (own != part or held > LIST_BYTES):
                yield looked_up(rows)
                rows, held = [], 0
            if block is None:  # the table's part
                sizes, text, counts = common.expand(payload.as_py(), np.uint32, np.uint8, np.int64)
                words = common.slices(text.tobytes(), np.r_[0, np.cumsum(sizes, dtype=np.int64)])
                counts, log_s, part = counts.reshape(len(weights), -1), np.empty((len(weights), len(sizes)), np.float32), own
                for some, lattice in lattices(text.tobytes(), sizes, pieces):
                    for k, (weight, stop) in enumerate(weights):
                        log_s[k, some] = lattice.forward(weight)[lattice.tails] + stop
                continue
            rows.append((block, payload.as_py()))
            held += len(rows[-1][1])
        if rows:
            yield looked_up(rows)


class Model:
    """Totals of the training rows: tokens and distinct tokens, over all and by class, and documents by class."""

    def __init__(self, docs: list[int], tokens: list[int], kinds: list[int], known: int):
        self.docs = np.array(docs, np.int64)
        self.tokens = np.array(tokens, np.int64) + self.docs  # each document has one end
        self.kinds = np.array(kinds, np.int64) + (self.docs > 0)
        self.n, self.v = int(self.tokens.sum()), known + int(self.docs.sum() > 0)
        self.log_class = np.log((self.docs + 1) / (self.docs.sum() + len(docs)))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))

    def log_p(self, counts: np.ndarray, log_s: np.ndarray) -> np.ndarray:
        """ln P(token | class) of tokens with their counts and ln S by class."""
        shared = np.logaddexp(_log(counts.sum(axis=0)), _log(self.v) + log_s) - _log(self.n + self.v) if self.n else log_s
        own = np.logaddexp(_log(counts), _log(self.kinds)[:, None] + shared) - _log(self.tokens + self.kinds)[:, None]
        return np.where((self.tokens > 0)[:, None], own, shared)


def _log(x) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.asarray(x, np.float64))


def add_up(table: pa.Table, model: Model, end_s: float, n_classes: int) -> pa.Table:
    """The rows of one block: its index, and the values of its words by part."""
    parts = sorted(zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True))
    ids, each, word, tf = common.expand(parts[0][1], np.uint8, np.uint32, np.uint32, np.uint32)
    got = [common.expand(p, np.int64, np.float32) for _, p in parts[1:]]
    counts = np.concatenate([np.zeros((n_classes, 0), np.int64), *(c.reshape(n_classes, -1) for c, _ in got)], axis=1)
    log_s = np.concatenate([np.zeros((n_classes, 0)), *(s.reshape(n_classes, -1) for _, s in got)], axis=1)
    known, log_p = counts.sum(axis=0), model.log_p(counts, log_s)
    base = model.base(known)
    first = np.r_[0, np.cumsum(each, dtype=np.int64)]

    def per_doc(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(each), values.dtype)
        some = np.flatnonzero(each)
        if len(some):
            total[some] = np.add.reduceat(values, first[some])
        return total

    tf = tf.astype(np.int64)
    ends = int(model.docs.sum())
    end_p = model.log_p(model.docs[:, None], np.full((n_classes, 1), end_s))[:, 0]
    by_class = np.stack([model.log_class[k] + per_doc(tf * log_p[k][word]) + end_p[k] for k in range(n_classes)])
    doc = common.from_streams([ids.tobytes()]).column("doc_id")
    return pa.table(
        {
            "doc_id": doc, "n_tokens": per_doc(tf) + 1, "n_known": per_doc(tf * (known[word] > 0)) + int(ends > 0),
            "train_tokens": np.full(len(each), model.n), "base_score": per_doc(tf * base[word]) + float(model.base(np.array(ends))),
            "score": np.logaddexp.reduce(by_class, axis=0) / math.log(10),
        }
    )


def score(
    docs: DataFrame, vocabulary: str, train: Column, class_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document; vocabulary: a sentencepiece model."""
    kind = docs.schema[id_col].dataType.simpleString()
    name = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), name.alias("name"))
    by_name = docs.where("train").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = [(r["name"], r["n"]) for r in by_name.orderBy(F.desc("n"), "name").limit(MAX_CLASSES).collect()]
    rest = docs.where("train").count() - sum(n for _, n in found)
    n_docs = [n for _, n in found] + [rest] * (rest > 0) or [0]
    place = F.lit(len(found) if rest else 0)
    for k, (value, _) in reversed(list(enumerate(found))):
        place = F.when(F.col("name") == value, k).otherwise(place)
    n_classes, n_parts = len(n_docs), common.shards_for(common.text_bytes(docs), PART_BYTES, LEAST_PARTS)

    rows = common.materialize(
        docs.select("doc_id", "text", "train", place.cast("int").alias("class")).mapInArrow(
            common.tidy(lambda b: block_rows(b, n_parts, n_classes)), "part int, block bigint, payload binary"
        ),
        "word-lists",
    )
    lists = rows.where(F.col("part") != INDEX)
    table = common.materialize(
        lists.repartition("part").sortWithinPartitions("part", "block").mapInArrow(
            common.tidy(lambda b: word_table(b, n_classes)), "part int, words binary, tokens array<bigint>, kinds array<bigint>, known bigint"
        ),
        "word-table",
    )
    sums = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("tokens", "kinds") for k in range(n_classes)]
    total = table.agg(F.sum("known").alias("known"), *sums).first()
    model = Model(n_docs, [total[f"tokens{k}"] or 0 for k in range(n_classes)], [total[f"kinds{k}"] or 0 for k in range(n_classes)], total["known"] or 0)

    pieces = pieces_of(vocabulary)
    weights = [pieces.weights()] * n_classes
    for _ in range(ROUNDS):
        shares = table.select("words").mapInArrow(common.tidy(lambda b, w=weights: expectations(b, vocabulary, w)), "kind bigint, piece bigint, share bigint")
        expected = np.zeros((n_classes, len(pieces.names)))
        for r in shares.groupBy("kind", "piece").agg(F.sum("share").alias("share")).collect():  # at most a row a class and piece
            expected[r["kind"], r["piece"]] = r["share"] / MICRO
        weights = [pieces.weights(expected[k], float(total[f"kinds{k}"] or 0)) for k in range(n_classes)]

    both = table.select("part", F.lit(None).cast("bigint").alias("block"), F.col("words").alias("payload")).unionByName(lists)
    values = both.repartition("part").sortWithinPartitions("part", F.asc_nulls_first("block")).mapInArrow(
        common.tidy(lambda b: served(b, vocabulary, weights)), "block bigint, part int, payload binary"
    )
    end_s = -math.log(max(model.v, 1) + 1)  # the end as one more kind of token
    return rows.where(F.col("part") == INDEX).select("block", "part", "payload").unionByName(values).groupBy("block").applyInArrow(
        common.tidied(lambda t: add_up(t, model, end_s, n_classes)),
        f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
