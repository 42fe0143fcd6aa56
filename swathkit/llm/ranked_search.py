"""Ranked lexical search by the threshold algorithm over shards of documents.

search() ranks all documents for each item of a query table by an integer BM25. Items come to the tasks in blocks of at
most QUERY_BYTES of text. For a block, each task cuts its documents into shards and keeps, of every document, its length
and the counts of the terms that some item holds (the forward index, one packed row a shard, written to the shared
folder); document frequencies, the number of documents and their length are summed by Spark. Then each shard sorts the
postings of each term by falling impact and runs the threshold algorithm for each item: it reads the lists of the item's
terms side by side, DEPTH entries and then twice as many at a time, looks up the whole score of each new document in the
forward index, and stops when the score that an unseen document can have is strictly below the k-th best. The k-th best
is carried from shard to shard of a task. The best of all shards are merged in two steps, so no task gets more than k
rows of each of MERGE_TASKS tasks for an item. Nothing is shuffled by term, so a term in every document costs a posting.

Every row of the documents is a document and every row of the items an item, so repeated ids are ranked each on its own.
Null text has no term. Equal scores go by ascending id, nulls last. Documents without a common term are not returned; an
item without a term, or an empty table on either side, gives no row. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.llm import common, terms

QUERY_BYTES = 8 << 20  #: item text in a block, which is broadcast
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 32 << 20  #: text bytes cut at once, and of a shard
DEPTH = 16  #: entries of each list read at first
MERGE_TASKS = 256  #: tasks whose best documents meet in one step


class Items:
    """A block of items: its distinct terms, and of each item the terms and how often it holds them."""

    def __init__(self, texts: list[str | None]):
        data, offsets = common.buffer_of(texts)
        data = data.translate(terms.LOWER)
        begin, end, item = terms.runs(data, offsets, terms.LETTERS_DIGITS)
        coded = terms.pieces(data, begin, end).dictionary_encode()
        self.vocabulary = coded.dictionary
        key, self.repeats = terms.counted(item * max(len(self.vocabulary), 1) + coded.indices.to_numpy().astype(np.int64))
        self.terms = key % max(len(self.vocabulary), 1)
        self.first = np.searchsorted(key // max(len(self.vocabulary), 1), np.arange(len(texts) + 1))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[k], self.first[k + 1])
        return self.terms[own], self.repeats[own]


def forward_rows(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row a shard: documents with a term, all their terms, df of each known term, and the packed forward index."""
    ids, length, count, term, tf, size = [], [], [], [], [], 0

    def packed() -> pa.RecordBatch:
        t = np.concatenate(term)
        known, df = terms.counted(t)
        n = np.concatenate(length)
        table = pa.table({"doc_id": pa.chunked_array(ids).combine_chunks()})
        payload = common.squeeze(common.to_stream(table), n, np.concatenate(count), t.astype(np.uint32), np.concatenate(tf))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                pa.array([known.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()),
            ],
            ["n_docs", "n_terms", "terms", "dfs", "payload"],
        )

    for part, data, offsets in terms.lowered(batches, CHUNK_BYTES):
        begin, end, doc = terms.runs(data, offsets, terms.LETTERS_DIGITS)
        found = pc.index_in(terms.pieces(data, begin, end), value_set=vocabulary)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        v = max(len(vocabulary), 1)
        key, n = terms.counted(doc[hit] * v + found.drop_null().to_numpy().astype(np.int64))
        ids.append(part.column("doc_id"))
        length.append(np.bincount(doc, minlength=part.num_rows).astype(np.int64))
        count.append(np.bincount(key // v, minlength=part.num_rows).astype(np.uint32))
        term.append(key % v)
        tf.append(n.astype(np.uint32))
        size += len(data)
        if size >= shard_bytes:
            yield packed()
            ids, length, count, term, tf, size = [], [], [], [], [], 0
    if ids:
        yield packed()


class Shard:
    """Forward index of a shard, and its postings by term and falling impact."""

    def __init__(self, payload: bytes, n_docs: int, n_terms: int):
        stream, length, count, term, tf = common.expand(payload, np.uint8, np.int64, np.uint32, np.uint32, np.uint32)
        self.ids = common.from_streams([stream.tobytes()]).column("doc_id").combine_chunks()
        self.place = np.empty(len(self.ids), np.int64)  # of each document in the order of ids
        self.place[pc.array_sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(self.ids))
        norm = 25 + 75 * length * n_docs // max(n_terms, 1)
        doc = np.repeat(np.arange(len(length)), count)
        tf = tf.astype(np.int64)
        self.term, self.first, self.count = term.astype(np.int64), np.cumsum(count.astype(np.int64)) - count, count.astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc])
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_terms, self.list_first = np.unique(self.term[order], return_index=True)
        self.list_end = np.r_[self.list_first[1:], len(order)]

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores: the forward index looked up for each document (all have a posting)."""
        n = self.count[docs]
        ends = np.cumsum(n)
        at = np.repeat(self.first[docs] - (ends - n), n) + np.arange(ends[-1])
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], ends - n)

    def best(self, query: np.ndarray, weight: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of at least all that belong to the k best, given that scores below floor do not."""
        place = np.minimum(np.searchsorted(self.list_terms, query), len(self.list_terms) - 1) if len(self.list_terms) else query[:0]
        own = query[: len(place)]
        place = place[(self.list_terms[place] == own) & (weight[own] > 0)]
        at, end, w = self.list_first[place], self.list_end[place], weight[self.list_terms[place]]
        seen, docs, got, step = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), DEPTH
        while len(at):
            fresh = np.unique(np.concatenate([self.list_doc[a : min(a + step, e)] for a, e in zip(at, end, strict=True)]))
            fresh = fresh[~np.isin(fresh, seen, assume_unique=True)]
            seen = np.concatenate([seen, fresh])
            if len(fresh):
                docs, got = np.concatenate([docs, fresh]), np.concatenate([got, self.scores(fresh, weight)])
                if len(docs) > k:
                    keep = np.lexsort((self.place[docs], -got))[:k]
                    docs, got = docs[keep], got[keep]
            at = at + step
            more = at < end
            at, end, w, step = at[more], end[more], w[more], 2 * step
            # an unseen document has at most the last impact read in each list that goes on
            threshold = int((w * self.list_impact[at - 1]).sum())
            if threshold < max(floor, int(got.min()) if len(got) == k else 0):
                break
        return [(int(s), int(d)) for s, d in zip(got, docs, strict=True) if s > 0 and s >= floor]


def search_block(docs: DataFrame, texts: list[str | None], k: int, shard_bytes: int) -> DataFrame:
    """item (its place in texts), doc_id, score of the k best of each task."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    items = Items(texts)
    sent = spark.sparkContext.broadcast(items)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from forward_rows(batches, sent.value.vocabulary, shard_bytes)

    rows = common.materialize(
        docs.mapInArrow(common.tidy(index), "n_docs bigint, n_terms bigint, terms array<int>, dfs array<bigint>, payload binary"), "forward-index"
    )
    totals = rows.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    pair = F.explode(F.arrays_zip("terms", "dfs"))
    df = {r["term"]: r["df"] for r in rows.select(pair.alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.dfs").alias("df")).collect()}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(items.vocabulary))], np.int64)
    weights = spark.sparkContext.broadcast(weight)
    n_items = len(texts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(n_items)]  # of this task: (-score, no id, id)
        own = np.zeros(len(weights.value), np.int64)
        for batch in batches:
            for payload in batch.column("payload"):
                shard = Shard(payload.as_py(), n_docs, n_terms)
                for i in range(n_items):
                    query, repeats = sent.value.of(i)
                    own[query] = weights.value[query] * repeats
                    found = shard.best(query, own, k, -best[i][-1][0] if len(best[i]) == k else 0)
                    own[query] = 0
                    if found:
                        ids = [shard.ids[d].as_py() for _, d in found]
                        best[i] = sorted(best[i] + [(-s, d is None, d) for (s, _), d in zip(found, ids, strict=True)])[:k]
        rows = [(i, d, -s) for i, own_best in enumerate(best) for s, _, d in own_best]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            columns = [pa.array(item, pa.int64()), pa.array(doc, shard.ids.type), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return rows.select("payload").mapInArrow(common.tidy(find), f"item bigint, doc_id {kind}, score bigint")


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    n = max(1, -(-2 * common.text_bytes(items) // query_bytes))
    dealt = common.materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items") if n > 1 else items.withColumn("block", F.lit(0))
    kind, found = items.schema["item_id"].dataType.simpleString(), None
    for b in range(n):
        block = dealt.where(F.col("block") == b).select("item_id", "text").toArrow()
        ids = spark.createDataFrame(list(enumerate(block.column("item_id").to_pylist())), f"item bigint, item_id {kind}")
        best = search_block(docs, block.column("text").to_pylist(), k, shard_bytes)
        best = best.withColumn("task", F.floor(F.spark_partition_id() / MERGE_TASKS))
        best = ranked(ranked(best, ["item", "task"], k).drop("rank", "task"), ["item"], k)
        own = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        own = common.materialize(own, "ranked") if n > 1 else own
        found = own if found is None else found.unionByName(own)
    return found

