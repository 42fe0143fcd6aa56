"""Token-id files: one concatenated id array per shard, document ends in Elias-Fano code.

write_token_shards() sorts documents by id into range partitions (one shuffle), encodes
them with the tokenizers library and writes chunk rows as Parquet (a container that any
Hadoop file system takes): ids as little-endian 16- or 32-bit integers, document ends as
Elias-Fano bits, document ids. read_token_shards() reads the chunks back; a document's
global start is the sum of the partitions and chunks before it plus its local offset, found
from sums of a few rows, never from a table of 64-bit offsets.

Null text is empty (only the end id); null ids come first; rows of one id lie in the order
of their text's hash, so that rows without an id spread too; an empty table gives no chunks
and no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swathkit.llm import common
from swathkit.llm.elias_fano import EliasFano

PARTITION_BYTES = 16 << 20  #: text bytes per range partition
CHUNK_BYTES = 4 << 20  #: text bytes per chunk
CACHE_WORDS, CACHE_LONGEST = 400_000, 64  #: words kept by a worker, and bytes of the longest one kept
LINE_END = 0x0A
LINES_BYTES, LINES_AT_ONCE = 1 << 10, 256  #: bytes of the lines of words that are encoded as a text, and texts at once
CHUNK = (
    "part int, chunk int, doc_ids array<bigint>, n_docs bigint, n_ids bigint, id_bytes int, ids binary, "
    "ends_low binary, ends_high binary, ends_samples binary"
)


def id_type(n: int) -> np.dtype:
    """The integers that hold ids below n."""
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


class WordEncoder:
    """Ids of pretokens by the tokenizers library, each distinct one once per worker while the cache lasts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = tuple(t.content.encode() for t in added.values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(1 + max(*vocabulary.values(), *added), np.int64)  #: of each id's piece: a symbol is a byte
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        for i, t in added.items():
            self.n_bytes[i] = len(t.content.encode())
        self.dtype = id_type(len(self.n_bytes))
        self.known = pa.array([], pa.binary())
        self.known_n, self.known_ids = np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def ids(self, words: pa.Array, keep: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n, at, ids of distinct pretokens: word w has n[w] of ids from at[w] on. keep: new ones go to the cache while there is room."""
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(place.is_null())
        new_n, new_ids = self.encoded(new)
        which = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        which[which < 0] = len(self.known) + np.arange(len(new))
        n, ids = np.concatenate([self.known_n, new_n]), np.concatenate([self.known_ids, new_ids])
        at = np.cumsum(n) - n
        room = CACHE_WORDS - len(self.known)
        if keep and room > 0 and len(new):
            short = np.flatnonzero(pc.binary_length(new).to_numpy(zero_copy_only=False) <= CACHE_LONGEST)[:room]
            self.known = pa.concat_arrays([self.known, new.take(pa.array(short))])
            taken = np.zeros(len(new), bool)
            taken[short] = True
            self.known_n = np.concatenate([self.known_n, new_n[taken]])
            self.known_ids = np.concatenate([self.known_ids, new_ids[np.repeat(taken, new_n)]])
        return n[which], at[which], ids

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all end to end: many words in a text, a line for each, the rest one by one."""
        n, ids = np.zeros(len(words), np.int64), np.zeros(0, self.dtype)
        lines = ~self.apart(words)
        together = self.encoded_lines(words.filter(pa.array(lines)))
        if together is None:  # pieces that aren't bytes of their text
            lines[:] = False
        else:
            n[lines], ids = together
        if lines.all():
            return n, ids
        coded = []
        rest = [w.decode("utf-8", "surrogatepass") for w in words.filter(pa.array(~lines)).to_pylist()]
        for k in range(0, len(rest), 20_000):
            coded += [e.ids for e in self.tokenizer.encode_batch_fast(rest[k : k + 20_000], add_special_tokens=False)]
        n[~lines] = list(map(len, coded))
        out, of_line = np.empty(n.sum(), self.dtype), np.repeat(lines, n)
        out[of_line] = ids
        out[~of_line] = [i for each in coded for i in each]
        return n, out

    def apart(self, words: pa.Array) -> np.ndarray:
        """Words that a line end beside them may change: white space and special strings."""
        space = pc.utf8_is_space(words.cast(pa.string()))
        return pc.or_(space, pc.is_in(words, value_set=pa.array(self.specials, pa.binary()))).to_numpy(zero_copy_only=False)

    def encoded_lines(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """encoded() of words that are cut as they are at a line end; None unless each line end has an id of its own.

        No word holds white space but a blank before it, so that a line end is always a pretoken by itself.
        """
        text, edges = common.buffer_of_array(words)
        text = np.insert(np.frombuffer(text, np.uint8), edges[1:], LINE_END).tobytes()
        edges = edges + np.arange(len(edges))
        n, ids = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        a = 0
        while a < len(words):
            cuts = [a]
            while cuts[-1] < len(words) and len(cuts) <= LINES_AT_ONCE:
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(edges, edges[cuts[-1]] + LINES_BYTES, "right")) - 1))
            parts = [text[edges[i] : edges[k]].decode("utf-8", "surrogatepass") for i, k in zip(cuts[:-1], cuts[1:], strict=True)]
            got = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            some = np.concatenate(got)
            stop, end = edges[a] + np.cumsum(self.n_bytes[some]), edges[a + 1 : cuts[-1] + 1]
            last = np.searchsorted(stop, end)
            if last[-1] != len(some) - 1 or (stop[last] != end).any() or (self.n_bytes[some[last]] != 1).any():
                return None
            n.append(np.diff(last, prepend=-1) - 1)
            ids.append(np.delete(some, last))
            a = cuts[-1]
        return np.concatenate(n), np.concatenate(ids)


@common.kept
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_chunk(enc: WordEncoder, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each followed by end_id if given, and where each text's ids end."""
    data, offsets = common.buffer_of_array(texts)
    words, index, first = common.words_of(data, offsets, enc.specials)
    size, at, flat = enc.ids(words)
    ids = common.gathered(index, size, at, flat)
    ends = np.r_[0, np.cumsum(size[index])][first[1:]]
    if end_id is not None:
        ids = np.insert(ids, ends, end_id)
        ends = ends + np.arange(1, len(ends) + 1)
    return ids, ends


def write_token_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode and write all documents in ascending id order."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = 1 + common.text_bytes(rows) // PARTITION_BYTES
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in common.chunks(batch, "text", CHUNK_BYTES):
                ids, ends = encode_chunk(enc, piece.column("text"), end_id)
                ef = EliasFano.encode(ends, len(ids))
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                        "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        "n_docs": [ef.n], "n_ids": [len(ids)], "id_bytes": pa.array([enc.dtype.itemsize], pa.int32()),
                        "ids": pa.array([ids.tobytes()], pa.binary()), "ends_low": [ef.low], "ends_high": [ef.high],
                        "ends_samples": [ef.samples],
                    }
                )
                chunk += 1

    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(common.tidy(run), CHUNK).write.option(
        "compression", "zstd"
    ).parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens (with the end id), ids_crc32 (of 32-bit little-endian ids)."""
    chunk_rows = spark.read.schema(CHUNK).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano(row["n_docs"], row["n_ids"], row["ends_low"], row["ends_high"], row["ends_samples"])
                ends = ends.select_many(np.arange(ends.n))
                starts = np.r_[0, ends[:-1]]
                wide = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(np.full(len(ends), row["chunk"], np.int32)),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64()),
                    ],
                    ["part", "chunk", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    docs = chunk_rows.mapInArrow(
        common.tidy(run), "part int, chunk int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sums = chunk_rows.select("part", "chunk", "n_ids")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range partition
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")
    )
    within = W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("chunk_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("n_ids").join(parts, "part")
    return docs.join(starts, ["part", "chunk"]).select(
        "doc_id", (F.col("part_start") + F.col("chunk_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids (array<int>, with the end id) from the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef = EliasFano(row["n_docs"], row["n_ids"], row["ends_low"], row["ends_high"], row["ends_samples"])
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ef.select_many(np.arange(ef.n))].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"])

    return spark.read.schema(CHUNK).parquet(path).mapInArrow(common.tidy(run), "doc_id bigint, ids array<int>")
