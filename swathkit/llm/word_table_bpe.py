"""BPE encoding and decoding through a table of distinct words.

encode_decode() cuts documents into blocks of bounded bytes. Each block lists its distinct pretokens once; the lists
are shuffled by a hash of the word, so that all copies of a word meet in one part of the word table, which encodes
each distinct word once with the tokenizers library. The ids go back to the blocks that listed the word and are joined
to the words' positions; texts come back by joining each id to its piece. What is shuffled: packed texts once, and per
block its distinct words and their ids in a fixed layout, never a row per word of a text. A block sends a row per part;
parts do not grow with blocks up to PART_BYTES x LEAST_PARTS of text, and a row holds one word at least beyond.

Null text is empty: no ids and the text ''. Null and repeated ids keep their rows; an empty
table gives an empty result; extra columns are dropped. Documents of any length are encoded
whole. The texts' words are spread by hash, so a frequent word costs one entry per block; lists of more than about
common.FAN blocks are merged before they meet, so that no task takes an entry of every block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm import common
from swathkit.llm.token_counts import byte_symbols
from swathkit.llm.token_shards import WordEncoder, encoder, id_type

BLOCK_BYTES = 4 << 20  #: text bytes per block
PART_BYTES, LEAST_PARTS = 32 << 20, 64  #: text bytes per part of the word table, and parts at least


@common.kept
def vocabulary(path: str) -> tuple[pa.Array, tuple[bytes, ...]]:
    """The bytes of each id of a byte-level BPE file, and its special strings (both bounded by its vocabulary)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    pieces: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    specials = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
    pieces |= specials
    return pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.binary()), tuple(specials.values())


def decoded(flat: pa.Array, ends: np.ndarray, tokenizer: str) -> pa.Array:
    """Texts of id lists end to end: each id is joined to its piece by its place in the table; invalid UTF-8 becomes U+FFFD."""
    table, _ = vocabulary(tokenizer)
    size = np.diff(np.frombuffer(table.buffers()[1], np.int32)[: len(table) + 1])
    out = []
    at = 0
    while at < len(ends) - 1:  # whole documents, so many that the pieces stay small
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 18), "right")) - 1)
        ids = flat.slice(ends[at], ends[stop] - ends[at])
        cut = np.r_[0, np.cumsum(size[ids.to_numpy()])][ends[at : stop + 1] - ends[at]]
        text = table.take(ids).buffers()[2].to_pybytes() if cut[-1] else b""
        texts = [text[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        out.append(pa.array(texts, pa.string()))
        at = stop
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of rows with id arrays, by an id-to-piece lookup; invalid UTF-8 becomes U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False)
            texts = decoded(batch.column("ids").flatten(), np.r_[0, np.cumsum(size)].astype(np.int64), tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, decoded string"
    )


def words_by_part(data: bytes, offsets: np.ndarray, specials: tuple[bytes, ...], n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a block in order of their part: their bytes, sizes and parts; the word at each position; the
    first position of each document."""
    words, index, first = common.words_of(data, offsets, specials)
    text, edges = common.buffer_of_array(words)
    part = (common.piece_hashes(text, edges) % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    text, _ = common.buffer_of_array(words.take(pa.array(order)))
    return text, np.diff(edges)[order], part[order], place[index], first


def stretches(key: np.ndarray) -> list[tuple[int, int]]:
    """Where each value of a sorted key starts and ends."""
    edges = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)].tolist() if len(key) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))


def listed_words(lists: list[bytes]) -> tuple[list[int], pa.DictionaryArray]:
    """How many words each list has, and all of them end to end."""
    parts = [common.expand(x, np.uint32, np.uint8) for x in lists]
    sizes = np.concatenate([p[0] for p in parts]).astype(np.int64)
    words = common.slices(np.concatenate([p[1] for p in parts]).tobytes(), np.r_[0, np.cumsum(sizes)])
    return [len(p[0]) for p in parts], words.dictionary_encode()


def dealt_ids(many: list[int], index: np.ndarray, n: np.ndarray, at: np.ndarray, flat: np.ndarray) -> list[bytes]:
    """Each list's ids: word w has n[w] of flat from at[w] on; index names the words of all lists end to end."""
    out, done = [], 0
    for m in many:
        own = index[done : done + m]
        done += m
        out.append(common.squeeze(n[own].astype(np.uint32), common.gathered(own, n, at, flat)))
    return out


def encode_words(lists: list[bytes], enc: WordEncoder) -> list[bytes]:
    """The ids of lists of words; each word is encoded once however many lists hold it."""
    many, words = listed_words(lists)
    return dealt_ids(many, words.indices.to_numpy(), *enc.ids(words.dictionary, keep=False))  # no other list has these words


def merge_words(lists: list[bytes]) -> bytes:
    """One list of the distinct words of all, in the order of their bytes."""
    words = listed_words(lists)[1].dictionary
    text, edges = common.buffer_of_array(words.take(pc.array_sort_indices(words)))
    return common.squeeze(np.diff(edges).astype(np.uint32), text)


def spread_ids(lists: list[bytes], ids: bytes, enc: WordEncoder) -> list[bytes]:
    """The ids of each list from those of merge_words()."""
    many, words = listed_words(lists)
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    size, flat = common.expand(ids, np.uint32, enc.dtype)
    n, at = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    n[order], at[order] = size, np.cumsum(size.astype(np.int64)) - size
    return dealt_ids(many, words.indices.to_numpy(), n, at, flat)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every document."""
    total = common.text_bytes(docs, text_col)
    n = common.shards_for(total, PART_BYTES, LEAST_PARTS)
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = common.packed_blocks(docs, BLOCK_BYTES, id_col, text_col)

    def list_words(key: tuple, table: pa.Table) -> pa.Table:
        _, specials = vocabulary(tokenizer)
        docs_of = common.from_streams(table.column("payload").to_pylist())
        text, sizes, part, _, _ = words_by_part(*common.buffer_of_array(docs_of.column("text")), specials, n)
        edges, spans = np.r_[0, np.cumsum(sizes)], stretches(part)
        return pa.table(
            {
                "key": pa.array([part[a] for a, _ in spans], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "body": pa.array([common.squeeze(sizes[a:b].astype(np.uint32), text[edges[a] : edges[b]]) for a, b in spans], pa.binary()),
            }
        )

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        common.drop(encoder)  # nothing is encoded from here on
        pieces, specials = vocabulary(tokenizer)
        kind_of_id = id_type(len(pieces))
        docs_of = common.from_streams(left.column("payload").to_pylist())
        doc_ids = docs_of.column("doc_id")
        buffer = common.buffer_of_array(docs_of.column("text"))
        del docs_of
        _, _, _, index, first = words_by_part(*buffer, specials, n)
        del buffer
        got = [common.expand(x, np.uint32, kind_of_id) for _, x in sorted(zip(right.column("key").to_pylist(), right.column("answer").to_pylist(), strict=True))]
        size = np.concatenate([np.zeros(0, np.int64), *(g[0] for g in got)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *(g[1].astype(np.int32) for g in got)])
        # ids of all words in the order of their positions, and where each document's end
        flat = pa.array(common.gathered(index, size, np.cumsum(size) - size, ids))
        ends = np.r_[0, np.cumsum(size[index])][first]
        del got, index
        return pa.table(
            {"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat), "decoded": decoded(flat, ends, tokenizer)}
        )

    listed = blocks.groupBy("block").applyInArrow(common.tidied(list_words), "key int, block bigint, body binary")
    coded = common.by_tree(
        listed, -(-total // BLOCK_BYTES),
        lambda lists, leaf: encode_words(lists, encoder(tokenizer)), lambda lists, leaf: merge_words(lists),
        lambda lists, ids, leaf: spread_ids(lists, ids, encoder(tokenizer)),
    )
    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        common.tidied(join), f"doc_id {kind}, ids array<int>, decoded string"
    )
