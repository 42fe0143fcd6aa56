"""Shared helpers of the training-data operators.

Everything here works on Arrow batches inside Spark tasks: a batch is cut into
chunks of bounded bytes, and a chunk's texts lie end to end in one UTF-8 buffer
with document offsets, so that numpy can look at all of them at once.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, a temporary folder, of local sessions only."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="swathkit-"))
    root = spark.conf.get("spark.checkpoint.dir")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_KEYS = 1_000_000  #: rows of hashes that are broadcast; more are shuffled


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """keys (rows of a few longs), written; broadcast if there are at most BROADCAST_KEYS."""
    keys = materialize(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose key is in keys (long hashes)."""
    return df.join(broadcast_if_small(keys), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose key is not in keys (long hashes)."""
    return df.join(broadcast_if_small(keys), on, "left_anti")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives free memory back: workers are reused and would keep the most any stage took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidied(run: Callable) -> Callable:
    """A function of a group (or two, with or without the key), after which the worker gives free memory back."""

    @functools.wraps(run)
    def tidy_run(*args):
        try:
            return run(*args)
        finally:
            give_back()

    tidy_run.__signature__ = inspect.signature(run)  # Spark passes the key by the number of parameters
    return tidy_run


IDLE = 32  #: tasks or groups in a row that do not use it, after which a worker drops what it keeps
_kept: dict[tuple, list] = {}


def kept(make: Callable) -> Callable:
    """make, a function of one argument, whose results a worker keeps while its tasks use them: workers outlive a stage."""

    @functools.wraps(make)
    def get(of):
        entry = _kept.get((make.__qualname__, of))
        if entry is None:
            entry = _kept[make.__qualname__, of] = [make(of), 0]
        entry[1] = 0
        return entry[0]

    return get


def drop(get: Callable) -> None:
    """Forget what this worker keeps of a kept() function: a later stage needs the room."""
    for key in [k for k in _kept if k[0] == get.__qualname__]:
        del _kept[key]


def give_back() -> None:
    for key, entry in list(_kept.items()):
        entry[1] += 1
        if entry[1] > IDLE:
            del _kept[key]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], n_keys: int) -> Iterator[np.ndarray]:
    """Sorted batches of longs as arrays that hold whole groups of the first n_keys columns."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1)
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :n_keys] != rows[-1, :n_keys]).any(axis=1))
        whole = last[-1] + 1 if len(last) else 0
        if whole or (held and (held[-1][-1, :n_keys] != rows[0, :n_keys]).any()):
            yield np.concatenate([*held, rows[:whole]])
            held = []
        held.append(rows[whole:])
    if held:
        yield np.concatenate(held)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, nulls as 0."""
    return df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string"))


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column has about max_bytes in each piece; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // max_bytes
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def buffer_of(texts: Iterable[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts end to end in UTF-8 (null: nothing), and where each starts; one offset more than texts."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return b"".join(parts), offsets


@functools.cache
def class_table() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in [*range(0x40000), *range(0xE0000, 0xE1000)]:  # no other plane has letters or numbers
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    # Unicode White_Space
    spaces = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE
    return table


def code_points(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte where each starts."""
    raw = np.frombuffer(data, np.uint8)
    if data.isascii():
        return raw, np.arange(len(raw))
    cps = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    return cps, np.flatnonzero((raw & 0xC0) != 0x80)


def slices(data: bytes | np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary array of data cut at edges (first 0, last len(data)); no copy."""
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]
    )


def pretoken_edges(data: bytes, starts: np.ndarray, specials: tuple[bytes, ...] = ()) -> np.ndarray:
    """Byte edges of byte-level BPE pretokens, last edge len(data).

    Same cuts as the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|\\s+(?!\\S)|\\s+ matched in each
    document on its own; each special string is a pretoken and splits the text around it.
    """
    if not data:
        return np.zeros(1, np.int64)
    cps, at = code_points(data)
    n = len(cps)
    inside: list[tuple[int, int]] = []
    cuts = [starts[starts < len(data)]]
    for special in specials:
        k = data.find(special)
        while k >= 0:
            d = np.searchsorted(starts, k, "right")  # a special string lies in one document
            if k + len(special) <= (starts[d] if d < len(starts) else len(data)):
                inside.append((k, k + len(special)))
                cuts.append(np.array([k, k + len(special)]))
            k = data.find(special, k + len(special))
    cut = np.unique(np.concatenate(cuts))
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, cut[cut < len(data)])] = True
    first[n] = True
    kind = class_table()[cps]
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:n]
    start = run.copy()
    # a run after white space in the same document: the last white space stands alone or, if a blank, joins the run
    j = np.flatnonzero(run & (kind != SPACE) & ~first[:n])
    j = j[kind[j - 1] == SPACE]
    start[j - 1] = True
    start[j[cps[j - 1] == 0x20]] = False
    # contractions: an apostrophe that starts a pretoken, directly followed by one of the endings
    q = np.flatnonzero((cps[:-1] == 0x27) & start[:-1] & run[1:] & (kind[1:] == LETTER) & ~first[1:n]) if n > 1 else np.zeros(0, int)
    if len(q):
        padded = np.r_[cps.astype(np.uint32), 0, 0, 0]
        one, two = padded[q + 1], padded[q + 2]
        two_in = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where((size == 0) & pair & two_in, 2, size)
        q, size = q[size > 0], size[size > 0]
        start[q + 1] = False
        rest = q + 1 + size
        ok = rest < n
        rest = rest[ok]
        rest = rest[(kind[rest] == LETTER) & ~first[rest]]
        start[rest] = True
    for a, b in inside:
        i, k = np.searchsorted(at, (a, b))
        start[i] = True
        start[i + 1 : k] = False
    return np.r_[at[start], len(data)]


EDGES_BYTES = 512 << 10  #: text bytes whose pretokens are cut at once; a longer document is cut as a whole


def words_of(data: bytes, starts: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pretokens, the index of each pretoken in them, and the first pretoken of each document (and the end)."""
    if not data:
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    found, a = [np.zeros(0, np.int64)], 0
    while a < len(data):  # whole documents, so many that what is made of each byte stays small
        i = int(np.searchsorted(starts, a))
        k = max(int(np.searchsorted(starts, a, "right")), int(np.searchsorted(starts, a + EDGES_BYTES, "right")) - 1)
        b = int(starts[k]) if k < len(starts) else len(data)
        found.append(pretoken_edges(data[a:b], starts[i:k] - a, specials)[:-1] + a)
        a = b
    edges = np.concatenate([*found, [len(data)]])
    coded = slices(data, edges).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(edges[:-1], starts)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def buffer_of_array(texts: pa.Array | pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """buffer_of() for an Arrow array of strings."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(raw):
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if raw.buffers()[2] else b""
    return data, offsets - offsets[0]


GATHERED = 1 << 15  #: stretches that gathered() takes at once


def gathered(index: np.ndarray, n: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches that index names, end to end: stretch w is n[w] of flat from at[w] on."""
    out = np.empty(sum(int(n[index[a : a + GATHERED]].sum()) for a in range(0, len(index), GATHERED)), flat.dtype)
    done = 0
    for a in range(0, len(index), GATHERED):
        own = index[a : a + GATHERED]
        size = n[own]
        ends = np.cumsum(size)
        out[done : done + ends[-1]] = flat[np.repeat(at[own] - (ends - size), size) + np.arange(ends[-1])]
        done += ends[-1]
    return out


# Odd 64-bit multipliers of the hashes.
STEP, MIX = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))


_powers: dict[int, np.ndarray] = {}
POWERS_KEPT = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; up to POWERS_KEPT of them stay in memory."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= POWERS_KEPT:
            _powers[base] = known
    return known[:n]


def stretch_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of data: differences of running sums, moved back to the start of the buffer."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASHES[np.frombuffer(data, np.uint8)] * powers(STEP, len(data)), out=total[1:])
    return mixed((total[end] - total[begin]) * powers(pow(STEP, -1, 1 << 64), len(data))[begin])


HASHED_BYTES = 256 << 10  #: bytes that piece_hashes() takes at once


def piece_hashes(data: bytes, edges: np.ndarray) -> np.ndarray:
    """stretch_hashes() of the pieces between edges, of a few at a time; a longer piece is taken as a whole."""
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + HASHED_BYTES, "right")) - 1)
        own = edges[a : b + 1] - edges[a]
        out.append(stretch_hashes(data[edges[a] : edges[b]], own[:-1], own[1:]))
        a = b
    return np.concatenate(out)


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays end to end in a fixed layout: their sizes, then zstd of their bytes."""
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    sizes = np.array([len(parts), *map(len, parts)], "<u4")
    return sizes.tobytes() + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def expand(payload: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of squeeze(), each as the kind given."""
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    sizes = np.frombuffer(payload, "<u4", n, 4).tolist()
    data = pa.decompress(payload[4 + 4 * n :], decompressed_size=sum(sizes), codec="zstd")
    at, out = 0, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def shards_for(total_bytes: int, shard_bytes: int, least: int) -> int:
    """How many shards a table is dealt to: `least`, and more only beyond least x shard_bytes.

    So what each block sends grows with the input up to there; beyond, rows are at most one per entry sent.
    """
    return max(least, -(-total_bytes // shard_bytes))


def to_stream(table: pa.Table | pa.RecordBatch) -> bytes:
    """An Arrow stream with zstd buffers."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def from_streams(payloads: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads])


def packed_blocks(
    docs: DataFrame, block_bytes: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """block, payload: a row per stretch of about block_bytes of text; a longer text is a block of its own.

    A payload is an Arrow stream (doc_id, text, struct of the carried columns if any) with zstd buffers. Blocks are
    numbered by the partition of docs and their place in it, so that equal rows spread like any others; docs must come
    in the same order if a task is done again, as files do.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if carry:
        columns.append(F.struct(*carry).alias("carried"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            payload = to_stream(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())], ["block", "payload"])

        for batch in batches:
            for part in chunks(batch, "text", max(block_bytes // 8, 1)):
                n = part.column("text").nbytes
                if held and size + n > block_bytes:
                    yield packed()
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += n
        if held:
            yield packed()

    return docs.select(*columns).mapInArrow(tidy(pack), "block bigint, payload binary")


FAN = 1024  #: rows of a key that are taken together


def by_tree(rows: DataFrame, sources: int, solve: Callable, merge: Callable, spread: Callable, leaf: bool = True) -> DataFrame:
    """key, block, answer of rows (key int, block bigint, body binary), where a key's answers depend on all its bodies.

    sources is about how many blocks there are. Up to FAN of them, a key is solved at once: solve(bodies, leaf) gives an
    answer for each body. Beyond, about FAN bodies of a key are merged to one, merge(bodies, leaf), whatever their order,
    merged ones are solved in the same way, and spread(bodies, answer, leaf) makes the answers of the bodies from that
    of the merged one. So a task takes about FAN bodies of a key, however many blocks hold it.
    """
    kind = "key int, block bigint, answer binary"

    def solved(table: pa.Table) -> pa.Table:
        out = solve(table.column("body").to_pylist(), leaf)
        return pa.table({"key": table.column("key"), "block": table.column("block"), "answer": pa.array(out, pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        body = merge(table.column("body").to_pylist(), leaf)
        return pa.table({"key": table.column("key")[:1], "block": table.column("above")[:1], "body": pa.array([body], pa.binary())})

    def given(left: pa.Table, right: pa.Table) -> pa.Table:
        out = spread(left.column("body").to_pylist(), right.column("answer")[0].as_py(), leaf)
        return pa.table({"key": left.column("key"), "block": left.column("block"), "answer": pa.array(out, pa.binary())})

    if sources <= FAN:
        return rows.groupBy("key").applyInArrow(tidied(solved), kind)
    groups = -(-sources // FAN)
    dealt = rows.withColumn("above", F.pmod(F.xxhash64("block"), F.lit(groups)))
    fewer = dealt.groupBy("key", "above").applyInArrow(tidied(merged), "key int, block bigint, body binary")
    answers = by_tree(fewer, groups, solve, merge, spread, False).withColumnRenamed("block", "above")
    return dealt.groupBy("key", "above").cogroup(answers.groupBy("key", "above")).applyInArrow(tidied(given), kind)
