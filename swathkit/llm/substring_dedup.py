"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller id goes.

1. Documents are dealt to blocks of bounded bytes (packed, one shuffle that all later steps reuse). Every window
   of `length` bytes is named by the smallest hash of its GRAM-byte grams, so equal windows have equal names and
   neighbours mostly share one; windows of one name side by side form a run.
2. Each block sends 32-bit prints of its names to shards; the shards answer which prints came more than once,
   and which from more than HOT_BLOCKS blocks. A window whose name came once can be repeated nowhere.
3. The distinct runs that remain go, with the smallest id that holds them, to shards by their name (runs of hot
   names as finer runs, by the smallest hash of longer grams, so a passage that a third of all documents hold spreads
   out). A shard builds suffix arrays (Larsson-Sadakane), Kasai common prefixes give groups of equal windows,
   and arrays of several shards in a task are merged by binary search. The answer is a bit per window: whether
   an equal window starts in a document with a smaller id.
4. Blocks join the bits to their documents and cut.

Hashes only choose what is compared; equality is decided on bytes. No step sees more than a block, or a shard's
share of distinct runs; where a key has rows of more than about common.FAN blocks, these are merged before they meet.

Null text is empty. Rows without an id count as later than any id; rows of one id do not remove each other's
bytes. Matches never cross documents. Texts shorter than `length` bytes keep all. An empty table gives an empty
result; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathkit.llm import common
from swathkit.llm.suffix_array import window_owners

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 4 << 20  #: text bytes per block
HOT_BLOCKS = 64
MAX_RUN = 64  #: windows in a run
FINER = 10  #: bytes that a gram of a finer run is shorter than a window
SHARD_TEXT, LEAST_SHARDS = 16 << 20, 128  #: text bytes per shard, and shards at least
SHARD_BYTES = 1 << 20  #: snippet bytes per suffix array
PART_BYTES = 1 << 17  #: text bytes hashed, and bytes or windows looked at, at once
NAME_PARTS = 8  #: parts by name in which runs of a block are told apart
LAST = np.iinfo(np.int64).max


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every width bytes: differences of running sums, moved back to the start."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(common.BYTE_HASHES[raw] * common.powers(common.STEP, len(raw)), out=total[1:])
    h = total[width:] - total[:-width]
    h *= common.powers(pow(common.STEP, -1, 1 << 64), len(raw))[: len(h)]
    return common.mixed(h)


def runs_of(data: bytes, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, name, document) of every run in documents that lie end to end."""
    out = []
    docs = len(offsets) - 1
    part = (offsets[:-1] // PART_BYTES) if docs else np.zeros(0, np.int64)
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, docs] if docs else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lo, hi = offsets[a], offsets[b]
        if hi - lo < length:
            continue
        raw = np.frombuffer(data, np.uint8, hi - lo, lo)
        names = common.window_min(gram_hashes(raw, GRAM), length - GRAM + 1)
        end = np.repeat(offsets[a + 1 : b + 1] - lo, np.diff(offsets[a : b + 1]))
        at = np.arange(len(names))
        ok = np.flatnonzero(at + length <= end[: len(names)])
        if not len(ok):
            continue
        named = names[ok]
        new = np.r_[True, (named[1:] != named[:-1]) | (ok[1:] != ok[:-1] + 1)]
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(ok)])
        pieces = -(-n // MAX_RUN)  # long runs (periodic text) in pieces
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(ok[first], pieces) + k * MAX_RUN
        many = np.minimum(np.repeat(n, pieces) - k * MAX_RUN, MAX_RUN)
        doc = np.searchsorted(offsets, begin + lo, "right") - 1
        out.append((begin + lo, many, np.repeat(named[first], pieces), doc))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spread(count: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each entry, end to end."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)


def parts_of(edges: np.ndarray) -> list[tuple[int, int]]:
    """First and last but one of entries of about PART_BYTES together; edges are where each starts and the last ends."""
    part = edges[:-1] // PART_BYTES
    cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)].tolist() if len(part) else [0]
    return list(zip(cut[:-1], cut[1:], strict=True))


def gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the stretches end to end, and their edges."""
    edges = np.r_[0, np.cumsum(size)]
    out = np.empty(edges[-1], raw.dtype)
    for a, b in parts_of(edges):
        out[edges[a] : edges[b]] = raw[np.repeat(begin[a:b] - edges[a:b], size[a:b]) + np.arange(edges[a], edges[b])]
    return out, edges


def finer_runs(raw: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, name, number of the run) of stretches of the runs whose windows share a finer name.

    That is the smallest hash of their grams of nearly a window's length: some windows stay together, so less is sent than
    for each of them alone, and neighbours go to different shards.
    """
    width = length - min(FINER, (length - GRAM) // 2)
    out = []
    part = np.cumsum(n + length - 1) // PART_BYTES
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(n)] if len(n) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = n[a:b]
        text, cut = gather(raw, begin[a:b], own + length - 1)
        names = common.window_min(gram_hashes(text, width), length - width + 1)
        named, run = names[np.repeat(cut[:-1], own) + spread(own)], np.repeat(np.arange(a, b), own)
        first = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (run[1:] != run[:-1])])
        out.append((begin[run[first]] + spread(own)[first], np.diff(np.r_[first, len(named)]), named[first], run[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Block:
    """Documents of a block in (id, text) order and their runs."""

    def __init__(self, payloads: list[bytes], length: int, n_shards: int):
        docs = common.from_streams(payloads)
        ids = docs.column("doc_id").combine_chunks().cast(pa.int64())
        keyed = docs.append_column("place", ids.fill_null(LAST)).sort_by([("place", "ascending"), ("text", "ascending")])
        self.ids = keyed.column("doc_id")
        self.carried = keyed.column("carried") if "carried" in keyed.column_names else None
        self.place = keyed.column("place").to_numpy()
        self.data, self.offsets = common.buffer_of_array(keyed.column("text"))
        self.raw = np.frombuffer(self.data, np.uint8)
        self.length, self.n_shards = length, n_shards
        self.begin, self.n, name, self.doc = runs_of(self.data, self.offsets, length)
        self.shard = ((name >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)
        joint = (self.shard.astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
        self.prints, self.print_of, self.times = np.unique(joint, return_inverse=True, return_counts=True)

    def candidates(self, codes: np.ndarray) -> None:
        """Distinct runs that may be repeated, and the units they are sent as.

        codes has, for each print, 0 (came once), 1 or 2 (hot). Units are distinct runs or, of hot names, distinct
        finer runs, in order of their shard. A distinct run is a piece or, if hot, several, from piece_at on; a piece has
        its windows, the bit that answers the first of them, and the smallest id of its unit in this block.
        """
        code = codes[self.print_of]
        self.kept = np.flatnonzero((code > 0) | (self.times[self.print_of] > 1))
        self.run_of, known = np.zeros(len(self.kept), np.int64), 0
        part = self.print_of[self.kept] % NAME_PARTS  # equal runs have one name
        for k in range(NAME_PARTS):
            own = np.flatnonzero(part == k)
            if len(own):
                text, edges = gather(self.raw, self.begin[self.kept[own]], self.n[self.kept[own]] + self.length - 1)
                coded = common.slices(text, edges).dictionary_encode()
                self.run_of[own] = coded.indices.to_numpy() + known
                known += len(coded.dictionary)
                del text, coded
        _, first = np.unique(self.run_of, return_index=True)  # the first of equal runs has the smallest id
        occurrence = self.kept[first]
        run_n = self.n[occurrence]
        begin, hot = self.begin[occurrence], code[occurrence] == 2
        least = self.place[self.doc[occurrence]]
        whole = np.flatnonzero(~hot)
        cut_begin, cut_n, cut_name, owner = finer_runs(self.raw, begin[hot], run_n[hot], self.length)
        many = np.ones(len(run_n), np.int64)  # pieces of each run
        many[hot] = np.bincount(owner, minlength=int(hot.sum()))
        owner = least[hot][owner]
        if len(cut_begin):
            text, edges = gather(self.raw, cut_begin, cut_n + self.length - 1)
            cut_of = common.slices(text, edges).dictionary_encode().indices.to_numpy()
            _, at = np.unique(cut_of, return_index=True)
            low = np.full(len(at), LAST)
            np.minimum.at(low, cut_of, owner)
            dealt = ((cut_name[at] >> np.uint64(32)) % np.uint64(self.n_shards)).astype(np.int64)
        else:
            cut_of, at, low, dealt = (np.zeros(0, np.int64) for _ in range(4))
        unit_begin = np.r_[begin[whole], cut_begin[at]].astype(np.int64)
        unit_n = np.r_[run_n[whole], cut_n[at]].astype(np.int64)
        unit_least = np.r_[least[whole], low].astype(np.int64)
        unit_shard = np.r_[self.shard[occurrence][whole], dealt].astype(np.int64)
        order = np.argsort(unit_shard, kind="stable")
        bit = np.empty(len(order), np.int64)
        bit[order] = np.cumsum(unit_n[order]) - unit_n[order]  # the first bit of each unit
        self.unit_begin, self.unit_n = unit_begin[order], unit_n[order]
        self.unit_least, self.unit_shard = unit_least[order], unit_shard[order]
        self.piece_at = np.r_[0, np.cumsum(many)]
        unit = np.empty(self.piece_at[-1], np.int64)
        unit[self.piece_at[:-1][whole]] = np.arange(len(whole))
        unit[np.repeat(self.piece_at[:-1][hot], many[hot]) + spread(many[hot])] = len(whole) + cut_of
        self.piece_n, self.piece_bit, self.piece_least = unit_n[unit], bit[unit], unit_least[unit]

    def removed(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal removed stretches."""
        n = self.n[self.kept]
        change = np.zeros(len(self.data) + 1, np.int32)
        for a, b in parts_of(np.r_[0, np.cumsum(n)]):
            kept, run = self.kept[a:b], self.run_of[a:b]
            many = self.piece_at[run + 1] - self.piece_at[run]
            piece = np.repeat(self.piece_at[run], many) + spread(many)
            windows = self.piece_n[piece]
            later = np.repeat(self.place[self.doc[kept]], many) > self.piece_least[piece]
            at = np.repeat(self.begin[kept], n[a:b]) + spread(n[a:b])
            gone = at[bits[np.repeat(self.piece_bit[piece], windows) + spread(windows)] | np.repeat(later, windows)]
            change[gone] += 1  # each window once
            change[gone + self.length] -= 1
        covered = np.r_[False, np.cumsum(change[:-1], out=change[:-1]) > 0, False]
        edge = np.flatnonzero(covered[1:] != covered[:-1])
        start, end = edge[::2], edge[1::2]
        # stretches end with their document
        cut = np.searchsorted(self.offsets, start, "right")
        more = [(s, e, c) for s, e, c in zip(start.tolist(), end.tolist(), cut.tolist(), strict=True) if e > self.offsets[c]]
        if more:
            plain = end <= self.offsets[cut]
            extra = []
            for s, e, _ in more:
                inner = self.offsets[(self.offsets > s) & (self.offsets < e)].tolist()
                extra += list(zip([s, *inner], [*inner, e], strict=True))
            extra = [(s, e) for s, e in extra if e > s]
            start = np.r_[start[plain], [s for s, _ in extra]].astype(np.int64)
            end = np.r_[end[plain], [e for _, e in extra]].astype(np.int64)
            order = np.argsort(start)
            start, end = start[order], end[order]
        return start, end


def to_whole_characters(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches without the parts of characters at their edges."""
    inner = np.r_[(raw & 0xC0) == 0x80, False]
    for _ in range(3):
        start = start + inner[start]
        end = end - inner[end]
    return start[start < end], end[start < end]


def send_prints(key: tuple, table: pa.Table, length: int, n_shards: int) -> pa.Table:
    block = Block(table.column("payload").to_pylist(), length, n_shards)
    shard = (block.prints >> np.uint64(32)).astype(np.int64)
    heads, edges = cut_by(shard)
    low = block.prints.astype(np.uint32)
    return pa.table(
        {
            "key": pa.array(heads, pa.int32()),
            "block": pa.array([key[0].as_py()] * len(heads), pa.int64()),
            "body": pa.array([low[a:b].tobytes() for a, b in edges], pa.binary()),
        }
    )


def cut_by(key: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """Values of a sorted key and the stretch of each."""
    if not len(key):
        return [], []
    at = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
    return key[at[:-1]].tolist(), list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def met_prints(bodies: list[bytes], leaf: bool) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The lists' sizes, the distinct prints, the print at each place of all lists, and how many blocks hold each."""
    if leaf:
        lists = [np.frombuffer(x, np.uint32) for x in bodies]
        times = [np.ones(len(x), np.int64) for x in lists]
    else:
        lists, times = zip(*(common.expand(x, np.uint32, np.int64) for x in bodies), strict=True)
    low, back = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.zeros(len(low), np.int64)
    np.add.at(total, back, np.concatenate(times))
    return [len(x) for x in lists], low, back, total


def dealt(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    edges = np.cumsum([0, *sizes])
    return [common.squeeze(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def count_prints(bodies: list[bytes], leaf: bool, hot_blocks: int) -> list[bytes]:
    """For each print of each list 0 (no other list holds it), 1, or 2 (over hot_blocks do)."""
    sizes, _, back, total = met_prints(bodies, leaf)
    return dealt(((total > 1).astype(np.uint8) + (total > hot_blocks))[back], sizes)


def merge_prints(bodies: list[bytes], leaf: bool) -> bytes:
    _, low, _, total = met_prints(bodies, leaf)
    return common.squeeze(low, total)


def spread_prints(bodies: list[bytes], answer: bytes, leaf: bool) -> list[bytes]:
    sizes, _, back, _ = met_prints(bodies, leaf)
    return dealt(common.expand(answer, np.uint8)[0][back], sizes)


def answers(table: pa.Table, kind: int, dtype: type) -> np.ndarray:
    """The answers of one kind in order of their shards."""
    rows = table.filter(pc.equal(table.column("kind"), kind)).select(["shard", "answer"]).to_pylist()
    parts = [common.expand(r["answer"], dtype)[0] for r in sorted(rows, key=lambda r: r["shard"])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def send_runs(key: tuple, left: pa.Table, right: pa.Table, length: int, n_shards: int) -> pa.Table:
    block = Block(left.column("payload").to_pylist(), length, n_shards)
    block.candidates(answers(right, 0, np.uint8))
    heads, edges = cut_by(block.unit_shard)
    payloads = []
    for a, b in edges:
        text, cut = gather(block.raw, block.unit_begin[a:b], block.unit_n[a:b] + length - 1)
        payloads.append(common.squeeze(np.diff(cut).astype(np.uint32), block.unit_least[a:b], text))
    return pa.table(
        {
            "key": pa.array(heads, pa.int32()),
            "block": pa.array([key[0].as_py()] * len(heads), pa.int64()),
            "body": pa.array(payloads, pa.binary()),
        }
    )


def met_runs(bodies: list[bytes]) -> tuple[list[int], np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The lists' sizes, the smallest id of each unit of all lists, the distinct units, which of them each unit is, and
    the smallest id of each distinct one."""
    parts = [common.expand(x, np.uint32, np.int64, np.uint8) for x in bodies]
    sizes = np.concatenate([p[0] for p in parts]).astype(np.int64)
    least = np.concatenate([p[1] for p in parts])
    many, text = [len(p[0]) for p in parts], np.concatenate([p[2] for p in parts])
    del parts
    coded = common.slices(text, np.r_[0, np.cumsum(sizes)]).dictionary_encode()
    of = coded.indices.to_numpy()
    low = np.full(len(coded.dictionary), LAST)
    np.minimum.at(low, of, least)
    return many, least, coded.dictionary, of, low


def dealt_windows(bits: np.ndarray, n: np.ndarray, many: list[int]) -> list[bytes]:
    """The bits of each list: n windows of each unit, many units of each list."""
    return dealt(bits, np.diff(np.cumsum(np.r_[0, n])[np.cumsum([0, *many])]).tolist())


def judge_runs(bodies: list[bytes], length: int) -> list[bytes]:
    """For each window of each unit whether a smaller id than the unit's holds it."""
    many, least, units, of, low = met_runs(bodies)
    data, edges = common.buffer_of_array(units)
    del units
    size = np.diff(edges)
    owner = window_owners(np.frombuffer(data, np.uint8), edges[:-1], size, low, length, SHARD_BYTES)
    n = size[of] - length + 1
    total = np.r_[0, np.cumsum(n)]
    lower = np.empty(total[-1], bool)
    for a, b in parts_of(total):
        lower[total[a] : total[b]] = owner[np.repeat(edges[:-1][of[a:b]], n[a:b]) + spread(n[a:b])] < np.repeat(least[a:b], n[a:b])
    return dealt_windows(lower, n, many)


def merge_runs(bodies: list[bytes]) -> bytes:
    """The distinct units in the order of their bytes, each with its smallest id."""
    _, _, units, _, low = met_runs(bodies)
    order = pc.array_sort_indices(units)
    text, edges = common.buffer_of_array(units.take(order))
    return common.squeeze(np.diff(edges).astype(np.uint32), low[order.to_numpy()], text)


def spread_runs(bodies: list[bytes], answer: bytes, length: int) -> list[bytes]:
    """The bits of each list from those of merge_runs(): where a list's smallest id is not that of the merged unit, the
    unit stands whole in a document of a smaller id."""
    many, least, units, of, low = met_runs(bodies)
    order = pc.array_sort_indices(units).to_numpy()
    size = np.diff(common.buffer_of_array(units)[1]) - length + 1
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(size[order]) - size[order]
    n = size[of]
    bits = common.expand(answer, np.bool_)[0][np.repeat(at[of], n) + spread(n)]
    return dealt_windows(bits | np.repeat(least > low[of], n), n, many)


def cut_documents(left: pa.Table, right: pa.Table, length: int, n_shards: int, whole_characters: bool) -> pa.Table:
    block = Block(left.column("payload").to_pylist(), length, n_shards)
    block.candidates(answers(right, 0, np.uint8))
    start, end = block.removed(answers(right, 1, np.bool_))
    if whole_characters:
        start, end = to_whole_characters(block.raw, start, end)
    owner = np.searchsorted(block.offsets, start, "right") - 1
    first = np.searchsorted(owner, np.arange(len(block.offsets)))
    kept, spans = [], []
    for k in range(len(block.offsets) - 1):
        lo, hi = int(block.offsets[k]), int(block.offsets[k + 1])
        own = list(zip(start[first[k] : first[k + 1]].tolist(), end[first[k] : first[k + 1]].tolist(), strict=True))
        spans.append([{"start": a - lo, "end": b - lo} for a, b in own])
        at, pieces = lo, []
        for a, b in own:
            pieces.append(block.data[at:a])
            at = b
        kept.append(b"".join([*pieces, block.data[at:hi]]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = {
        "doc_id": block.ids.cast(pa.int64()),
        "n_bytes": pa.array(np.diff(block.offsets)),
        "spans": pa.array(spans, span),
        "kept": pa.array(kept, pa.binary()),
    }
    return pa.table(out | ({"carried": block.carried} if block.carried is not None else {}))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None, hot_blocks: int = HOT_BLOCKS,
    id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole_characters: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, spans (removed stretches of bytes: start, end), kept (the bytes that stay), carried.

    carry names columns that come back in a struct `carried`. With whole_characters only characters that are
    covered whole are removed, so that what stays is valid UTF-8.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    same = {id_col: F.col(id_col).cast("bigint")}
    rows = docs.withColumns(same)
    total = common.text_bytes(rows, text_col)
    n, sources = common.shards_for(total, SHARD_TEXT, LEAST_SHARDS), -(-total // (block_bytes or BLOCK_BYTES))
    blocks = common.packed_blocks(rows, block_bytes or BLOCK_BYTES, id_col, text_col, carry)
    kind = T.StructType.fromDDL("doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    if carry:
        kind = kind.add("carried", rows.select(F.struct(*carry).alias("c")).schema["c"].dataType)
    named = lambda answered, kind: answered.select("block", F.lit(kind).alias("kind"), F.col("key").alias("shard"), "answer")
    prints = blocks.groupBy("block").applyInArrow(
        common.tidied(lambda key, table: send_prints(key, table, length, n)), "key int, block bigint, body binary"
    )
    codes = named(
        common.by_tree(prints, sources, lambda x, leaf: count_prints(x, leaf, hot_blocks), merge_prints, spread_prints), 0
    )
    units = blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(
        common.tidied(lambda key, left, right: send_runs(key, left, right, length, n)), "key int, block bigint, body binary"
    )
    bits = named(
        common.by_tree(
            units, sources, lambda x, leaf: judge_runs(x, length), lambda x, leaf: merge_runs(x),
            lambda x, answer, leaf: spread_runs(x, answer, length),
        ), 1,
    )
    return blocks.groupBy("block").cogroup(codes.union(bits).groupBy("block")).applyInArrow(
        common.tidied(lambda left, right: cut_documents(left, right, length, n, whole_characters)), kind
    )
