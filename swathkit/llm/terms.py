"""Terms of texts that lie end to end in one UTF-8 buffer: maximal runs of member bytes, found for all texts at once.

The classes are classes of bytes: every byte of a character beyond ASCII is at least 0x80, so a class that takes all of
them needs no decoding. A run never crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from swathkit.llm import common


def all_but(*ranges: tuple[int, int]) -> np.ndarray:
    """The bytes outside the ranges (inclusive)."""
    member = np.ones(256, bool)
    for a, b in ranges:
        member[a : b + 1] = False
    return member


LETTERS = all_but((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  #: letters of ASCII and all characters beyond it
LETTERS_DIGITS = all_but((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
NOT_SPACE = all_but((0x20, 0x20), (0x09, 0x0D))

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))  #: A-Z only


def runs(data: bytes, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of each maximal run of member bytes; offsets: where documents start, and the end."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[np.frombuffer(data, np.uint8)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] = inside[starts]
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def pieces(data: bytes, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches [begin, end) of data, in order and without overlap, as a binary array."""
    if not len(begin):
        return pa.array([], pa.binary())
    edges = np.empty(2 * len(begin) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = begin, end, len(data)
    return common.slices(data, edges).take(pa.array(np.arange(0, 2 * len(begin), 2)))


def lowered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Stretches of batches with about max_bytes in the column text, the texts end to end with A-Z lowered, their offsets."""
    for batch in batches:
        for part in common.chunks(batch, "text", max_bytes):
            data, offsets = common.buffer_of_array(part.column("text"))
            yield part, data.translate(LOWER), offsets


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs."""
    return np.unique(keys, return_counts=True)
