"""Suffix arrays of many short snippets, in numpy.

window_order() sorts the windows of `depth` bytes of a shard by Larsson-Sadakane refinement: order by the
first 8 bytes, then double the compared length through the ranks reached so far, touching only groups that are
still tied. common_prefixes() is Kasai's walk along the text, one lane per snippet. merge_owners() joins the
sorted windows of several shards by binary search.

Texts are bytes here: null and empty ones come as no snippet, snippets shorter than a window have none, and equal windows
stay in the order of their places. No snippets give empty arrays.
"""

from __future__ import annotations

import numpy as np


def group_heads(changed: np.ndarray) -> np.ndarray:
    """For each place the place where its group starts; changed says where a group starts."""
    places = np.where(changed, np.arange(len(changed), dtype=np.int32), np.int32(0))
    return np.maximum.accumulate(places)


def window_order(data: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all windows of depth (at least 8) bytes inside the snippets, in byte order of the windows.

    data holds the snippets end to end; begin and size are theirs.
    """
    n = len(data)
    room = np.repeat((begin + size).astype(np.int32), size) - np.arange(n, dtype=np.int32)  # bytes to the snippet's end
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.flatnonzero(room >= 8).astype(np.int32)
    order = order[np.argsort(key[order])]
    changed = np.ones(len(order), bool)
    np.not_equal(key[order[1:]], key[order[:-1]], out=changed[1:])
    del key, padded
    rank = np.zeros(n, np.int32)
    rank[order] = group_heads(changed)
    have = 8
    while have < depth:
        step = min(have, depth - have)
        have += step
        order = order[room[order] >= have]  # what is too short for this depth is never compared again
        if not len(order):
            break
        own = rank[order]
        tied = np.zeros(len(order), bool)
        tied[1:] = own[1:] == own[:-1]
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        part = order[places]
        joint = (rank[part].astype(np.uint64) << np.uint64(32)) | rank[part + step].astype(np.uint64)
        by = np.argsort(joint)
        order[places] = part[by]
        changed = np.ones(len(order), bool)
        changed[1:] = rank[order[1:]] != rank[order[:-1]]
        joint = joint[by]
        again = np.ones(len(places), bool)
        again[1:] = joint[1:] != joint[:-1]
        changed[places] = again
        rank[order] = group_heads(changed)
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Bytes (depth at most) that each window shares with the one before it in order; 0 for the first.

    Kasai's walk: from one position of a snippet to the next the shared length falls by one at most, so it is
    carried along, where the window before has a next one too and is not equal (equal windows stand in any
    order); all snippets walk side by side.
    """
    n = len(data)
    room = np.repeat((begin + size).astype(np.int32), size) - np.arange(n, dtype=np.int32)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    windows = size - depth + 1
    carried = np.zeros(len(begin), np.int64)
    for k in range(int(windows.max(initial=0))):
        lanes = np.flatnonzero(windows > k)
        at = begin[lanes] + k
        other = before[at]
        lanes, at, other = lanes[other >= 0], at[other >= 0], other[other >= 0]
        h = np.maximum(carried[lanes] - 1, 0)
        live = np.flatnonzero(h < depth)
        while len(live):
            same = data[at[live] + h[live]] == data[other[live] + h[live]]
            live = live[same]
            h[live] += 1
            live = live[h[live] < depth]
        out[at] = h
        carried[:] = 0
        carried[lanes] = np.where((room[other] > depth) & (h < depth), h, 0)
    return out[order]


def owners(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each window in order, smallest doc of each group) of the windows of one shard."""
    order = window_order(data, begin, size, depth)
    if not len(order):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = common_prefixes(data, order, begin, size, depth)
    heads = np.flatnonzero(np.r_[True, shared[1:] < depth])
    group = np.cumsum(np.r_[True, shared[1:] < depth]) - 1
    of = np.repeat(doc, size)[order]
    return order, group, np.minimum.reduceat(of, heads)


def window_owners(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, depth: int, shard_bytes: int) -> np.ndarray:
    """For each text position that starts a window, the smallest doc of all equal windows.

    Snippets go to shards of about shard_bytes, each with a suffix array of its own; equal windows of different
    shards are found by binary search of one shard's sorted distinct windows in the other's.
    """
    out = np.zeros(len(data), np.int64)
    if not len(begin):
        return out
    shard = begin // shard_bytes
    edges = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(begin)]
    made = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lo, hi = begin[a], begin[b - 1] + size[b - 1]
        order, group, owner = owners(data[lo:hi], begin[a:b] - lo, size[a:b], doc[a:b], depth)
        made.append([order + lo, group, owner])
    if len(made) > 1:
        merge_owners(data, made, depth)
    for order, group, owner in made:
        out[order] = owner[group]
    return out


def merge_owners(data: np.ndarray, made: list[list[np.ndarray]], depth: int) -> None:
    """Lower the owners of windows that several shards hold; made is a list of [order, group, owner] and is changed."""
    padded = np.lib.stride_tricks.sliding_window_view(data, depth)

    def distinct(order: np.ndarray, group: np.ndarray) -> np.ndarray:
        heads = order[np.flatnonzero(np.r_[True, np.diff(group) > 0])] if len(order) else order
        return np.ascontiguousarray(padded[heads]).view(f"S{depth}").ravel()

    words = [distinct(order, group) for order, group, _ in made]
    for i in range(len(made)):
        for j in range(i + 1, len(made)):
            if not len(words[i]) or not len(words[j]):
                continue
            at = np.minimum(np.searchsorted(words[i], words[j]), len(words[i]) - 1)
            hit = np.flatnonzero(words[i][at] == words[j])
            low = np.minimum(made[i][2][at[hit]], made[j][2][hit])
            made[i][2][at[hit]] = low
            made[j][2][hit] = low
