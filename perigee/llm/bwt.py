"""Merging Burrows-Wheeler transforms of shards by interleave refinement.

Each shard (a list of texts) has the transform of its own sorted suffixes. A merge starts from the shards' rows
one shard after another and refines: a round takes the rows in the present order and deals them out by the
symbol before them, stably. After k rounds rows are in the order of their first k symbols, and no suffix of
the whole was sorted again. The round in which two neighbouring rows part is their common prefix's length
plus one; runs of rows that haven't parted after k rounds are the intervals of substrings of k bytes that
repeat.

Rounds go with the longest common prefix (or the length asked for), each over all suffixes. That is why the
query over whole tables runs on anchors (substrings.py); the README has the figures.

Defined results: no texts give an empty transform; empty texts are their end alone; a text's end sorts below
all bytes and by the text's place among all shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """Rows in suffix order: the symbol before each (0 is an end, bytes are one higher), and for rows that
    are reached by an end, which text begins there."""

    symbol: np.ndarray
    text: np.ndarray  # of the row's suffix
    start: np.ndarray  # where it begins


def of_shard(texts: list[bytes], first: int = 0) -> Transform:
    """The transform of one shard by sorting its suffixes; `first` is the number of its first text."""
    rows = [(t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t) + 1)]
    rows.sort(key=lambda r: (r[0], r[1]))
    symbol = [texts[n][i - 1] + 1 if i else 0 for _, n, i in rows]
    return Transform(np.array(symbol, np.int16), np.array([n + first for _, n, _ in rows], np.int64), np.array([i for *_, i in rows], np.int64))


def merge(shards: list[Transform], length: int | None = None) -> tuple[Transform, np.ndarray]:
    """The merged transform and, between neighbouring rows, the common prefix (at most `length`, if given).

    With a length, rows that share more than that many symbols keep the order of their shards.
    """
    symbol = np.concatenate([s.symbol for s in shards]) if shards else np.zeros(0, np.int16)
    text = np.concatenate([s.text for s in shards]) if shards else np.zeros(0, np.int64)
    start = np.concatenate([s.start for s in shards]) if shards else np.zeros(0, np.int64)
    n = len(symbol)
    if not n:
        return Transform(symbol, text, start), np.zeros(0, np.int64)
    # row after a step back: within its shard, the row of the suffix one symbol longer
    place = np.empty(n, np.int64)
    lo = 0
    for s in shards:
        own = s.symbol.astype(np.int64)
        # an end leads to the row of the whole text's end, in the order of the texts
        key = np.where(own == 0, s.text - n, own * n)
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((np.arange(len(own)), key))] = np.arange(len(own))
        place[lo : lo + len(own)] = rank + lo
        lo += len(own)
    order = np.arange(n)  # rows of the shards, in the order found so far
    block = np.zeros(n, np.int64)  # equal for rows that agree so far
    common = np.full(max(0, n - 1), -1, np.int64)
    k = 0
    while length is None or k <= length:
        # the suffix one symbol longer is sorted by its first symbol, then by what is known of the rest
        longer = place[order]
        first = symbol[order].astype(np.int64)
        ends = np.where(first == 0, text[order], 0)
        deal = np.lexsort((np.arange(n), ends, first))
        new_order = longer[deal]
        whole = np.stack((first[deal], ends[deal], np.where(first[deal] == 0, 0, block[deal])), 1)
        parted = (whole[1:] != whole[:-1]).any(axis=1)
        common[parted & (common < 0)] = k
        new_block = np.concatenate(([0], np.cumsum(parted)))
        k += 1
        if (new_order == order).all() and (new_block == block).all():
            break
        order, block = new_order, new_block
    common[common < 0] = k if length is None else length
    return Transform(symbol[order], text[order], start[order]), common if length is None else np.minimum(common, length)


def repeated_starts(texts: list[bytes], length: int, shards: int = 2) -> set[tuple[int, int]]:
    """(text, start) of every string of `length` bytes that also starts elsewhere."""
    cut = [texts[i * len(texts) // shards : (i + 1) * len(texts) // shards] for i in range(shards)]
    first = np.cumsum([0, *(len(c) for c in cut)])
    merged, common = merge([of_shard(c, int(f)) for c, f in zip(cut, first, strict=False)], length)
    hit = np.zeros(len(merged.text), bool)
    hit[:-1] |= common >= length
    hit[1:] |= common >= length
    return set(zip(merged.text[hit].tolist(), merged.start[hit].tolist(), strict=True))
