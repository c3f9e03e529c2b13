"""Simple-8b word-aligned coding of integer ids, with escapes and block offsets.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector says how many ids
of how many bits the payload packs. Ids are coded in blocks of 240 that start at a word
boundary, so that all blocks are coded and decoded in step by array operations. An id that
needs more than 20 bits is coded as the escape value and kept in full in a side list.
"""

from __future__ import annotations

import struct

import numpy as np

#: (ids in a word, bits of each) by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20)]
BLOCK, ESCAPE = 240, (1 << 20) - 1
_MAGIC, _HEAD = b"FS8B", struct.Struct("<4sIQIII")
_COUNT = np.array([c for c, _ in SELECTORS], np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and the escaped ids of ``ids`` (unsigned 32-bit)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    escaped = ids >= ESCAPE
    side = ids[escaped].astype(np.uint32)
    blocks = -(-n // BLOCK)
    coded = np.zeros((blocks, 2 * BLOCK), np.uint32)
    flat = np.zeros(blocks * BLOCK, np.uint32)
    flat[:n] = np.where(escaped, ESCAPE, ids)
    coded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    take = np.full((blocks, BLOCK), len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        fits = coded[:, : BLOCK + count - 1] < (1 << bits)
        have = 1
        while have < count and fits.any():
            step = min(have, count - have)
            fits = fits[:, : fits.shape[1] - step] & fits[:, step:]
            have += step
        if have == count:
            take[fits] = s
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    at, live, step = np.zeros(blocks, np.int64), np.arange(blocks), 0
    who, where, which, when = [], [], [], []
    while live.size:
        s = take[live, at[live]]
        who.append(live)
        where.append(at[live])
        which.append(s)
        when.append(np.full(live.size, step))
        at[live] += _COUNT[s]
        live, step = live[at[live] < length[live]], step + 1
    who, where, which, when = map(np.concatenate, (who, where, which, when))
    order = np.lexsort((when, who))
    who, where, which = who[order], where[order], which[order]
    words = which.astype(np.uint64) << np.uint64(60)
    for s in np.unique(which):
        count, bits = SELECTORS[s]
        if bits:
            rows = np.flatnonzero(which == s)
            for j in range(count):
                words[rows] |= coded[who[rows], where[rows] + j].astype(np.uint64) << np.uint64(j * bits)
    return words, np.searchsorted(who, np.arange(blocks)).astype(np.uint32), side


def unpack(words: np.ndarray, first: np.ndarray, side: np.ndarray, n: int) -> np.ndarray:
    """The ids that :func:`pack` was given."""
    out = np.zeros(n + 2 * BLOCK, np.uint32)
    if not n:
        return out[:0]
    which = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[which]
    before = np.cumsum(count) - count
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first.astype(np.int64), len(words))))
    at = before - before[first.astype(np.int64)][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(which):
        c, bits = SELECTORS[s]
        if bits:
            rows = np.flatnonzero(which == s)
            mask = np.uint64((1 << bits) - 1)
            for j in range(c):
                to = at[rows] + j
                held = to < stop[rows]
                out[to[held]] = ((words[rows[held]] >> np.uint64(j * bits)) & mask).astype(np.uint32)
    out = out[:n]
    if len(side):
        out[out == ESCAPE] = side
    return out


def write_page(ids: np.ndarray, lengths: np.ndarray, keys: list[int | None]) -> bytes:
    """A page of the file: header, keys, whether each key is null, lengths, block offsets, escapes, words."""
    words, first, side = pack(ids)
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([k or 0 for k in keys], "<i8")
    head = _HEAD.pack(_MAGIC, len(keys), len(ids), len(first), len(side), len(words))
    return b"".join([head, key.tobytes(), null.tobytes(), lengths.astype("<u8").tobytes(), first.astype("<u4").tobytes(), side.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_page(page: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    magic, docs, n, blocks, escapes, words = _HEAD.unpack_from(page)
    if magic != _MAGIC:
        raise ValueError("not a page of Simple-8b ids")
    at = _HEAD.size

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(page, kind, count, at)
        at += x.nbytes
        return x

    key, null, lengths = part("<i8", docs), part("u1", docs), part("<u8", docs).astype(np.int64)
    first, side, packed = part("<u4", blocks), part("<u4", escapes), part("<u8", words)
    keys = [None if x else k for k, x in zip(key.tolist(), null.tolist(), strict=True)]
    return unpack(packed, first, side, n), lengths, keys
