"""Simple-8b: whole numbers below 2^64 in 64-bit words, in blocks that decode on their own.

A word's low four bits select how many values it holds and how wide they are (SELECTORS); the values lie
above, first value lowest. Selector 0 is the escape: the next word is one raw value, for those that don't
fit 60 bits. A coded segment is a header, the blocks' first words and the words, all little-endian:

    magic "S8B1" | block size u32 | values u64 | words u64 | block offsets u32 x blocks | words u64 x words

Each block holds ``block`` values (the last one fewer) and begins with a new word, so any block decodes
from its offset alone, and all words of one selector decode together as one array.
"""

from __future__ import annotations

import struct

import numpy as np

#: Selector -> (values in the word, bits each).
SELECTORS = {1: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 0
_HEAD = struct.Struct("<4sIQQ")
U = np.uint64
_COUNT = np.array([1] + [SELECTORS[s][0] for s in range(1, 16)], np.int64)


def _choose(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the selector of a word that would start there. ends: the end of its block."""
    out = np.full(len(values), ESCAPE, np.uint8)
    at = np.arange(len(values))  # the values that are narrow enough so far
    most = int(values.max()) if len(values) else 0
    if most < 1 << 32:
        values = values.astype(np.uint32)
    for s in range(15, 0, -1):  # fewer bits, more values: the later, the better
        count, bits = SELECTORS[s]
        if most >> bits:
            at = at[values[at] < values.dtype.type(1 << bits)]
        if len(at) < count:
            break
        start = at[: len(at) - count + 1]
        start = start[at[count - 1 :] - start == count - 1]  # a run of narrow values
        out[start[ends[start] - start >= count]] = s
    return out


def encode(values, block: int = 256) -> bytes:
    values = np.ascontiguousarray(values, U)
    n = len(values)
    starts = np.arange(0, n, block, dtype=np.int64)
    stops = np.minimum(starts + block, n)
    chosen = _choose(values, np.repeat(stops, stops - starts)) if n else np.empty(0, np.uint8)
    place, step, active, firsts = starts.copy(), 0, np.arange(len(starts)), []
    owners = []
    while len(active):  # one word of every block at a time
        firsts.append(place[active]), owners.append(active)
        place[active] += _COUNT[chosen[place[active]]]
        active = active[place[active] < stops[active]]
        step += 1
    at = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
    at = np.sort(at)  # positions are in block order
    selector = chosen[at]
    width = np.where(selector == ESCAPE, 2, 1)
    word_at = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), U)
    for s in np.unique(selector):
        mine = selector == s
        head, from_ = word_at[mine], at[mine]
        if s == ESCAPE:
            words[head + 1] = values[from_]
            continue
        count, bits = SELECTORS[int(s)]
        w = np.full(len(head), U(s))
        for i in range(count if bits else 0):
            w |= values[from_ + i] << U(4 + i * bits)
        words[head] = w
    offsets = word_at[np.searchsorted(at, starts)].astype("<u4")
    return _HEAD.pack(b"S8B1", block, n, len(words)) + offsets.tobytes() + words.astype("<u8").tobytes()


def decode(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of the blocks first_block..last_block (its end excluded), all by default."""
    magic, block, n, count = _HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b segment")
    blocks = -(-n // block)
    offsets = np.frombuffer(data, "<u4", blocks, _HEAD.size).astype(np.int64)
    words = np.frombuffer(data, "<u8", count, _HEAD.size + 4 * blocks)
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.empty(0, U)
    begin, end = offsets[first_block], offsets[last_block] if last_block < blocks else count
    words = words[begin:end].astype(U)
    selector = (words & U(15)).astype(np.intp)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():  # a raw word may look like an escape: follow the blocks' words in order
        i = 0
        while i < len(words):
            hit = np.flatnonzero(selector[i:] == ESCAPE)
            if not len(hit):
                break
            i += int(hit[0]) + 1
            if i < len(words):
                raw[i] = True
            i += 1
    held = np.where(raw, 0, _COUNT[selector])
    total = min(last_block * block, n) - first_block * block
    to = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), U)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero(~raw & (selector == s))
        if s == ESCAPE:
            out[to[mine]] = words[mine + 1]
            continue
        values, bits = SELECTORS[int(s)]
        mask = (U(1) << U(bits)) - U(1)
        for i in range(values if bits else 0):
            out[to[mine] + i] = (words[mine] >> U(4 + i * bits)) & mask
    return out[:total]
