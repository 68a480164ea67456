"""Section codecs on bytes: store, run lengths, varint, LZ77, dictionary, delta and base32.

``encode(id, data)`` and ``decode(id, data, capacity)``; decoders are strict and raise TelemetryError.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np

from .schema import TelemetryError

# Codec numbers and names.
CODECS = {0: "store", 1: "rle", 2: "varint", 3: "lz77", 4: "dict", 5: "delta", 6: "base32"}
WINDOW, SHORTEST, LONGEST, PHRASE, MOST_PHRASES = 4096, 3, 18, 4, 65535


def _fail(code: str):
    raise TelemetryError(code)


def _room(size: int, capacity: int) -> None:
    if size > capacity:
        _fail("RANGE")


def _rle_encode(data: bytes) -> bytes:
    out = bytearray()
    for run in re.finditer(rb"(.)\1{0,254}", data, re.S):
        out += bytes((len(run[0]), run[0][0]))
    return bytes(out)


def _rle_decode(data: bytes, capacity: int) -> bytes:
    out = bytearray()
    for run, value in zip(data[::2], data[1::2]):
        if not run:
            _fail("BADRECORD")
        _room(len(out) + run, capacity)
        out += bytes((value,)) * run
    if len(data) % 2:
        _fail("TRUNCATED")
    return bytes(out)


def _words(data: bytes) -> np.ndarray:
    if len(data) % 4:
        _fail("TRUNCATED")
    return np.frombuffer(data, "<u4").astype(np.int64)


def _leb128(values) -> bytes:
    out = bytearray()
    for v in values:
        while v > 0x7F:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
    return bytes(out)


def _read_leb128(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            _fail("TRUNCATED")
        byte = data[at]
        at += 1
        if shift == 28 and byte > 0x0F:  # a sixth group or more than 32 bits
            _fail("RANGE")
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _varint_encode(data: bytes) -> bytes:
    return _leb128(_words(data).tolist())


def _varint_decode(data: bytes, capacity: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        value, at = _read_leb128(data, at)
        _room(len(out) + 4, capacity)
        out += struct.pack("<I", value)
    return bytes(out)


def zigzag(v):
    """Signed 32-bit to unsigned, small magnitudes first."""
    return (v << 1 ^ v >> 31) & 0xFFFFFFFF


def unzigzag(u):
    v = u >> 1 ^ -(u & 1)
    return v & 0xFFFFFFFF


def _delta_encode(data: bytes) -> bytes:
    words = _words(data)
    if not len(words):
        return b""
    steps = ((np.diff(words) + 2**31) % 2**32 - 2**31).tolist()  # wrapped to signed 32 bits
    return data[:4] + _leb128(zigzag(s) for s in steps)


def _delta_decode(data: bytes, capacity: int) -> bytes:
    if not data:
        return b""
    if len(data) < 4:
        _fail("TRUNCATED")
    _room(4, capacity)
    value, at, out = struct.unpack_from("<I", data)[0], 4, bytearray(data[:4])
    while at < len(data):
        step, at = _read_leb128(data, at)
        value = (value + unzigzag(step)) & 0xFFFFFFFF
        _room(len(out) + 4, capacity)
        out += struct.pack("<I", value)
    return bytes(out)


def _longest_match(data: bytes, p: int) -> tuple[int, int]:
    """Length and distance of the longest earlier match, the farthest of equals; bytes.find does the search."""
    at, most = max(0, p - WINDOW), min(LONGEST, len(data) - p)
    length, where = 0, p
    while most >= SHORTEST and length < most:
        # an overlapping match may run into p itself
        at = data.find(data[p : p + max(length + 1, SHORTEST)], at, p + most - 1)
        if at < 0 or at >= p:
            break
        length, where = max(length + 1, SHORTEST), at
        while length < most and data[at + length] == data[p + length]:
            length += 1
    return length, p - where


def _lz77_encode(data: bytes) -> bytes:
    out, p = bytearray(), 0
    while p < len(data):
        flag, group = 0, bytearray()
        for bit in range(8):
            if p >= len(data):
                break
            length, distance = _longest_match(data, p)
            if length >= SHORTEST:
                flag |= 1 << bit
                group += struct.pack("<H", (distance - 1) & 0xFF | (((distance - 1) >> 8) << 4 | length - SHORTEST) << 8)
                p += length
            else:
                group.append(data[p])
                p += 1
        out.append(flag)
        out += group
    return bytes(out)


def _lz77_decode(data: bytes, capacity: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        flag = data[at]
        at += 1
        for bit in range(8):
            if at >= len(data):
                break
            if not flag >> bit & 1:
                _room(len(out) + 1, capacity)
                out.append(data[at])
                at += 1
                continue
            if at + 2 > len(data):
                _fail("TRUNCATED")
            low, high = data[at : at + 2]
            at += 2
            distance, length = (low | high >> 4 << 8) + 1, (high & 15) + SHORTEST
            if distance > len(out):
                _fail("BADRECORD")
            _room(len(out) + length, capacity)
            piece = bytes(out[len(out) - distance :])
            out += (piece * (length // distance + 1))[:length]
    return bytes(out)


def _dict_encode(data: bytes) -> bytes:
    blocks = [data[i : i + PHRASE] for i in range(0, len(data), PHRASE)]
    number = {b: i for i, b in enumerate(dict.fromkeys(blocks))}
    if len(number) > MOST_PHRASES:
        _fail("RANGE")
    table = b"".join(bytes((len(b),)) + b for b in number)
    return struct.pack("<H", len(number)) + table + struct.pack(f"<{len(blocks)}H", *map(number.__getitem__, blocks))


def _dict_decode(data: bytes, capacity: int) -> bytes:
    if len(data) < 2:
        _fail("TRUNCATED")
    phrases, at = [], 2
    for _ in range(struct.unpack_from("<H", data)[0]):
        if at >= len(data) or at + 1 + data[at] > len(data):
            _fail("TRUNCATED")
        phrases.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    out = bytearray()
    for (i,) in struct.iter_unpack("<H", data[at : len(data) - (len(data) - at) % 2]):
        if i >= len(phrases):
            _fail("BADRECORD")
        _room(len(out) + len(phrases[i]), capacity)
        out += phrases[i]
    if (len(data) - at) % 2:
        _fail("TRUNCATED")
    return bytes(out)


def _base32_decode(data: bytes, capacity: int) -> bytes:
    if len(data) % 8:
        _fail("TRUNCATED")
    body = data.rstrip(b"=")
    if len(data) - len(body) not in (0, 1, 3, 4, 6) or not re.fullmatch(rb"[A-Z2-7]*", body):
        _fail("BADRECORD")
    out = base64.b32decode(data)
    _room(len(out), capacity)
    return out


def _store_decode(data: bytes, capacity: int) -> bytes:
    _room(len(data), capacity)
    return data


_ENCODE = {0: bytes, 1: _rle_encode, 2: _varint_encode, 3: _lz77_encode, 4: _dict_encode, 5: _delta_encode, 6: base64.b32encode}
_DECODE = {0: _store_decode, 1: _rle_decode, 2: _varint_decode, 3: _lz77_decode, 4: _dict_decode, 5: _delta_decode, 6: _base32_decode}


def encode(codec: int, data: bytes) -> bytes:
    return _ENCODE[codec](data) if codec in _ENCODE else _fail("BADRECORD")


def decode(codec: int, data: bytes, capacity: int) -> bytes:
    return _DECODE[codec](data, capacity) if codec in _DECODE else _fail("BADRECORD")
