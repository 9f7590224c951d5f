"""MessagePack values: built, or skipped without building them."""

from __future__ import annotations

import struct


def _taken(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("MessagePack ends within a value")
    return data[at : at + n]


def unpack(data: bytes, at: int = 0):
    """The MessagePack value at a place and the place after it."""
    b = _taken(data, at, 1)[0]
    at += 1
    if b < 0x80:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    if b < 0x90:
        return _pairs(data, at, b & 15)
    if b < 0xA0:
        return _items(data, at, b & 15)
    if b < 0xC0:
        return _taken(data, at, b & 31).decode(), at + (b & 31)
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    if b in (0xC4, 0xC5, 0xC6, 0xD9, 0xDA, 0xDB):
        width = {0xC4: 1, 0xC5: 2, 0xC6: 4, 0xD9: 1, 0xDA: 2, 0xDB: 4}[b]
        n = int.from_bytes(_taken(data, at, width))
        body = _taken(data, at + width, n)
        return (body if b < 0xC7 else body.decode()), at + width + n
    if b in (0xCA, 0xCB):
        width = 4 if b == 0xCA else 8
        return struct.unpack(">f" if width == 4 else ">d", _taken(data, at, width))[0], at + width
    if 0xCC <= b <= 0xD3:
        width = 1 << (b & 3)
        return int.from_bytes(_taken(data, at, width), signed=b >= 0xD0), at + width
    if b in (0xDC, 0xDD, 0xDE, 0xDF):
        width = 2 if b in (0xDC, 0xDE) else 4
        n = int.from_bytes(_taken(data, at, width))
        return (_items if b < 0xDE else _pairs)(data, at + width, n)
    raise ValueError(f"MessagePack type {b:#x} is not supported")


def _items(data: bytes, at: int, n: int):
    out = []
    for _ in range(n):
        value, at = unpack(data, at)
        out.append(value)
    return out, at


def _pairs(data: bytes, at: int, n: int):
    out = {}
    for _ in range(n):
        key, at = unpack(data, at)
        out[key], at = unpack(data, at)
    return out, at


def _length(data: bytes, at: int, width: int) -> int:
    if at + width > len(data):
        raise IndexError("MessagePack goes on")
    return int.from_bytes(data[at : at + width])


def map_size(data: bytes, at: int) -> tuple[int, int]:
    """The number of pairs of the map at a place (none for nil) and the place of the first; IndexError where data ends before that."""
    b = data[at]
    if b == 0xC0:
        return 0, at + 1
    if 0x80 <= b < 0x90:
        return b & 15, at + 1
    if b in (0xDE, 0xDF):
        width = 2 if b == 0xDE else 4
        return _length(data, at + 1, width), at + 1 + width
    raise ValueError("a catalogue and its bundles are maps")


def skip(data: bytes, at: int) -> int:
    """The place after the value at a place, of which nothing is built; IndexError where data ends before that."""
    left = 1
    while left:
        b = data[at]
        at, left = at + 1, left - 1
        if b < 0x80 or b >= 0xE0 or b in (0xC0, 0xC2, 0xC3):
            continue
        if b < 0x90:
            left += 2 * (b & 15)
        elif b < 0xA0:
            left += b & 15
        elif b < 0xC0:
            at += b & 31
        elif b in (0xC4, 0xC5, 0xC6, 0xD9, 0xDA, 0xDB):
            width = {0xC4: 1, 0xC5: 2, 0xC6: 4, 0xD9: 1, 0xDA: 2, 0xDB: 4}[b]
            at += width + _length(data, at, width)
        elif b in (0xCA, 0xCB):
            at += 4 if b == 0xCA else 8
        elif 0xCC <= b <= 0xD3:
            at += 1 << (b & 3)
        elif b in (0xDC, 0xDD, 0xDE, 0xDF):
            width = 2 if b in (0xDC, 0xDE) else 4
            n = _length(data, at, width)
            at, left = at + width, left + (n if b < 0xDE else 2 * n)
        else:
            raise ValueError(f"MessagePack type {b:#x} is not supported")
    if at > len(data):
        raise IndexError("MessagePack goes on")
    return at


def packed(x) -> bytes:
    """A value of None, booleans, whole numbers, strings, lists and maps as MessagePack."""
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        return struct.pack("B", x) if 0 <= x < 128 else struct.pack(">Bq", 0xD3, x)
    if isinstance(x, str):
        raw = x.encode()
        return (struct.pack("B", 0xA0 | len(raw)) if len(raw) < 32 else struct.pack(">BI", 0xDB, len(raw))) + raw
    if isinstance(x, list):
        return struct.pack(">BI", 0xDD, len(x)) + b"".join(map(packed, x))
    return map_head(len(x)) + b"".join(packed(k) + packed(v) for k, v in x.items())


def map_head(n: int) -> bytes:
    """What begins a map of n pairs."""
    return struct.pack(">BI", 0xDF, n)
