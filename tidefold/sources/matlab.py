"""Numeric arrays of MATLAB level-5 files: tagged elements, small elements, compressed elements, either byte order."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Element types and array classes of the format (fixed values).
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
HEADER = 128


def _elements(data: memoryview, at: int, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, bytes) of the elements one after the other."""
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: type and size share a word, its bytes follow at once
            kind, size, begin, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            begin, step = at + 8, 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)
        if begin + size > len(data):
            raise ValueError("an element ends after the file")
        yield kind, data[begin : begin + size]
        at += step


def _array(data: memoryview, order: str) -> tuple[str, np.ndarray | None]:
    """Name and values of a matrix element; None where it is no real numeric array."""
    parts = list(_elements(data, 0, order))
    flags = struct.unpack_from(order + "I", parts[0][1])[0]
    shape = np.frombuffer(parts[1][1], order + "i4")
    name = bytes(parts[2][1]).decode("latin-1")
    kind = CLASSES.get(flags & 0xFF)
    if kind is None or flags & 0x0800:  # cells, structs, text, sparse or complex arrays
        return name, None
    values = np.frombuffer(parts[3][1], order + NUMBERS[parts[3][0]]).astype(kind)
    return name, values.reshape(shape, order="F")


def read_arrays(content: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a file by name; other variables are left out."""
    if len(content) < HEADER or content[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level-5 file")
    order = "<" if content[126:128] == b"IM" else ">"
    found: dict[str, np.ndarray] = {}

    def take(kind: int, data: memoryview) -> None:
        if kind == COMPRESSED:
            for inner in _elements(memoryview(zlib.decompress(data)), 0, order):
                take(*inner)
        elif kind == MATRIX and len(data):
            name, values = _array(data, order)
            if values is not None:
                found[name] = values

    for element in _elements(memoryview(content), HEADER, order):
        take(*element)
    return found


def write_arrays(arrays: dict[str, np.ndarray], compress: bool = True, order: str = "<") -> bytes:
    """A level-5 file of numeric arrays; one-dimensional ones become columns."""

    def element(kind: int, data: bytes) -> bytes:
        if 0 < len(data) <= 4:
            return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    classes, numbers = ({v: k for k, v in t.items()} for t in (CLASSES, NUMBERS))
    out = [b"numeric arrays".ljust(124), struct.pack(order + "H", 0x0100), b"IM" if order == "<" else b"MI"]
    for name, a in arrays.items():
        a = a.reshape(-1, 1) if a.ndim < 2 else a
        kind = a.dtype.str[1:]
        body = element(6, struct.pack(order + "II", classes[kind], 0)) + element(5, np.array(a.shape, order + "i4").tobytes()) + element(1, name.encode("latin-1"))
        body += element(numbers[kind], a.astype(order + kind).tobytes(order="F"))
        whole = struct.pack(order + "II", MATRIX, len(body)) + body
        packed = zlib.compress(whole)
        out.append(struct.pack(order + "II", COMPRESSED, len(packed)) + packed if compress else whole)
    return b"".join(out)
