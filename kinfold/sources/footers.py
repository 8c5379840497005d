"""What a parquet column chunk says without its values being read: page headers and dictionary pages.

A reader for whole chunks has to decode every page.  A page header, though, is a few bytes of
Thrift's compact protocol, and says how long its page is and how it is encoded; so one can step
from header to header, and read the dictionary page alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed values of the format: page types and the encodings whose values are places in a dictionary.
DATA_PAGE, INDEX_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 1, 2, 3
DICTIONARY_ENCODINGS = (2, 8)
#: Writers known to put only values that occur into a dictionary.
SOUND_WRITERS = ("parquet-cpp", "parquet-mr")
HEADER_BYTES = 256


class Short(Exception):
    """A header goes on behind the bytes read so far."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data):
            raise Short
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def _value(data: bytes, at: int, kind: int):
    if kind in (1, 2):
        return kind == 1, at
    if kind == 3:
        return data[at], at + 1
    if kind in (4, 5, 6):
        n, at = _varint(data, at)
        return (n >> 1) ^ -(n & 1), at
    if kind == 7:
        return None, at + 8
    if kind == 8:
        n, at = _varint(data, at)
        if at + n > len(data):
            raise Short
        return data[at:at + n], at + n
    if kind in (9, 10):
        if at >= len(data):
            raise Short
        size, inner = data[at] >> 4, data[at] & 15
        at += 1
        if size == 15:
            size, at = _varint(data, at)
        items = []
        for _ in range(size):
            item, at = _value(data, at, inner)
            items.append(item)
        return items, at
    if kind == 12:
        return compact_struct(data, at)
    raise ValueError(f"unexpected type {kind} in a page header")


def compact_struct(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(field number -> value, place behind it) of a struct in Thrift's compact protocol."""
    out, field = {}, 0
    while True:
        if at >= len(data):
            raise Short
        byte = data[at]
        at += 1
        if byte == 0:
            return out, at
        if byte >> 4:
            field += byte >> 4
        else:
            n, at = _varint(data, at)
            field = (n >> 1) ^ -(n & 1)
        out[field], at = _value(data, at, byte & 15)


def _header(file, at: int) -> tuple[dict, int]:
    size = HEADER_BYTES
    while True:
        file.seek(at)
        data = file.read(size)
        try:
            header, used = compact_struct(data)
            return header, at + used
        except (Short, IndexError):
            if len(data) < size:
                raise ValueError("a page header ends early") from None
            size *= 4


def pages(file, chunk) -> Iterator[tuple[int, int | None, int, dict]]:
    """(type, encoding, place of the content, header) of each page, stepping over their contents."""
    at = chunk.dictionary_page_offset if chunk.has_dictionary_page and chunk.dictionary_page_offset else chunk.data_page_offset
    end = at + chunk.total_compressed_size
    while at < end:
        header, content = _header(file, at)
        inner = header.get({DATA_PAGE: 5, DICTIONARY_PAGE: 7, DATA_PAGE_V2: 8}.get(header[1], 0), {})
        yield header[1], inner.get(4 if header[1] == DATA_PAGE_V2 else 2), content, header
        at = content + header[3]


def dictionary_values(file, chunk, type_: pa.DataType, created_by: str) -> pa.Array | None:
    """The distinct values of a chunk from its dictionary page; None if the page does not prove them.

    It does where every data page holds places in the dictionary and the writer is known to enter
    only values that occur.  The data pages themselves are not read.
    """
    if not chunk.has_dictionary_page or not created_by.startswith(SOUND_WRITERS) or chunk.physical_type not in ("BYTE_ARRAY", "INT32", "INT64", "FLOAT", "DOUBLE"):
        return None
    place = None
    for kind, encoding, content, header in pages(file, chunk):
        if kind == DICTIONARY_PAGE:
            place = (content, header)
        elif kind in (DATA_PAGE, DATA_PAGE_V2) and encoding not in DICTIONARY_ENCODINGS:
            return None
    if place is None:
        return None
    content, header = place
    file.seek(content)
    data = file.read(header[3])
    if chunk.compression != "UNCOMPRESSED":
        data = pa.Codec("lz4_raw" if chunk.compression == "LZ4_RAW" else chunk.compression.lower()).decompress(data, header[2]).to_pybytes()
    n = header[7][1]
    if chunk.physical_type == "BYTE_ARRAY":
        values, at = [], 0
        for _ in range(n):
            size = int.from_bytes(data[at:at + 4], "little")
            values.append(data[at + 4:at + 4 + size])
            at += 4 + size
        out = pa.array(values, pa.binary())
        return out.cast(type_) if pa.types.is_string(type_) or pa.types.is_large_string(type_) else out
    kinds = {"INT32": np.int32, "INT64": np.int64, "FLOAT": np.float32, "DOUBLE": np.float64}
    flat = pa.array(np.frombuffer(data, kinds[chunk.physical_type], n))
    if flat.type == type_:
        return flat
    width = {"INT32": 32, "INT64": 64}.get(chunk.physical_type)
    if pa.types.is_integer(type_):
        return flat.cast(type_, safe=False)
    return flat.view(type_) if getattr(type_, "bit_width", 0) == width else None
