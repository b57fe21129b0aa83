"""Parallel decoding of one large stream: xz blocks and lzip members are found from the
end of the file and decoded each by itself."""

from __future__ import annotations

import io
import lzma
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.errors import ArchiveError, Corrupt
from lading.sources.codecs import lzip
from lading.sources.formats.single import lzip_members

_OUT = "path string, split int, start long, size long, data binary, error string"


def _number(data: bytes, at: int) -> tuple[int, int]:
    """xz's variable-length integer and the place behind it."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if not b & 128:
            return value, at
        if shift > 62:
            raise Corrupt("an overlong xz number")


def _packed(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def xz_blocks(src) -> list[tuple[int, int, int, bytes]]:
    """(place, unpadded size, decoded size, stream flags) of each block, from the indexes
    of all streams, read backwards over padding."""
    end, out = src.seek(0, io.SEEK_END), []
    while end:
        src.seek(max(0, end - 12))
        foot = src.read(12)
        if foot[-4:] == b"\0\0\0\0":
            end -= 4
            continue
        if len(foot) < 12 or foot[10:] != b"YZ" or zlib.crc32(foot[4:10]) != struct.unpack("<I", foot[:4])[0]:
            raise Corrupt("the xz footer")
        size, flags = (struct.unpack("<I", foot[4:8])[0] + 1) * 4, foot[8:10]
        src.seek(max(0, end - 12 - size))
        index = src.read(size)
        if index[:1] != b"\0" or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise Corrupt("the xz index")
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            whole, at = _number(index, at)
            full, at = _number(index, at)
            sizes.append((whole, full))
        place = end - 12 - size - sum(-(-w // 4) * 4 for w, _ in sizes)
        if place < 12:
            raise Corrupt("the xz index doesn't fit its stream")
        end, own = place - 12, []
        for whole, full in sizes:
            own.append((place, whole, full, flags))
            place += -(-whole // 4) * 4
        out = own + out
    return out


def xz_block(src, place: int, whole: int, full: int, flags: bytes) -> bytes:
    """One block, decoded as a stream of its own with an index of one record."""
    src.seek(place)
    body = src.read(-(-whole // 4) * 4)
    index = b"\0\1" + _packed(whole) + _packed(full)
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    back = struct.pack("<I", len(index) // 4 - 1) + flags
    stream = b"\xfd7zXZ\0" + flags + struct.pack("<I", zlib.crc32(flags)) + body + index + struct.pack("<I", zlib.crc32(back)) + back + b"YZ"
    try:
        return lzma.decompress(stream, lzma.FORMAT_XZ)
    except lzma.LZMAError as e:
        raise Corrupt(f"xz block: {e}") from e


def _splits(data: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    src = io.BytesIO(data)
    if data[:6] == b"\xfd7zXZ\0":
        for place, whole, full, flags in xz_blocks(src):
            yield place, whole, full, flags, data[place : place + -(-whole // 4) * 4]
    else:
        at = 0
        for _, full, whole in lzip_members(src):
            yield at, whole, full, b"", data[at : at + whole]
            at += whole


def split_decode(files: DataFrame, wanted: tuple[int, int] | None = None) -> DataFrame:
    """``path``, ``split``, ``start`` and ``size`` in the decoded stream, and ``data``, of
    the blocks of xz files and members of lzip files. The blocks are dealt out before
    they are decoded, so one file keeps many tasks busy; of ``wanted``, a decoded byte
    range, only the blocks that touch it are decoded."""

    def cut(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = 0
                try:
                    for n, (_, whole, full, flags, body) in enumerate(_splits(data or b"")):
                        if wanted is None or (start < wanted[1] and start + full > wanted[0]):
                            rows.append((path, n, start, full, whole, flags, body, None))
                        start += full
                except (ArchiveError, IndexError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            names = ("path", "split", "start", "size", "whole", "flags", "body", "error")
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    def decode(batches):
        for batch in batches:
            out, faults = [], []
            for full, whole, flags, body, error in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6, 7))):
                data = None
                if error is None:
                    try:
                        data = xz_block(io.BytesIO(body), 0, whole, full, flags) if flags else b"".join(lzip(io.BytesIO(body)))
                    except ArchiveError as e:
                        error = str(e)
                out.append(data), faults.append(error)
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(out, pa.binary()), pa.array(faults, pa.string())], names=["path", "split", "start", "size", "data", "error"])

    blocks = files.select("path", "content").mapInArrow(cut, "path string, split int, start long, size long, whole long, flags binary, body binary, error string")
    return blocks.repartition(F.col("path"), F.col("split")).mapInArrow(decode, _OUT)
