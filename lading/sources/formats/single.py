"""A bare compressed stream: one member, named after the file."""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

from lading.errors import UnsupportedFormat
from lading.functions.digests import crc32_combine
from lading.sources.base import Archive, crc_bytes, member, tidy, utc
from lading.sources.codecs import STREAMS

#: Endings that a stream's name loses, by stream.
SUFFIXES = {"gz": (".gz",), "bz2": (".bz2",), "xz": (".xz",), "zst": (".zst",), "lz4": (".lz4",), "lz": (".lz",), "lzma": (".lzma",), "zz": (".zz", ".zlib"), "br": (".br",), "Z": (".Z",)}


def inferred_name(path: str | None, suffixes: Iterable[str]) -> str:
    """The file's name without the longest ending of ``suffixes`` (any case); with
    ``.uncompressed`` if it has none; ``data`` without a usable name."""
    base = os.path.basename((path or "").rstrip("/"))
    if base in ("", ".", ".."):
        return "data"
    ends = [s for s in suffixes if base.lower().endswith(s.lower()) and len(base) > len(s)]
    return base[: -len(max(ends, key=len))] if ends else base + ".uncompressed"


def _gzip_header(head: bytes) -> tuple[int, bytes | None, bytes | None]:
    """Modification time, stored name and comment of a gzip header."""
    flags, stamp, at = head[3], struct.unpack("<I", head[4:8])[0], 10
    if flags & 4:
        at += 2 + struct.unpack("<H", head[at : at + 2])[0]
    fields = []
    for bit in (8, 16):
        if flags & bit and (end := head.find(b"\0", at)) >= 0:
            fields.append(head[at:end])
            at = end + 1
        else:
            fields.append(None)
    return stamp, fields[0], fields[1]


def lzip_members(src) -> list[tuple[int, int, int]]:
    """(checksum, data size, member size) of each member, read back from the trailers;
    empty if they don't chain to the start."""
    end, out = src.seek(0, io.SEEK_END), []
    while end > 0:
        if end < 26:
            return []
        src.seek(end - 20)
        crc, size, whole = struct.unpack("<IQQ", src.read(20))
        if not 26 <= whole <= end:
            return []
        src.seek(end - whole)
        if src.read(4) != b"LZIP":
            return []
        out.append((crc, size, whole))
        end -= whole
    return out[::-1]


def listing(src, archive: Archive) -> Iterator[dict]:
    if archive.stream == "uncompressed":
        raise UnsupportedFormat("not a compressed stream")
    fields: dict = {"size": None, "modified": None, "hashes": {}, "comment": None}
    extra = {}
    end = src.seek(0, io.SEEK_END)
    if archive.stream == "gz" and end >= 18:
        src.seek(0)
        stamp, stored, comment = _gzip_header(src.read(65536))
        fields["modified"] = utc(stamp) if stamp else None
        fields["comment"] = comment.decode("latin-1") if comment else None
        if stored:
            extra["gzip.name"] = stored.decode("latin-1")
        if _one_gzip_member(src):
            src.seek(end - 8)
            fields["hashes"] = {"crc32": crc_bytes(struct.unpack("<I", src.read(4))[0])}
    if archive.stream == "lz" and (parts := lzip_members(src)):
        crc = 0
        for c, n, _ in parts:
            crc = crc32_combine(crc, c, n)
        fields |= {"size": sum(n for _, n, _ in parts), "hashes": {"crc32": crc_bytes(crc)}}
    name = inferred_name(archive.archive_id, SUFFIXES[archive.stream])
    yield member(archive, 0, type="file", name=tidy(name, "file"), raw_name=name.encode(), compressed_size=end, compression=[{"algo": archive.stream, "level": None, "properties": None}], extra=extra, block=0, **fields)


def _one_gzip_member(src) -> bool:
    """Whether the first member's deflate data ends 8 bytes before the file does."""
    src.seek(0)
    machine, data = zlib.decompressobj(31), b""
    try:
        while not machine.eof and (data := machine.unconsumed_tail or src.read(1 << 20)):
            machine.decompress(data, 1 << 20)
    except zlib.error:
        return False
    return machine.eof and not machine.unused_data and not src.read(1)


def content(src, archive: Archive, wanted: Iterable[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    for row in wanted:
        src.seek(0)
        yield row, STREAMS[archive.stream](src)


def cost(archive: Archive) -> dict:
    return {"listing": "indexed", "access": "direct", "solid_block_count": None}


