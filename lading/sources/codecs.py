"""Streaming decoders. Each takes a binary file and yields decoded chunks of bounded size."""

from __future__ import annotations

import bz2
import importlib.util
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

from lading.errors import Corrupt, MissingComponent, Truncated, UnsupportedFeature

CHUNK = 1 << 20
Decoder = Callable[[BinaryIO], Iterator[bytes]]


def stored(src: BinaryIO) -> Iterator[bytes]:
    while data := src.read(CHUNK):
        yield data


def _inflate(src: BinaryIO, wbits: int) -> Iterator[bytes]:
    machine = zlib.decompressobj(wbits)
    try:
        while not machine.eof and (data := machine.unconsumed_tail or src.read(CHUNK)):
            if out := machine.decompress(data, CHUNK):
                yield out
        if out := machine.flush():
            yield out
    except zlib.error as e:
        raise Corrupt(f"deflate data: {e}") from e
    if not machine.eof:
        raise Truncated("the deflate stream ends early")


def deflate(src: BinaryIO) -> Iterator[bytes]:
    return _inflate(src, -15)


def zlib_stream(src: BinaryIO) -> Iterator[bytes]:
    return _inflate(src, 15)


def gzip(src: BinaryIO) -> Iterator[bytes]:
    """Members one after the other, zero bytes between and behind them; other bytes
    behind a member are corruption, reported after the data before them."""
    rest = src.read(CHUNK)
    while True:
        machine = zlib.decompressobj(31)
        try:
            while not machine.eof and rest:
                if out := machine.decompress(rest, CHUNK):
                    yield out
                if not machine.eof:
                    rest = machine.unconsumed_tail or src.read(CHUNK)
        except zlib.error as e:
            raise Corrupt(f"gzip data: {e}") from e
        if not machine.eof:
            raise Truncated("the gzip stream ends early")
        rest = machine.unused_data.lstrip(b"\0")
        while len(rest) < 2 and (data := src.read(CHUNK)):
            rest = (rest + data).lstrip(b"\0")
        if not rest:
            return
        if not rest.startswith(b"\x1f\x8b"):
            raise Corrupt("bytes that aren't gzip follow a complete member")


def _chain(src: BinaryIO, make: Callable, padding: bytes, magic: bytes, faults: tuple, name: str) -> Iterator[bytes]:
    """Streams of one kind in a row."""
    rest, machine = src.read(CHUNK), make()
    started = False
    while True:
        try:
            while not machine.eof:
                if machine.needs_input and not rest and not (rest := src.read(CHUNK)):
                    raise Truncated(f"the {name} stream ends early")
                out, rest = machine.decompress(rest, CHUNK), b""
                started = True
                if out:
                    yield out
        except (*faults, EOFError) as e:
            raise Corrupt(f"{name} data: {e}") from e
        rest = machine.unused_data.lstrip(padding) if padding else machine.unused_data
        while len(rest) < len(magic) and (data := src.read(CHUNK)):
            rest = (rest + data).lstrip(padding) if padding else rest + data
        if not rest:
            return
        if not rest.startswith(magic):
            if name == "bzip2" and started:
                return  # as other readers do, what follows the last stream is ignored
            raise Corrupt(f"bytes that aren't {name} follow a complete stream")
        machine = make()


def bzip2(src: BinaryIO) -> Iterator[bytes]:
    return _chain(src, bz2.BZ2Decompressor, b"", b"BZh", (OSError, ValueError), "bzip2")


def xz(src: BinaryIO) -> Iterator[bytes]:
    return _chain(src, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), b"\0", b"\xfd7zXZ\0", (lzma.LZMAError,), "xz")


def _lzma_run(machine: lzma.LZMADecompressor, src: BinaryIO, size: int | None = None) -> Iterator[bytes]:
    done = 0
    try:
        while not machine.eof and (size is None or done < size):
            data = src.read(CHUNK) if machine.needs_input else b""
            if machine.needs_input and not data:
                break
            out = machine.decompress(data, CHUNK if size is None else min(CHUNK, size - done))
            done += len(out)
            if out:
                yield out
    except (lzma.LZMAError, EOFError) as e:
        raise Corrupt(f"LZMA data: {e}") from e
    if not machine.eof and (size is None or done < size):
        raise Truncated("the LZMA stream ends early")


def lzma_alone(src: BinaryIO) -> Iterator[bytes]:
    return _lzma_run(lzma.LZMADecompressor(lzma.FORMAT_ALONE), src)


def lzma_raw(filters: list[dict], size: int | None) -> Decoder:
    return lambda src: _lzma_run(lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters), src, size)


def lzma1_properties(five: bytes) -> dict:
    """The filter of LZMA1's property byte and dictionary size."""
    if len(five) < 5 or five[0] >= 225:
        raise Corrupt("LZMA properties")
    lc, rest = five[0] % 9, five[0] // 9
    return {"id": lzma.FILTER_LZMA1, "lc": lc, "lp": rest % 5, "pb": rest // 5, "dict_size": max(4096, struct.unpack("<I", five[1:5])[0])}


def lzma2_properties(one: bytes) -> dict:
    if len(one) != 1 or one[0] > 40:
        raise Corrupt("LZMA2 properties")
    size = 0xFFFFFFFF if one[0] == 40 else (2 | (one[0] & 1)) << (one[0] // 2 + 11)
    return {"id": lzma.FILTER_LZMA2, "dict_size": max(4096, size)}


def lzip(src: BinaryIO) -> Iterator[bytes]:
    """Members with a 6-byte header and a trailer of CRC-32, data size and member size."""
    rest = src.read(6)
    first = True
    while rest:
        if len(rest) < 6 or rest[:4] != b"LZIP":
            if first:
                raise Truncated("the lzip header ends early") if b"LZIP".startswith(rest[:4]) else Corrupt("no lzip header")
            return
        if rest[4] > 1:
            raise UnsupportedFeature(f"lzip version {rest[4]}")
        first, base = False, 1 << (rest[5] & 31)
        machine = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": max(4096, base - (base // 16) * (rest[5] >> 5))}])
        crc = size = 0
        for out in _lzma_run(machine, src):
            crc, size = zlib.crc32(out, crc), size + len(out)
            yield out
        tail = machine.unused_data
        while len(tail) < 26 and (data := src.read(26 - len(tail) if len(tail) < 20 else 26 - len(tail))):
            tail += data
        if len(tail) < 20:
            raise Truncated("the lzip trailer ends early")
        if struct.unpack("<IQ", tail[:12]) != (crc, size):
            raise Corrupt("lzip checksum or size")
        src = _Again(tail[20:], src)
        rest = src.read(6)


class _Again(io.RawIOBase):
    """Bytes read too early, then the rest of the file."""

    def __init__(self, head: bytes, src: BinaryIO):
        self.head, self.src = head, src

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = (self.head, b"") if n < 0 else (self.head[:n], self.head[n:])
            return out if n >= 0 and (len(out) == n or n < 0) else out + (self.src.read(n - len(out)) if n >= 0 else self.src.read())
        return self.src.read(n)


def zstd(src: BinaryIO) -> Iterator[bytes]:
    try:
        import zstandard
    except ImportError:
        yield from _arrow("zstd")(src)
        return
    try:
        with zstandard.ZstdDecompressor().stream_reader(src, read_across_frames=True, closefd=False) as f:
            while data := f.read(CHUNK):
                yield data
    except zstandard.ZstdError as e:
        raise Corrupt(f"zstd data: {e}") from e


def _arrow(name: str) -> Decoder:
    def decode(src: BinaryIO) -> Iterator[bytes]:
        import pyarrow as pa

        try:
            with pa.CompressedInputStream(pa.PythonFile(_Whole(src), "r"), name) as f:
                while data := f.read(CHUNK):
                    yield data
        except OSError as e:
            raise (Truncated if "truncated" in str(e).lower() else Corrupt)(f"{name} data: {e}") from e

    return decode


class _Whole(io.RawIOBase):
    """A readable file for libraries that ask for one; closing it leaves the source open."""

    def __init__(self, src: BinaryIO):
        self.src = src

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        return self.src.read(n)


def unix_compress(src: BinaryIO) -> Iterator[bytes]:
    """LZW with codes of growing width; in block mode code 256 clears the table. Codes
    come in groups of eight of one width, and a change of width drops a group's rest."""
    head = src.read(3)
    if len(head) < 3:
        raise Truncated("the .Z header ends early")
    if head[:2] != b"\x1f\x9d":
        raise Corrupt("no .Z header")
    most, block = head[2] & 31, bool(head[2] & 0x80)
    if not 9 <= most <= 16:
        raise Corrupt(f".Z codes of up to {most} bits")
    fresh = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    table, width, before = fresh[:], 9, b""
    out, pool, held, taken = bytearray(), 0, 0, 0
    data = src.read(CHUNK)

    def realign() -> None:
        nonlocal skip, taken
        skip, taken = (-taken) % (8 * width), 0

    skip, at = 0, 0
    while True:
        need = skip + width
        while held < need:
            if at >= len(data):
                data, at = src.read(CHUNK), 0
                if not data:
                    break
            pool |= data[at] << held
            held, at = held + 8, at + 1
        if held < need:
            break
        pool, held, skip = pool >> skip, held - skip, 0
        code = pool & ((1 << width) - 1)
        pool, held, taken = pool >> width, held - width, taken + width
        if code == 256 and block:
            realign()
            table, width, before = fresh[:], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise Corrupt(".Z code without an entry")
        if before and len(table) < 1 << most:
            table.append(before + word[:1])
        before = word
        out += word
        if len(table) >= (1 << width) and width < most:
            realign()
            width += 1
        if len(out) >= CHUNK:
            yield bytes(out)
            out.clear()
    if out:
        yield bytes(out)


#: Stream formats by the name that stands in a format's ``stream``.
STREAMS: dict[str, Decoder] = {
    "uncompressed": stored, "gz": gzip, "bz2": bzip2, "xz": xz, "zst": zstd, "lz4": _arrow("lz4"), "lz": lzip, "lzma": lzma_alone, "zz": zlib_stream, "br": _arrow("brotli"), "Z": unix_compress,
}
#: Codecs that need a package this library doesn't bring.
OPTIONAL = {"deflate64": "inflate64", "ppmd": "pyppmd", "bcj2": None}


def optional(name: str) -> Decoder:
    package = OPTIONAL[name]
    if package and importlib.util.find_spec(package):
        return {"deflate64": _deflate64, "ppmd": _ppmd}[name]
    raise MissingComponent(f"{name} needs the package {package}") if package else UnsupportedFeature(name)


def _deflate64(src: BinaryIO) -> Iterator[bytes]:
    import inflate64

    machine = inflate64.Inflater()
    while data := src.read(CHUNK):
        if out := machine.inflate(data):
            yield out


def _ppmd(src: BinaryIO) -> Iterator[bytes]:
    import pyppmd

    head = src.read(2)
    packed = int.from_bytes(head, "little")
    machine = pyppmd.Ppmd8Decoder((packed & 15) + 1, ((packed >> 4 & 255) + 1) << 20, packed >> 12)
    while data := src.read(CHUNK):
        yield machine.decode(data, -1)


class DecodedFile(io.RawIOBase):
    """A forward-only file over decoded chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        parts, size = [self.held], len(self.held)
        while n < 0 or size < n:
            if (chunk := next(self.chunks, None)) is None:
                break
            parts.append(chunk)
            size += len(chunk)
        data = b"".join(parts)
        out, self.held = (data, b"") if n < 0 else (data[:n], data[n:])
        self.at += len(out)
        return out


def decoded(src: BinaryIO, stream: str) -> BinaryIO:
    return src if stream == "uncompressed" else DecodedFile(STREAMS[stream](src))
