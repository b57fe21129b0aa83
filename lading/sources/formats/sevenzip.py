"""7z: a header at the end describes folders (solid blocks) and the files in them."""

from __future__ import annotations

import io
import lzma
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from lading.errors import Corrupt, Encrypted, Truncated, UnsupportedFeature
from lading.sources import aes, codecs
from lading.sources.base import Archive, crc_bytes, exactly, filetime, guarded, member, tidy, window
from lading.sources.formats.single import inferred_name

MAGIC = b"7z\xbc\xaf\x27\x1c"
# Property numbers of the header.
END, HEADER, MAIN_STREAMS, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, UNPACK_SIZE, COUNT = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13
EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES, CREATED, ACCESSED, MODIFIED, ATTRIBUTES, COMMENT, ENCODED = 14, 15, 16, 17, 18, 19, 20, 21, 22, 23
ARCHIVE_PROPERTIES = 2
# Coder ids.
METHODS = {
    b"\x00": "copy", b"\x21": "lzma2", b"\x03\x01\x01": "lzma", b"\x03": "delta", b"\x04": "bcj_x86", b"\x05": "bcj_ppc", b"\x06": "bcj_ia64", b"\x07": "bcj_arm", b"\x08": "bcj_armt", b"\x09": "bcj_sparc",
    b"\x03\x03\x01\x03": "bcj_x86", b"\x03\x03\x02\x05": "bcj_ppc", b"\x03\x03\x04\x01": "bcj_ia64", b"\x03\x03\x05\x01": "bcj_arm", b"\x03\x03\x07\x01": "bcj_armt", b"\x03\x03\x08\x05": "bcj_sparc", b"\x03\x03\x01\x1b": "bcj2",
    b"\x04\x01\x08": "deflate", b"\x04\x01\x09": "deflate64", b"\x04\x02\x02": "bzip2", b"\x03\x04\x01": "ppmd", b"\x04\xf7\x11\x01": "zstd", b"\x04\xf7\x11\x02": "brotli", b"\x04\xf7\x11\x04": "lz4", b"\x06\xf1\x07\x01": "aes",
}
_FILTERS = {"bcj_x86": lzma.FILTER_X86, "bcj_ppc": lzma.FILTER_POWERPC, "bcj_ia64": lzma.FILTER_IA64, "bcj_arm": lzma.FILTER_ARM, "bcj_armt": lzma.FILTER_ARMTHUMB, "bcj_sparc": lzma.FILTER_SPARC}
_MOST = 1 << 24


@dataclass
class Folder:
    coders: list[tuple[str, bytes, int, int]]  # method, properties, inputs, outputs
    bonds: dict[int, int]  # input -> output
    packed: list[int]
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None
    start: int = 0
    pack_sizes: list[int] = field(default_factory=list)

    @property
    def size(self) -> int:
        return next((s for k, s in enumerate(self.sizes) if k not in self.bonds.values()), 0)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Corrupt("the 7z header ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """Leading ones of the first byte count the bytes that follow."""
        first = self.byte()
        value, mask = 0, 0x80
        for k in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << (8 * k)
            value |= self.byte() << (8 * k)
            mask >>= 1
        return value

    def count(self) -> int:
        n = self.number()
        if n > _MOST:
            raise Corrupt("an absurd count in the 7z header")
        return n

    def bits(self, n: int) -> list[bool]:
        data = self.take((n + 7) // 8)
        return [bool(data[k // 8] >> (7 - k % 8) & 1) for k in range(n)]

    def some(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [struct.unpack("<I", self.take(4))[0] if has else None for has in self.some(n)]


def _folder(r: _Reader) -> Folder:
    coders, ins, outs = [], 0, 0
    for _ in range(r.count()):
        flag = r.byte()
        method = METHODS.get(name := r.take(flag & 15), name.hex())
        n_in, n_out = (r.count(), r.count()) if flag & 0x10 else (1, 1)
        properties = r.take(r.count()) if flag & 0x20 else b""
        coders.append((method, properties, n_in, n_out))
        ins, outs = ins + n_in, outs + n_out
    bonds = {}
    for _ in range(max(0, outs - 1)):
        i = r.count()
        bonds[i] = r.count()
    free = ins - len(bonds)
    packed = [i for i in range(ins) if i not in bonds] if free == 1 else [r.count() for _ in range(free)]
    return Folder(coders, bonds, packed, [0] * outs)


def _streams(r: _Reader) -> tuple[list[Folder], list[int], list[int | None]]:
    """Folders with their places, and the sizes and digests of the files in them."""
    position, pack_sizes, folders, counts, sizes, crcs = 0, [], [], None, None, None
    while (p := r.number()) != END:
        if p == PACK:
            position, n = r.number(), r.count()
            while (q := r.number()) != END:
                if q == SIZE:
                    pack_sizes = [r.number() for _ in range(n)]
                elif q == CRC:
                    r.digests(n)
        elif p == UNPACK:
            if r.number() != FOLDER:
                raise Corrupt("no folders in the 7z header")
            n = r.count()
            if r.byte():
                raise UnsupportedFeature("7z folders outside the header")
            folders = [_folder(r) for _ in range(n)]
            while (q := r.number()) != END:
                if q == UNPACK_SIZE:
                    for f in folders:
                        f.sizes = [r.number() for _ in f.sizes]
                elif q == CRC:
                    for f, c in zip(folders, r.digests(n)):
                        f.crc = c
        elif p == SUBSTREAMS:
            counts = [1] * len(folders)
            q = r.number()
            if q == COUNT:
                counts = [r.count() for _ in folders]
                q = r.number()
            sizes = []
            for f, k in zip(folders, counts):
                inner = [r.number() for _ in range(k - 1)] if q == SIZE else []
                if k:
                    sizes += [*inner, f.size - sum(inner)] if q == SIZE or k == 1 else [0] * k
            if q == SIZE:
                q = r.number()
            crcs = []
            unknown = [k for f, k in zip(folders, counts) if not (k == 1 and f.crc is not None)]
            given = iter(r.digests(sum(unknown))) if q == CRC else None
            for f, k in zip(folders, counts):
                crcs += [f.crc] if k == 1 and f.crc is not None else [next(given) if given else None for _ in range(k)]
            while q != END:
                q = r.number()
        else:
            raise Corrupt("an unknown part of the 7z header")
    counts = counts if counts is not None else [1] * len(folders)
    at, offset = 0, 32 + position
    for f in folders:
        f.start, f.pack_sizes = offset, pack_sizes[at : at + len(f.packed)]
        at, offset = at + len(f.packed), offset + sum(pack_sizes[at : at + len(f.packed)])
    if sizes is None:
        sizes, crcs = [f.size for f in folders], [f.crc for f in folders]
    for f, k in zip(folders, counts):
        f.files = k
    return folders, sizes, crcs


def _stage(method: str, properties: bytes, size: int, data: Iterator[bytes]) -> Iterator[bytes]:
    file = codecs.DecodedFile(data)
    if method == "copy":
        return codecs.stored(file)
    if method == "lzma":
        return codecs.lzma_raw([codecs.lzma1_properties(properties)], size)(file)
    if method == "lzma2":
        return codecs.lzma_raw([codecs.lzma2_properties(properties)], size)(file)
    if method in _FILTERS or method == "delta":
        own = {"id": lzma.FILTER_DELTA, "dist": properties[0] + 1} if method == "delta" else {"id": _FILTERS[method]}
        return _filtered(own, file, size)
    if method in ("deflate", "bzip2", "zstd"):
        return {"deflate": codecs.deflate, "bzip2": codecs.bzip2, "zstd": codecs.zstd}[method](file)
    if method in ("brotli", "lz4"):
        return codecs.STREAMS[{"brotli": "br", "lz4": "lz4"}[method]](file)
    if method in codecs.OPTIONAL:
        return codecs.optional(method)(file)
    raise UnsupportedFeature(f"7z method {method}")


def _filtered(own: dict, file, size: int) -> Iterator[bytes]:
    """A branch or delta filter by itself: the data is wrapped as uncompressed LZMA2
    chunks, which the library then decodes through the filter."""
    machine = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[own, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}])
    first = True
    while size:
        piece = exactly(file, min(size, 65536), "filtered data")
        size -= len(piece)
        wrapped = (b"\1" if first else b"\2") + struct.pack(">H", len(piece) - 1) + piece + (b"" if size else b"\0")
        first = False
        if out := machine.decompress(wrapped):
            yield out


def _held(data: Iterator[bytes], f: Folder, files: list[tuple[int, int | None]]) -> tuple[bool, int]:
    """Whether decoded data has its folder's size and holds against all checksums there
    are, and how many bytes lie in files that hold against their own."""
    file, crc, size, right, sound = codecs.DecodedFile(guarded(data)), 0, 0, 0, True
    try:
        for left, want in [*files, (f.size - sum(n for n, _ in files), None)]:
            own, n = 0, left
            while left > 0 and (part := file.read(min(left, 1 << 20))):
                crc, own, left = zlib.crc32(part, crc), zlib.crc32(part, own), left - len(part)
                size += len(part)
            if want is not None:
                sound &= left <= 0 and own == want
                right += n if left <= 0 and own == want else 0
    except (Corrupt, Truncated):
        return False, right
    return sound and size >= f.size and (f.crc is None or crc == f.crc), right


def _tried(src, f: Folder, passwords: tuple[bytes, ...], files: list[tuple[int, int | None]] = ()) -> bytes | None:
    """The password under which an encrypted folder decodes to its checksum and those of
    its ``files`` (size, checksum), or without any to its size. Of a damaged folder, the one under which most
    of its files do, if they have four bytes. None for folders that aren't encrypted."""
    if not any(c[0] == "aes" for c in f.coders):
        return None
    best, most = None, 3
    for password in passwords:
        whole, right = _held(unpacked(src, f, password), f, list(files))
        if whole:
            return password
        if right > most:
            best, most = password, right
    if best is not None:
        return best
    raise Encrypted("no password fits" if passwords else "a password is needed")


def unpacked(src, f: Folder, password: bytes | None = None) -> Iterator[bytes]:
    """A folder's decoded bytes: its coders form one chain from the packed stream."""
    if any(c[2] != 1 or c[3] != 1 for c in f.coders) or len(f.packed) != 1:
        raise UnsupportedFeature("7z coders with several streams (BCJ2)")
    order, at = [], f.packed[0]
    after = {o: i for i, o in f.bonds.items()}
    while True:
        order.append(at)
        if len(order) > len(f.coders):
            raise Corrupt("7z coders in a circle")
        if at not in after:
            break
        at = after[at]
    data = window(src, f.start, f.pack_sizes[0])
    for k in order:
        if f.coders[k][0] == "aes":
            data = _cut(aes.chained_decrypt(*aes.sevenzip_key(f.coders[k][1], password or b""), data), f.sizes[k])
        else:
            data = _stage(f.coders[k][0], f.coders[k][1], f.sizes[k], data)
    return data


def _cut(data: Iterator[bytes], size: int) -> Iterator[bytes]:
    for part in data:
        yield part[:size]
        size -= min(size, len(part))


def _whole(src, f: Folder, passwords: tuple[bytes, ...] = ()) -> bytes:
    data = b"".join(unpacked(src, f, _tried(src, f, passwords)))
    if len(data) < f.size or (f.crc is not None and zlib.crc32(data) != f.crc):
        raise Corrupt("the packed 7z header")
    return data


def _parsed(src, passwords: tuple[bytes, ...] = ()) -> tuple[list[Folder], list[int], list[int | None], list[dict], str | None]:
    src.seek(0)
    head = exactly(src, 32, "the 7z signature header")
    if head[:6] != MAGIC:
        raise Corrupt("no 7z signature")
    offset, size, crc = struct.unpack("<QQI", head[12:32])
    if zlib.crc32(head[12:32]) != struct.unpack("<I", head[8:12])[0]:
        raise Corrupt("the 7z start header's checksum")
    if not size:
        return [], [], [], [], None
    if size > src.seek(0, io.SEEK_END):
        raise Corrupt("the 7z header lies behind the end")
    src.seek(32 + offset)
    data = exactly(src, size, "the 7z header")
    if zlib.crc32(data) != crc:
        raise Corrupt("the 7z header's checksum")
    r = _Reader(data)
    while (kind := r.number()) == ENCODED:
        folders, _, _ = _streams(r)
        r = _Reader(_whole(src, folders[0], passwords))
    if kind != HEADER:
        raise Corrupt("no 7z header")
    folders, sizes, crcs, files, note = [], [], [], [], None
    while (p := r.number()) != END:
        if p == MAIN_STREAMS:
            folders, sizes, crcs = _streams(r)
        elif p == FILES:
            files, note = _files(r)
        elif p == ARCHIVE_PROPERTIES:
            while r.number() != END:
                r.take(r.count())
        else:
            raise Corrupt("an unknown part of the 7z header")
    return folders, sizes, crcs, files, note


def _files(r: _Reader) -> tuple[list[dict], str | None]:
    n = r.count()
    files, empty, note = [{} for _ in range(n)], [], None
    while (p := r.number()) != END:
        part = _Reader(r.take(r.count()))
        if p == EMPTY_STREAM:
            bits = part.bits(n)
            for f, b in zip(files, bits):
                f["empty"] = b
            empty = [f for f, b in zip(files, bits) if b]
        elif p in (EMPTY_FILE, ANTI):
            for f, b in zip(empty, part.bits(len(empty))):
                f["file" if p == EMPTY_FILE else "anti"] = b
        elif p == NAMES and not part.byte():
            for f, raw in zip(files, _names(part.data[1:])):
                f["raw"] = raw
        elif p in (CREATED, ACCESSED, MODIFIED, ATTRIBUTES):
            has = part.some(n)
            if part.byte():
                raise UnsupportedFeature("7z properties outside the header")
            for f, b in zip(files, has):
                if b:
                    f[p] = struct.unpack("<Q", part.take(8))[0] if p != ATTRIBUTES else struct.unpack("<I", part.take(4))[0]
        elif p == COMMENT and not part.byte():
            note = part.data[1:].decode("utf-16-le", "replace").rstrip("\0")
    return files, note


def _names(data: bytes) -> Iterator[bytes]:
    start = 0
    for at in range(0, len(data) - 1, 2):
        if data[at : at + 2] == b"\0\0":
            yield data[start:at]
            start = at + 2


def listing(src, archive: Archive) -> Iterator[dict]:
    folders, sizes, crcs, files, archive.comment = _parsed(src, archive.passwords)
    inner = [(k, i) for k, f in enumerate(folders) for i in range(f.files)]
    archive.is_solid = any(f.files > 1 for f in folders)
    archive.solid_blocks = len(folders)
    archive.is_encrypted = any(c[0] == "aes" for f in folders for c in f.coders)
    stream = 0
    for number, f in enumerate(files):
        attrs = f.get(ATTRIBUTES)
        mode = attrs >> 16 if attrs is not None and attrs & 0x8000 else None
        has = not f.get("empty", False)
        kind = "anti" if f.get("anti") else "directory" if not has and not f.get("file") else "file"
        if mode is not None and (mode & 0o170000) == 0o120000 or attrs is not None and attrs & 0x400 and not attrs & 0x10:
            kind = "symlink"
        raw = f.get("raw", b"")
        name = raw.decode("utf-16-le", "replace") if raw else inferred_name(archive.archive_id, (".7z",))
        where, size, crc = (None, 0, None)
        if has:
            if stream >= len(inner):
                raise Corrupt("more 7z files than streams")
            where, size, crc = inner[stream], sizes[stream], crcs[stream]
            stream += 1
        folder = folders[where[0]] if where else None
        shown = tidy(name, "directory" if kind == "directory" else kind, backslash=mode is None)
        if shown != name:
            archive.note("name_normalized", name, number, "info")
        yield member(
            archive, number, type=kind, name=shown, raw_name=raw, size=size if kind in ("file", "symlink") else None, compressed_size=sum(folder.pack_sizes) if folder and folder.files == 1 else None,
            modified=filetime(f.get(MODIFIED)), accessed=filetime(f.get(ACCESSED)), created=filetime(f.get(CREATED)), mode=mode & 0o7777 if mode is not None else None,
            compression=[{"algo": m, "level": None, "properties": p or None} for m, p, _, _ in reversed(folder.coders)] if folder else [], is_encrypted=bool(folder and any(c[0] == "aes" for c in folder.coders)),
            windows_attrs=attrs & 0xFFFF if attrs is not None else None, create_system="unix" if mode is not None else None, hashes={"crc32": crc_bytes(crc)} if crc is not None and kind in ("file", "symlink") else {},
            block=where[0] if where else -1, block_position=where[1] if where else 0,
        )


def content(src, archive: Archive, wanted: Iterable[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Each folder that holds wanted members is decoded once, up to the last of them."""
    folders, sizes, crcs, *_ = _parsed(src, archive.passwords)
    by_block: dict[int, list[dict]] = {}
    for row in wanted:
        by_block.setdefault(row["block"], []).append(row)
    for block, rows in sorted(by_block.items()):
        if block < 0:
            yield from ((row, iter(())) for row in rows)
            continue
        base = sum(f.files for f in folders[:block])
        file, at = None, 0
        for row in sorted(rows, key=lambda r: r["block_position"]):
            def chunks(row=row):
                nonlocal file, at
                if file is None:
                    inner = slice(base, base + folders[block].files)
                    password = _tried(src, folders[block], archive.passwords, list(zip(sizes[inner], crcs[inner])))
                    file = codecs.DecodedFile(unpacked(src, folders[block], password and archive.fits(password)))
                while at < row["block_position"]:
                    skip = sizes[base + at]
                    while skip:
                        skip -= len(exactly(file, min(skip, 1 << 20), "a 7z folder"))
                    at += 1
                left = sizes[base + at]
                at += 1
                while left:
                    data = exactly(file, min(left, 1 << 20), "a 7z folder")
                    left -= len(data)
                    yield data

            data = chunks()
            yield row, data
            for _ in data:  # the next member starts behind this one
                pass


def link_target(src, archive: Archive, row: dict) -> str | None:
    for _, chunks in content(src, archive, [row]):
        return b"".join(chunks).decode("utf-8", "replace")


def cost(archive: Archive) -> dict:
    return {"listing": "indexed", "access": "solid" if archive.is_solid else "direct", "solid_block_count": archive.solid_blocks}
