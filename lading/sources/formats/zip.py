"""ZIP: the central directory lists, each member decodes alone."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

from lading.errors import Corrupt, Encrypted, Truncated, UnsupportedFeature
from lading.sources import aes, codecs
from lading.sources.base import Archive, crc_bytes, dos_time, exactly, filetime, member, text_of, tidy, utc, window

# Compression methods and creating systems by their numbers.
METHODS = {0: "stored", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz", 98: "ppmd"}
SYSTEMS = {0: "fat", 1: "amiga", 2: "openvms", 3: "unix", 4: "vm_cms", 5: "atari_st", 6: "os2_hpfs", 7: "macintosh", 8: "z_system", 9: "cpm", 10: "ntfs", 11: "mvs", 12: "vse", 13: "acorn_risc", 14: "vfat", 15: "alternate_mvs", 16: "beos", 17: "tandem", 18: "os400", 19: "darwin"}

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def _directory(src) -> tuple[int, int, int, bytes, int]:
    """(offset, size, entries, comment, bytes before the archive) of the central directory."""
    end = src.seek(0, io.SEEK_END)
    tail_at = max(0, end - 65557)
    src.seek(tail_at)
    tail = src.read()
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] > len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise Corrupt("no end of central directory")
    disk, first, _, count, size, offset, note = struct.unpack("<4H2IH", tail[at + 4 : at + 22])
    if disk or first:
        if not (disk == first == 0xFFFF):
            raise UnsupportedFeature("a split ZIP archive")
    comment, closing = tail[at + 22 : at + 22 + note], tail_at + at
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        src.seek(max(0, closing - 20))
        locator = src.read(20)
        if locator[:4] == _LOCATOR:
            where = struct.unpack("<Q", locator[8:16])[0]
            src.seek(where)
            record = exactly(src, 56, "the ZIP64 record")
            if record[:4] == _END64:
                count, size, offset = struct.unpack("<3Q", record[32:56])
                closing = where
    return offset, size, count, comment, max(0, closing - size - offset)


def _extras(data: bytes) -> dict[int, bytes]:
    out, i = {}, 0
    while i + 4 <= len(data):
        kind, n = struct.unpack("<HH", data[i : i + 4])
        out.setdefault(kind, data[i + 4 : i + 4 + n])
        i += 4 + n
    return out


def _times(dos: int, extra: dict[int, bytes]) -> dict:
    """Modified, accessed and created: NTFS times over the DOS time, Unix times over both, each by itself."""
    out = {"modified": dos_time(dos), "accessed": None, "created": None}
    ntfs = extra.get(0x000A, b"")
    if len(ntfs) >= 32 and ntfs[4:8] == b"\1\0\x18\0":
        for name, ticks in zip(("modified", "accessed", "created"), struct.unpack("<3Q", ntfs[8:32])):
            out[name] = filetime(ticks) or out[name]
    unix = extra.get(0x5455, b"")
    if unix:
        at = 1
        for bit, name in enumerate(("modified", "accessed", "created")):
            if unix[0] >> bit & 1 and len(unix) >= at + 4:
                out[name] = utc(struct.unpack("<i", unix[at : at + 4])[0])
                at += 4
    return out


def listing(src, archive: Archive) -> Iterator[dict]:
    offset, size, count, comment, shift = _directory(src)
    archive.comment = comment.decode("utf-8", "replace") or None
    src.seek(offset + shift)
    for number in range(count):
        head = exactly(src, 46, "the central directory")
        if head[:4] != _ENTRY:
            raise Corrupt("no entry where the central directory should have one")
        made, _, flags, method, dos, crc, packed, full, n, m, k, _, _, attrs, at = struct.unpack("<HHHHIIIIHHHHHII", head[4:46])
        raw, tail, note = exactly(src, n, "a name"), exactly(src, m, "an extra field"), exactly(src, k, "a comment")
        extra = _extras(tail)
        big = extra.get(1, b"")
        values = list(struct.unpack(f"<{len(big) // 8}Q", big[: len(big) // 8 * 8]))
        full = values.pop(0) if full == 0xFFFFFFFF and values else full
        packed = values.pop(0) if packed == 0xFFFFFFFF and values else packed
        at = values.pop(0) if at == 0xFFFFFFFF and values else at
        system = made >> 8
        mode = attrs >> 16 if system == 3 else 0
        encrypted, aes = bool(flags & 1), extra.get(0x9901, b"")
        aes_version = struct.unpack("<H", aes[:2])[0] if len(aes) >= 7 else 0
        if method == 99 and len(aes) >= 7:
            method = struct.unpack("<H", aes[5:7])[0]
        if flags & 0x800:
            name, lossy = text_of(raw)
        else:
            try:
                name, lossy = raw.decode("utf-8"), False
            except UnicodeDecodeError:
                name, lossy = raw.decode(archive.fallback_encoding, "replace"), False
                archive.note("name_encoding", f"read as {archive.fallback_encoding}", number, "info")
        link = (mode & 0o170000) == 0o120000
        kind = "symlink" if link else "directory" if raw.endswith(b"/") or (attrs & 0x10 and system in (0, 10, 14)) or (mode & 0o170000) == 0o040000 else "other" if (mode & 0o170000) not in (0, 0o100000) else "file"
        shown = tidy(name, kind, backslash=system in (0, 6, 10, 14))
        if shown != name:
            archive.note("name_normalized", name, number, "info")
        archive.is_encrypted |= encrypted
        digest = {} if kind not in ("file", "symlink") or aes_version == 2 else {"crc32": crc_bytes(crc)}
        yield member(
            archive, number, type=kind, name=shown, name_lossy=lossy, raw_name=raw, size=full, compressed_size=packed, **_times(dos, extra), mode=mode & 0o7777 if system == 3 and mode else None,
            comment=note.decode("utf-8", "replace") or None, compression=[{"algo": METHODS.get(method, f"method {method}"), "level": None, "properties": None}], is_encrypted=encrypted, create_system=SYSTEMS.get(system, "unknown"),
            windows_attrs=attrs & 0xFFFF if system in (0, 10, 14) else None, hashes=digest, extra={"zip.offset": str(at + shift), "zip.flags": str(flags), "zip.dos": str(dos), "zip.crc": str(crc)} | ({"zip.aes": aes.hex()} if aes else {}),
        )


def _lzma(src: io.BufferedIOBase, size: int) -> Iterator[bytes]:
    head = exactly(src, 4, "LZMA properties")
    five = exactly(src, struct.unpack("<H", head[2:4])[0], "LZMA properties")
    return codecs.lzma_raw([codecs.lzma1_properties(five)], size)(src)


_TABLE = [0] * 256
for _n in range(256):
    _c = _n
    for _ in range(8):
        _c = _c >> 1 ^ 0xEDB88320 if _c & 1 else _c >> 1
    _TABLE[_n] = _c


class ZipCrypto:
    """The traditional cipher: three keys that the plain text keeps changing."""

    def __init__(self, password: bytes):
        self.keys = (0x12345678, 0x23456789, 0x34567890)
        for b in password:
            self._update(b)

    def _update(self, b: int) -> None:
        k0, k1, k2 = self.keys
        k0 = k0 >> 8 ^ _TABLE[(k0 ^ b) & 255]
        k1 = ((k1 + (k0 & 255)) * 134775813 + 1) & 0xFFFFFFFF
        self.keys = (k0, k1, k2 >> 8 ^ _TABLE[(k2 ^ k1 >> 24) & 255])

    def decrypt(self, data: bytes) -> bytes:
        out = bytearray()
        for c in data:
            t = self.keys[2] | 2
            c ^= (t * (t ^ 1)) >> 8 & 255
            self._update(c)
            out.append(c)
        return bytes(out)


def _payload(src, row: dict) -> tuple[int, int]:
    at = int(row["extra"]["zip.offset"])
    src.seek(at)
    head = exactly(src, 30, "a local header")
    if head[:4] != _LOCAL:
        raise Corrupt("no local header", row["name"])
    n, m = struct.unpack("<HH", head[26:30])
    return at + 30 + n + m, row["compressed_size"]


def _opened(chunks: Iterable[bytes], row: dict) -> Iterator[bytes]:
    method, file = row["compression"][0]["algo"], codecs.DecodedFile(iter(chunks))
    if method == "lzma":
        return _lzma(file, row["size"])
    simple = {"stored": codecs.stored, "deflate": codecs.deflate, "bzip2": codecs.bzip2, "zstd": codecs.zstd, "xz": codecs.xz}
    if method in simple:
        return simple[method](file)
    if method in codecs.OPTIONAL:
        return codecs.optional(method)(file)
    raise UnsupportedFeature(f"compression {method}", row["name"])


def _plain(src, start: int, size: int, row: dict, archive: Archive) -> Iterator[bytes]:
    """Data without its encryption. Each password is tried against the check byte and
    then against the checksum or authentication code. Where none holds, the member is
    damaged if another one speaks for a password whose check bytes hold, or there is no other."""
    if not archive.passwords:
        raise Encrypted("a password is needed", row["name"])
    if "zip.aes" in row["extra"]:
        strength = bytes.fromhex(row["extra"]["zip.aes"])[4]
        if strength not in (1, 2, 3):
            raise Corrupt("WinZip AES strength", row["name"])
        passed = []
        for password in archive.passwords:
            try:
                for _ in aes.winzip_encrypted(window(src, start, size), size, strength, password)[1]:
                    pass
            except Encrypted:
                continue
            except (Corrupt, Truncated):  # a damaged member, or a wrong password that the check bytes let pass
                passed.append(password)
                continue
            return aes.winzip(window(src, start, size), size, strength, archive.fits(password))
        for password in passed:
            if _known(src, row, archive, password):
                return aes.winzip(window(src, start, size), size, strength, password)
        raise Encrypted("no password fits", row["name"])
    flags, dos, crc = (int(row["extra"][k]) for k in ("zip.flags", "zip.dos", "zip.crc"))
    want = (dos >> 8 if flags & 8 else crc >> 24) & 255
    for password in archive.passwords:
        src.seek(start)
        machine = ZipCrypto(password)
        if machine.decrypt(exactly(src, 12, "the encryption header"))[11] != want:
            continue
        try:
            total = 0
            for data in _opened((machine.decrypt(x) for x in window(src, start + 12, size - 12)), row):
                total = zlib.crc32(data, total)
        except (Corrupt, Truncated):
            continue
        if total == crc:
            machine = ZipCrypto(archive.fits(password))
            src.seek(start)
            machine.decrypt(src.read(12))
            return (machine.decrypt(x) for x in window(src, start + 12, size - 12))
    raise Encrypted("no password fits", row["name"])


def _known(src, row: dict, archive: Archive, password: bytes) -> bool:
    """Whether the check bytes of another member let a password pass, or there is no other AES member."""
    alone = True
    try:
        for other in listing(src, Archive(archive.archive_id, archive.container, archive.stream, fallback_encoding=archive.fallback_encoding)):
            if other["member_id"] == row["member_id"] or "zip.aes" not in other["extra"]:
                continue
            alone, where = False, src.tell()
            try:
                start, size = _payload(src, other)
                if aes.winzip_passes(window(src, start, size), size, bytes.fromhex(other["extra"]["zip.aes"])[4], password):
                    return True
            except (Corrupt, Truncated, KeyError, IndexError):  # this one can't tell
                pass
            src.seek(where)
    except (Corrupt, Truncated):  # of the directory
        pass
    return alone


def content(src, archive: Archive, wanted: Iterable[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    for row in wanted:
        def chunks(row=row):
            start, size = _payload(src, row)
            data = _plain(src, start, size, row, archive) if row["is_encrypted"] else window(src, start, size)
            yield from _opened(data, row)

        yield row, chunks()


def link_target(src, archive: Archive, row: dict) -> str | None:
    """A symlink's target is its content."""
    for _, chunks in content(src, archive, [row]):
        return text_of(b"".join(chunks))[0]


def cost(archive: Archive) -> dict:
    return {"listing": "indexed", "access": "direct", "solid_block_count": None}


