"""RAR 1.5 to 4 and RAR 5: headers are read here; stored members are read directly, and
compressed data is reported as unsupported (its format is not public)."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

from lading.errors import Corrupt, Encrypted, MissingComponent, Truncated, UnsupportedFeature
from lading.sources import aes
from lading.sources.base import Archive, crc_bytes, dos_time, exactly, filetime, member, text_of, tidy, utc, window

OLD, NEW = b"Rar!\x1a\7\0", b"Rar!\x1a\7\1\0"
#: How far into a file an archive behind a program stub is looked for.
STUB = 2 << 20
# Creating systems of old archives, redirections of new ones.
SYSTEMS = {0: "fat", 1: "os2_hpfs", 2: "ntfs", 3: "unix", 4: "macintosh", 5: "beos"}
REDIRECTIONS = {1: "symlink", 2: "symlink", 3: "symlink", 4: "hardlink", 5: "hardlink"}


class _Fields:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Corrupt("a RAR header ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def vint(self) -> int:
        """Seven bits a byte, low ones first, while the top bit is set."""
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if not b & 128:
                return value
            shift += 7
            if shift > 63:
                raise Corrupt("an overlong RAR number")

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]


def _start(src) -> int:
    src.seek(0)
    head = src.read(STUB)
    at = min((i for i in (head.find(OLD), head.find(NEW)) if i >= 0), default=-1)
    if at < 0:
        raise Corrupt("no RAR signature")
    return at


def _entries(src, archive: Archive) -> Iterator[dict]:
    """File headers of all volumes in a row, parts of split members joined."""
    at, end, held = _start(src), src.seek(0, io.SEEK_END), None
    while at < end:
        src.seek(at)
        sign = src.read(8)
        reader = _new if sign == NEW else _old if sign[:7] == OLD else None
        if reader is None:
            break
        at += 8 if reader is _new else 7
        for e in reader(src, at, end, archive):
            if "end" in e:
                at = e["end"]
                break
            if e["split_before"] and held:
                held["extents"] += e["extents"]
                held |= {k: e[k] for k in ("hashes", "split_after")}
                held["packed"] += e["packed"]
                e = held
            if e["split_after"]:
                held = e
            else:
                held = None
                yield e
        else:
            break
    if held:
        archive.note("archive_eof", "the last volume is missing")
        yield held


def _key(f: _Fields, passwords: tuple[bytes, ...], with_iv: bool) -> tuple[bytes, bytes, bytes]:
    """Key, checksum key and initial vector of an encryption record, by the first password whose check value fits."""
    f.vint()
    flags, rounds = f.vint(), f.take(1)[0]
    salt, iv = f.take(16), f.take(16) if with_iv else b""
    check = f.take(12)[:8] if flags & 1 else None
    for password in passwords:
        key, mac, own = aes.rar5_keys(password, salt, rounds)
        if check is None or own == check:
            return key, mac, iv
    raise Encrypted("no password fits" if passwords else "a password is needed")


def _header(src, at: int, key: bytes | None) -> tuple[bytes, bytes, int]:
    """Checksummed size, body and end of the header at ``at``."""
    src.seek(at)
    if key is None:
        head = src.read(4 + 10)
        if len(head) < 7:
            raise Truncated("a RAR header ends early")
        f = _Fields(head[4:])
        size = f.vint()
        src.seek(at + 4 + f.at)
        body, end = exactly(src, size, "a RAR header"), at + 4 + f.at + size
    else:
        iv, first = exactly(src, 16, "a RAR header"), exactly(src, 16, "a RAR header")
        head = b"".join(aes.chained_decrypt(key, iv, iter([first])))
        f = _Fields(head[4:])
        size = f.vint()
        whole = (4 + f.at + size + 15) // 16 * 16
        more = exactly(src, whole - 16, "a RAR header")
        head += b"".join(aes.chained_decrypt(key, first, iter([more])))
        body, end = head[4 + f.at : 4 + f.at + size], at + 16 + whole
    if zlib.crc32(head[4 : 4 + f.at] + body) != struct.unpack("<I", head[:4])[0]:
        raise Encrypted("the RAR headers don't decrypt") if key else Corrupt("a RAR header's checksum")
    return head[4 : 4 + f.at], body, end


def _new(src, at: int, end: int, archive: Archive) -> Iterator[dict]:
    key = None
    while at < end:
        _, body, data_at = _header(src, at, key)
        f = _Fields(body)
        kind, flags = f.vint(), f.vint()
        extra = f.vint() if flags & 1 else 0
        packed = f.vint() if flags & 2 else 0
        at = data_at + packed
        if kind == 4:
            archive.is_encrypted = True
            key, _, _ = _key(f, archive.passwords, with_iv=False)
            continue
        if kind == 5:
            yield {"end": at}
            return
        if kind == 1:
            archive.is_solid |= bool(f.vint() & 4)
        if kind != 2:
            continue
        own = f.vint()
        full, attrs = f.vint(), f.vint()
        modified = utc(f.u32()) if own & 2 else None
        hashes = {"crc32": crc_bytes(f.u32())} if own & 4 else {}
        packing, host = f.vint(), f.vint()
        raw = f.take(f.vint())
        e = {
            "raw": raw, "size": None if own & 8 else full, "packed": packed, "extents": [(data_at, packed)], "modified": modified, "accessed": None, "created": None, "hashes": hashes, "method": packing >> 7 & 7,
            "directory": bool(own & 1), "mode": attrs if host == 1 else None, "attrs": attrs if host == 0 else None, "system": "unix" if host == 1 else "ntfs", "encrypted": False, "split_before": bool(flags & 8),
            "split_after": bool(flags & 16), "solid": bool(packing & 64), "version": None, "redirect": None, "target": None, "extra": {},
        }
        f.at = max(f.at, len(body) - extra)
        while f.at < len(body):
            n = f.vint()
            stop = f.at + n
            what = f.vint()
            if what == 1:
                e["encrypted"] = archive.is_encrypted = True
                e["extra"]["rar.encryption"] = body[f.at : stop].hex()
                f.vint()
                if f.vint() & 2:
                    e["hashes"], e["extra"]["rar.tweaked"] = {}, hashes.get("crc32", b"").hex()
            elif what == 2 and f.vint() == 0 and "rar.tweaked" not in e["extra"]:
                e["hashes"] = e["hashes"] | {"blake2sp": f.take(32)}
            elif what == 3:
                bits = f.vint()
                for bit, name in ((2, "modified"), (4, "created"), (8, "accessed")):
                    if bits & bit:
                        e[name] = utc(f.u32()) if bits & 1 else filetime(struct.unpack("<Q", f.take(8))[0])
            elif what == 4:
                f.vint()
                e["version"] = f.vint()
            elif what == 5:
                e["redirect"] = f.vint()
                f.vint()
                e["target"] = f.take(f.vint())
            f.at = stop
        yield e


def _old(src, at: int, end: int, archive: Archive) -> Iterator[dict]:
    while at + 7 <= end:
        src.seek(at)
        head = exactly(src, 7, "a RAR header")
        crc, kind, flags, size = struct.unpack("<HBHH", head)
        if size < 7:
            raise Corrupt("a RAR header's size")
        body = exactly(src, size - 7, "a RAR header")
        more = struct.unpack("<I", body[:4])[0] if flags & 0x8000 or kind in (0x74, 0x7A) else 0
        if kind == 0x73:
            archive.is_solid |= bool(flags & 8)
            if flags & 0x80:
                archive.is_encrypted = True
                raise Encrypted("the RAR headers are encrypted")
        if kind == 0x7B:
            yield {"end": at + size}
            return
        if kind == 0x74:
            if zlib.crc32(head[2:] + body) & 0xFFFF != crc:
                raise Corrupt("a RAR header's checksum")
            packed, full, host, digest, stamp, _, method, n, attrs = struct.unpack("<IIBIIBBHI", body[:25])
            i = 25
            if flags & 0x100:
                high, top = struct.unpack("<II", body[25:33])
                packed, full, i = packed | high << 32, full | top << 32, 33
            more = packed
            raw = body[i : i + n]
            mode = attrs if host == 3 else None
            e = {
                "raw": raw, "size": full, "packed": packed, "extents": [(at + size, packed)], "modified": dos_time(stamp), "accessed": None, "created": None, "hashes": {"crc32": crc_bytes(digest)}, "method": method - 0x30,
                "directory": flags & 0xE0 == 0xE0, "mode": mode, "attrs": attrs if host in (0, 2) else None, "system": SYSTEMS.get(host, "unknown"), "encrypted": bool(flags & 4), "split_before": bool(flags & 1),
                "split_after": bool(flags & 2), "solid": bool(flags & 16), "version": None, "redirect": None, "target": None, "extra": {}, "name": _wide(raw) if flags & 0x200 else None,
            }
            if flags & 0x800 and b";" in raw:
                e["raw"], _, number = raw.rpartition(b";")
                e["version"] = int(number) if number.isdigit() else None
            archive.is_encrypted |= e["encrypted"]
            if mode is not None and mode & 0o170000 == 0o120000:
                e["redirect"] = 1
            yield e
        at += size + more


def _wide(raw: bytes) -> str | None:
    """An old archive's Unicode name: two-bit codes choose between a byte, a byte with a
    common high byte, two bytes, and a run copied from the plain name."""
    plain, gap, packed = raw.partition(b"\0")
    if not gap or len(packed) < 2:
        return text_of(plain)[0]
    high, at, out, codes, left = packed[0], 1, [], 0, 0
    try:
        while at < len(packed):
            if not left:
                codes, at, left = packed[at], at + 1, 4
            code, codes, left = codes >> 6, codes << 2 & 255, left - 1
            if code == 0:
                out.append(packed[at])
                at += 1
            elif code == 1:
                out.append(packed[at] | high << 8)
                at += 1
            elif code == 2:
                out.append(packed[at] | packed[at + 1] << 8)
                at += 2
            else:
                n, at = packed[at], at + 1
                step, base = (packed[at], high << 8) if n & 128 else (0, 0)
                at += bool(n & 128)
                out += [(c + step & 255) | base for c in plain[len(out) : len(out) + (n & 127) + 2]]
    except IndexError:
        pass
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace")


def listing(src, archive: Archive) -> Iterator[dict]:
    block = position = 0
    for number, e in enumerate(_entries(src, archive)):
        name, lossy = (e["name"], False) if e.get("name") else text_of(e["raw"])
        kind = REDIRECTIONS.get(e["redirect"]) or ("directory" if e["directory"] else "file")
        if e["solid"] and number:
            position += 1
        else:
            block, position = number, 0
        shown = tidy(name, kind, backslash=e["system"] != "unix")
        if e["version"]:
            shown = f"{shown};{e['version']}"
        target = text_of(e["target"])[0] if e["target"] else None
        if kind == "symlink" and target is None and e["method"] == 0 and not e["encrypted"]:
            target = text_of(b"".join(b for start, n in e["extents"] for b in window(src, start, n)))[0]
        yield member(
            archive, number, type=kind, name=shown, name_lossy=lossy, raw_name=e["raw"], size=e["size"], compressed_size=e["packed"], modified=e["modified"], accessed=e["accessed"], created=e["created"],
            mode=e["mode"] & 0o7777 if e["mode"] is not None else None, link_target=target, compression=[{"algo": "stored" if e["method"] == 0 else "rar", "level": e["method"], "properties": None}], is_encrypted=e["encrypted"],
            is_current=e["version"] is None, create_system=e["system"], windows_attrs=e["attrs"], hashes={} if kind == "directory" else e["hashes"], block=block, block_position=position,
            extra=e["extra"] | {"rar.extents": ",".join(f"{a}:{n}" for a, n in e["extents"])} | ({"rar.redirection": str(e["redirect"])} if e["redirect"] else {}),
        )


def content(src, archive: Archive, wanted: Iterable[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    for row in wanted:
        def chunks(row=row):
            if row["compression"][0]["algo"] != "stored":
                raise MissingComponent("compressed RAR data needs the program unrar", row["name"])
            data = (b for piece in row["extra"]["rar.extents"].split(",") for b in window(src, *map(int, piece.split(":"))))
            if not row["is_encrypted"]:
                yield from data
                return
            if "rar.encryption" not in row["extra"]:
                raise UnsupportedFeature("the encryption of archives before RAR 5", row["name"])
            key, mac, iv = _key(_Fields(bytes.fromhex(row["extra"]["rar.encryption"])), archive.passwords, with_iv=True)
            left, crc = row["size"] or 0, 0
            for part in aes.chained_decrypt(key, iv, data):
                part, left = part[:left], left - min(left, len(part))
                crc = zlib.crc32(part, crc)
                yield part
            if (want := row["extra"].get("rar.tweaked")) and crc_bytes(aes.rar5_mixed_crc(crc, mac)).hex() != want:
                raise Corrupt("the mixed checksum differs", row["name"])

        yield row, chunks()


def cost(archive: Archive) -> dict:
    return {"listing": "indexed", "access": "solid" if archive.is_solid else "direct", "solid_block_count": None}
