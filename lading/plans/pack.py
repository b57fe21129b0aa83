"""Archives packed from tables, deterministic, as rows (path, content): what the queries read back."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import hmac
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lading.sources.aes import Aes, counter_mode, rar5_keys, rar5_mixed_crc, sevenzip_key
from lading.functions.digests import blake2sp
from lading.sources.formats.zip import ZipCrypto

_OUT = "path string, content binary"


def _zip(rows, method: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in rows:
            info = zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr, info.create_system = method, 0o100644 << 16, 3
            z.writestr(info, data)
    return out.getvalue()


def _tar(rows) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, data in rows:
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(data), 1_577_836_800, 0o640
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def _arrow(name: str):
    return lambda data: pa.compress(data, codec=name, asbytes=True) if name != "lz4" else _lz4(data)


def _lz4(data: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as f:
        f.write(data)
    return sink.getvalue().to_pybytes()


def _lzip(data: bytes) -> bytes:
    raw = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}])
    return b"LZIP\x01\x14" + raw + struct.pack("<IQQ", zlib.crc32(data), len(data), len(raw) + 26)


COMPRESS = {"gz": lambda d: gzip.compress(d, mtime=0), "bz2": lambda d: bz2.compress(d, 1), "xz": lambda d: lzma.compress(d, preset=0), "lzma": lambda d: lzma.compress(d, lzma.FORMAT_ALONE, preset=0), "zst": _zstd, "lz4": _lz4, "br": _arrow("brotli"), "zz": zlib.compress, "lz": _lzip}


def _lzw(data: bytes, most: int = 16) -> bytes:
    """Unix compress: codes of nine bits and more, in groups of eight of one width."""
    out, bits, held, group, width = bytearray(b"\x1f\x9d" + bytes([0x80 | most])), 0, 0, 0, 9
    table, free = {bytes([i]): i for i in range(256)}, 257

    def put(code: int) -> None:
        nonlocal bits, held, group
        bits, held, group = bits | code << held, held + width, group + 1
        while held >= 8:
            out.append(bits & 255)
            bits, held = bits >> 8, held - 8

    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        if free < 1 << most:
            table[longer] = free
            free += 1
            if free > 1 << width and width < most:
                while group % 8:  # the group is filled up before the width grows
                    put(0)
                width, group = width + 1, 0
        word = data[k : k + 1]
    if word:
        put(table[word])
    if held:
        out.append(bits & 255)
    return bytes(out)


COMPRESS["Z"] = _lzw


def _locked_zip(rows, password: bytes, aes: bool) -> bytes:
    """Deflated members under the traditional cipher or WinZip AES-256 (AE-2)."""
    body, directory = bytearray(), bytearray()
    for name, data in rows:
        deflate = zlib.compressobj(wbits=-15)
        small, crc, raw = deflate.compress(data) + deflate.flush(), zlib.crc32(data), name.encode()
        if aes:
            salt = hashlib.sha256(raw).digest()[:16]
            keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 66)
            hidden = b"".join(counter_mode(Aes(keys[:32]), iter([small])))
            payload = salt + keys[64:] + hidden + hmac.new(keys[32:64], hidden, "sha1").digest()[:10]
            method, extra, crc = 99, struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", 3, 8), 0
        else:
            machine, out = ZipCrypto(password), bytearray()
            for b in bytes(11) + bytes([crc >> 24]) + small:
                t = machine.keys[2] | 2
                out.append(b ^ (t * (t ^ 1)) >> 8 & 255)
                machine._update(b)
            payload, method, extra = bytes(out), 8, b""
        common = struct.pack("<HHIIIIHH", 0x801, method, 0x50210000, crc, len(payload), len(data), len(raw), len(extra))
        directory += b"PK\1\2" + struct.pack("<HH", 0x31E, 20) + common + struct.pack("<HHHII", 0, 0, 0, 0o100644 << 16, len(body)) + raw + extra
        body += b"PK\3\4" + struct.pack("<H", 20) + common + raw + extra + payload
    return bytes(body + directory) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(rows), len(rows), len(directory), len(body), 0)


def chained_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Cipher block chaining over data filled up with zeros."""
    cipher, out = Aes(key), []
    blocks = np.frombuffer(data + bytes(-len(data) % 16), np.uint8).reshape(-1, 16)
    before = np.frombuffer(iv, np.uint8)
    for block in blocks:
        before = cipher.encrypt((block ^ before).reshape(1, 16))[0]
        out.append(before.tobytes())
    return b"".join(out)


def _number(n: int) -> bytes:
    """A 7z number: leading ones of the first byte count the bytes that follow."""
    first, mask = 0, 0x80
    for k in range(8):
        if n < 1 << (7 * (k + 1)):
            return bytes([first | n >> (8 * k)]) + (n & ((1 << (8 * k)) - 1)).to_bytes(k, "little")
        first, mask = first | mask, mask >> 1
    return b"\xff" + n.to_bytes(8, "little")


_LZMA2 = {"id": lzma.FILTER_LZMA2, "preset": 1, "dict_size": 1 << 20}
#: The coders of 7z folders, the last one first: ids, properties, and how the data becomes the packed stream.
SEVENZIP = {
    "copy": [(b"\0", b"", lambda d: d)],
    "lzma": [(b"\3\1\1", b"\x5d" + struct.pack("<I", 1 << 20), lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "preset": 1, "dict_size": 1 << 20}]))],
    "lzma2": [(b"\x21", b"\x10", lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[_LZMA2]))],
    "deflate": [(b"\4\1\x08", b"", lambda d: zlib.compress(d, wbits=-15))],
    "bzip2": [(b"\4\2\2", b"", lambda d: bz2.compress(d, 1))],
    "delta": [(b"\3", b"\3", None), (b"\x21", b"\x10", lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_DELTA, "dist": 4}, _LZMA2]))],
    "bcj": [(b"\3\3\1\3", b"", None), (b"\x21", b"\x10", lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, _LZMA2]))],
}


def _7z(rows, method: str, solid: bool, password: bytes | None = None, anti: tuple[str, ...] = ()) -> bytes:
    """Files with data in one folder, or in one each with its own checksum; a ``lzma``
    archive also packs its header."""
    full, coders = [r for r in rows if r[1]], SEVENZIP[method]
    groups = [full] if solid and full else [[r] for r in full]
    packs, folders, sizes = [], b"", b""
    for group in groups:
        data = b"".join(d for _, d in group)
        small = coders[-1][2](data)
        chain, lengths = [(i, p) for i, p, _ in coders], [len(data)] * len(coders)
        if password is not None:
            iv = hashlib.sha256(data).digest()[:16]
            properties = bytes([0x43, 0x0F]) + iv
            chain.append((b"\6\xf1\7\1", properties))
            lengths.append(len(small))
            small = chained_encrypt(sevenzip_key(properties, password)[0], iv, small)
        folders += _number(len(chain)) + b"".join(bytes([len(i) | (0x20 if p else 0)]) + i + (_number(len(p)) + p if p else b"") for i, p in chain)
        folders += b"".join(_number(k) + _number(k + 1) for k in range(len(chain) - 1))
        sizes += b"".join(map(_number, lengths))
        packs.append(small)
    crc = lambda datas: b"\x0a\1" + b"".join(struct.pack("<I", zlib.crc32(d)) for d in datas)
    header = b"\1"
    if groups:
        header += b"\4\6" + _number(0) + _number(len(packs)) + b"\x09" + b"".join(_number(len(p)) for p in packs) + b"\0"
        header += b"\7\x0b" + _number(len(groups)) + b"\0" + folders + b"\x0c" + sizes + (b"" if solid else crc([d for _, d in full])) + b"\0"
        if solid:
            header += b"\x08\x0d" + _number(len(full)) + (b"\x09" + b"".join(_number(len(d)) for _, d in full[:-1]) if len(full) > 1 else b"") + crc([d for _, d in full]) + b"\0"
        header += b"\0"
    bits = lambda flags: bytes(int("".join("1" if f else "0" for f in flags[i : i + 8]).ljust(8, "0"), 2) for i in range(0, len(flags), 8))
    part = lambda kind, data: bytes([kind]) + _number(len(data)) + data
    empty = [r for r in rows if not r[1]]
    header += b"\5" + _number(len(rows))
    if empty:
        header += part(14, bits([not d for _, d in rows])) + part(15, bits([True] * len(empty)))
        if anti:
            header += part(16, bits([n in anti for n, _ in empty]))
    header += part(17, b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in rows))
    header += part(20, b"\1\0" + struct.pack("<Q", 132223104000000000) * len(rows)) + part(21, b"\1\0" + struct.pack("<I", 0o100640 << 16 | 0x8000) * len(rows)) + b"\0\0"
    body = b"".join(packs)
    if method == "lzma":
        _, properties, encode = SEVENZIP["lzma"][0]
        small = encode(header)
        packed_header = b"\x17\6" + _number(len(body)) + _number(1) + b"\x09" + _number(len(small)) + b"\0"
        packed_header += b"\7\x0b" + _number(1) + b"\0" + _number(1) + b"\x23\3\1\1" + _number(5) + properties + b"\x0c" + _number(len(header)) + crc([header]) + b"\0\0"
        body, header = body + small, packed_header
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + header


def _vint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _rar_block(body: bytes, data: bytes = b"") -> bytes:
    head = _vint(len(body)) + body
    return struct.pack("<I", zlib.crc32(head)) + head + data


RAR5 = b"Rar!\x1a\7\1\0"


def _rar5(rows, password: bytes | None = None, volumes: int = 1, blake: bool = False, versions: bool = False) -> bytes:
    """Stored members; under a password with mixed checksums; members cut over
    ``volumes`` volumes in a row; BLAKE2sp digests; every other member an earlier version of the next."""
    files = []
    for k, (name, data) in enumerate(rows):
        records, crc, stored = [], zlib.crc32(data), data
        if password is not None:
            salt, iv = hashlib.sha256(name.encode()).digest()[:16], hashlib.sha256(data).digest()[:16]
            key, mac, check = rar5_keys(password, salt, 3)
            stored, crc = chained_encrypt(key, iv, data), rar5_mixed_crc(crc, mac)
            records.append(_vint(1) + _vint(0) + _vint(3) + bytes([3]) + salt + iv + check + hashlib.sha256(check).digest()[:4])
        if blake:
            records.append(_vint(2) + _vint(0) + blake2sp(data))
        if versions and k % 2 == 0:
            records.append(_vint(4) + _vint(0) + _vint(k // 2 + 1))
        extra = b"".join(_vint(len(r)) + r for r in records)
        files.append((name.encode(), data, stored, crc, extra))

    def block(f, piece: bytes, flags: int) -> bytes:
        name, data, _, crc, extra = f
        body = _vint(2) + _vint(2 | flags | (1 if extra else 0)) + (_vint(len(extra)) if extra else b"") + _vint(len(piece)) + _vint(6) + _vint(len(data)) + _vint(0o100644) + struct.pack("<II", 1_577_836_800, crc)
        return _rar_block(body + _vint(0) + _vint(1) + _vint(len(name)) + name + extra, piece)

    main, end = _rar_block(_vint(1) + _vint(0) + _vint(0)), _rar_block(_vint(5) + _vint(0) + _vint(0))
    if volumes == 1:
        return RAR5 + main + b"".join(block(f, f[2], 0) for f in files) + end
    out = b""
    for v in range(volumes):  # each volume holds the end of one member and the start of the next
        out += RAR5 + main
        for k, f in enumerate(files):
            first, last = k * (volumes - 1) // max(len(files), 1), (k * (volumes - 1) // max(len(files), 1)) + 1
            half = len(f[2]) // 2
            if v == first:
                out += block(f, f[2][:half], 16) if k + 1 == len(files) or (k + 1) * (volumes - 1) // len(files) != first else block(f, f[2], 0)
            elif v == last and (k + 1 == len(files) or (k + 1) * (volumes - 1) // len(files) != first):
                out += block(f, f[2][half:], 8)
        out += end
    return out


def _rar4(rows) -> bytes:
    """Stored members of the older format."""

    def block(kind: int, flags: int, body: bytes, data: bytes = b"") -> bytes:
        rest = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
        return struct.pack("<H", zlib.crc32(rest) & 0xFFFF) + rest + data

    out = b"Rar!\x1a\7\0" + block(0x73, 0, bytes(6))
    for name, data in rows:
        raw = name.encode()
        body = struct.pack("<IIBIIBBHI", len(data), len(data), 3, zlib.crc32(data), 40 << 25 | 1 << 21 | 1 << 16, 29, 0x30, len(raw), 0o100644) + raw
        out += block(0x74, 0x8000, body, data)
    return out + block(0x7B, 0, b"")


def _iso(rows, joliet: bool) -> bytes:
    """Directories one level deep, with Rock Ridge names and modes, or with Joliet names alone."""
    sector, dirs = 2048, {}
    for name, data in rows:
        folder, _, base = name.rpartition("/")
        dirs.setdefault(folder, []).append((base, data))
    dirs.setdefault("", [])
    both = lambda n, f: struct.pack("<" + f, n) + struct.pack(">" + f, n)

    def record(name: bytes, at: int, size: int, folder: bool, own: bytes = b"") -> bytes:
        own = (b"" if len(name) % 2 else b"\0") + own
        own += b"\0" * ((33 + len(name) + len(own)) % 2)
        return bytes([33 + len(name) + len(own), 0]) + both(at, "I") + both(size, "I") + bytes([120, 1, 1, 0, 0, 0, 0, 2 if folder else 0, 0, 0]) + both(1, "H") + bytes([len(name)]) + name + own

    def rock(name: str, mode: int) -> bytes:
        if joliet:
            return b""
        raw = name.encode()
        return b"PX\x24\1" + both(mode, "I") + both(1, "I") + both(0, "I") + both(0, "I") + b"NM" + bytes([5 + len(raw), 1, 0]) + raw

    def spelt(k: int, name: str, folder: bool) -> bytes:
        return name.encode("utf-16-be") if joliet else b"%s%06d%s" % (b"D" if folder else b"F", k, b"" if folder else b".;1")

    def filled(records: list[bytes]) -> bytes:
        out = b""
        for r in records:
            if len(out) % sector + len(r) > sector:
                out += bytes(-len(out) % sector)
            out += r
        return out + bytes(-len(out) % sector)

    order = sorted(dirs)
    entries = {d: sorted(dirs[d]) for d in order}
    places: dict = {}

    def folder_bytes(d: str) -> bytes:
        mark = b"" if joliet or d else b"SP\7\1\xbe\xef\0"
        own = [record(b"\0", places.get(d, 0), places.get((d, "size"), 0), True, mark), record(b"\1", places.get("", 0), places.get(("", "size"), 0), True)]
        if not d:
            own += [record(spelt(k, x, True), places.get(x, 0), places.get((x, "size"), 0), True, rock(x, 0o040755)) for k, x in enumerate(order) if x]
        return filled(own + [record(spelt(k, n, False), places.get((d, n), 0), len(b), False, rock(n, 0o100640)) for k, (n, b) in enumerate(entries[d])])

    at = 19
    for d in order:
        places[d], places[d, "size"] = at, len(folder_bytes(d))
        at += places[d, "size"] // sector
    body = b""
    for d in order:
        for n, b in entries[d]:
            places[d, n] = at + len(body) // sector
            body += b + bytes(-len(b) % sector)

    def volume(kind: int, escape: bytes) -> bytes:
        v = bytearray(sector)
        v[0:7] = bytes([kind]) + b"CD001\1"
        v[40:72] = b"VOLUME".ljust(32)
        v[88 : 88 + len(escape)] = escape
        v[156:190] = record(b"\0", places[""], places["", "size"], True)[:34]
        return bytes(v)

    heads = volume(1, b"") + (volume(2, b"%/E") if joliet else b"") + (b"\xffCD001\1").ljust(sector, b"\0")
    return (bytes(16 * sector) + heads).ljust(19 * sector, b"\0") + b"".join(map(folder_bytes, order)) + body


def _linked_tar(rows) -> bytes:
    """Each file, and for every fifth a hard link and a symbolic link to it."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for k, (name, data) in enumerate(rows):
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(data), 1_577_836_800, 0o640
            t.addfile(info, io.BytesIO(data))
            if k % 5 == 0:
                for kind, folder, target in ((tarfile.LNKTYPE, "hard", name), (tarfile.SYMTYPE, "soft", "../" + name)):
                    link = tarfile.TarInfo(f"{folder}/{k:06d}")
                    link.type, link.linkname, link.mtime = kind, target, 1_577_836_800
                    t.addfile(link)
    return out.getvalue()


#: The password of archives that have one.
PASSWORD = "correct horse"
_SECRET = PASSWORD.encode()
BUILD = {
    "zip-crypto": lambda rows: _locked_zip(rows, _SECRET, False), "zip-aes": lambda rows: _locked_zip(rows, _SECRET, True), "tar-links": _linked_tar, "rar": _rar5, "rar4": _rar4,
    "rar-locked": lambda rows: _rar5(rows, _SECRET), "rar-volumes": lambda rows: _rar5(rows, volumes=4), "rar-blake": lambda rows: _rar5(rows, blake=True), "rar-versions": lambda rows: _rar5(rows, versions=True),
    "iso": lambda rows: _iso(rows, False), "iso-joliet": lambda rows: _iso(rows, True), "7z-locked": lambda rows: _7z(rows, "lzma2", True, _SECRET), "7z-anti": lambda rows: _7z([*rows, *((n, b"") for n, _ in rows[::4])], "copy", False, anti=tuple(n for n, _ in rows[::4])),
    **{f"7z-{m}": lambda rows, m=m: _7z(rows, m, True) for m in SEVENZIP}, "7z-single": lambda rows: _7z(rows, "lzma2", False),
}


def packed(rows: DataFrame, kind: str = "zip") -> DataFrame:
    """One archive for each ``archive`` of ``rows`` (archive, name, data), members in
    order of name. Kinds: zip, zip-stored, zip-bz2, zip-lzma, tar, tar.gz, tar.bz2, tar.xz, tar.zst, tar.lz4, and those of ``BUILD``.
    An archive's rows meet in one task, so archives must be of bounded size."""

    def build(table: pa.Table) -> pa.Table:
        names, datas = table.column("name").to_pylist(), table.column("data").to_pylist()
        inner = sorted(zip(names, datas), key=lambda r: r[0])
        if kind in BUILD:
            whole = BUILD[kind](inner)
        elif kind.startswith("zip"):
            whole = _zip(inner, {"zip": zipfile.ZIP_DEFLATED, "zip-stored": zipfile.ZIP_STORED, "zip-bz2": zipfile.ZIP_BZIP2, "zip-lzma": zipfile.ZIP_LZMA}[kind])
        else:
            whole = _tar(inner)
            if "." in kind:
                whole = COMPRESS[kind.split(".")[1]](whole)
        return pa.table([table.column("archive").slice(0, 1), pa.array([whole], pa.binary())], names=["path", "content"])

    return rows.groupBy("archive").applyInArrow(build, _OUT)


def compressed(rows: DataFrame, stream: str) -> DataFrame:
    """One bare compressed stream for each row (path, data)."""

    def step(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([COMPRESS[stream](d) for d in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return rows.select("path", "data").mapInArrow(step, _OUT)


def concatenated(rows: DataFrame, stream: str) -> DataFrame:
    """One file for each ``archive`` of ``rows`` (archive, name, data): a compressed stream for each row, in order of name."""

    def build(table: pa.Table) -> pa.Table:
        inner = sorted(zip(table.column("name").to_pylist(), table.column("data").to_pylist()))
        return pa.table([table.column("archive").slice(0, 1), pa.array([b"".join(COMPRESS[stream](d) for _, d in inner)], pa.binary())], names=["path", "content"])

    return rows.groupBy("archive").applyInArrow(build, _OUT)
