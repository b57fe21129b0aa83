"""What formats share: the archive that is being read, member rows, and the checks of
listings and of decoded content."""

from __future__ import annotations

import bisect
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from lading.errors import ArchiveError, Corrupt, LimitReached, Truncated, UsageError

_EPOCH = datetime(1970, 1, 1)


@dataclass
class Limits:
    """Bounds of a listing (members, bytes of metadata; None for no bound) and of decoding
    (bytes, ratio and the output from which the ratio counts)."""

    members: int | None = 1_048_576
    metadata: int | None = 64 << 20
    output: int = 2 << 30
    ratio: float = 1000.0
    ratio_from: int = 5 << 20


@dataclass
class Archive:
    """One archive: its id, detected format, options, and what listing finds out."""

    archive_id: str
    container: str
    stream: str = "uncompressed"
    passwords: tuple[bytes, ...] = ()
    fallback_encoding: str = "cp437"
    strict_end: bool = False
    limits: Limits = field(default_factory=Limits)
    size: int | None = None
    comment: str | None = None
    is_encrypted: bool = False
    is_solid: bool = False
    solid_blocks: int | None = None
    extra: dict[str, str] = field(default_factory=dict)
    diagnostics: list[dict] = field(default_factory=list)

    def fits(self, password: bytes) -> bytes:
        """``password``, which from now on is tried first."""
        self.passwords = (password, *(p for p in self.passwords if p != password))
        return password

    def note(self, code: str, message: str, member_id: int | None = None, severity: str = "warning", context: str | None = None) -> None:
        self.diagnostics.append({"archive_id": self.archive_id, "seq": len(self.diagnostics), "code": code, "severity": severity, "member_id": member_id, "message": message, "context": context})


def text_of(raw: bytes) -> tuple[str, bool]:
    """A name as valid text, and whether it had to be rewritten: bytes that aren't UTF-8
    become ``%XX`` and then ``%`` becomes ``%25``, so that the raw name can be had back."""
    try:
        return raw.decode("utf-8"), False
    except UnicodeDecodeError:
        loose = raw.decode("utf-8", "surrogateescape")
        return "".join(f"%{ord(c) - 0xDC00:02X}" if "\udc80" <= c <= "\udcff" else "%25" if c == "%" else c for c in loose), True


def tidy(name: str, kind: str, backslash: bool = False) -> str:
    """A member's name: backslashes of Windows entries are separators, empty and ``.``
    segments go, ``..`` and a leading slash stay, directories end with a slash, and no
    name is empty."""
    if backslash:
        name = name.replace("\\", "/")
    kept = [s for s in name.split("/") if s not in ("", ".")]
    out = ("/" if name.startswith("/") else "") + "/".join(kept) if kept else "."
    return out + "/" if kind == "directory" and out != "." else out


def utc(seconds: float | None) -> dict | None:
    if seconds is None:
        return None
    try:
        return {"wall": None, "utc": (_EPOCH + timedelta(microseconds=round(seconds * 1_000_000))).replace(tzinfo=UTC)}
    except OverflowError:
        return None


def filetime(ticks: int | None) -> dict | None:
    """100 ns ticks since 1601; 0 means unset."""
    if not ticks:
        return None
    try:
        return {"wall": None, "utc": (_EPOCH + timedelta(microseconds=ticks // 10 - 11_644_473_600_000_000)).replace(tzinfo=UTC)}
    except OverflowError:
        return None


def dos_time(value: int) -> dict | None:
    """MS-DOS date and time (date in the high half), local time of an unknown zone."""
    day, clock = value >> 16, value & 0xFFFF
    try:
        return {"wall": datetime((day >> 9) + 1980, day >> 5 & 15, day & 31, clock >> 11, clock >> 5 & 63, min(59, (clock & 31) * 2)), "utc": None}
    except ValueError:
        return None


def crc_bytes(crc: int) -> bytes:
    return (crc & 0xFFFFFFFF).to_bytes(4, "big")


def member(archive: Archive, number: int, **fields) -> dict:
    row = {"archive_id": archive.archive_id, "member_id": number, "name_lossy": False, "compression": [], "is_encrypted": False, "is_current": True, "is_sparse": False, "hashes": {}, "extra": {}, "block": number, "block_position": 0}
    return row | fields


def metadata_bytes(row: dict) -> int:
    """Bytes that a listed member keeps: ASCII text counts its length, other text four times."""
    size = 0
    for v in row.values():
        for x in v.items() if isinstance(v, dict) else [("", v)]:
            for y in x:
                size += (len(y) if y.isascii() else 4 * len(y)) if isinstance(y, str) else len(y) if isinstance(y, bytes) else 0
    return size


def limited(rows: Iterable[dict], limits: Limits) -> Iterator[dict]:
    """The rows until a limit of listings is crossed."""
    size = 0
    for n, row in enumerate(rows, 1):
        size += metadata_bytes(row)
        if limits.members is not None and n > limits.members:
            raise LimitReached(f"more than {limits.members} members")
        if limits.metadata is not None and size > limits.metadata:
            raise LimitReached(f"more than {limits.metadata} bytes of metadata")
        yield row


class _Adler:
    def __init__(self) -> None:
        self.value = 1

    def update(self, data: bytes) -> None:
        self.value = zlib.adler32(data, self.value)

    def digest(self) -> bytes:
        return self.value.to_bytes(4, "big")


class _Crc:
    def __init__(self) -> None:
        self.value = 0

    def update(self, data: bytes) -> None:
        self.value = zlib.crc32(data, self.value)

    def digest(self) -> bytes:
        return self.value.to_bytes(4, "big")


def hasher(algorithm: str):
    """An incremental digest, or None for one that can't be computed here."""
    from lading.functions.digests import Blake2sp

    if algorithm == "crc32":
        return _Crc()
    if algorithm == "adler32":
        return _Adler()
    if algorithm == "blake2sp":
        return Blake2sp()
    return hashlib.new(algorithm) if algorithm in hashlib.algorithms_available else None


def verified(chunks: Iterable[bytes], row: dict, archive: Archive) -> Iterator[tuple[bytes, str | None]]:
    """The chunks, and with the last (possibly empty) one the verdict ``ok`` or
    ``unverified``; raises if the length or a stored digest differs or a limit is crossed."""
    known = {a: h for a in row["hashes"] if (h := hasher(a))}
    for a in row["hashes"]:
        if a not in known:
            archive.note("digest_unverifiable", f"digest {a} can't be computed", row["member_id"])
    size, limits = 0, archive.limits
    for data in chunks:
        size += len(data)
        for h in known.values():
            h.update(data)
        if row["size"] is not None and size > row["size"]:
            raise Corrupt(f"more data than the declared {row['size']} bytes", row["name"])
        if size > limits.output:
            raise LimitReached(f"more than {limits.output} bytes of output", row["name"])
        packed = row["compressed_size"]
        if packed and size > limits.ratio_from and size > limits.ratio * packed:
            raise LimitReached(f"output is over {limits.ratio:g} times the input", row["name"])
        yield data, None
    if row["size"] is not None and size < row["size"]:
        raise Truncated(f"{size} of the declared {row['size']} bytes", row["name"])
    for a, h in known.items():
        if h.digest() != row["hashes"][a]:
            raise Corrupt(f"{a} differs from the stored digest", row["name"])
    yield b"", "ok" if known else "unverified"


def exactly(src, n: int, what: str) -> bytes:
    data = src.read(n)
    if len(data) < n:
        raise Truncated(f"{what} ends early")
    return data


def window(src, start: int, size: int) -> Iterator[bytes]:
    """``size`` bytes of a seekable file from ``start`` in chunks."""
    src.seek(start)
    while size:
        data = src.read(min(size, 1 << 20))
        if not data:
            raise Truncated("the archive ends inside a member")
        size -= len(data)
        yield data


def guarded(rows: Iterable, fault: type[ArchiveError] = Corrupt) -> Iterator:
    """Parsing faults of a hostile archive as an archive error."""
    import struct

    try:
        yield from rows
    except (struct.error, IndexError, KeyError, OverflowError, UnicodeError, ValueError, MemoryError) as e:
        raise fault(f"{type(e).__name__}: {e}") from e


class Joined(io.RawIOBase):
    """Seekable files in a row, such as volumes, as one; no more of them is read than is asked for."""

    def __init__(self, parts: list):
        self.parts, self.starts, total = parts, [], 0
        for p in parts:
            self.starts.append(total)
            total += p.seek(0, io.SEEK_END)
        self.total, self.at = total, 0

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = max(0, at + (0, self.at, self.total)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        left, out = self.total - self.at if n is None or n < 0 else n, []
        while left > 0 and self.at < self.total:
            k = bisect.bisect_right(self.starts, self.at) - 1
            self.parts[k].seek(self.at - self.starts[k])
            if not (data := self.parts[k].read(left)):
                break
            out.append(data)
            self.at, left = self.at + len(data), left - len(data)
        return b"".join(out)


class Peekable(io.RawIOBase):
    """A stream that can't seek, such as a pipe, whose start may be read again: seeking
    back works as far as what was read is held, at most ``keep`` bytes; reading on needs no more."""

    def __init__(self, src, keep: int = 4 << 20):
        self.src, self.keep, self.held, self.at, self.lost = src, keep, b"", 0, 0

    def seek(self, at: int, whence: int = 0) -> int:
        if whence == io.SEEK_END:
            raise UsageError("a stream's end isn't known")
        at += self.at if whence else 0
        if at < self.lost:
            raise UsageError("a stream can't go back so far")
        while at > self.lost + len(self.held):
            if not self._more(min(1 << 20, at - self.lost - len(self.held))):
                break
        self.at = at
        return at

    def tell(self) -> int:
        return self.at

    def _more(self, n: int) -> bool:
        data = self.src.read(n)
        self.held += data or b""
        return bool(data)

    def read(self, n: int = -1) -> bytes:
        while n is None or n < 0 or self.lost + len(self.held) < self.at + n:
            if not self._more(1 << 16 if n is None or n < 0 else self.at + n - self.lost - len(self.held)):
                break
        begin = self.at - self.lost
        out = self.held[begin:] if n is None or n < 0 else self.held[begin : begin + n]
        self.at += len(out)
        if len(self.held) > 2 * self.keep:
            cut = max(0, min(len(self.held) - self.keep, self.at - self.lost - self.keep))
            self.held, self.lost = self.held[cut:], self.lost + cut
        return out
