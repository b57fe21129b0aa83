"""TAR: one forward pass over 512-byte blocks, with GNU long names and PAX records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from lading.errors import Corrupt, Truncated
from lading.sources.base import Archive, exactly, member, text_of, tidy, utc
from lading.sources.codecs import decoded

BLOCK = 512
# Types by their flag.
KINDS = {b"0": "file", b"\0": "file", b"7": "file", b"S": "file", b"1": "hardlink", b"2": "symlink", b"5": "directory", b"3": "other", b"4": "other", b"6": "other"}


def _number(field: bytes) -> int:
    """Octal text, or base 256 if the first bit is set."""
    if field[:1] and field[0] & 0x80:
        n = int.from_bytes(field, "big") & ((1 << (8 * len(field) - 1)) - 1)
        return n - (1 << (8 * len(field) - 1)) if field[0] & 0x40 else n
    text = field.split(b"\0", 1)[0].strip()
    return int(text, 8) if text else 0


def _cut(field: bytes) -> bytes:
    return field.split(b"\0", 1)[0]


def _sound(head: bytes) -> bool:
    """Whether the header's checksum holds, by unsigned or by signed bytes."""
    try:
        want = _number(head[148:156])
    except ValueError:
        return False
    rest = head[:148] + b" " * 8 + head[156:]
    return want in (sum(rest), sum(b - 256 if b > 127 else b for b in rest))


def _records(data: bytes) -> dict[bytes, bytes]:
    """PAX records: length, space, keyword = value, newline."""
    out = {}
    while data.strip(b"\0"):
        size, _, _ = data.partition(b" ")
        n = int(size)
        if n <= len(size) + 1 or n > len(data):
            raise Corrupt("a PAX record")
        key, _, value = data[len(size) + 1 : n - 1].partition(b"=")
        out[key] = value
        data = data[n:]
    return out


def _skip(src, n: int) -> None:
    while n:
        got = src.read(min(n, 1 << 20))
        if not got:
            raise Truncated("the archive ends inside a member")
        n -= len(got)


def _walk(src, archive: Archive) -> Iterator[tuple[dict, int]]:
    """(member row, bytes of data that follow); the caller reads or skips data and padding."""
    number, shared, own, long_name, long_link = 0, {}, {}, None, None
    while True:
        head = src.read(BLOCK)
        if len(head) < BLOCK or not head.strip(b"\0"):
            if head and len(head) < BLOCK:
                raise Truncated("a header ends early")
            if not head:
                archive.note("archive_eof", "the end marker is missing")
                if archive.strict_end:
                    raise Truncated("the end marker is missing")
            return
        if not _sound(head):
            raise Corrupt("a header's checksum is wrong")
        flag, size = head[156:157], _number(head[124:136])
        if flag in b"xgLK" and flag:
            data = exactly(src, size, "an extended header")
            _skip(src, -size % BLOCK)
            if flag == b"g":
                shared |= _records(data)
            elif flag == b"x":
                own = _records(data)
            elif flag == b"L":
                long_name = _cut(data)
            else:
                long_link = _cut(data)
            continue
        pax = shared | own
        prefix = _cut(head[345:500]) if head[257:263] == b"ustar\0" else b""
        raw = pax.get(b"path") or long_name or (prefix + b"/" if prefix else b"") + _cut(head[:100])
        target = pax.get(b"linkpath") or long_link or _cut(head[157:257])
        size = int(pax[b"size"]) if pax.get(b"size") else size
        kind = KINDS.get(flag, "file")
        if kind == "file" and flag in (b"0", b"\0") and raw.endswith(b"/"):
            kind = "directory"
        stored = size if kind == "file" else 0
        sparse = flag == b"S" or any(k.startswith(b"GNU.sparse") for k in pax)
        holes, full, raw = [], size, pax.get(b"GNU.sparse.name", raw)
        if flag == b"S":
            holes, full = _old_sparse(src, head)
        elif sparse:
            full = int(pax.get(b"GNU.sparse.realsize") or pax.get(b"GNU.sparse.size") or size)
            if flat := pax.get(b"GNU.sparse.map"):
                v = [int(x) for x in flat.split(b",")]
                holes = list(zip(v[::2], v[1::2]))
            elif pax.get(b"GNU.sparse.major") == b"1":
                holes = None
        name, lossy = text_of(raw)
        shown = tidy(name, kind)
        if shown != name:
            archive.note("name_normalized", name, number, "info")
        uname, gname = pax.get(b"uname", _cut(head[265:297])), pax.get(b"gname", _cut(head[297:329]))
        owner = [int(pax[k]) if pax.get(k) else _number(head[a:b]) for k, a, b in ((b"uid", 108, 116), (b"gid", 116, 124))]
        yield member(
            archive, number, type=kind, name=shown, name_lossy=lossy, raw_name=raw, size=full if kind == "file" else None, compressed_size=None, modified=utc(float(pax.get(b"mtime") or _number(head[136:148]))),
            accessed=utc(float(pax[b"atime"])) if pax.get(b"atime") else None, created=utc(float(pax[b"ctime"])) if pax.get(b"ctime") else None, mode=_number(head[100:108]) & 0o7777, uid=owner[0], gid=owner[1],
            uname=text_of(uname)[0] or None, gname=text_of(gname)[0] or None, comment=text_of(pax[b"comment"])[0] if pax.get(b"comment") else None, link_target=text_of(target)[0] if kind in ("symlink", "hardlink") else None,
            is_sparse=sparse, block=0 if archive.stream != "uncompressed" else number, block_position=number if archive.stream != "uncompressed" else 0,
            extra={f"tar.pax.{text_of(k)[0]}": text_of(v)[0] for k, v in pax.items()}, _holes=holes,
        ), stored
        number, own, long_name, long_link = number + 1, {}, None, None


def _old_sparse(src, head: bytes) -> tuple[list[tuple[int, int]], int]:
    pieces, more, full = [head[386 + 24 * i : 410 + 24 * i] for i in range(4)], head[482], _number(head[483:495])
    while more:
        block = exactly(src, BLOCK, "a sparse map")
        pieces += [block[24 * i : 24 * i + 24] for i in range(21)]
        more = block[504]
    return [(_number(p[:12]), _number(p[12:])) for p in pieces if p.strip(b"\0")], full


def listing(src, archive: Archive) -> Iterator[dict]:
    file = decoded(src, archive.stream)
    archive.is_solid = archive.stream != "uncompressed"
    archive.solid_blocks = 1 if archive.is_solid else None
    for row, size in _walk(file, archive):
        row.pop("_holes")
        yield row
        _skip(file, size + -size % BLOCK)


def content(src, archive: Archive, wanted: Iterable[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """One pass; it stops after the last member that is wanted. With ``strict_end`` a
    member is whole only if the block that its data ends in is."""
    ids = {r["member_id"] for r in wanted}
    if not ids:
        return
    last, file = max(ids), decoded(src, archive.stream)
    for row, size in _walk(file, archive):
        holes = row.pop("_holes")
        left = [size, -size % BLOCK]

        def data(n: int | None = None) -> Iterator[bytes]:
            n = left[0] if n is None else n
            while n:
                got = file.read(min(n, 1 << 20))
                if not got:
                    raise Truncated("the archive ends inside a member")
                n, left[0] = n - len(got), left[0] - len(got)
                yield got

        def padded(chunks: Iterator[bytes]) -> Iterator[bytes]:
            yield from chunks
            for _ in data():
                pass
            _skip(file, left[1])
            left[1] = 0

        if row["member_id"] in ids and row["type"] == "file":
            chunks = _filled(data, row["size"], holes) if row["is_sparse"] else data()
            yield row, padded(chunks) if archive.strict_end else chunks
        for _ in data():
            pass
        _skip(file, left[1])
        if row["member_id"] >= last:
            return


def _filled(data, full: int, holes) -> Iterator[bytes]:
    """A sparse file's bytes, zeros in its holes."""
    if holes is None:  # the map stands before the data, as decimal lines in whole blocks
        text, used = b"", 0

        def line() -> int:
            nonlocal text, used
            while b"\n" not in text:
                text += b"".join(data(BLOCK))
                used += BLOCK
            first, _, text = text.partition(b"\n")
            return int(first)

        holes = [(line(), line()) for _ in range(line())]
    at = 0
    for start, size in holes:
        while at < start:
            n = min(start - at, 1 << 20)
            yield bytes(n)
            at += n
        for got in data(size):
            yield got
            at += len(got)
    while at < full:
        n = min(full - at, 1 << 20)
        yield bytes(n)
        at += n


def cost(archive: Archive) -> dict:
    if archive.stream == "uncompressed":
        return {"listing": "requires_scanning", "access": "direct", "solid_block_count": None}
    return {"listing": "requires_decompression", "access": "solid", "solid_block_count": 1}
