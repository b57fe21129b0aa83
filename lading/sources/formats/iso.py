"""ISO 9660: Rock Ridge names and attributes if there, else Joliet names, else plain ones."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta, timezone

from lading.errors import Corrupt
from lading.sources.base import Archive, exactly, member, text_of, tidy, window

SECTOR = 2048


def _stamp(d: bytes) -> dict | None:
    """Seven bytes: years since 1900, month, day, hour, minute, second, quarters of an hour from UTC."""
    try:
        when = datetime(1900 + d[0], d[1], d[2], d[3], d[4], d[5], tzinfo=timezone(timedelta(minutes=15 * struct.unpack("b", d[6:7])[0])))
        return {"wall": None, "utc": when.astimezone(UTC)}
    except (ValueError, IndexError, OverflowError):
        return None


def _volumes(src) -> tuple[bytes, bytes | None]:
    plain = joliet = None
    for sector in range(16, 16 + 64):
        src.seek(sector * SECTOR)
        d = exactly(src, SECTOR, "a volume descriptor")
        if d[1:6] != b"CD001":
            raise Corrupt("no volume descriptor")
        if d[0] == 255:
            break
        if d[0] == 1 and plain is None:
            plain = d
        elif d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
            joliet = d
    if plain is None:
        raise Corrupt("no primary volume descriptor")
    return plain, joliet


def _fields(src, area: bytes, depth: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """System use entries, with those of continuation areas."""
    at = 0
    while at + 4 <= len(area) and area[at + 2] >= 4 and at + area[at + 2] <= len(area):
        kind, data = area[at : at + 2], area[at + 4 : at + area[at + 2]]
        if kind == b"ST":
            return
        if kind == b"CE" and len(data) >= 24 and depth < 32:
            block, offset, size = (struct.unpack("<I", data[i : i + 4])[0] for i in (0, 8, 16))
            src.seek(block * SECTOR + offset)
            yield from _fields(src, src.read(min(size, SECTOR)), depth + 1)
        else:
            yield kind, data
        at += area[at + 2]


def _rock_ridge(src, area: bytes) -> dict:
    out: dict = {}
    for kind, d in _fields(src, area):
        if kind == b"NM" and d[:1] and not d[0] & 6:
            out["name"] = out.get("name", b"") + d[1:]
        elif kind == b"PX" and len(d) >= 32:
            out["mode"], out["uid"], out["gid"] = (struct.unpack("<I", d[i : i + 4])[0] for i in (0, 16, 24))
        elif kind == b"SL" and d[:1]:
            parts, at = out.setdefault("link", []), 1
            while at + 2 <= len(d):
                flags, text = d[at], d[at + 2 : at + 2 + d[at + 1]]
                text = b".." if flags & 4 else b"." if flags & 2 else b"" if flags & 8 else text
                if out.pop("joined", False) and parts:
                    parts[-1] += text
                else:
                    parts.append(text)
                out["joined"] = bool(flags & 1)
                at += 2 + d[at + 1]
        elif kind == b"TF" and d[:1]:
            at, width = 1, 17 if d[0] & 0x80 else 7
            for bit, name in enumerate(("created", "modified", "accessed")):
                if d[0] >> bit & 1 and width == 7:
                    out[name] = _stamp(d[at : at + 7])
                at += width if d[0] >> bit & 1 else 0
    return out


def listing(src, archive: Archive) -> Iterator[dict]:
    plain, joliet = _volumes(src)
    archive.comment = plain[40:72].decode("ascii", "replace").strip() or None
    root = plain[156:190]
    src.seek(struct.unpack("<I", root[2:6])[0] * SECTOR)
    first = exactly(src, SECTOR, "the root directory")
    area = first[34 : first[0]] if first[0] >= 34 else b""
    rock = any(k in (b"SP", b"RR", b"PX", b"ER") for k, _ in _fields(src, area))
    start = root if rock or not joliet else joliet[156:190]
    wide = not rock and joliet is not None
    archive.extra["iso.names"] = "rock_ridge" if rock else "joliet" if wide else "iso9660"
    seen, number = set(), 0

    def walk(record: bytes, inside: bytes) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
        block, size = struct.unpack("<I", record[2:6])[0], struct.unpack("<I", record[10:14])[0]
        if block in seen:
            archive.note("directory_cycle", f"directory at block {block} met twice")
            return
        seen.add(block)
        src.seek(block * SECTOR)
        data, at, below, pieces = src.read(size), 0, [], []
        while at < len(data):
            n = data[at]
            if n < 34:
                at = (at // SECTOR + 1) * SECTOR
                continue
            r = data[at : at + n]
            at += n
            raw = r[33 : 33 + r[32]]
            if raw in (b"\0", b"\1"):
                continue
            pieces.append((struct.unpack("<I", r[2:6])[0], struct.unpack("<I", r[10:14])[0]))
            if r[25] & 0x80:
                continue
            yield r, inside, pieces
            if r[25] & 2:
                below.append((r, inside))
            pieces = []
        for r, d in below:
            yield from walk(r, d + _name(src, r, rock, wide) + b"/")

    for r, inside, pieces in walk(start, b""):
        own = _rock_ridge(src, _area(r)) if rock else {}
        raw = inside + _name(src, r, rock, wide)
        mode = own.get("mode")
        form = mode & 0o170000 if mode is not None else 0
        kind = "symlink" if form == 0o120000 else "directory" if r[25] & 2 else "file" if form in (0, 0o100000) else "other"
        name, lossy = text_of(raw)
        size = sum(n for _, n in pieces) if kind == "file" else None
        yield member(
            archive, number, type=kind, name=tidy(name, kind), name_lossy=lossy, raw_name=raw, size=size, compressed_size=size, modified=own.get("modified") or _stamp(r[18:25]), accessed=own.get("accessed"), created=own.get("created"),
            mode=mode & 0o7777 if mode is not None else None, uid=own.get("uid"), gid=own.get("gid"), link_target=text_of(_joined(own["link"]))[0] if own.get("link") and kind == "symlink" else None,
            extra={"iso.extents": ",".join(f"{b}:{n}" for b, n in pieces)},
        )
        number += 1


def _joined(parts: list[bytes]) -> bytes:
    return b"/" + b"/".join(parts[1:]) if parts[:1] == [b""] else b"/".join(parts)


def _area(r: bytes) -> bytes:
    return r[33 + r[32] + (1 - r[32] % 2) :]


def _name(src, r: bytes, rock: bool, wide: bool) -> bytes:
    raw = r[33 : 33 + r[32]]
    if rock and (name := _rock_ridge(src, _area(r)).get("name")):
        return name
    if wide:
        return raw.decode("utf-16-be", "replace").rsplit(";", 1)[0].encode()
    return raw.rsplit(b";", 1)[0].rstrip(b".")


def content(src, archive: Archive, wanted: Iterable[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    for row in wanted:
        def chunks(row=row):
            for piece in filter(None, row["extra"]["iso.extents"].split(",")):
                block, size = map(int, piece.split(":"))
                yield from window(src, block * SECTOR, size)

        yield row, chunks()


def cost(archive: Archive) -> dict:
    return {"listing": "indexed", "access": "direct", "solid_block_count": None}
