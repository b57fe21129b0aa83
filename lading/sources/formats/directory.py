"""A directory tree as an archive: files before subdirectories, names in order."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

from lading.errors import ArchiveError
from lading.sources.base import Archive, member, text_of, tidy, utc


def _walk(root: str, inner: str = "") -> Iterator[tuple[str, os.stat_result]]:
    try:
        entries = sorted(os.scandir(os.path.join(root, inner)), key=lambda e: (e.is_dir(follow_symlinks=False), e.name))
    except FileNotFoundError:
        yield inner, None
        return
    for e in entries:
        path = os.path.join(inner, e.name)
        try:
            status = e.stat(follow_symlinks=False)
        except FileNotFoundError:
            yield path, None
            continue
        yield path, status
        if stat.S_ISDIR(status.st_mode):
            yield from _walk(root, path)


def listing(root: str, archive: Archive) -> Iterator[dict]:
    number, seen = 0, {}
    for path, status in _walk(root):
        if status is None:
            archive.note("scan_race", f"{path} vanished while it was listed")
            continue
        mode = status.st_mode
        kind = "symlink" if stat.S_ISLNK(mode) else "directory" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"
        raw, target = os.fsencode(path), None
        same = (status.st_dev, status.st_ino)
        if kind == "file" and status.st_nlink > 1 and same in seen:
            kind, target = "hardlink", seen[same]
        elif kind == "symlink":
            target = text_of(os.fsencode(os.readlink(os.path.join(root, path))))[0]
        name, lossy = text_of(raw)
        if kind == "file" and status.st_nlink > 1:
            seen[same] = name
        yield member(
            archive, number, type=kind, name=tidy(name, kind), name_lossy=lossy, raw_name=raw, size=status.st_size if kind == "file" else None, compressed_size=status.st_size if kind == "file" else None,
            modified=utc(status.st_mtime_ns / 1e9), accessed=utc(status.st_atime_ns / 1e9), mode=stat.S_IMODE(mode), uid=status.st_uid, gid=status.st_gid, link_target=target, create_system="unix",
        )
        number += 1


def content(root: str, archive: Archive, wanted: Iterable[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    def chunks(path: bytes) -> Iterator[bytes]:
        try:
            with open(path, "rb") as f:
                while data := f.read(1 << 20):
                    yield data
        except OSError as e:
            raise ArchiveError(str(e)) from e

    for row in wanted:
        yield row, chunks(os.path.join(os.fsencode(root), row["raw_name"]))


def cost(archive: Archive) -> dict:
    return {"listing": "requires_scanning", "access": "direct", "solid_block_count": None}
