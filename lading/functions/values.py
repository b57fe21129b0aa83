"""Times, modes, digests and listing lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lading.functions.names import MARKS, escaped


def filetime_to_timestamp(ticks: Column) -> Column:
    """100 ns ticks since 1601 as a timestamp, in whole microseconds; 0 and null are unset."""
    return F.when(ticks != 0, F.timestamp_micros(F.call_function("div", ticks, F.lit(10)) - F.lit(11_644_473_600_000_000)))


def modified_utc(time: Column, zone: str = "UTC") -> Column:
    """A member's time as an instant; wall-clock times are taken to be of ``zone``."""
    return F.coalesce(time["utc"], F.to_utc_timestamp(time["wall"].cast("timestamp"), zone))


def crc32_digest(crc: Column) -> Column:
    """Four big-endian bytes."""
    return F.unhex(F.lpad(F.hex(crc), 8, "0"))


def strict_mode(mode: Column, kind: Column) -> Column:
    """Directories 755; files without set-id, sticky and execute bits and at most 644."""
    plain = F.least(mode.bitwiseAND(0o666), F.lit(0o644))
    return F.when(kind == "directory", 0o755).when(kind.isin("file", "hardlink"), F.coalesce(plain, F.lit(0o644))).otherwise(mode)


def standard_mode(mode: Column, kind: Column) -> Column:
    """Without set-id and sticky bits."""
    return F.when(kind == "directory", F.coalesce(mode.bitwiseAND(0o777), F.lit(0o755))).when(kind.isin("file", "hardlink"), F.coalesce(mode.bitwiseAND(0o777), F.lit(0o644))).otherwise(mode)


def format_mode(mode: Column) -> Column:
    """``rwxr-xr-x``; dashes for null."""
    bits = [F.when(mode.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.when(mode.isNull(), "---------").otherwise(F.concat(*bits))


def format_size(size: Column) -> Column:
    return F.coalesce(size.cast("string"), F.lit("-"))


def format_mtime(time: Column) -> Column:
    """To the minute, as stored; a dash for null."""
    return F.coalesce(F.date_format(time["wall"], "yyyy-MM-dd HH:mm"), F.date_format(time["utc"], "yyyy-MM-dd HH:mm"), F.lit("-"))


def format_hashes(hashes: Column) -> Column:
    """``algorithm=hex`` in order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(hashes)), lambda e: F.concat(e["key"], F.lit("="), F.lower(F.hex(e["value"])))), " ")


def text_bytes(text: Column) -> Column:
    """Bytes a kept text is counted as: its length if ASCII, else four for each character."""
    return F.coalesce(F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(4 * F.length(text)), F.lit(0))


def member_line(row: dict[str, Column] | None = None, digests: bool = False) -> Column:
    """A listing line of a member: type, status (E encrypted, ~ superseded, -), mode,
    size, time, name and link target, and its digests if asked for."""
    c = row or {k: F.col(k) for k in ("type", "is_encrypted", "is_current", "mode", "size", "modified", "name", "link_target", "hashes")}
    mark = F.lit("?")
    for kind, m in MARKS.items():
        mark = F.when(c["type"] == kind, m).otherwise(mark)
    status = F.when(c["is_encrypted"], "E").when(~c["is_current"], "~").otherwise("-")
    shown = F.when(c["type"].isin("symlink", "hardlink") & c["link_target"].isNotNull(), F.concat(escaped(c["name"]), F.lit(" -> "), escaped(c["link_target"]))).otherwise(escaped(c["name"]))
    size = format_size(c["size"])
    line = F.concat_ws("  ", F.concat(mark, status), format_mode(c["mode"]), F.when(F.length(size) < 10, F.lpad(size, 10, " ")).otherwise(size), format_mtime(c["modified"]), shown)
    return F.when(F.size(c["hashes"]) > 0, F.concat(line, F.lit("  ["), format_hashes(c["hashes"]), F.lit("]"))).otherwise(line) if digests else line


def access_summary(cost: Column) -> Column:
    """The cost of listing and access in words."""
    listing = F.when(cost["listing"] == "requires_decompression", "listing requires decompression").when(cost["listing"] == "requires_scanning", "listing requires scan").otherwise("reading one member may decode earlier members in its block")
    n = cost["solid_block_count"]
    blocks = F.when(n.isNotNull(), F.concat(n.cast("string"), F.when(n == 1, " solid block").otherwise(" solid blocks")))
    solid = F.concat(F.lit("solid ("), F.concat_ws("; ", listing, blocks), F.lit(")"))
    head = F.when(cost["listing"] == "indexed", "random (indexed)").when(cost["listing"] == "requires_scanning", "random (listing requires scan)").otherwise("random (listing requires decompression)")
    return F.when(cost["access"] == "solid", solid).otherwise(head)


def type_predicates(kind: Column) -> dict[str, Column]:
    """``is_file``, ``is_dir``, ``is_link`` (either sort), ``is_other``, ``is_anti``."""
    return {"is_file": kind == "file", "is_dir": kind == "directory", "is_link": kind.isin("symlink", "hardlink"), "is_other": kind == "other", "is_anti": kind == "anti"}
