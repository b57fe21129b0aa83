"""Format detection: exact signatures as column expressions, then bounded probes."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.errors import ArchiveError
from lading.sources.codecs import STREAMS, DecodedFile

# Signatures by place, in the order in which they are tried.
MAGIC = (
    (0, b"PK\x03\x04", "zip", "uncompressed"), (0, b"PK\x05\x06", "zip", "uncompressed"), (0, b"PK\x07\x08", "zip", "uncompressed"),
    (257, b"ustar", "tar", "uncompressed"),
    (0, b"7z\xbc\xaf\x27\x1c", "7z", "uncompressed"),
    (0, b"Rar!\x1a\x07\x01\x00", "rar", "uncompressed"), (0, b"Rar!\x1a\x07\x00", "rar", "uncompressed"),
    (0, b"\x1f\x8b", "raw_stream", "gz"), (0, b"BZh", "raw_stream", "bz2"), (0, b"\xfd7zXZ\x00", "raw_stream", "xz"), (0, b"LZIP", "raw_stream", "lz"),
    (0, b"\x28\xb5\x2f\xfd", "raw_stream", "zst"), (0, b"\x04\x22\x4d\x18", "raw_stream", "lz4"), (0, b"\x1f\x9d", "raw_stream", "Z"),
)
FAR_MAGIC = ((32769, b"CD001", "iso", "uncompressed"),)
# Name endings, the longest that fits counts.
EXTENSIONS = {
    ".zip": ("zip", "uncompressed"), ".tar": ("tar", "uncompressed"), ".7z": ("7z", "uncompressed"), ".rar": ("rar", "uncompressed"), ".iso": ("iso", "uncompressed"),
    ".gz": ("raw_stream", "gz"), ".bz2": ("raw_stream", "bz2"), ".xz": ("raw_stream", "xz"), ".zst": ("raw_stream", "zst"), ".lz4": ("raw_stream", "lz4"), ".lz": ("raw_stream", "lz"), ".lzma": ("raw_stream", "lzma"),
    ".zz": ("raw_stream", "zz"), ".zlib": ("raw_stream", "zz"), ".br": ("raw_stream", "br"), ".z": ("raw_stream", "Z"),
    ".tar.gz": ("tar", "gz"), ".tgz": ("tar", "gz"), ".tar.bz2": ("tar", "bz2"), ".tbz2": ("tar", "bz2"), ".tbz": ("tar", "bz2"), ".tar.xz": ("tar", "xz"), ".txz": ("tar", "xz"), ".tar.zst": ("tar", "zst"), ".tzst": ("tar", "zst"),
    ".tar.lz4": ("tar", "lz4"), ".tar.lz": ("tar", "lz"), ".tlz": ("tar", "lz"), ".tar.lzma": ("tar", "lzma"), ".tar.br": ("tar", "br"), ".tar.z": ("tar", "Z"), ".tar.zz": ("tar", "zz"),
}
#: Decoded bytes in which a tar header is looked for, and input that a probe may read.
PROBE = 1 << 20
#: What is read of a file to identify it: past ISO's signature, and a probe's worth.
HEAD = PROBE + 32774


def _pair(container: str, stream: str) -> Column:
    return F.struct(F.lit(container).alias("container"), F.lit(stream).alias("stream"))


def _first(cases: list[tuple[Column, str, str]]) -> Column:
    """The format of the first condition that holds, in one flat CASE."""
    out = F
    for condition, container, stream in cases:
        out = out.when(condition, _pair(container, stream))
    return out


def by_magic(content: Column, table=MAGIC) -> Column:
    """The first signature that fits, as a format; null without one."""
    return _first([(F.substring(content, offset + 1, len(magic)) == F.lit(magic), container, stream) for offset, magic, container, stream in table])


def by_extension(path: Column) -> Column:
    """The format of the longest ending that fits; null without one."""
    return _first([(F.lower(path).endswith(end), container, stream) for end, (container, stream) in sorted(EXTENSIONS.items(), key=lambda e: -len(e[0]))])


def _decodes(head: bytes, stream: str) -> bool:
    """Whether a bounded prefix decodes to something before it fails or ends."""
    try:
        return bool(DecodedFile(STREAMS[stream](io.BytesIO(head))).read(1))
    except ArchiveError:
        return False


def probed(head: bytes) -> str | None:
    """The stream of content without a signature: zlib by its checked header, LZMA alone
    by plausible properties, Brotli by decoding."""
    if len(head) >= 2 and head[0] & 15 == 8 and head[0] >> 4 <= 7 and int.from_bytes(head[:2], "big") % 31 == 0 and not head[1] & 32 and _decodes(head, "zz"):
        return "zz"
    if len(head) >= 14 and head[0] < 225 and _lzma_plausible(head) and _decodes(head, "lzma"):
        return "lzma"
    if len(head) >= 2 and _brotli_starts(head) and _decodes(head, "br"):
        return "br"
    return None


def _lzma_plausible(head: bytes) -> bool:
    dictionary, size = int.from_bytes(head[1:5], "little"), int.from_bytes(head[5:13], "little")
    power = dictionary and (dictionary & (dictionary - 1) == 0 or (dictionary // 3 * 3 == dictionary and (dictionary // 3) & (dictionary // 3 - 1) == 0) or dictionary == 0xFFFFFFFF)
    return bool(power) and head[13] == 0 and (size == 2**64 - 1 or size < 1 << 40)


def _brotli_starts(head: bytes) -> bool:
    """Text is full of bytes that also start Brotli streams, so printable starts don't count."""
    return not all(32 <= b < 127 or b in (9, 10, 13) for b in head[:16])


def holds_tar(head: bytes, stream: str) -> bool:
    """Whether the decoded stream has a tar header at its start."""
    try:
        data = DecodedFile(STREAMS[stream](io.BytesIO(head))).read(512)
    except ArchiveError:
        return False
    return data[257:262] == b"ustar"


def identify(path: str, head: bytes) -> tuple[str, str, str, str, int]:
    """(container, stream, confidence, detected_by, payload offset) of content and name:
    near signatures, probes, far signatures, the name's ending, else unknown."""

    def first(table):
        return next(((c, s) for o, m, c, s in table if head[o : o + len(m)] == m), None)

    found, sure, how = first(MAGIC), "certain", "magic"
    if not found and (stream := probed(head[:PROBE])):
        found, sure, how = ("raw_stream", stream), "probable", "content_probe"
    if not found:
        found = first(FAR_MAGIC)
    if found:
        if found[0] == "raw_stream" and holds_tar(head[:PROBE], found[1]):
            return "tar", found[1], "probable", "content_probe", 0
        return *found, sure, how, 0
    if head[:2] == b"MZ" or head[:4] == b"\x7fELF":
        for magic, container in ((b"Rar!\x1a\x07", "rar"), (b"7z\xbc\xaf\x27\x1c", "7z")):
            if (at := head.find(magic)) > 0:
                return container, "uncompressed", "probable", "sfx_scan", at
    for end, (container, stream) in sorted(EXTENSIONS.items(), key=lambda e: -len(e[0])):
        if path.lower().endswith(end):
            return container, stream, "guess", "extension", 0
    return "unknown", "uncompressed", "guess", "none", 0


_OUT = "path string, container string, stream string, confidence string, detected_by string, payload_offset long"


def detect(files: DataFrame) -> DataFrame:
    """``path``, ``format``, ``confidence``, ``detected_by``, ``payload_offset`` and
    ``extension_conflict`` of ``files`` (path, content). Containers with a signature are
    settled by column expressions; of compressed streams and what has no signature the
    head goes through the probes. ``format('archive')`` with the view ``formats`` reads no more than heads."""
    found = by_magic(F.col("content"))
    sure = F.coalesce(found["container"] != "raw_stream", F.lit(False))
    # the heads of files that are settled don't go to Python
    rows = files.select("path", F.when(sure, found["container"]).alias("container"), F.when(sure, F.lit(None).cast("binary")).otherwise(F.substring("content", 1, HEAD)).alias("head"))
    schema = pa.schema([("path", pa.string()), *((k, pa.string()) for k in ("container", "stream", "confidence", "detected_by")), ("payload_offset", pa.int64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, c, "uncompressed", "certain", "magic", 0) if c else (p, *identify(p, bytes(h or b""))) for p, c, h in zip(*(x.to_pylist() for x in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    out = rows.mapInArrow(probe, _OUT).select("path", F.struct("container", "stream").alias("format"), "confidence", "detected_by", "payload_offset", by_extension(F.col("path")).alias("_named"))
    named = F.col("_named")
    benign = (F.col("format.container") == "raw_stream") & (named["container"] == "tar") & (named["stream"] == F.col("format.stream"))
    return out.withColumn("extension_conflict", F.coalesce((named != F.col("format")) & ~benign & (F.col("detected_by") != "extension"), F.lit(False))).drop("_named")
