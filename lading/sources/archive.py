"""Archives as tables: ``archives``, ``members``, ``content`` and ``diagnostics`` of a
table of files, and the data sources ``archive`` and ``archive_stream`` over paths."""

from __future__ import annotations

import fnmatch
import io
import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lading import schema as S
from lading.errors import ArchiveError, DetectionError, UnsupportedFormat, UsageError
from lading.sources.base import Archive, Joined, Limits, guarded, hasher, limited, verified
from lading.sources.codecs import STREAMS
from lading.sources.detect import HEAD, identify
from lading.sources.formats import MODULES, handler
from lading.sources.volumes import volume_place

_MEMBERS, _CONTENT, _ARCHIVES, _DIAGNOSTICS = (to_arrow_schema(s) for s in (S.MEMBERS, S.CONTENT, S.ARCHIVES, S.DIAGNOSTICS))
#: Rows of the data source's view of formats.
FORMATS = S._struct(**{k: S.T.StringType() for k in ("path", "container", "stream", "confidence", "detected_by")}, payload_offset=S.T.LongType())
_FORMATS = to_arrow_schema(FORMATS)
#: Rows and bytes of content in a batch.
ROWS, BYTES = 4096, 8 << 20
_OPTIONS = {"passwords", "fallback_encoding", "strict_end", "limits", "format", "listing", "byte_offset"}


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path``, ``content`` of all files under ``paths``, from any file system that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")


def opened(path: str, src, options: dict) -> tuple[Archive, object]:
    """The archive at ``path`` and the file to read it from."""
    if unknown := set(options) - _OPTIONS:
        raise UsageError(f"unknown options: {sorted(unknown)}")
    limits = options.get("limits") or (Limits(members=None, metadata=None) if src is None else Limits())  # a directory's listing holds no members
    given = options.get("passwords", ())  # a list, or a function of the path that gives one
    more = {"passwords": tuple(p.encode() if isinstance(p, str) else p for p in (given(path) if callable(given) else given)), "fallback_encoding": options.get("fallback_encoding", "cp437"), "strict_end": options.get("strict_end", False), "limits": limits}
    if src is None:
        if not os.path.isdir(path):
            raise DetectionError("not a directory")
        return Archive(path, "directory", **more), path
    if start := options.get("byte_offset", 0):
        src = _Part(src, start)
    src.seek(0)
    head = src.read(HEAD)
    if fixed := options.get("format"):
        container, stream = fixed
        sure, how, at = "certain", "given", 0
    else:
        container, stream, sure, how, at = identify(path, head)
    src.seek(0)
    archive = Archive(path, container, stream, **more)
    archive.extra |= {"confidence": sure, "detected_by": how, "payload_offset": str(at)}
    if container == "unknown":
        raise DetectionError("no signature and no usable ending")
    return archive, _Part(src, at) if at and container != "rar" else src


class _Part(io.RawIOBase):
    """A file from a place on."""

    def __init__(self, src, start: int):
        self.src, self.start = src, start
        src.seek(start)

    def seek(self, at: int, whence: int = 0) -> int:
        return self.src.seek(at + self.start if whence == 0 else at, whence) - self.start

    def tell(self) -> int:
        return self.src.tell() - self.start

    def read(self, n: int = -1) -> bytes:
        return self.src.read(n)


def list_members(path: str, src, options: dict, state: dict | None = None) -> Iterator[dict]:
    """Member rows up to a fault, which goes to ``state['error']``, the archive to
    ``state['archive']``; without a ``state`` that takes the fault, it is raised after them."""
    try:
        archive, src = opened(path, src, options)
        if state is not None:
            state["archive"] = archive
        module = handler(archive.container)
        for row in limited(guarded(module.listing(src, archive)), archive.limits):
            if row["type"] == "symlink" and row.get("link_target") is None and hasattr(module, "link_target"):
                where = src.tell()
                try:
                    row["link_target"] = next(guarded([module.link_target(src, archive, row)]))
                except ArchiveError as e:
                    archive.note("symlink_target", str(e), row["member_id"])
                src.seek(where)
            yield row
    except ArchiveError as e:
        if state is None:
            raise type(e)(f"incomplete listing: {path}: {e}", e.member_name) from e
        state["error"] = e


def read_content(path: str, src, options: dict, wanted: set[int] | None = None, names: set[str] | None = None) -> Iterator[dict]:
    """Content rows of the wanted files (all, by id or by name); a member's fault stands
    on its last row, an archive's on a row without a member."""
    state: dict = {}
    rows = [r for r in list_members(path, src, options, state) if r["type"] in ("file", "symlink") and (wanted is None or r["member_id"] in wanted) and (names is None or r["name"] in names)]
    archive = state.get("archive")
    if archive is not None and rows:
        module = handler(archive.container)
        inner = _Part(src, int(archive.extra["payload_offset"])) if archive.container not in ("rar", "directory") and archive.extra["payload_offset"] != "0" else path if archive.container == "directory" else src
        if hasattr(inner, "seek"):
            inner.seek(0)
        by_id = {r["member_id"]: r for r in rows}
        done: set[int] = set()
        try:
            for row, chunks in guarded(module.content(inner, archive, rows)):
                done.add(row["member_id"])
                yield from _rows(by_id[row["member_id"]], chunks, archive)
        except ArchiveError as e:
            for r in rows:
                if r["member_id"] not in done:
                    yield _content(r, 0, None, True, "error", e)
    if "error" in state:
        yield {"archive_id": path, "member_id": None, "name": None, "chunk_index": 0, "data": None, "last": True, "verdict": "error", "error": state["error"].row()}


def _content(row: dict, index: int, data: bytes | None, last: bool, verdict: str | None = None, error: ArchiveError | None = None) -> dict:
    return {"archive_id": row["archive_id"], "member_id": row["member_id"], "name": row["name"], "chunk_index": index, "data": data, "last": last, "verdict": verdict, "error": error.row() if error else None}


def _rows(row: dict, chunks: Iterable[bytes], archive: Archive) -> Iterator[dict]:
    index, held, verdict, fault = 0, b"", None, None
    try:
        for data, verdict in verified(guarded(chunks), row, archive):
            if verdict is None:
                if held:
                    yield _content(row, index, held, False)
                    index += 1
                held = data
    except ArchiveError as e:
        e.member_name = e.member_name or row["name"]
        verdict, fault = "error", e
    yield _content(row, index, held, True, verdict, fault)


def archive_row(path: str, src, options: dict) -> dict:
    state: dict = {}
    count = 0
    cheap = options.get("listing") == "index_only"
    if cheap:
        try:
            archive, _ = opened(path, src, options)
            cheap = handler(archive.container).cost(archive)["listing"] != "indexed"
        except (ArchiveError, KeyError):
            cheap = False
    if cheap:
        state["archive"], count = archive, None
    else:
        for _ in list_members(path, src, options, state):
            count += 1
    a, error = state.get("archive"), state.get("error")
    base = {"archive_id": path, "listing_error": error.row() if error else None, "is_multivolume": False}
    if a is None:
        return base
    extra = {k: v for k, v in a.extra.items() if k not in ("confidence", "detected_by", "payload_offset")}
    cost = handler(a.container).cost(a)
    return base | {
        "format": {"container": a.container, "stream": a.stream}, "confidence": a.extra.get("confidence"), "detected_by": a.extra.get("detected_by"), "payload_offset": int(a.extra.get("payload_offset", 0)), "is_solid": a.is_solid,
        "member_count": None if error else count, "comment": a.comment, "is_encrypted": a.is_encrypted, "cost": cost, "extra": extra,
    }


def _notes(path: str, src, options: dict) -> Iterator[dict]:
    state: dict = {}
    for _ in list_members(path, src, options, state):
        pass
    if "archive" in state:
        yield from state["archive"].diagnostics


def _batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        cols = []
        for f in schema:
            values = [r.get(f.name) for r in held]
            if pa.types.is_map(f.type):
                values = [None if v is None else list(v.items()) for v in values]
            cols.append(pa.array(values, f.type))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    for r in rows:
        held.append(r)
        size += len(r.get("data") or b"")
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _mapped(table: DataFrame, each, out, arrow: pa.Schema) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                cols = batch.to_pydict()
                for values in zip(*cols.values()):
                    yield from each(*values)

        yield from _batched(rows(), arrow)

    return table.mapInArrow(step, out)


def archives(table: DataFrame, **options) -> DataFrame:
    """A row for each file of ``table`` (path, content): format, counts, cost, and the
    fault that ended its listing. With ``listing='index_only'`` archives without an index aren't walked."""
    return _mapped(table.select("path", "content"), lambda p, c: [archive_row(p, io.BytesIO(c or b""), options)], S.ARCHIVES, _ARCHIVES)


def _taking(faults: str) -> Callable[[], dict | None]:
    """What makes the state of a listing that keeps the members before a fault, or raises it."""
    if faults not in ("keep", "raise"):
        raise UsageError(f"unknown choice of faults {faults}")
    return dict if faults == "keep" else lambda: None


def members(table: DataFrame, faults: str = "keep", **options) -> DataFrame:
    """A row for each member, in archive order by ``member_id``; of a damaged archive, those before
    the fault, which stands in ``archives``. With ``faults='raise'`` an action on them fails at a fault."""
    state = _taking(faults)
    return _mapped(table.select("path", "content"), lambda p, c: list_members(p, io.BytesIO(c or b""), options, state()), S.MEMBERS, _MEMBERS)


def content(table: DataFrame, wanted: DataFrame | None = None, names: Iterable[str] | None = None, **options) -> DataFrame:
    """Decoded chunks of members: all, those of ``wanted`` (archive_id, member_id), or
    those with one of ``names``. Blocks without a wanted member are never decoded."""
    keep = None if names is None else set(names)
    if wanted is None:
        return _mapped(table.select("path", "content"), lambda p, c: read_content(p, io.BytesIO(c or b""), options, None, keep), S.CONTENT, _CONTENT)
    ids = wanted.groupBy("archive_id").agg(F.collect_set("member_id").alias("ids"))
    chosen = table.select("path", "content").join(ids, F.col("path") == F.col("archive_id")).select("path", "content", "ids")
    return _mapped(chosen, lambda p, c, i: read_content(p, io.BytesIO(c or b""), options, set(i), keep), S.CONTENT, _CONTENT)


def _digested(path: str, src, options: dict, wanted: set[int] | None, algorithm: str) -> Iterator[dict]:
    """Digests of members, taken as their chunks are decoded."""
    h, size = hasher(algorithm), 0
    for r in read_content(path, src, options, wanted):
        if r["member_id"] is None:
            continue
        h.update(r["data"] or b"")
        size += len(r["data"] or b"")
        if r["last"]:
            yield {"archive_id": path, "member_id": r["member_id"], "name": r["name"], "size": size, "digest": h.digest().hex(), "verdict": r["verdict"]}
            h, size = hasher(algorithm), 0


def member_digests(table: DataFrame, algorithm: str = "sha256", wanted: DataFrame | None = None, **options) -> DataFrame:
    """``digest`` (hexadecimal), ``size`` and ``verdict`` of the members' content, all or
    those of ``wanted``; the content itself stays where it is decoded."""
    if hasher(algorithm) is None:
        raise UsageError(f"unknown digest {algorithm}")
    out = S._struct(archive_id=S.T.StringType(), member_id=S.T.IntegerType(), name=S.T.StringType(), size=S.T.LongType(), digest=S.T.StringType(), verdict=S.T.StringType())
    if wanted is None:
        return _mapped(table.select("path", "content"), lambda p, c: _digested(p, io.BytesIO(c or b""), options, None, algorithm), out, to_arrow_schema(out))
    ids = wanted.groupBy("archive_id").agg(F.collect_set("member_id").alias("ids"))
    chosen = table.select("path", "content").join(ids, F.col("path") == F.col("archive_id")).select("path", "content", "ids")
    return _mapped(chosen, lambda p, c, i: _digested(p, io.BytesIO(c or b""), options, set(i), algorithm), out, to_arrow_schema(out))


def diagnostics(table: DataFrame, **options) -> DataFrame:
    """What was remarkable about listings, numbered in each archive."""
    return _mapped(table.select("path", "content"), lambda p, c: _notes(p, io.BytesIO(c or b""), options), S.DIAGNOSTICS, _DIAGNOSTICS)


def assert_complete(table: DataFrame) -> DataFrame:
    """``archives`` rows; an action on them fails where a listing is incomplete."""
    broken = F.col("listing_error").isNotNull()
    return table.filter(F.when(broken, F.raise_error(F.concat(F.lit("incomplete listing: "), F.col("archive_id"), F.lit(": "), F.col("listing_error.message"))).cast("boolean")).otherwise(True))


def decompressed(table: DataFrame, stream: str | None = None) -> DataFrame:
    """``path``, ``data`` and ``error`` of bare compressed streams; containers and plain files are faults."""

    def each(path: str, data: bytes):
        try:
            container, found, *_ = identify(path, (data or b"")[:HEAD])
            name = stream or (found if container in ("raw_stream", "tar") and found != "uncompressed" else None)
            if name is None or name not in STREAMS:
                raise UnsupportedFormat("not a compressed stream")
            yield {"path": path, "data": b"".join(STREAMS[name](io.BytesIO(data))), "error": None}
        except ArchiveError as e:
            yield {"path": path, "data": None, "error": e.row()}

    out = S._struct(path=S.T.StringType(), data=S.T.BinaryType(), error=S.ERROR)
    return _mapped(table.select("path", "content"), each, out, to_arrow_schema(out))


def format_table(spark: SparkSession) -> DataFrame:
    """Known formats and how far this installation reads them: full, partial (with what is missing) or none."""
    import importlib.util

    have = lambda name: importlib.util.find_spec(name) is not None
    missing = {"zip": [("inflate64", "deflate64"), ("pyppmd", "ppmd")], "7z": [("inflate64", "deflate64"), ("pyppmd", "ppmd")], "rar": [("unrar", "compressed data")]}
    rows = []
    for container in MODULES:
        for stream in STREAMS if container in ("tar", "raw_stream") else ["uncompressed"]:
            if container == "raw_stream" and stream == "uncompressed":
                continue
            lacking = [f"{p}: {what}" for p, what in missing.get(container, []) if not have(p)]
            label = stream if container == "raw_stream" else container if stream == "uncompressed" else f"{container}.{stream}"
            rows.append((container, stream, "" if container == "directory" else label, "partial" if lacking else "full", lacking))
    return spark.createDataFrame(rows, "container string, stream string, extension string, support string, missing array<string>")


def supported_formats(spark: SparkSession) -> DataFrame:
    """The formats of :func:`format_table` that nothing is missing for, or only some of whose methods."""
    return format_table(spark).filter("support in ('full', 'partial')")


class _Set(InputPartition):
    """The files of one archive: one, or its volumes in order."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, S3, GCS, HDFS, ...) and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _found(pattern: str, tree: bool) -> list[str]:
    """Paths that a pattern names; directories stand for the files below them, unless they are archives (``tree``)."""
    fs, path = _system(pattern)
    scheme = pattern[: pattern.index("://") + 3] if "://" in pattern and not pattern.startswith("file:") else ""
    fixed = path.split("*")[0].split("?")[0].split("[")[0]
    if fixed == path:
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File or (tree and info.type == pafs.FileType.Directory):
            return [scheme + path]
        base, keep = path, lambda p: True
    else:
        base, keep = fixed.rpartition("/")[0], lambda p: fnmatch.fnmatchcase(p, path)
    inner = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    wanted = pafs.FileType.Directory if tree and fixed != path else pafs.FileType.File
    return sorted(scheme + f.path for f in inner if f.type == wanted and keep(f.path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.view, self.names = options.get("view", "members"), None
        self.path = options.get("path", "")
        self.volumes = options.get("volumes", "false").lower() == "true"
        self.state = _taking(options.get("faults", "raise"))
        self.options = json.loads(options.get("options", "{}"))
        if "limits" in self.options:
            self.options["limits"] = Limits(**self.options["limits"])
        if secret := options.get("passwordfile"):
            fs, where = _system(secret)
            with fs.open_input_file(where) as f:
                self.options["passwords"] = f.read().decode("utf-8").splitlines()

    def partitions(self):
        found = [p for pattern in self.path.split(",") for p in _found(pattern, self.view == "tree")]
        if not self.volumes:
            return [_Set([p]) for p in found]
        sets: dict[str, list[tuple[int, str]]] = {}
        for p in found:
            base, part = volume_place(p)
            sets.setdefault(base, []).append((part, p))
        whole = [[p for _, p in sorted(v)] for v in sets.values() if sorted(k for k, _ in v) == list(range(1, len(v) + 1))]
        return [_Set(v) for v in sorted(whole)]

    def read(self, partition):
        """The file is opened where it is and read by ranges; of volumes, those that a range lies in."""
        if partition is None:  # no file was found
            return
        path, opened_files = partition.paths[0], []
        for p in partition.paths if self.view != "tree" else []:
            fs, where = _system(p)
            opened_files.append(fs.open_input_file(where))
        path = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        src = None if self.view == "tree" else Joined(opened_files) if len(opened_files) > 1 else opened_files[0]
        try:
            if self.view == "archives":
                yield from _batched([archive_row(path, src, self.options)], _ARCHIVES)
            elif self.view in ("members", "tree"):
                yield from _batched((r for r in list_members(path, src, self.options, self.state()) if self.names is None or r["name"] in self.names), _MEMBERS)
            elif self.view == "diagnostics":
                yield from _batched(_notes(path, src, self.options), _DIAGNOSTICS)
            elif self.view == "formats":
                yield from _batched([dict(zip(("path", "container", "stream", "confidence", "detected_by", "payload_offset"), (path, *identify(path, src.read(HEAD)))))], _FORMATS)
            else:
                yield from _batched(read_content(path, src, self.options, None, self.names), _CONTENT)
        finally:
            for f in opened_files:
                f.close()


class _NamedReader(_Reader):
    def pushFilters(self, filters):
        """Names that a content or member scan is restricted to are known before anything is decoded."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            yield f


class ArchiveSource(DataSource):
    """``spark.read.format('archive').option('view', ...).load(path)``, views archives,
    members (default), content, diagnostics, formats (by the files' heads alone) and tree
    (directories as archives). ``path`` names files, folders or patterns, by commas, in any
    file system that pyarrow opens (local, ``s3://``, ``gs://``, ``hdfs://``). A
    partition is a file, or with the option ``volumes`` a set of volumes, read by ranges
    where it is by the executor, so its size isn't bounded by
    memory. A fault that ends a listing fails the views of members and tree; with the option ``faults``
    at ``keep`` they end before it. ``options`` is JSON of the functions' options; passwords come from ``passwordFile``."""

    takes = _NamedReader

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self):
        view = self.options.get("view", "members")
        known = {"archives": S.ARCHIVES, "members": S.MEMBERS, "tree": S.MEMBERS, "content": S.CONTENT, "diagnostics": S.DIAGNOSTICS, "formats": FORMATS}
        if view not in known:
            raise UsageError(f"unknown view {view}")
        return known[view]

    def reader(self, schema):
        return self.takes(dict(self.options))


class StreamSource(DataSource):
    """``format('archive_stream')``: decoded chunks of bare compressed files."""

    takes = _NamedReader

    @classmethod
    def name(cls) -> str:
        return "archive_stream"

    def schema(self):
        return S.CONTENT

    def reader(self, schema):
        return self.takes(dict(self.options) | {"view": "content"})


class _WholeArchiveSource(ArchiveSource):
    takes = _Reader


class _WholeStreamSource(StreamSource):
    takes = _Reader


_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Both data sources, for ``spark``. Spark refuses readers that take filters unless
    ``spark.sql.python.filterPushdown.enabled`` is set: it is set where the session doesn't
    say; where it was turned off, the sources read all names and Spark filters them."""
    if spark.conf.get(_PUSHDOWN, None) is None:
        spark.conf.set(_PUSHDOWN, "true")
    pushed = spark.conf.get(_PUSHDOWN) == "true"
    spark.dataSource.register(ArchiveSource if pushed else _WholeArchiveSource)
    spark.dataSource.register(StreamSource if pushed else _WholeStreamSource)


