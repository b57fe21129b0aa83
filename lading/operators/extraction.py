"""Safe extraction: a plan made of columns, then a writer that trusts only what it sees on disk."""

from __future__ import annotations

import io
import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lading import schema as S
from lading.errors import ArchiveError, UsageError
from lading.functions.names import collision_key, unportable, unsafe, without_trailing_dots
from lading.functions.values import standard_mode, strict_mode
from lading.operators.links import with_link_targets
from lading.operators.members import with_current
from lading.sources.archive import _batched, read_content
from lading.sources.base import Limits

POLICIES, OVERWRITE = ("strict", "standard", "trusted"), ("error", "skip", "replace", "rename")


def planned(members: DataFrame, policy: str = "strict", overwrite: str = "error", limits: Limits | None = None) -> DataFrame:
    """``members`` with what is to become of each: ``action`` (write, superseded, blocked,
    collides, limit), ``reason``, ``final_name`` and ``final_mode``.

    Every policy blocks names and links that leave the destination. Strict and standard
    also block reserved names and colons; strict rewrites trailing dots and spaces. Of
    members with one collision key the first claims it; under ``rename`` later ones get
    `` (N)``. Declared sizes are held against the limits in archive order."""
    if policy not in POLICIES or overwrite not in OVERWRITE:
        raise UsageError(f"policy {policy}, overwrite {overwrite}")
    limits = limits or Limits()
    kind, name = F.col("type"), F.col("name")
    reason = unsafe(name, kind, F.col("link_target"))
    final, mode = name, F.col("mode")
    if policy != "trusted":
        reason = F.coalesce(reason, unportable(name))
    if policy == "strict":
        reason = F.coalesce(reason, F.when(without_trailing_dots(name).isNull(), "dots_only"))
        final = F.coalesce(without_trailing_dots(name), name)
        mode = strict_mode(mode, kind)
    elif policy == "standard":
        mode = standard_mode(mode, kind)
    rows = with_current(members) if "is_current" in members.columns else members
    rows = rows.withColumn("reason", reason).withColumn("final_name", final).withColumn("final_mode", mode)
    rows = rows.withColumn("action", F.when(~F.col("is_current"), "superseded").when(F.col("reason").isNotNull(), "blocked").when(kind == "anti", "remove").otherwise("write"))
    rows = rows.withColumn("_key", collision_key(F.col("final_name"), policy))
    order = Window.partitionBy("archive_id", "_key", F.col("action") == "write").orderBy("member_id")
    nth = F.when((F.col("action") == "write") & (kind != "directory"), F.row_number().over(order))
    rows = rows.withColumn("_nth", nth)
    running = Window.partitionBy("archive_id").orderBy("member_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bytes", F.sum(F.when(F.col("action") == "write", F.coalesce("size", F.lit(0))).otherwise(0)).over(running))
    over = (F.col("_bytes") > limits.output) | (F.coalesce(F.col("size") > limits.ratio * F.col("compressed_size"), F.lit(False)) & (F.col("size") > limits.ratio_from) & (F.col("compressed_size") > 0))
    rows = rows.withColumn("action", F.when((F.col("action") == "write") & over, "limit").when((F.col("action") == "write") & (F.col("_nth") > 1) & F.lit(overwrite in ("error", "skip")), "collides").otherwise(F.col("action")))
    rows = rows.withColumn("reason", F.when(F.col("action") == "limit", "resource_limit").otherwise(F.col("reason")))
    if overwrite == "rename":
        rows = renamed(rows, policy)
    return rows.drop("_key", "_nth", "_bytes")


def renamed(rows: DataFrame, policy: str) -> DataFrame:
    """Later members with a claimed key get the first free ``name (N)``. The names that
    are taken depend on those before, so an archive's colliding members are walked in order."""
    one = rows.filter((F.col("action") == "write") & (F.col("type") != "directory"))
    crowded = one.groupBy("archive_id").agg(F.max("_nth").alias("most")).filter("most > 1").select("archive_id")
    few = one.join(crowded, "archive_id", "left_semi").select("archive_id", "member_id", "final_name", "_key")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member_id")
        taken, out = set(), []
        for name, key in zip(pdf["final_name"], pdf["_key"]):
            n, new = 1, name
            while key in taken:
                folder, slash, base = name.rpartition("/")
                stem, dot, end = base.rpartition(".")
                new = folder + slash + (f"{stem} ({n}){dot}{end}" if dot and stem else f"{base} ({n})")
                key, n = key_of(new, policy), n + 1
            taken.add(key)
            out.append(new)
        return pd.DataFrame({"archive_id": pdf["archive_id"], "member_id": pdf["member_id"], "_new": out})

    new = few.groupBy("archive_id").applyInPandas(walk, "archive_id string, member_id int, _new string")
    return rows.join(new, ["archive_id", "member_id"], "left").withColumn("final_name", F.coalesce("_new", "final_name")).drop("_new")


def key_of(name: str, policy: str) -> str:
    """The collision key of one name."""
    import unicodedata

    plain = name.replace("\\", "/").rstrip("/")
    return plain if policy == "trusted" else unicodedata.normalize("NFC", plain).casefold()


def extract(files: DataFrame, members: DataFrame, dest: str, policy: str = "strict", overwrite: str = "error", on_error: str = "continue", wanted: DataFrame | None = None, where=None, rename=None, progress=None, **options) -> DataFrame:
    """Extracts the archives of ``files`` (path, content) below ``dest``/archive name, a
    folder that all executors share, and returns a row for each member: status extracted,
    not_overwritten, superseded, blocked or failed, with path and fault.

    ``members`` is their listing. ``wanted`` (archive_id, member_id) and ``where`` select
    members; a hard link that is wanted brings its target's content along. ``rename``, a
    column, changes final names after the policy and is checked again; null skips a member.
    ``progress``, an accumulator of a number, is added the bytes written so far while
    tasks run. An archive is one task; files are written beside their place and then moved, so that
    a retried task ends in the same state. ``on_error='stop'`` ends an archive at its
    first failure."""
    rows = with_link_targets(planned(members, policy, overwrite, options.get("limits")))
    keep = F.lit(True) if where is None else where
    if wanted is not None:
        rows = rows.join(wanted.select("archive_id", "member_id", F.lit(True).alias("_in")).distinct(), ["archive_id", "member_id"], "left")
        keep = keep & F.coalesce("_in", F.lit(False))
    rows = rows.filter(keep)
    if rename is not None:
        rows = rows.withColumn("final_name", rename).filter("final_name is not null")
        again = unsafe(F.col("final_name"), F.col("type"), F.col("link_target"))
        rows = rows.withColumn("reason", F.coalesce("reason", again)).withColumn("action", F.when(again.isNotNull() & (F.col("action") == "write"), "blocked").otherwise(F.col("action")))
    plan = rows.groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct("member_id", "type", "name", "final_name", "final_mode", "action", "reason", "link_target", "link_target_id", F.col("modified.utc").cast("double").alias("mtime")))).alias("plan"))
    work = files.select("path", "content").join(plan, F.col("path") == F.col("archive_id")).select("path", "content", "plan")
    schema = to_arrow_schema(S.RESULTS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, data, todo in zip(*(c.to_pylist() for c in batch.columns)):
                    yield from _write(path, data, todo, dest, overwrite, on_error, options, progress)

        yield from _batched(rows(), schema)

    return work.mapInArrow(step, S.RESULTS)


def _inside(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)


def _clear(path: str, overwrite: str) -> bool:
    """Whether ``path`` may be written: it isn't there, or what is there is replaced."""
    if not os.path.lexists(path):
        return True
    if overwrite != "replace":
        return False
    if os.path.isdir(path) and not os.path.islink(path):
        raise ArchiveError("a directory stands where a file should go")
    os.unlink(path)
    return True


def _free(path: str) -> str:
    folder, base = os.path.split(path)
    stem, dot, end = base.rpartition(".")
    n = 1
    while os.path.lexists(path):
        path = os.path.join(folder, f"{stem} ({n}){dot}{end}" if dot and stem else f"{base} ({n})")
        n += 1
    return path


def _write(archive: str, data: bytes, todo: list[dict], dest: str, overwrite: str, on_error: str, options: dict, progress=None) -> Iterator[dict]:
    root = os.path.join(os.path.realpath(dest), os.path.basename(archive.rstrip("/")))
    os.makedirs(root, exist_ok=True)
    places: dict[int, str] = {}
    final = {"superseded": "superseded", "blocked": "blocked", "limit": "failed", "collides": "not_overwritten"}

    def result(m: dict, status: str, path: str | None = None, error: ArchiveError | None = None) -> dict:
        fault = error.row() if error else {"code": m["reason"], "message": m["reason"], "member_name": m["name"]} if m["reason"] else None
        return {"archive_id": archive, "member_id": m["member_id"], "name": m["name"], "status": status, "path": path, "requested_path": os.path.join(root, m["final_name"]), "error": fault}

    def parent_of(path: str) -> str:
        folder = os.path.dirname(path)
        if not _inside(os.path.realpath(folder), root):
            raise ArchiveError("the parent directory lies outside the destination")
        os.makedirs(folder, exist_ok=True)
        return folder

    todo = sorted(todo, key=lambda m: m["member_id"])
    files = {m["member_id"] for m in todo if m["action"] == "write" and m["type"] == "file"}
    orphans = {m["link_target_id"] for m in todo if m["action"] == "write" and m["type"] == "hardlink" and m["link_target_id"] is not None} - files
    staged: dict[int, str | ArchiveError] = {}
    with tempfile.TemporaryDirectory(dir=root, prefix=".lading-") as stage:
        if files | orphans:
            handle = None
            for row in read_content(archive, io.BytesIO(data), options, files | orphans):
                k = row["member_id"]
                if k is None:
                    continue
                if row["chunk_index"] == 0:
                    handle = open(os.path.join(stage, str(k)), "wb")  # noqa: SIM115
                handle.write(row["data"] or b"")
                if progress is not None:
                    progress.add(len(row["data"] or b""))
                if row["last"]:
                    handle.close()
                    staged[k] = ArchiveError(row["error"]["message"], row["name"]) if row["error"] else os.path.join(stage, str(k))
        for m in todo:
            if m["action"] in final:
                yield result(m, final[m["action"]])
                continue
            path = os.path.normpath(os.path.join(root, m["final_name"]))
            try:
                if m["type"] == "anti":
                    if path in places.values() and os.path.lexists(path):
                        os.unlink(path)
                    yield result(m, "extracted", path)
                    continue
                if m["type"] == "directory":
                    if path != root:
                        parent_of(path)
                    os.makedirs(path, exist_ok=True)
                    os.chmod(path, m["final_mode"] if m["final_mode"] is not None else 0o755)
                    yield result(m, "extracted", path)
                    continue
                parent_of(path)
                if overwrite == "rename":
                    path = _free(path)
                elif not _clear(path, overwrite):
                    fault = ArchiveError("it exists") if overwrite == "error" else None
                    yield result(m, "not_overwritten", path, fault)
                    if fault and on_error == "stop":
                        return
                    continue
                if m["type"] == "symlink":
                    os.symlink(m["link_target"] or "", path)
                    if not _inside(os.path.realpath(path), root):
                        os.unlink(path)
                        m = m | {"reason": "link_escape"}
                        yield result(m, "blocked")
                        continue
                else:
                    source = staged.get(m["member_id"] if m["type"] == "file" else m["link_target_id"])
                    there = places.get(m["link_target_id"]) if m["type"] == "hardlink" else None
                    if isinstance(source, ArchiveError):
                        raise source
                    if there:
                        try:
                            os.link(there, path)
                        except OSError:
                            shutil.copy2(there, path)
                    elif source is None:
                        raise ArchiveError("the link's target is not in the archive")
                    else:
                        shutil.copyfile(source, path + ".part") if m["type"] == "hardlink" else shutil.move(source, path + ".part")
                        os.replace(path + ".part", path)
                    if m["final_mode"] is not None and not there:
                        os.chmod(path, m["final_mode"])
                    if m["mtime"] is not None and not there:
                        os.utime(path, (m["mtime"], m["mtime"]))
                places[m["member_id"]] = path
                yield result(m, "extracted", path)
            except (ArchiveError, OSError, ValueError) as e:
                yield result(m, "failed", path, e if isinstance(e, ArchiveError) else ArchiveError(str(e), m["name"]))
                if on_error == "stop":
                    return
