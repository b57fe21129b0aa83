"""Sources: files joined, streams that can't seek, paths of any file system, packed fixtures of every kind."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from lading.errors import ArchiveError, UsageError
from lading.functions.digests import crc32_combine
from lading.operators import extraction
from lading.plans.formats import _carried_out
from lading.plans.pack import _7z, _tar, BUILD, COMPRESS, PASSWORD
from lading.sources.archive import list_members, members, read_content, register
from lading.sources.base import Joined, Limits, Peekable
from lading.sources.codecs import STREAMS
from lading.sources.volumes import volume_place


@pytest.mark.parametrize("kind", sorted(BUILD))
def test_every_packed_kind_reads_back(kind):
    rng = random.Random(1)
    rows = [(f"en/{i:04d}.txt", bytes(rng.randrange(97, 123) for _ in range(rng.randrange(0, 3000) if i % 7 else 0))) for i in range(40)]
    data, path = BUILD[kind](rows), "x." + kind.split("-")[0].replace("rar4", "rar")
    options = {"passwords": ["no", PASSWORD]}
    got = {}
    for r in read_content(path, io.BytesIO(data), options):
        assert r["error"] is None
        name = r["name"].partition(";")[0]
        got[name] = got.get(name, b"") + (r["data"] or b"")
    assert all(got.get(n, b"") == d for n, d in rows)
    if "lock" in kind or kind in ("zip-crypto", "zip-aes"):
        assert all(r["error"] for r in read_content(path, io.BytesIO(data), {}) if r["last"] and (r["name"] is None or dict(rows)[r["name"]]))


@pytest.mark.parametrize("kind", sorted(BUILD))
def test_damage_never_escapes_the_error_tree(kind):
    rows = [(f"d/{i}", bytes([97 + i]) * 40 * i) for i in range(8)]
    data, rng = BUILD[kind](rows), random.Random(3)
    for k in range(25):
        bad = bytearray(data[: rng.randrange(len(data))] if k % 3 == 0 else data)
        for _ in range(1 + k % 4):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        for r in read_content(f"m.{kind.split('-')[0]}", io.BytesIO(bytes(bad)), {"passwords": [PASSWORD]}):
            assert r["archive_id"].startswith("m.")


@pytest.mark.parametrize("size", [0, 1, 511, 5000, 300000])
def test_unix_compress_of_any_size(size):
    rng = random.Random(size)
    data = bytes(rng.choice(b"abcde \n") for _ in range(size))
    assert b"".join(STREAMS["Z"](io.BytesIO(COMPRESS["Z"](data)))) == data


def test_joined_files_read_as_one():
    data, rng = bytes(range(256)) * 9, random.Random(2)
    cuts = sorted(rng.sample(range(len(data)), 5))
    whole = Joined([io.BytesIO(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)])])
    assert whole.seek(0, io.SEEK_END) == len(data) and whole.read() == b""
    for _ in range(200):
        a, n = rng.randrange(len(data) + 9), rng.randrange(700)
        assert whole.seek(a) == a and whole.read(n) == data[a : a + n]
    assert whole.seek(3) == 3 and whole.read() == data[3:]


def test_a_pipe_can_be_looked_into():
    class Pipe(io.RawIOBase):
        def __init__(self, data):
            self.data = io.BytesIO(data)

        def read(self, n=-1):
            return self.data.read(min(n, 777) if n >= 0 else n)

    rows = [("a.txt", b"alpha" * 1000), ("b.txt", b"beta" * 5000)]
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, d in rows:
            info = tarfile.TarInfo(n)
            info.size = len(d)
            t.addfile(info, io.BytesIO(d))
    for stream in (out.getvalue(), COMPRESS["gz"](out.getvalue())):
        pipe = Peekable(Pipe(stream))
        assert [r["name"] for r in list_members("x.tar.gz", pipe, {})] == ["a.txt", "b.txt"]
    small = Peekable(Pipe(bytes(100000)), keep=1000)
    while small.read(500):
        pass
    with pytest.raises(UsageError):
        small.seek(0)


def test_a_wrong_password_that_passes_the_check_bytes_of_winzip_aes():
    """The salt of packed members is a hash of their name: the check bytes of the second one let ``first`` pass."""
    rows = [("p/000000001", b"one" * 50), ("p/000011090", b"two" * 50)]
    data = BUILD["zip-aes"](rows)
    read = lambda data, **o: [(r["name"], r["data"], r["error"] and r["error"]["code"]) for r in read_content("x.zip", io.BytesIO(data), o)]
    assert read(data, passwords=["first", "second"]) == [(n, b"", "encryption") for n, _ in rows]
    assert read(data, passwords=["first"]) == [(n, b"", "encryption") for n, _ in rows]
    assert read(data, passwords=["first", PASSWORD]) == [(n, d, None) for n, d in rows]
    # a damaged member under the right password is damaged, alone or with others
    at = data.index(b"PK\3\4", 4)
    hurt = data[: at - 1] + bytes([data[at - 1] ^ 1]) + data[at:]
    assert [e for _, _, e in read(hurt, passwords=["first", PASSWORD])] == ["corruption", None]
    alone = BUILD["zip-aes"](rows[:1])
    at = alone.index(b"PK\1\2")
    hurt = alone[: at - 1] + bytes([alone[at - 1] ^ 1]) + alone[at:]
    assert [e for _, _, e in read(hurt, passwords=["no", PASSWORD])] == ["corruption"]


def test_wrong_passwords_of_solid_7z_folders_without_a_checksum():
    """Under one in some hundred wrong passwords, such as w72, the LZMA2 data ends at once without a fault."""
    rows = [("a", b"one" * 50), ("b", b"two" * 50)]
    read = lambda data, *p: [(r["name"], r["data"], r["error"] and r["error"]["code"]) for r in read_content("x.7z", io.BytesIO(data), {"passwords": p})]
    for data in (BUILD["7z-locked"](rows), _7z(rows, "copy", True, PASSWORD.encode())):
        assert read(data, "w72", PASSWORD) == [(n, d, None) for n, d in rows]
        assert read(data, "w72") == [(n, b"", "encryption") for n, _ in rows]
    # one member is damaged, the other speaks for the password
    hurt = data[: 32 + 250] + bytes([data[32 + 250] ^ 1]) + data[32 + 251 :]
    assert [(n, e) for n, _, e in read(hurt, "w72", PASSWORD)] == [("a", None), ("b", "corruption")]


def test_volume_places():
    assert volume_place("/d/X.7z.002") == ("/d/x.7z", 2) and volume_place("a.part10.rar") == ("a.rar", 10) and volume_place("a.r00") == ("a.rar", 2) and volume_place("a.rar") == ("a.rar", 1) and volume_place("b.zip") == ("b.zip", 1)


def test_data_source_paths_views_and_volumes(spark, tmp_path):
    register(spark)
    data = BUILD["7z-lzma2"]([("n/a", b"x" * 5000), ("n/b", bytes(range(256)) * 30)])
    for k in range(3):
        (tmp_path / f"v.7z.00{k + 1}").write_bytes(data[k * len(data) // 3 : (k + 1) * len(data) // 3])
    (tmp_path / "w.7z").write_bytes(data)
    (tmp_path / "gap.7z.002").write_bytes(b"x")
    source = lambda path, **o: spark.read.format("archive").options(**o).load(path)
    rows = source(f"file://{tmp_path}", volumes="true").collect()
    assert sorted((r.archive_id.rpartition("/")[2], r.name) for r in rows) == [("v.7z.001", "n/a"), ("v.7z.001", "n/b"), ("w.7z", "n/a"), ("w.7z", "n/b")]
    assert [(r.container, r.detected_by) for r in source(f"{tmp_path}/w*", view="formats").collect()] == [("7z", "magic")]
    assert source(f"{tmp_path}/none*").collect() == []


@pytest.mark.parametrize("setting", [None, "false", "true"])
def test_data_sources_with_and_without_pushed_filters(spark, tmp_path, setting):
    key = "spark.sql.python.filterPushdown.enabled"
    (tmp_path / "w.7z").write_bytes(BUILD["7z-lzma2"]([("n/a", b"x" * 500), ("n/b", b"y" * 300)]))
    (tmp_path / "one.gz").write_bytes(COMPRESS["gz"](b"z" * 700))
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)
        register(spark)
        assert spark.conf.get(key) == (setting or "true")
        m = spark.read.format("archive").load(f"{tmp_path}/w.7z")
        assert sorted(r.name for r in m.collect()) == ["n/a", "n/b"]
        assert [(r.name, r.size) for r in m.filter("name in ('n/b', 'n/c')").collect()] == [("n/b", 300)]
        c = spark.read.format("archive").option("view", "content").load(f"{tmp_path}/w.7z").filter("name = 'n/a'")
        assert [bytes(r.data) for r in c.collect()] == [b"x" * 500]
        z = spark.read.format("archive_stream").load(f"{tmp_path}/one.gz")
        assert b"".join(bytes(r.data) for r in z.collect()) == b"z" * 700
    finally:
        spark.conf.set(key, before)
        register(spark)


def test_checksums_combine_over_any_lengths():
    import zlib

    rng = random.Random(5)
    for n in (0, 1, 7, 8 << 20):
        a, b = bytes(rng.randrange(256) for _ in range(50)), bytes(min(n, 100000))
        assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def _deep(root, names, make):
    """Below ``root`` a folder whose path alone is so long that some thousand names in it cross the metadata limit of archives."""
    folder = os.path.join(root, *["é" * 120] * 14)
    os.makedirs(folder)
    for name in names:
        make(os.path.join(folder, name))
    return "é" * 120 + ("/" + "é" * 120) * 13 + "/"


def test_a_directory_is_listed_whole_beyond_the_limits_of_archives(spark, tmp_path):
    register(spark)
    names = [f"{k:05d}" for k in range(7500)]
    folder = _deep(tmp_path, names, lambda p: open(p, "wb").close())
    tree = spark.read.format("archive").option("view", "tree").load(str(tmp_path))
    rows = tree.select("type", F.element_at(F.split("name", "/"), -1).alias("end"), "size", F.length("name").alias("n")).collect()
    assert sorted(r.end for r in rows if r.type == "file") == names and {(r.size, r.n) for r in rows if r.type == "file"} == {(0, len(folder) + 5)}
    assert sum(r.type == "directory" for r in rows) == 14
    # limits that are given hold
    state: dict = {}
    assert len(list(list_members(str(tmp_path), None, {"limits": Limits(members=9)}, state))) == 9 and state["error"].code == "resource_limit"


def test_links_of_a_directory_beyond_the_limits_of_archives(spark, tmp_path):
    """Files, then a hard and a symbolic link to each, in one folder."""
    register(spark)

    def make(path):
        open(path, "wb").close() if path.endswith("f") else os.link(path[:-1] + "f", path) if path.endswith("h") else os.symlink("../" + path[-5:-1] + "f", path)

    folder = _deep(tmp_path, [f"{k:04d}{end}" for k in range(2500) for end in "fhs"], make)
    tree = spark.read.format("archive").option("view", "tree").load(str(tmp_path)).filter("type <> 'directory'")
    rows = {r.name.removeprefix(folder): (r.type, r.link_target) for r in tree.select("name", "type", "link_target").collect()}
    assert len(rows) == 7500
    for k in range(2500):
        assert rows[f"{k:04d}f"] == ("file", None) and rows[f"{k:04d}h"] == ("hardlink", f"{folder}{k:04d}f") and rows[f"{k:04d}s"] == ("symlink", f"../{k:04d}f")


def test_modes_and_times_of_a_directory_beyond_the_limits_of_archives(spark, tmp_path):
    register(spark)

    def make(path):
        open(path, "wb").close()
        os.chmod(path, 0o600 + int(path[-1]))
        os.utime(path, (0, 1_577_836_800 + int(path[-5:])))

    _deep(tmp_path, [f"{k:05d}" for k in range(7500)], make)
    tree = spark.read.format("archive").option("view", "tree").load(str(tmp_path)).filter("type = 'file'")
    rows = tree.select(F.substring("name", -5, 5).cast("int").alias("k"), "mode", F.col("modified.utc").cast("long").alias("at")).collect()
    assert sorted((r.k, r.mode, r.at) for r in rows) == [(k, 0o600 + k % 10, 1_577_836_800 + k) for k in range(7500)]


def test_a_listing_that_a_fault_ends_does_not_look_whole(spark, tmp_path):
    cut = _tar([(f"n/{k}", b"x" * 600) for k in range(3)])[: 2 * 1536 + 100]  # inside the third header
    got, state = [], {}
    with pytest.raises(ArchiveError, match="incomplete listing: x.tar: "):
        got.extend(r["name"] for r in list_members("x.tar", io.BytesIO(cut), {}))
    assert [r["name"] for r in list_members("x.tar", io.BytesIO(cut), {}, state)] == ["n/0", "n/1"] and state["error"].code == "truncated"
    with pytest.raises(ArchiveError, match="not a directory"):
        list(list_members(str(tmp_path / "none"), None, {}))
    register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cut.tar").write_bytes(cut)
    source = lambda path="in", **o: spark.read.format("archive").options(**o).load(str(tmp_path / path))
    with pytest.raises(Exception, match="incomplete listing"):
        source().collect()
    assert [r.name for r in source(faults="keep").collect()] == ["n/0", "n/1"]
    assert source(view="archives").first().listing_error.code == "truncated"
    few = {"view": "tree", "options": '{"limits": {"members": 1}}'}
    (tmp_path / "in" / "other").write_bytes(b"")
    with pytest.raises(Exception, match="more than 1 members"):
        source(**few).collect()
    assert source(**few, faults="keep").count() == 1 and source(view="tree").count() == 2
    with pytest.raises(Exception, match="unknown choice of faults"):
        source(faults="none").collect()
    files = spark.createDataFrame([("x.tar", cut)], "path string, content binary")
    assert members(files).count() == 2
    with pytest.raises(Exception, match="incomplete listing"):
        members(files, faults="raise").collect()


def test_an_extraction_that_failed_does_not_look_whole(spark, tmp_path):
    files = spark.createDataFrame([("x.tar", _tar([("a/b", b"x"), ("c", b"y")]))], "path string, content binary")
    rows = lambda dest: extraction.extract(files, members(files), str(tmp_path / dest))
    _carried_out(rows("one"))
    (tmp_path / "two" / "x.tar").mkdir(parents=True)
    (tmp_path / "two" / "x.tar" / "a").write_bytes(b"a file where a folder should go")
    with pytest.raises(RuntimeError, match="1 members were not extracted, such as .*x.tar/a/b"):
        _carried_out(rows("two"))
