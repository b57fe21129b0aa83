import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lading.errors import UsageError
from lading.operators import extraction, links, members as ops
from lading.sources import archive as src
from lading.sources.archive import register


def tar(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, kind, payload in entries:
            info = tarfile.TarInfo(name)
            info.mtime, info.mode = 1000, 0o4755
            if kind == "file":
                info.size = len(payload)
                t.addfile(info, io.BytesIO(payload))
                continue
            info.type = {"dir": tarfile.DIRTYPE, "sym": tarfile.SYMTYPE, "hard": tarfile.LNKTYPE, "fifo": tarfile.FIFOTYPE}[kind]
            info.linkname = payload or ""
            t.addfile(info)
    return out.getvalue()


ENTRIES = [
    ("ok/a.txt", "file", b"one"), ("ok/", "dir", None), ("../up", "file", b"x"), ("/abs", "file", b"x"), ("ok/l", "sym", "a.txt"), ("evil", "sym", "../../etc"), ("absl", "sym", "/etc/passwd"), ("ok/h", "hard", "ok/a.txt"),
    ("pipe", "fifo", None), ("a.", "file", b"dot"), ("nul.txt", "file", b"x"), ("README", "file", b"1"), ("readme", "file", b"2"), ("twice", "file", b"old"), ("twice", "file", b"new"), ("s1", "sym", "s2"), ("s2", "sym", "s1"),
]


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("in/t.tar", tar(ENTRIES))], "path string, content binary")


def outcome(rows):
    return {(r.name, r.member_id): r.status for r in rows.collect()}


@pytest.mark.parametrize("policy", ["strict", "standard", "trusted"])
def test_what_leaves_the_destination_is_blocked_under_every_policy(files, tmp_path, policy):
    got = outcome(extraction.extract(files, src.members(files), str(tmp_path), policy=policy, overwrite="rename"))
    for name in (("../up", 2), ("/abs", 3), ("evil", 5), ("absl", 6), ("pipe", 8)):
        assert got[name] == "blocked", name
    assert got[("twice", 13)] == "superseded" and (tmp_path / "t.tar/twice").read_bytes() == b"new"
    assert (tmp_path / "t.tar/ok/l").is_symlink() and (tmp_path / "t.tar/ok/h").read_bytes() == b"one"
    assert os.path.samefile(tmp_path / "t.tar/ok/h", tmp_path / "t.tar/ok/a.txt")
    assert not (tmp_path / "up").exists() and not list(tmp_path.glob("t.tar/.lading*"))
    mode = (tmp_path / "t.tar/ok/a.txt").stat().st_mode & 0o7777
    assert mode == {"strict": 0o644, "standard": 0o755, "trusted": 0o4755}[policy]
    assert got[("nul.txt", 10)] == ("extracted" if policy == "trusted" else "blocked")
    assert (tmp_path / ("t.tar/a" if policy == "strict" else "t.tar/a.")).read_bytes() == b"dot"
    both = {(tmp_path / "t.tar" / n).read_bytes() for n in (("README", "readme") if policy == "trusted" else ("README", "readme (1)"))}
    assert both == {b"1", b"2"}


def test_overwrite_policies(files, tmp_path):
    listing = src.members(files)
    first = outcome(extraction.extract(files, listing, str(tmp_path), overwrite="error"))
    assert first[("ok/a.txt", 0)] == "extracted" and first[("readme", 12)] == "not_overwritten"
    (tmp_path / "t.tar/ok/a.txt").write_bytes(b"mine")
    assert outcome(extraction.extract(files, listing, str(tmp_path), overwrite="skip"))[("ok/a.txt", 0)] == "not_overwritten"
    assert (tmp_path / "t.tar/ok/a.txt").read_bytes() == b"mine"
    assert outcome(extraction.extract(files, listing, str(tmp_path), overwrite="replace"))[("ok/a.txt", 0)] == "extracted"
    assert (tmp_path / "t.tar/ok/a.txt").read_bytes() == b"one"
    with pytest.raises(UsageError):
        extraction.planned(listing, policy="lax")


def test_selection_brings_a_hard_links_content(files, tmp_path):
    got = outcome(extraction.extract(files, src.members(files), str(tmp_path), where=F.col("name") == "ok/h"))
    assert got == {("ok/h", 7): "extracted"} and (tmp_path / "t.tar/ok/h").read_bytes() == b"one" and not (tmp_path / "t.tar/ok/a.txt").exists()


def test_rename_hook_is_checked_again(files, tmp_path):
    new = F.when(F.col("name") == "ok/a.txt", "../out").when(F.col("name") == "README", "Z/README")
    got = outcome(extraction.extract(files, src.members(files), str(tmp_path), rename=new))
    assert got == {("ok/a.txt", 0): "blocked", ("README", 11): "extracted"} and (tmp_path / "t.tar/Z/README").exists()


def test_an_existing_symlink_does_not_lead_out(files, tmp_path):
    (tmp_path / "t.tar").mkdir()
    (tmp_path / "outside").mkdir()
    (tmp_path / "t.tar/ok").symlink_to(tmp_path / "outside")
    got = outcome(extraction.extract(files, src.members(files), str(tmp_path), overwrite="replace"))
    assert got[("ok/a.txt", 0)] == "failed" and not list((tmp_path / "outside").iterdir())


def test_limits_and_damaged_members(spark, tmp_path):
    from lading.sources.base import Limits

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb", bytes(8 << 20))
        z.writestr("fine", b"fine")
    files = spark.createDataFrame([("b.zip", out.getvalue())], "path string, content binary")
    limits = Limits(ratio=100.0, ratio_from=1 << 20)
    rows = {r.name: r for r in extraction.extract(files, src.members(files), str(tmp_path), limits=limits).collect()}
    assert rows["bomb"].status == "failed" and rows["bomb"].error.code == "resource_limit" and rows["fine"].status == "extracted"
    verdicts = {r.name: r.error.code if r.error else r.verdict for r in src.content(files, limits=limits).filter("last").collect()}
    assert verdicts == {"bomb": "resource_limit", "fine": "ok"}
    few = src.archives(files, limits=Limits(members=1)).first()
    assert few.listing_error.code == "resource_limit" and src.members(files, limits=Limits(members=1)).count() == 1


def test_link_closure(files):
    got = {r.name: r.link_target_id for r in links.with_link_targets(src.members(files)).collect() if r.type in ("symlink", "hardlink")}
    assert got == {"ok/l": 0, "evil": None, "absl": None, "ok/h": 0, "s1": None, "s2": None}


def test_data_sources(spark, tmp_path):
    (tmp_path / "t.tar").write_bytes(tar([("a", "file", b"aaa"), ("b", "file", b"b" * 3_000_000)]))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("n", b"zzz")
    (tmp_path / "s.gz").write_bytes(__import__("gzip").compress(b"stream"))
    register(spark)
    load = lambda view: spark.read.format("archive").option("view", view).load(str(tmp_path))
    assert sorted(r.name for r in load("members").collect()) == ["a", "b", "n", "s"]
    assert {os.path.basename(r.archive_id): r.member_count for r in load("archives").collect()} == {"t.tar": 2, "z.zip": 1, "s.gz": 1}
    chunks = load("content").filter("name = 'b'").orderBy("chunk_index").collect()
    assert len(chunks) > 1 and sum(len(r.data) for r in chunks) == 3_000_000 and chunks[-1].verdict == "unverified"
    assert [bytes(r.data) for r in spark.read.format("archive_stream").load(str(tmp_path / "s.gz")).collect()] == [b"stream"]
    tree = {r.name: r.type for r in load("tree").collect()}
    assert tree == {"t.tar": "file", "z.zip": "file", "s.gz": "file"}
    binary = src.files(spark, str(tmp_path))
    assert src.members(binary).count() == 4
    with pytest.raises(Exception, match="incomplete listing"):
        (tmp_path / "broken.zip").write_bytes(b"PK\3\4 nothing")
        src.assert_complete(src.archives(src.files(spark, str(tmp_path)))).collect()


def test_arriving_archives(spark, tmp_path):
    from lading.streaming.arrivals import arriving_members, new_files

    inbox = tmp_path / "in"
    inbox.mkdir()
    for k in range(3):
        with zipfile.ZipFile(inbox / f"{k}.zip", "w") as z:
            z.writestr("same", b"same")
            z.writestr("own", str(k).encode())
    for name, frame in (("arrived", arriving_members(spark, str(inbox))), ("fresh", new_files(spark, str(inbox)))):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("arrived").count() == 6 and spark.table("fresh").count() == 4


def test_globs_agree_with_shell_patterns(spark):
    from lading.functions.names import glob_regex, python_glob

    names = ["a/b.txt", "a.TXT", "[x]", "a]b", "é/ü", "x\ny", "a-b", "ab", "!a", "^a"]
    patterns = ["*", "*.txt", "a?b", "[ab]*", "[!a]*", "[[]x]", "a[]]b", "*/?", "[a-c]*", "x*y", "[^a]*", "a.b", "["]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select("name", *(F.col("name").rlike(glob_regex(p)).alias(f"p{i}") for i, p in enumerate(patterns))).collect()
    for r in got:
        for i, p in enumerate(patterns):
            assert r[f"p{i}"] == python_glob(r.name, p), (r.name, p)


def test_selectors(spark, files):
    m = src.members(files)
    assert ops.selected(m).count() == len(ENTRIES)
    assert [r.member_id for r in ops.get(m, "twice").collect()] == [14]
    assert {r.name for r in ops.selected(m, names=["a."], ids=m.filter("member_id = 1")).collect()} == {"a.", "ok/"}
