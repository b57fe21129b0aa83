"""The command line, passwords from a function, progress, formats of one's own."""

import io
import json
import zipfile

import pytest

from lading import cli
from lading.operators import extraction
from lading.plans.pack import BUILD, PASSWORD
from lading.sources import archive as src, formats


@pytest.fixture
def zipped(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("d/x.txt", b"alpha" * 50)
        z.writestr("y.bin", b"beta")
    return path


def test_list_info_test_detect(spark, zipped, capsys):
    assert cli.main(["list", str(zipped)]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split()[-1] for x in lines] == ["d/x.txt", "y.bin"] and " 250 " in lines[0]
    assert cli.main(["info", str(zipped)]) == 0
    info = json.loads(capsys.readouterr().out)
    assert info["member_count"] == 2 and info["format"]["container"] == "zip" and not info["is_encrypted"]
    assert cli.main(["test", str(zipped)]) == 0
    assert json.loads(capsys.readouterr().out)["ok"] == 2
    assert cli.main(["detect", str(zipped)]) == 0
    assert json.loads(capsys.readouterr().out)["detected_by"] == "magic"


def test_extract_and_exit_codes(spark, zipped, tmp_path, capsys, monkeypatch):
    assert cli.main(["extract", str(zipped), "--dest", str(tmp_path / "out"), "--include", "d/*", "--include", "none*"]) == 0
    assert (tmp_path / "out" / "a.zip" / "d" / "x.txt").read_bytes() == b"alpha" * 50 and not (tmp_path / "out" / "a.zip" / "y.bin").exists()
    assert "no member matches none*" in capsys.readouterr().err
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../up", b"x")
    assert cli.main(["extract", str(bad), "--dest", str(tmp_path / "out")]) == 1
    broken = tmp_path / "broken.zip"
    broken.write_bytes(zipped.read_bytes()[:-30])
    assert cli.main(["list", str(broken)]) == 3
    with pytest.raises(SystemExit) as e:
        cli.main(["frobnicate", "x"])
    assert e.value.code == 2
    locked = tmp_path / "locked.zip"
    locked.write_bytes(BUILD["zip-aes"]([("s", b"secret")]))
    assert cli.main(["test", str(locked)]) == 1
    monkeypatch.setenv("PW", PASSWORD)
    assert cli.main(["test", str(locked), "--password-env", "PW"]) == 0


def test_passwords_from_a_function_and_the_one_that_fits_first(spark):
    rows = [(f"m{i}", bytes([65 + i]) * 30) for i in range(6)]
    files = spark.createDataFrame([("one.zip", BUILD["zip-crypto"](rows)), ("two.7z", BUILD["7z-locked"](rows))], "path string, content binary")
    got = src.member_digests(files, passwords=lambda path: ["x", "y", PASSWORD] if path else []).collect()
    assert len(got) == 12 and all(r.verdict == "ok" for r in got)
    archive, _ = src.opened("one.zip", io.BytesIO(BUILD["zip-crypto"](rows)), {"passwords": ["x", PASSWORD]})
    archive.fits(PASSWORD.encode())
    assert archive.passwords == (PASSWORD.encode(), b"x")


def test_progress_of_an_extraction(spark, zipped, tmp_path):
    files = src.files(spark, str(zipped))
    done = spark.sparkContext.accumulator(0)
    extraction.extract(files, src.members(files), str(tmp_path / "p"), progress=done).collect()
    assert done.value == 254


def test_a_format_of_ones_own(tmp_path, monkeypatch):
    (tmp_path / "lines_format.py").write_text("""
from lading.sources.base import member

def listing(source, archive):
    for n, line in enumerate(source.read().splitlines()):
        yield member(archive, n, type="file", name=line.decode().split("=")[0], raw_name=line, size=len(line.split(b"=")[1]), compressed_size=None, modified=None)

def content(source, archive, wanted):
    for row in wanted:
        yield row, iter([row["raw_name"].split(b"=")[1]])

def cost(archive):
    return {"listing": "requires_scanning", "access": "direct", "solid_block_count": None}
""")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(formats, "MODULES", dict(formats.MODULES))
    formats.register_format("lines", "lines_format")
    rows = list(src.read_content("x.lines", io.BytesIO(b"a=1\nb=22"), {"format": ("lines", "uncompressed")}))
    assert [(r["name"], r["data"]) for r in rows] == [("a", b"1"), ("b", b"22")]
