"""Readers against archives made by other programs, by hand, and damaged ones."""

import bz2
import gzip
import hashlib
import io
import lzma
import os
import random
import shutil
import struct
import subprocess
import tarfile
import zipfile
import zlib

import pytest

from lading.errors import ArchiveError, Corrupt, Truncated
from lading.functions.digests import Blake2sp, adler32_combine, blake2sp, crc32_combine
from lading.sources import codecs
from lading.sources.archive import archive_row, list_members, read_content
from lading.sources.detect import identify

BSDTAR = shutil.which("bsdtar")
TREE = {"a.txt": b"alpha\n" * 400, "dir/b.bin": bytes(range(256)) * 64, "dir/deep/c": b"", "é.txt": "ünï".encode(), "x86": bytes(random.Random(1).randrange(256) for _ in range(30000))}


def names(path, data, **options):
    return [r["name"] for r in list_members(path, io.BytesIO(data), options)]


def contents(path, data, **options):
    out, faults = {}, []
    for r in read_content(path, io.BytesIO(data), options):
        if r["error"]:
            faults.append(r["error"]["code"])
        if r["name"] is not None:
            out[r["name"]] = out.get(r["name"], b"") + (r["data"] or b"")
    return out, faults


@pytest.fixture
def tree(tmp_path):
    for name, data in TREE.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "tree" / "link").symlink_to("dir/b.bin")
    os.link(tmp_path / "tree" / "a.txt", tmp_path / "tree" / "hard.txt")
    return tmp_path / "tree"


@pytest.mark.skipif(not BSDTAR, reason="no bsdtar")
@pytest.mark.parametrize(
    "kind, options",
    [
        ("a.zip", ["--format=zip"]), ("a.tar", ["--format=ustar"]), ("p.tar", ["--format=pax"]), ("g.tar", ["--format=gnutar"]), ("a.tar.gz", ["-z", "--format=pax"]), ("a.tar.bz2", ["-j"]), ("a.tar.xz", ["-J"]), ("a.tar.Z", ["-Z"]), ("a.tar.lz", ["--lzip"]), ("a.tar.lzma", ["--lzma"]),
        ("a.7z", ["--format=7zip"]), ("s.7z", ["--format=7zip", "--options", "7zip:compression=store"]), ("d.7z", ["--format=7zip", "--options", "7zip:compression=deflate"]), ("b.7z", ["--format=7zip", "--options", "7zip:compression=bzip2"]), ("l.7z", ["--format=7zip", "--options", "7zip:compression=lzma2"]),
        ("a.iso", ["--format=iso9660"]), ("j.iso", ["--format=iso9660", "--options", "iso9660:!rockridge"]),
    ],
)
def test_archives_of_another_program(tree, tmp_path, kind, options):
    path = tmp_path / kind
    made = subprocess.run([BSDTAR, "-c", *options, "-f", path, "-C", tree, *sorted(os.listdir(tree))], capture_output=True, env={**os.environ, "LC_ALL": "C.UTF-8"})
    if made.returncode:
        pytest.skip(made.stderr.decode())
    data = path.read_bytes()
    got, faults = contents(kind, data)
    assert not faults
    plain = kind == "j.iso"
    for name, want in TREE.items():
        if plain and name == "é.txt":
            continue
        assert got.get(name) == want, name
    rows = {r["name"]: r for r in list_members(kind, io.BytesIO(data), {})}
    if not plain:
        assert rows["link"]["type"] == "symlink" and rows["link"]["link_target"] == "dir/b.bin"
        assert rows["dir/"]["type"] == "directory"
    info = archive_row(kind, io.BytesIO(data), {})
    assert info["member_count"] == len(rows) and info["listing_error"] is None
    if "tar" in kind:
        pair = [rows[n] for n in ("a.txt", "hard.txt")]
        assert sorted(r["type"] for r in pair) == ["file", "hardlink"]


@pytest.mark.skipif(not BSDTAR, reason="no bsdtar")
@pytest.mark.parametrize("cipher", ["zipcrypt", "aes128", "aes256"])
def test_encrypted_zip(tree, tmp_path, cipher):
    path = tmp_path / "c.zip"
    made = subprocess.run([BSDTAR, "-c", "--format=zip", "--options", f"zip:encryption={cipher}", "--passphrase", "s3cret", "-f", path, "-C", tree, "a.txt", "x86"], capture_output=True)
    if made.returncode:
        pytest.skip(made.stderr.decode())
    data = path.read_bytes()
    assert contents("c.zip", data)[1] == ["encryption"] * 2
    got, faults = contents("c.zip", data, passwords=["wrong", "s3cret"])
    assert not faults and got == {k: TREE[k] for k in ("a.txt", "x86")}


def test_zip_names_and_times():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("./a//b", "../up", "/abs", "d/", "same", "same"):
            z.writestr(zipfile.ZipInfo(name, (1999, 12, 31, 23, 59, 58)), b"x" if not name.endswith("/") else b"")
        link = zipfile.ZipInfo("l")
        link.create_system, link.external_attr = 3, 0o120777 << 16
        z.writestr(link, "a/b")
        dos = zipfile.ZipInfo("w")
        dos.create_system = 0
        z.writestr(dos, b"")
    rows = list(list_members("x.zip", io.BytesIO(out.getvalue().replace(b"\x00\x00w", b"\x00\x00w")), {}))
    assert [r["name"] for r in rows] == ["a/b", "../up", "/abs", "d/", "same", "same", "l", "w"]
    assert rows[0]["modified"]["wall"].isoformat() == "1999-12-31T23:59:58" and rows[0]["hashes"] == {"crc32": zlib.crc32(b"x").to_bytes(4, "big")}
    assert rows[6]["type"] == "symlink" and rows[6]["link_target"] == "a/b"


def test_member_damage_is_a_row():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("good", b"fine" * 10)
        z.writestr("bad", b"WRONG" * 10)
    data = out.getvalue().replace(b"WRONGWRONG", b"WRONGwrong", 1)
    rows = list(read_content("x.zip", io.BytesIO(data), {}))
    assert [(r["name"], r["verdict"]) for r in rows if r["last"]] == [("good", "ok"), ("bad", "error")]
    assert rows[-1]["error"]["code"] == "corruption"


def _tar(**kw):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", **kw) as t:
        for name, data in TREE.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        long = tarfile.TarInfo("n" * 180 + "/" + "m" * 180)
        long.size = 3
        t.addfile(long, io.BytesIO(b"abc"))
        link = tarfile.TarInfo("h")
        link.type, link.linkname = tarfile.LNKTYPE, "a.txt"
        t.addfile(link)
        dev = tarfile.TarInfo("fifo")
        dev.type = tarfile.FIFOTYPE
        t.addfile(dev)
    return out.getvalue()


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
def test_tar_forms(form):
    data = _tar(format=form)
    got, faults = contents("x.tar", data)
    assert not faults and got == {**TREE, "n" * 180 + "/" + "m" * 180: b"abc"}
    rows = {r["name"]: r for r in list_members("x.tar", io.BytesIO(data), {})}
    assert rows["h"]["type"] == "hardlink" and rows["h"]["link_target"] == "a.txt" and rows["fifo"]["type"] == "other"


def test_tar_without_end_and_with_a_broken_header():
    data = _tar(format=tarfile.GNU_FORMAT).rstrip(b"\0")
    data += bytes(-len(data) % 512)
    state = {}
    assert len(list(list_members("x.tar", io.BytesIO(data), {}, state))) == 8 and "error" not in state
    assert [d["code"] for d in state["archive"].diagnostics] == ["archive_eof"]
    assert len(list(list_members("x.tar", io.BytesIO(data), {"strict_end": True}, state))) == 8 and state["error"].code == "truncated"
    whole, state = bytearray(_tar(format=tarfile.GNU_FORMAT)), {}
    second = 512 + len(TREE["a.txt"]) + -len(TREE["a.txt"]) % 512
    whole[second + 150] ^= 1
    assert [r["name"] for r in list_members("x.tar", io.BytesIO(bytes(whole)), {}, state)] == ["a.txt"] and state["error"].code == "corruption"


def test_gzip_members_padding_junk_and_end():
    two = gzip.compress(b"one") + gzip.compress(b"two")
    decode = lambda d: b"".join(codecs.gzip(io.BytesIO(d)))
    assert decode(two) == decode(two + bytes(700)) == b"onetwo"
    with pytest.raises(Corrupt):
        decode(two + b"junk")
    with pytest.raises(Truncated):
        decode(two[:-3])
    rows = list(list_members("d/x.TXT.gz", io.BytesIO(gzip.compress(b"one", mtime=7)), {}))
    assert rows[0]["name"] == "x.TXT" and rows[0]["hashes"]["crc32"] == zlib.crc32(b"one").to_bytes(4, "big") and rows[0]["modified"]["utc"].timestamp() == 7
    assert list(list_members("x.gz", io.BytesIO(two), {}))[0]["hashes"] == {}


def _lzip(data):
    raw = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}])
    return b"LZIP\x01" + bytes([20]) + raw + struct.pack("<IQQ", zlib.crc32(data), len(data), len(raw) + 26)


def test_lzip_and_its_combined_checksum():
    a, b = b"first" * 1000, b"second" * 999
    data = _lzip(a) + _lzip(b)
    assert b"".join(codecs.lzip(io.BytesIO(data))) == a + b
    row = list(list_members("x.lz", io.BytesIO(data), {}))[0]
    assert row["size"] == len(a + b) and row["hashes"]["crc32"] == zlib.crc32(a + b).to_bytes(4, "big")
    got, faults = contents("x.lz", data)
    assert not faults and got == {"x": a + b}


@pytest.mark.parametrize("stream", ["gz", "bz2", "xz", "lzma", "zz", "zst", "lz4", "br"])
def test_truncated_and_damaged_streams_are_typed(stream):
    from lading.plans.pack import COMPRESS

    data = COMPRESS[stream](bytes(random.Random(2).randrange(256) for _ in range(5000)))
    rng = random.Random(3)
    for k in range(40):
        bad = bytearray(data[: rng.randrange(len(data))] if k % 2 else data)
        if bad and not k % 2:
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        try:
            b"".join(codecs.STREAMS[stream](io.BytesIO(bytes(bad))))
        except ArchiveError:
            pass


@pytest.mark.parametrize("kind", ["zip", "tar", "7z", "iso"])
def test_mutated_archives_never_escape_the_error_tree(kind, tree, tmp_path):
    if kind in ("7z", "iso") and not BSDTAR:
        pytest.skip("no bsdtar")
    path = tmp_path / f"m.{kind}"
    if kind == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in TREE.items():
                z.writestr(n, d)
    elif kind == "tar":
        path.write_bytes(_tar(format=tarfile.PAX_FORMAT))
    else:
        subprocess.run([BSDTAR, "-c", f"--format={'7zip' if kind == '7z' else 'iso9660'}", "-f", path, "-C", tree, "a.txt", "dir"], check=True)
    data, rng = path.read_bytes(), random.Random(5)
    for k in range(60):
        bad = bytearray(data)
        if k % 3 == 0:
            bad = bad[: rng.randrange(len(bad))]
        else:
            for _ in range(1 + k % 4):
                bad[rng.randrange(len(bad)) if k % 2 else -1 - rng.randrange(min(len(bad), 400))] = rng.randrange(256)
        for r in read_content(f"m.{kind}", io.BytesIO(bytes(bad)), {}):
            assert r["archive_id"] == f"m.{kind}"


def _vint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _block(body, data=b""):
    head = _vint(len(body)) + body
    return struct.pack("<I", zlib.crc32(head)) + head + data


def _rar5(name, data, split=0, redirect=None):
    extra = b""
    if redirect:
        record = _vint(5) + _vint(redirect[0]) + _vint(0) + _vint(len(redirect[1])) + redirect[1]
        extra = _vint(len(record)) + record
    flags = 2 | split | (1 if extra else 0)
    body = _vint(2) + _vint(flags) + (_vint(len(extra)) if extra else b"") + _vint(len(data)) + _vint(6) + _vint(len(data)) + _vint(0o100644) + struct.pack("<II", 1000, zlib.crc32(data)) + _vint(0) + _vint(1) + _vint(len(name)) + name + extra
    return _block(body, data)


def test_rar5_stored_members_links_and_volumes():
    sign, main, end = b"Rar!\x1a\7\1\0", _block(_vint(1) + _vint(0) + _vint(0)), _block(_vint(5) + _vint(0) + _vint(0))
    data = sign + main + _rar5(b"d/a.txt", b"alpha") + _rar5(b"l", b"", redirect=(1, b"d/a.txt")) + end
    rows = list(list_members("x.rar", io.BytesIO(data), {}))
    assert [(r["name"], r["type"], r["link_target"]) for r in rows] == [("d/a.txt", "file", None), ("l", "symlink", "d/a.txt")]
    got, faults = contents("x.rar", data)
    assert got["d/a.txt"] == b"alpha" and not faults
    stub = contents("x.exe", b"MZ" + bytes(3000) + data)[0]
    assert stub["d/a.txt"] == b"alpha"


def _chained(key, iv, data):
    import numpy as np

    from lading.sources.aes import Aes

    cipher, out = Aes(key), b""
    data += bytes(-len(data) % 16)
    for i in range(0, len(data), 16):
        iv = cipher.encrypt(np.frombuffer(bytes(a ^ b for a, b in zip(data[i : i + 16], iv)), np.uint8).reshape(1, 16)).tobytes()
        out += iv
    return out


@pytest.mark.parametrize("headers", [False, True])
def test_rar5_encryption(headers):
    from lading.sources.aes import rar5_keys, rar5_mixed_crc

    salt, iv, text = b"0123456789abcdef", b"fedcba9876543210", b"secret contents " * 3 + b"end"
    key, mac, check = rar5_keys(b"pw", salt, 3)
    packed = _chained(key, iv, text)
    record = _vint(1) + _vint(0) + _vint(3) + bytes([3]) + salt + iv + check + hashlib.sha256(check).digest()[:4]
    extra = _vint(len(record)) + record
    mixed = rar5_mixed_crc(zlib.crc32(text), mac)
    body = _vint(2) + _vint(3) + _vint(len(extra)) + _vint(len(packed)) + _vint(4) + _vint(len(text)) + _vint(0o100644) + struct.pack("<I", mixed) + _vint(0) + _vint(1) + _vint(3) + b"s.x" + extra
    blocks = [(_block(_vint(1) + _vint(0) + _vint(0)), b""), (_block(body), packed), (_block(_vint(5) + _vint(0) + _vint(0)), b"")]
    data = b"Rar!\x1a\7\1\0"
    if headers:
        data += _block(_vint(4) + _vint(0) + _vint(0) + _vint(1) + bytes([3]) + salt + check + hashlib.sha256(check).digest()[:4])
        blocks = [(iv + _chained(key, iv, h), d) for h, d in blocks]
    data += b"".join(h + d for h, d in blocks)
    got, faults = contents("x.rar", data, passwords=["no", "pw"])
    assert got == {"s.x": text} and not faults
    assert contents("x.rar", data)[1] == ["encryption"] and contents("x.rar", data, passwords=["no"])[1] == ["encryption"]


def test_rar4_stored_member():
    def block(kind, flags, body, data=b""):
        rest = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
        return struct.pack("<H", zlib.crc32(rest) & 0xFFFF) + rest + data

    data = b"hello rar"
    body = struct.pack("<IIBIIBBHI", len(data), len(data), 3, zlib.crc32(data), (40 << 25 | 1 << 21 | 1 << 16), 29, 0x30, 5, 0o100644) + b"n.txt"
    whole = b"Rar!\x1a\7\0" + block(0x73, 0, bytes(6)) + block(0x74, 0x8000, body, data) + block(0x7B, 0, b"")
    got, faults = contents("x.rar", whole)
    assert got == {"n.txt": data} and not faults


def test_detection_order():
    assert identify("x.zip", gzip.compress(_tar())[:2000])[:3] == ("tar", "gz", "probable")
    assert identify("x.gz", b"plain words only")[:3] == ("raw_stream", "gz", "guess")
    assert identify("x", b"plain words only")[0] == "unknown"
    assert identify("x", zlib.compress(b"abc" * 100))[:2] == ("raw_stream", "zz")
    assert identify("x", lzma.compress(b"abc" * 100, lzma.FORMAT_ALONE))[:2] == ("raw_stream", "lzma")
    assert identify("x", bytes(32769) + b"CD001")[:3] == ("iso", "uncompressed", "certain")
    assert identify("x", bz2.compress(b"abc"))[:2] == ("raw_stream", "bz2")


def test_digest_algebra():
    rng = random.Random(4)
    for _ in range(50):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(300))) for _ in range(2))
        assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
        assert adler32_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    h = Blake2sp()
    data = bytes(range(256)) * 10
    for i in range(0, len(data), 37):
        h.update(data[i : i + 37])
    assert h.digest() == blake2sp(data) != hashlib.blake2s(data).digest()
    assert blake2sp(b"").hex() == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"


def test_aes_on_the_published_vectors():
    import numpy as np

    from lading.sources.aes import Aes, chained_decrypt

    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        cipher = Aes(bytes(range(n)))
        packed = cipher.encrypt(plain)
        assert packed.tobytes().hex() == want and (cipher.decrypt(packed) == plain).all()
    key, iv, data = bytes(range(32)), bytes(range(16)), bytes(range(96))
    cipher, before, out = Aes(key), iv, b""
    for i in range(0, 96, 16):
        before = cipher.encrypt(np.frombuffer(bytes(a ^ b for a, b in zip(data[i : i + 16], before)), np.uint8).reshape(1, 16)).tobytes()
        out += before
    assert b"".join(chained_decrypt(key, iv, iter([out[:40], out[40:]]))) == data


def test_key_derivations():
    from lading.sources.aes import rar5_keys, sevenzip_key

    h = hashlib.sha256()
    for k in range(8):
        h.update("pä".encode("utf-16-le") + k.to_bytes(8, "little"))
    assert sevenzip_key(bytes([3]), "pä".encode()) == (h.digest(), bytes(16))
    key, mac, check = rar5_keys(b"pw", b"s" * 16, 4)
    assert key == hashlib.pbkdf2_hmac("sha256", b"pw", b"s" * 16, 16) and mac == hashlib.pbkdf2_hmac("sha256", b"pw", b"s" * 16, 32)
    last = hashlib.pbkdf2_hmac("sha256", b"pw", b"s" * 16, 48)
    assert check == bytes(last[i] ^ last[8 + i] ^ last[16 + i] ^ last[24 + i] for i in range(8))


def test_split_decoding_of_xz_and_lzip(spark):
    from lading.sources.splits import split_decode, xz_blocks

    parts = [bytes([65 + k]) * (1000 * k + 1) for k in range(5)]
    xz = b"".join(lzma.compress(p, check=lzma.CHECK_SHA256 if k == 2 else lzma.CHECK_CRC64) + bytes(4 * k) for k, p in enumerate(parts))
    lz = b"".join(map(_lzip, parts))
    assert [full for _, _, full, _ in xz_blocks(io.BytesIO(xz))] == [len(p) for p in parts]
    files = spark.createDataFrame([("a.xz", xz), ("b.lz", lz), ("c.xz", xz[:-5])], "path string, content binary")
    rows = split_decode(files).orderBy("path", "split").collect()
    for path in ("a.xz", "b.lz"):
        assert b"".join(bytes(r.data) for r in rows if r.path == path) == b"".join(parts)
    assert [r.error is not None for r in rows if r.path == "c.xz"] == [True]
    few = split_decode(files.filter("path = 'a.xz'"), wanted=(1, 1002)).collect()
    assert sorted(r.split for r in few) == [1]
