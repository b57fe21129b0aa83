"""Member names as column expressions: normal form, link targets, portability, display."""

from __future__ import annotations

import fnmatch
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that change the direction of text.
BIDI = "\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
# Device names that Windows reserves.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
# Marks of member types in listings.
MARKS = {"file": "-", "directory": "d", "symlink": "l", "hardlink": "h", "other": "?", "anti": "!"}


def _segments(name: Column) -> Column:
    return F.filter(F.split(name, "/"), lambda s: (s != "") & (s != "."))


def normal_name(name: Column, kind: Column, backslash: Column | bool = False) -> Column:
    """A member's name with backslashes of Windows entries as separators, without empty
    and ``.`` segments, with ``..`` and a leading slash kept, a slash behind directories;
    ``.`` if nothing is left."""
    flag = F.lit(backslash) if isinstance(backslash, bool) else backslash
    name = F.when(flag, F.replace(name, F.lit("\\"), F.lit("/"))).otherwise(name)
    kept = _segments(name)
    whole = F.concat(F.when(name.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"), F.when(kind == "directory", "/").otherwise(""))
    return F.when(F.size(kept) == 0, ".").otherwise(whole)


def link_target_name(name: Column, target: Column, kind: Column) -> Column:
    """The member that a link names, or null: a hard link's target counts from the root,
    a symbolic link's from the link's directory; absolute ones and those that leave the
    archive name none."""
    folder = F.regexp_replace(F.regexp_replace(name, "/+$", ""), "[^/]*$", "")
    joined = F.when(kind == "symlink", F.concat(folder, target)).otherwise(target)
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    path = F.aggregate(_segments(joined), F.array().cast("array<string>"), lambda done, s: F.when((s == "..") & F.coalesce(up(done), F.lit(False)), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s))))
    fine = (target != "") & ~target.startswith("/") & ~joined.startswith("/") & (F.size(path) > 0) & (F.get(path, F.lit(0)) != "..")
    return F.when(fine, F.array_join(path, "/"))


def inferred_name(path: Column, suffixes: Sequence[str]) -> Column:
    """A stream's name from its file's: without the longest ending that fits (any case), else with ``.uncompressed``; ``data`` without a usable name."""
    base = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0)
    out = F.concat(base, F.lit(".uncompressed"))
    for s in sorted(suffixes, key=len):
        out = F.when(F.lower(base).endswith(s.lower()) & (F.length(base) > len(s)), F.substring(base, F.lit(1), F.length(base) - len(s))).otherwise(out)
    return F.when(path.isNull() | base.isin("", ".", ".."), "data").otherwise(out)


def has_bidi(name: Column) -> Column:
    return name.rlike("[" + "".join(f"\\u{ord(c):04x}" for c in BIDI) + "]")


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern as an anchored regular expression: ``*`` also
    crosses slashes, ``[!x]`` is a negated set."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] not in ("!",) else i + 3) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" if inner[0] == "!" else "") + re.sub(r"([\\\[\]^&])", r"\\\1", inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", c) if ord(c) < 128 else c
        i += 1
    return f"(?s)^{out}$"


def matches_globs(name: Column, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> Column:
    """Any include (or none given) and no exclude."""
    out = F.lit(True)
    if includes:
        out = F.lit(False)
        for p in includes:
            out = out | name.rlike(glob_regex(p))
    for p in excludes:
        out = out & ~name.rlike(glob_regex(p))
    return out


def python_glob(name: str, pattern: str) -> bool:
    """What :func:`glob_regex` must agree with."""
    return fnmatch.fnmatchcase(name, pattern)


def without_trailing_dots(name: Column) -> Column:
    """Each segment without trailing dots and spaces; a segment of nothing else has no portable spelling (null)."""
    parts = F.split(name, "/")
    plain = lambda s: s.isin("", ".", "..")
    cut = lambda s: F.regexp_replace(s, "[. ]+$", "")
    bad = F.exists(parts, lambda s: ~plain(s) & (cut(s) == ""))
    return F.when(~bad, F.array_join(F.transform(parts, lambda s: F.when(plain(s), s).otherwise(cut(s))), "/"))


def unportable(name: Column) -> Column:
    """Why a name can't be written everywhere: a reserved device name or a colon; else null."""
    parts = F.filter(F.split(name, r"[\\/]"), lambda s: s != "")
    reserved = F.exists(parts, lambda s: F.upper(F.trim(F.substring_index(s, ".", 1))).isin(RESERVED))
    return F.when(reserved, "reserved_name").when(F.exists(parts, lambda s: s.contains(":")), "colon")


@F.pandas_udf(T.StringType())
def folded_key(name: pd.Series) -> pd.Series:
    """Canonical composition and full case folding, which Spark has not."""
    return name.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())


def collision_key(name: Column, policy: str = "strict") -> Column:
    """What makes two members the same file: exact names if trusted, else folded ones."""
    plain = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "/+$", "")
    return plain if policy == "trusted" else folded_key(plain)


def portable_spelling(raw: bytes) -> str:
    """Bytes that aren't UTF-8 as ``%XX``; only then ``%`` as ``%25``."""
    from lading.sources.base import text_of

    return text_of(raw)[0]


@F.pandas_udf(T.StringType())
def escaped(name: pd.Series) -> pd.Series:
    """Control and unprintable characters as backslash escapes, for terminals."""
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\"}

    def one(s: str) -> str:
        return "".join(short.get(c) or (c if c.isprintable() else f"\\x{ord(c) & 255:02x}" if ord(c) <= 255 or 0xDC00 <= ord(c) <= 0xDFFF else f"\\u{ord(c):04x}") for c in s)

    return name.map(lambda s: None if s is None else one(s))


def unsafe(name: Column, kind: Column, link_target: Column) -> Column:
    """Why a member must not be written under any policy, else null. Symbolic links are
    looked at again by the writer, where they then stand."""
    parts = F.split(name, r"[\\/]")
    bare = F.regexp_replace(name, "/+$", "")
    target = F.coalesce(link_target, F.lit(""))
    outside = target.startswith("/") | F.coalesce(link_target_name(name, target, kind).isNull() & _climbs(name, target, kind), F.lit(False))
    return (
        F.when(F.instr(name, "\0") > 0, "nul")
        .when(name.startswith("/") | name.startswith("\\") | name.rlike("^\\p{L}:"), "absolute")
        .when(F.array_contains(parts, ".."), "traversal")
        .when((kind != "directory") & bare.isin("", "."), "root")
        .when(kind == "other", "special_file")
        .when(kind.isin("symlink", "hardlink") & (F.instr(target, "\0") > 0), "link_escape")
        .when(kind.isin("symlink", "hardlink") & outside, "link_escape")
    )


def _climbs(name: Column, target: Column, kind: Column) -> Column:
    """Whether a relative target leaves the root: the path so far never has more ``..`` than segments."""
    folder = F.regexp_replace(F.regexp_replace(name, "/+$", ""), "[^/]*$", "")
    joined = F.when(kind == "symlink", F.concat(folder, target)).otherwise(target)
    depth = F.aggregate(_segments(joined), F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")), lambda a, s: F.struct((a["d"] + F.when(s == "..", -1).otherwise(1)).alias("d"), F.least(a["least"], a["d"] + F.when(s == "..", -1).otherwise(1)).alias("least")))
    return depth["least"] < 0


def file_extension(fmt: Column) -> Column:
    container, stream = fmt["container"], fmt["stream"]
    return F.when(container.isin("directory", "unknown"), "").when(container == "raw_stream", stream).when(stream == "uncompressed", container).otherwise(F.concat_ws(".", container, stream))


def display_name(fmt: Column) -> Column:
    """``TAR_GZ``, ``ZIP``, ``GZ``, ...; a few streams have a name of their own."""
    own = {"lz": "LZIP", "lzma": "LZMA_ALONE", "zz": "ZLIB", "br": "BROTLI"}
    label = fmt["stream"]
    for k, v in own.items():
        label = F.when(fmt["stream"] == k, v).otherwise(label)
    container = F.when(fmt["container"] == "7z", "SEVEN_Z").otherwise(F.upper(fmt["container"]))
    return F.when(fmt["container"] == "raw_stream", F.upper(label)).when(fmt["stream"] == "uncompressed", container).otherwise(F.concat_ws("_", container, F.upper(label)))
