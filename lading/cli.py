"""``python -m lading.cli list|info|test|detect|extract PATH...``: thin wrappers of the operators.

Exit codes: 0 fine, 1 a failed or blocked member, 2 wrong use, 3 an archive that can't be read."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from lading.functions.names import escaped
from lading.functions.values import access_summary, member_line
from lading.operators import extraction, integrity, members as ops
from lading.session import session
from lading.sources import archive as src
from lading.sources.detect import detect


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lading")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("list", "info", "test", "detect", "extract"):
        v = verbs.add_parser(verb)
        v.add_argument("path", nargs="+")
        v.add_argument("--include", action="append", default=[])
        v.add_argument("--exclude", action="append", default=[])
        v.add_argument("--password-env", help="environment variable that holds the password")
        if verb == "list":
            v.add_argument("--digests", action="store_true")
        if verb == "extract":
            v.add_argument("--dest", default=".")
            v.add_argument("--policy", choices=extraction.POLICIES, default="strict")
            v.add_argument("--overwrite", choices=extraction.OVERWRITE, default="rename")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session("local[*]")
    files = src.files(spark, *a.path)
    options = {"passwords": [os.environ[a.password_env]]} if a.password_env else {}
    code = 0
    listing = ops.globbed(ops.with_current(src.members(files, **options)), a.include, a.exclude)
    if a.verb == "list":
        for r in listing.orderBy("archive_id", "member_id").select(member_line(digests=a.digests).alias("line")).toLocalIterator():
            print(r.line)
    elif a.verb == "info":
        for r in src.archives(files, **options).select(escaped(F.col("archive_id")).alias("archive"), "format", "member_count", "is_encrypted", access_summary(F.col("cost")).alias("access"), "listing_error").toLocalIterator():
            print(json.dumps(r.asDict(True)))
    elif a.verb == "detect":
        for r in detect(files).toLocalIterator():
            print(json.dumps(r.asDict(True)))
    elif a.verb == "test":
        for r in integrity.test_summary(src.content(files, wanted=listing, **options)).toLocalIterator():
            print(json.dumps(r.asDict()))
            code = max(code, int(r.error > 0))
    else:
        chosen = listing.select("archive_id", "member_id")
        rows = extraction.extract(files, src.members(files, **options), a.dest, a.policy, a.overwrite, wanted=chosen, **options)
        for r in rows.toLocalIterator():
            print(json.dumps(r.asDict(True)))
            code = max(code, int(r.status in ("failed", "blocked")))
    if a.include:
        for r in ops.unmatched_includes(src.members(files, **options), a.include).collect():  # as many as patterns
            print(f"no member matches {r.pattern}", file=sys.stderr)
    if src.archives(files, **options).filter("listing_error is not null").count():
        code = 3
    return code


if __name__ == "__main__":
    sys.exit(main())
