"""What can be wrong with an archive, as codes that tables carry."""

from __future__ import annotations


class ArchiveError(Exception):
    """A fault of one archive or member; it becomes an error column, not a failed job."""

    code = "archive"

    def __init__(self, message: str, member_name: str | None = None):
        super().__init__(message)
        self.member_name = member_name

    def row(self) -> dict:
        return {"code": self.code, "message": str(self), "member_name": self.member_name}


class DetectionError(ArchiveError):
    code = "format_detection"


class UnsupportedFormat(ArchiveError):
    code = "unsupported_format"


class UnsupportedFeature(ArchiveError):
    code = "unsupported_feature"


class Corrupt(ArchiveError):
    code = "corruption"


class Truncated(ArchiveError):
    code = "truncated"


class Encrypted(ArchiveError):
    code = "encryption"


class LinkTargetMissing(ArchiveError):
    code = "link_target_not_found"


class MissingComponent(ArchiveError):
    code = "package_not_installed"


class LimitReached(ArchiveError):
    code = "resource_limit"


class UsageError(ValueError):
    """A call that can't be meant; it fails the job."""
