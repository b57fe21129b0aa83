"""Schemas of the tables that archives turn into."""

from __future__ import annotations

from pyspark.sql import types as T

_time = T.StructType([T.StructField("wall", T.TimestampNTZType()), T.StructField("utc", T.TimestampType())])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FORMAT = _struct(container=T.StringType(), stream=T.StringType())
COST = _struct(listing=T.StringType(), access=T.StringType(), solid_block_count=T.IntegerType())
ERROR = _struct(code=T.StringType(), message=T.StringType(), member_name=T.StringType())

ARCHIVES = _struct(
    archive_id=T.StringType(), format=FORMAT, confidence=T.StringType(), detected_by=T.StringType(), payload_offset=T.LongType(), is_solid=T.BooleanType(), member_count=T.IntegerType(),
    comment=T.StringType(), is_encrypted=T.BooleanType(), is_multivolume=T.BooleanType(), cost=COST, extra=T.MapType(T.StringType(), T.StringType()), listing_error=ERROR,
)

#: A member is identified by (archive_id, member_id); member_id is its place in the archive.
MEMBERS = _struct(
    archive_id=T.StringType(), member_id=T.IntegerType(), type=T.StringType(), name=T.StringType(), name_lossy=T.BooleanType(), raw_name=T.BinaryType(), size=T.LongType(), compressed_size=T.LongType(),
    modified=_time, accessed=_time, created=_time, mode=T.IntegerType(), uid=T.LongType(), gid=T.LongType(), uname=T.StringType(), gname=T.StringType(), comment=T.StringType(), link_target=T.StringType(),
    compression=T.ArrayType(_struct(algo=T.StringType(), level=T.IntegerType(), properties=T.BinaryType())), is_encrypted=T.BooleanType(), is_current=T.BooleanType(), is_sparse=T.BooleanType(),
    create_system=T.StringType(), windows_attrs=T.LongType(), hashes=T.MapType(T.StringType(), T.BinaryType()), extra=T.MapType(T.StringType(), T.StringType()), block=T.IntegerType(), block_position=T.IntegerType(),
)

#: Decoded content in chunks; ``verdict`` and ``error`` stand on a member's last chunk.
CONTENT = _struct(archive_id=T.StringType(), member_id=T.IntegerType(), name=T.StringType(), chunk_index=T.IntegerType(), data=T.BinaryType(), last=T.BooleanType(), verdict=T.StringType(), error=ERROR)

DIAGNOSTICS = _struct(archive_id=T.StringType(), seq=T.IntegerType(), code=T.StringType(), severity=T.StringType(), member_id=T.IntegerType(), message=T.StringType(), context=T.StringType())

RESULTS = _struct(archive_id=T.StringType(), member_id=T.IntegerType(), name=T.StringType(), status=T.StringType(), path=T.StringType(), requested_path=T.StringType(), error=ERROR)
