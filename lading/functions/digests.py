"""Digests that Spark has not: combination of checksums, BLAKE2sp, Adler-32."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for _ in range(32):
        if b & 0x80000000:
            out ^= a
        a = a >> 1 ^ _POLY if a & 1 else a >> 1
        b = b << 1 & 0xFFFFFFFF
    return out


#: x to the powers 8, 16, 32, ...
_POWERS = [0x00800000]
for _ in range(63):
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


@lru_cache(4096)
def _shift(length: int) -> int:
    """x to the eightfold length."""
    power, k = 0x80000000, 0
    while length:
        if length & 1:
            power = _times(power, _POWERS[k])
        length, k = length >> 1, k + 1
    return power


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of two strings in a row from theirs and the second's length: the first
    times x to the eightfold length, plus the second."""
    return (_times(first, _shift(length)) if first else 0) ^ second


def adler32_combine(first: int, second: int, length: int) -> int:
    m = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % m
    return ((b1 + b2 + length * (a1 - 1)) % m) << 16 | a


class Blake2sp:
    """BLAKE2s in eight leaves that take turns at 64-byte blocks, and a root over them."""

    def __init__(self) -> None:
        self.leaves = [hashlib.blake2s(fanout=8, depth=2, inner_size=32, node_offset=i, node_depth=0, last_node=i == 7) for i in range(8)]
        self.held, self.turn = b"", 0

    def update(self, data: bytes) -> None:
        data = self.held + data
        whole = len(data) // 64 * 64
        for i in range(0, whole, 64):
            self.leaves[self.turn].update(data[i : i + 64])
            self.turn = (self.turn + 1) % 8
        self.held = data[whole:]

    def digest(self) -> bytes:
        leaves = [x.copy() for x in self.leaves]
        if self.held:
            leaves[self.turn].update(self.held)
        root = hashlib.blake2s(fanout=8, depth=2, inner_size=32, node_offset=0, node_depth=1, last_node=True)
        for x in leaves:
            root.update(x.digest())
        return root.digest()


def blake2sp(data: bytes) -> bytes:
    h = Blake2sp()
    h.update(data)
    return h.digest()


@F.pandas_udf(T.BinaryType())
def blake2sp_of(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else blake2sp(bytes(x)))


@F.pandas_udf(T.LongType())
def adler32_of(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.adler32(bytes(x))).astype("Int64")


def combined_crc32(chunks: DataFrame, keys: list[str], order: str, crc: str = "crc", length: str = "n", out: str = "crc32") -> DataFrame:
    """CRC-32 and ``size`` of each key's chunks in order from the chunks' own. A key's
    chunks stand in a row of one partition and are folded as they stream by."""
    rows = chunks.select(*keys, order, F.col(crc).cast("long").alias(crc), F.col(length).cast("long").alias(length)).repartition(*keys).sortWithinPartitions(*keys, order)
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", `{out}` long, `size` long"
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, size = None, 0, 0
        for batch in batches:
            done: list[tuple] = []
            own = [c.to_pylist() for c in batch.columns]
            for key, c, k in zip(zip(*own[:n]), own[n + 1], own[n + 2]):
                if key == now:
                    total, size = crc32_combine(total, c, k), size + k
                else:
                    if now is not None:
                        done.append((*now, total, size))
                    now, total, size = key, c, k
            if done:
                yield _table(done, batch)
        if now is not None:
            yield _table([(*now, total, size)], batch)

    def _table(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [*like.schema.types[:n], pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[*keys, out, "size"])

    return rows.mapInArrow(fold, schema)
