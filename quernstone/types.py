"""The engine's types: 64-bit integers, strings and (in expressions only) booleans; no nulls."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Type(str, Enum):
    INT64 = "INT64"
    VARCHAR = "VARCHAR"
    BOOL = "BOOL"

    @property
    def spark(self) -> T.DataType:
        return {Type.INT64: T.LongType(), Type.VARCHAR: T.StringType(), Type.BOOL: T.BooleanType()}[self]


STORED = (Type.INT64, Type.VARCHAR)
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1
#: Spark types of external tables that are read as an engine type; others are outside the data model.
READABLE = {
    T.ByteType: Type.INT64,
    T.ShortType: Type.INT64,
    T.IntegerType: Type.INT64,
    T.LongType: Type.INT64,
    T.StringType: Type.VARCHAR,
}
