"""64-bit codes for column values.

Grouping on a few longs is narrower and faster to shuffle than grouping on texts
and mixed types. A code must be one-to-one on the values of its column, with null
kept as null. Integers, dates and timestamps are their own code; for values of at
most eight bytes xxhash64 is a bijection (it only rotates, xors with its own shift
and multiplies by odd numbers). Wider values get a hash whose one-to-oneness has
to be proven on the data (see plans.coded) before anything is concluded from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_FIXED_WIDTH = (
    T.FloatType,
    T.DoubleType,
    T.TimestampNTZType,
    T.DayTimeIntervalType,
    T.YearMonthIntervalType,
)


def check_groupable(name: str, dtype: T.DataType) -> None:
    """Reject types whose grouping equality Spark does not define or we do not code."""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        raise TypeError(f"column {name}: {dtype.simpleString()} has no grouping equality; convert it first")
    if isinstance(dtype, T.StringType) and dtype.simpleString() != "string":
        raise TypeError(f"column {name}: collated strings are not supported; cast to plain string first")
    if isinstance(dtype, T.ArrayType):
        check_groupable(name, dtype.elementType)
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            check_groupable(f"{name}.{field.name}", field.dataType)


def needs_proof(dtype: T.DataType) -> bool:
    """True where the code is a hash of something wider than eight bytes."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision > 18
    return not isinstance(dtype, (*_INTEGERS, *_FIXED_WIDTH, T.DateType, T.TimestampType, T.NullType))


def code(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NullType) or isinstance(dtype, _INTEGERS):
        return value.cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    return hashed(value, 0)


def hashed(value: Column, slot: int) -> Column:
    """Hash number `slot` of a value; further slots are independent of the first."""
    parts = [value] if slot == 0 else [F.lit(slot), value]
    return F.when(value.isNotNull(), F.xxhash64(*parts))
