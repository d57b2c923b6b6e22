"""Column types of the dialect: their Spark types, literals, coercion and rendering."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

#: Spellings of the types, any other name is VARCHAR.
SPELLINGS = {
    "INT32": "INT32", "INT": "INT32", "INT64": "INT64", "FLOAT64": "FLOAT64", "FLOAT": "FLOAT64", "DOUBLE": "FLOAT64",
    "BOOL": "BOOL", "BOOLEAN": "BOOL", "VARCHAR": "VARCHAR", "TIMESTAMP": "TIMESTAMP",
}
#: Spark types; a timestamp is a UTC wall time, whatever the session's time zone.
SPARK = {
    "INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT64": T.DoubleType(), "BOOL": T.BooleanType(),
    "VARCHAR": T.StringType(), "TIMESTAMP": T.TimestampNTZType(),
}
NUMERIC = ("INT32", "INT64", "FLOAT64")
_EPOCH = datetime(1970, 1, 1)


def spelled(name: str) -> str:
    """The type that a spelling stands for."""
    return SPELLINGS.get(name.upper(), "VARCHAR")


def of_spark(kind: T.DataType) -> str | None:
    """The dialect's type of a Spark column; None if it has no counterpart."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "INT32"
    if isinstance(kind, T.LongType):
        return "INT64"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT64"
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "VARCHAR"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return "TIMESTAMP"
    return None


def from_millis(ms: int) -> datetime:
    return _EPOCH + timedelta(milliseconds=ms)


def coerce(value: object, kind: str) -> object:
    """A literal as INSERT and UPDATE store it: what doesn't fit its column's type becomes that type's default."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("INT32", "INT64"):
        out = int(value) if isinstance(value, int) else 0
        bound = 1 << (31 if kind == "INT32" else 63)
        if not -bound <= out < bound:
            raise InvalidArgument(f"{out} is out of range for {kind}")
        return out
    if kind == "FLOAT64":
        return float(value) if number else 0.0
    if kind == "BOOL":
        return bool(value) if isinstance(value, int) else False
    if kind == "TIMESTAMP":
        return from_millis(value if isinstance(value, int) and not isinstance(value, bool) else 0)
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else str(value) if isinstance(value, int) else ""


def literal_for(value: object, kind: str, spark_type: T.DataType) -> Column | None:
    """A literal to compare a column of this type with; None if the two never match."""
    if kind in NUMERIC:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
            return F.lit(float(value))
        return F.lit(value)
    if kind == "VARCHAR":
        return F.lit(value) if isinstance(value, str) else None
    if kind == "BOOL":
        return F.lit(bool(value)) if isinstance(value, int) and value in (0, 1) else None
    if kind == "TIMESTAMP":
        if not isinstance(value, int) or isinstance(value, bool):
            return None
        if isinstance(spark_type, T.TimestampType):
            return F.timestamp_millis(F.lit(value))
        return F.lit(from_millis(value).isoformat(sep=" ", timespec="milliseconds")).cast("timestamp_ntz")
    return None


def rendered(value: object) -> str:
    """A cell as text: doubles with six decimals, booleans in lower case, timestamps to the second."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)
