"""Type names of the source language and the Spark types they stand for."""

from __future__ import annotations

from pyspark.sql import types as T

# Source type name -> Spark type.
SPARK_TYPES: dict[str, T.DataType] = {
    "type text": T.StringType(),
    "type number": T.DoubleType(),
    "Int64.Type": T.LongType(),
    "Int32.Type": T.IntegerType(),
    "type date": T.DateType(),
    "type datetime": T.TimestampType(),
    "type datetimezone": T.TimestampType(),
    "type logical": T.BooleanType(),
    "type binary": T.BinaryType(),
    "Decimal.Type": T.DecimalType(38, 18),
    "Currency.Type": T.DecimalType(19, 4),
    "Percentage.Type": T.DoubleType(),
    "type time": T.StringType(),
    "type duration": T.LongType(),
    "type any": T.StringType(),
}


def spark_type(name: str | T.DataType, ntz: bool = False) -> T.DataType:
    """Resolve a source type name, a Spark DDL type or a ``DataType``.

    ``ntz`` picks the timestamp without zone for ``type datetime``. A name that
    is neither a source type nor Spark DDL becomes a string.
    """
    if isinstance(name, T.DataType):
        return name
    name = name.strip()
    if ntz and name == "type datetime":
        return T.TimestampNTZType()
    if name in SPARK_TYPES:
        return SPARK_TYPES[name]
    try:
        return T.DataType.fromDDL(name)
    except Exception:
        return T.StringType()
