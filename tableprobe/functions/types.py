"""Display names and type tests of Spark column types."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

#: Spark type -> display name. Types not listed show Spark's own name.
_DISPLAY = {
    T.ByteType: "int",
    T.ShortType: "int",
    T.IntegerType: "int",
    T.LongType: "int",
    T.FloatType: "float",
    T.DoubleType: "float",
    T.DecimalType: "decimal",
    T.BooleanType: "boolean",
    T.StringType: "string",
    T.CharType: "string",
    T.VarcharType: "string",
    T.NullType: "string",
    T.BinaryType: "binary",
    T.DateType: "date",
    T.TimestampType: "datetime",
    T.TimestampNTZType: "datetime",
    T.TimeType: "time",
    T.ArrayType: "list",
    T.StructType: "struct",
}

#: An unsigned 64-bit integer reads as this decimal and stays an integer to the user.
UINT64 = T.DecimalType(20, 0)


def simplify_type(dtype: T.DataType) -> str:
    """Short type name: int, float, string, date, datetime, boolean, binary, ..."""
    if dtype == UINT64:
        return "int"
    return _DISPLAY.get(type(dtype), dtype.simpleString())


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType))


def column(name: str):
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_columns_to_string(df: DataFrame) -> DataFrame:
    """A column of the null type holds nothing; it is shown and computed as text."""
    voids = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    if not voids:
        return df
    return df.withColumns({name: column(name).cast("string") for name in voids})
