"""Nested values: deep merges, first values of maps, JSON by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, MapType, StructType, TimestampNTZType, TimestampType


def merged(a: Column, b: Column, kind: DataType) -> Column:
    """Two values of one type as one: arrays one after the other, maps and structs by key, of anything else ``a`` unless it's null."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.concat(a, b), a, b)
    if isinstance(kind, MapType):
        return F.coalesce(F.map_zip_with(a, b, lambda _, x, y: merged(x, y, kind.valueType)), a, b)
    if isinstance(kind, StructType):
        both = F.struct(*[merged(a[f.name], b[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)
    return F.coalesce(a, b)


def first_value(values: Column) -> Column:
    """The first value of a map that isn't null, empty, zero or false as text."""
    return F.get(F.filter(F.map_values(values), lambda v: v.isNotNull() & ~v.cast("string").isin("", "0", "0.0", "false")), F.lit(0))


def parsed_bool(value: Column) -> Column:
    """True for "true", "yes", "y", "t" and "1" in any case; all else is false, null too."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "yes", "y", "t", "1"), F.lit(False))


def json_record(columns: list[Column], schema: StructType) -> Column:
    """One JSON object of columns of these types: dates as ISO text, decimals as numbers, the rest as it is."""

    def plain(c: Column, kind: DataType) -> Column:
        if isinstance(kind, DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c.cast("double") if isinstance(kind, DecimalType) else c

    return F.to_json(F.struct(*[plain(c, f.dataType).alias(f.name) for c, f in zip(columns, schema.fields)]), {"ignoreNullFields": "false"})
