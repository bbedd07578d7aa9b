"""Type strings to Spark types, strictly and recursively.

Two spellings are accepted: expression-library names (int64, array<string>) and SQL names (BIGINT, VARCHAR[],
STRUCT(a INTEGER)). Names that mean no type raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import types as T

_SIMPLE: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "tinyint": T.ByteType(), "int8": T.ByteType(), "smallint": T.ShortType(), "int16": T.ShortType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "int32": T.IntegerType(), "bigint": T.LongType(), "int64": T.LongType(), "long": T.LongType(),
    "utinyint": T.ShortType(), "uint8": T.ShortType(), "usmallint": T.IntegerType(), "uint16": T.IntegerType(),
    "uint": T.LongType(), "uinteger": T.LongType(), "uint32": T.LongType(), "ubigint": T.DecimalType(20, 0), "uint64": T.DecimalType(20, 0), "hugeint": T.DecimalType(38, 0),
    "float": T.FloatType(), "float32": T.FloatType(), "real": T.FloatType(), "double": T.DoubleType(), "float64": T.DoubleType(),
    "string": T.StringType(), "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(), "uuid": T.StringType(), "json": T.StringType(),
    "binary": T.BinaryType(), "blob": T.BinaryType(), "bytea": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "timestamp_ntz": T.TimestampNTZType(), "timestamp_s": T.TimestampNTZType(), "timestamp_ms": T.TimestampNTZType(), "timestamp_ns": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "timestamp_ltz": T.TimestampType(),
    "interval": T.DayTimeIntervalType(), "decimal": T.DecimalType(38, 18), "numeric": T.DecimalType(38, 18),
}


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([") - (c in ">)]")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def parse_type(text: str) -> T.DataType:
    """The Spark type of a type string; unknown names raise ValueError. Field names keep their case."""
    t = text.strip()
    low = t.lower()
    if low.startswith("!"):  # not nullable: contracts ignore it
        return parse_type(t[1:])
    if m := re.fullmatch(r"(.*)\[\d*\]", t, re.S):
        return T.ArrayType(parse_type(m[1]))
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", low):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if re.fullmatch(r"(?:varchar|char|string)\s*\(\s*\d+\s*\)", low):
        return T.StringType()
    if m := re.fullmatch(r"timestamp\s*\(([^)]*)\)", low):
        return T.TimestampType() if re.search("[a-z]", m[1]) else T.TimestampNTZType()
    if low in ("time", "time(6)"):
        return T.TimeType()
    if m := re.fullmatch(r"(array|list|map|struct|row)\s*[<(](.*)[>)]", t, re.S | re.I):
        kind, parts = m[1].lower(), _parts(m[2])
        if kind in ("array", "list") and len(parts) == 1:
            return T.ArrayType(parse_type(parts[0]))
        if kind == "map" and len(parts) == 2:
            return T.MapType(parse_type(parts[0]), parse_type(parts[1]))
        if kind in ("struct", "row") and parts:
            fields = [re.fullmatch(r'"?([^":\s]+)"?\s*[:\s]\s*(.+)', p, re.S) for p in parts]
            if all(fields):
                return T.StructType([T.StructField(f[1], parse_type(f[2])) for f in fields])
    if low in _SIMPLE:
        return _SIMPLE[low]
    raise ValueError(f"no type is called {text!r}")


def schema_of(columns: Mapping[str, str | T.DataType] | T.StructType) -> T.StructType:
    """A schema of nullable fields from names and type strings."""
    if isinstance(columns, T.StructType):
        return T.StructType([T.StructField(f.name, f.dataType) for f in columns])
    return T.StructType([T.StructField(n, t if isinstance(t, T.DataType) else parse_type(t)) for n, t in columns.items()])
