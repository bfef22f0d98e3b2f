"""The schema text of ingest configurations: ``name type, name type``."""

from __future__ import annotations

from pyspark.sql import types as T

INGEST_SPARK_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
    "number": T.LongType(),
    "timestamp": T.TimestampType(),
}


def parse_schema(text: str) -> T.StructType:
    """Nullable fields in order; an unknown type or a malformed entry raises."""
    fields = []
    for entry in text.split(","):
        words = entry.split()
        if len(words) != 2:
            raise ValueError(f"expected 'name type', got {entry.strip()!r}")
        name, dtype = words
        if dtype.lower() not in INGEST_SPARK_TYPES:
            raise ValueError(f"ingest knows no type {dtype.lower()}")
        fields.append(T.StructField(name, INGEST_SPARK_TYPES[dtype.lower()], True))
    return T.StructType(fields)
