"""Schemas of the two index tables and of what feeds them."""

from pyspark.sql import types as T

DIM = 768

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("chunk_count", T.IntegerType()),
    ]
)
LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime_ms", T.LongType()),
        T.StructField("is_file", T.BooleanType()),
    ]
)


def require(df, schema: T.StructType, what: str):
    """The columns of ``schema`` in order; a missing or differently typed one is an error.
    Extra columns are dropped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name not in have:
            raise ValueError(f"{what} lacks column {f.name}")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"{what}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*[f.name for f in schema.fields])
