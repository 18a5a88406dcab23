"""Explicit schemas of the data model (no inference anywhere)."""

from pyspark.sql import types as T

# Parsed performance trace: one row per trace line.
TRACE = T.StructType([
    T.StructField("framework", T.StringType()),
    T.StructField("run_ts", T.TimestampNTZType()),
    T.StructField("phase", T.StringType()),
    T.StructField("nodes", T.IntegerType()),
    T.StructField("seconds", T.DecimalType(18, 5)),
    T.StructField("file", T.StringType()),
])

XML_PROPERTY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("description", T.StringType()),
])
