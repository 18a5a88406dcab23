"""Host files, XML configuration and directory catalogues (A2, A4, A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.schemas import XML_PROPERTY


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every text line below ``path`` with its file path: ``(file, line)`` (A2).

    The file path is the natural group key (one host file = one allocation).
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"),
                                    F.col("value").alias("line"))


def read_xml_properties(spark: SparkSession, path: str) -> DataFrame:
    """``<property><name/><value/></property>`` rows of XML configs (A4).

    Lay configs out as ``<root>/profile=<name>/<file>.xml``: ``profile`` is
    then a partition column and a filter on it prunes whole profiles.
    Commented-out properties give no row. Placeholders stay as text.
    """
    df = (spark.read.format("xml").option("rowTag", "property")
          .schema(XML_PROPERTY).load(path))
    return df.withColumn("file", F.col("_metadata.file_path"))


def read_catalog(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Recursive listing ``(path, name, modificationTime, length)`` (A5).

    Uses the ``binaryFile`` source but never selects ``content``, so the
    scan reads no file bodies (``ReadSchema`` holds no content column).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path).select("path", "modificationTime", "length")
    return df.withColumn("name", F.substring_index("path", "/", -1))
