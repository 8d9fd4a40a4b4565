"""Provider order-by-order CSV files: their lines, and what the files themselves are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.structural_csv import MBO_FIELDS


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, file_name, raw_line) of every line but the header; records end at line ends, as none goes on in the next."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("raw_line"))
    body = lines.where(F.col("raw_line") != ",".join(MBO_FIELDS))
    return body.withColumn("record_id", F.monotonically_increasing_id()).select("record_id", "file_name", "raw_line")


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, sha256, bytes) of each file, its content hashed where it is read."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def identity_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or other than expected; none means the sources are what they should be."""
    columns = ["file_name", "sha256", "bytes"]
    a, b = found.select(*columns), expected.select(*columns)
    return a.exceptAll(b).withColumn("finding", F.lit("UNEXPECTED")).unionByName(b.exceptAll(a).withColumn("finding", F.lit("MISSING")))
