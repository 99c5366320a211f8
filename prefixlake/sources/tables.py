"""Schemas and readers of the library's own tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One line of the decision log; it has no column for texts.
DECISION = (
    "request_id string, timestamp string, namespace string, model string, block_index int, block_type string, block_content_hash string, outcome string, method string, "
    "context_id string, version int, similarity double, guard_outcome string, rejection_reason string, bypass_reason string, error_component string"
)
#: One line of an adapter's trace; results are of many kinds and stay JSON.
TRACE = "timestamp double, pid int, replica string, operation string, keys array<string>, batch_size int, result string, page_count int"


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision log; a line that is no record stops the read."""
    return spark.read.schema(DECISION).option("mode", "FAILFAST").json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, in order of file names."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name()).orderBy("file")

