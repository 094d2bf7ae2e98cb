"""The same programs on streams of JSON lines (Structured Streaming)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.api import run_documents


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as documents; blank lines are skipped."""
    df = spark.readStream.text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("place"), F.col("value").alias("doc")).filter(F.trim("doc") != "")


def query_stream(docs: DataFrame, program: str, variables: dict[str, Any] | None = None) -> DataFrame:
    """A program without state over a stream of documents: outputs and errors, see run_documents."""
    return run_documents(docs, program, variables)


def counts_by(docs: DataFrame, program: str) -> DataFrame:
    """Running counts of a program's outputs: group_by and length, kept up to date."""
    return query_stream(docs, program).where("error is null").groupBy("value").count()
