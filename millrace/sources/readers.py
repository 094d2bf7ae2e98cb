"""Documents as rows (doc: JSON text), with an order that follows files and places in them.

All readers are Spark's, so any store that Spark reaches will do; .gz and .zst are decoded by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.values import Problem, all_json, to_json

RECORD_SEPARATOR = "\x1e"
#: documents of a file that are given on at once
BATCH = 10_000
#: tasks that rows are dealt to, at least
TASKS_A_CORE = 4
BLANK = r"^[ \t\r\n\x{FEFF}]*$"


def _ordered(df: DataFrame, value: Column) -> DataFrame:
    """(file, place, doc): place grows along a file, also over its splits."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), value.alias("doc"))


def lines(spark: SparkSession, path) -> DataFrame:
    """One document a line; blank lines are skipped, a byte order mark is dropped."""
    text = F.regexp_replace("value", r"^\x{FEFF}", "")
    return _ordered(spark.read.text(path), text).filter(~F.col("doc").rlike(BLANK))


def raw_lines(spark: SparkSession, path, slurp: bool = False) -> DataFrame:
    """Lines as strings, or each file as one string."""
    df = spark.read.text(path, wholetext=slurp)
    return _ordered(df, _quoted(F.col("value")))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def sequence(spark: SparkSession, path) -> DataFrame:
    """Documents between record separators (RFC 7464); what can't be read is skipped."""
    df = _ordered(spark.read.option("lineSep", RECORD_SEPARATOR).text(path), F.col("value")).filter(~F.col("doc").rlike(BLANK))
    return df.filter(F.try_parse_json("doc").isNotNull())


def documents(spark: SparkSession, path) -> DataFrame:
    """Files of one document or of several that follow each other, also over many lines."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = all_json(text)
                for at in range(0, len(values), BATCH):
                    docs = [to_json(x) for x in values[at : at + BATCH]]
                    yield pa.record_batch([pa.array([file] * len(docs), pa.string()), pa.array(range(at, at + len(docs)), pa.int64()), pa.array(docs, pa.string())], ["file", "place", "doc"])

    # a file is one row, so a document's place in it is its number
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(split, "file string, place long, doc string")


def looks_like_lines(spark: SparkSession, path) -> bool:
    """Whether the first line is a whole object or array and another line follows."""
    first = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    if len(first) < 2 or first[0].strip()[:1] not in ("{", "["):
        return False
    try:
        return len(all_json(first[0])) == 1
    except Problem:
        return False


def read_json(spark: SparkSession, path, mode: str = "auto") -> DataFrame:
    """mode: lines, documents, seq, raw, raw-slurp, or auto (lines if the file looks like it)."""
    if mode == "auto":
        mode = "lines" if looks_like_lines(spark, path) else "documents"
    readers = {"lines": lines, "documents": documents, "seq": sequence, "raw": raw_lines, "raw-slurp": lambda s, p: raw_lines(s, p, True)}
    return readers[mode](spark, path)


def rows_as_json(df: DataFrame, deal: bool = False) -> DataFrame:
    """A table's rows as documents; nulls are kept as nulls. deal spreads them over all cores, in their order."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}
    columns = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.monotonically_increasing_id().alias("place"), columns.alias("row"))
    if deal:
        # a row group of a file is read by one task, and may hold a million rows
        spark = df.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
        rows = rows.repartitionByRange(tasks, "place").sortWithinPartitions("place")
    return rows.select(F.lit("").alias("file"), "place", F.to_json("row", options).alias("doc"))
