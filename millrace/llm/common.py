"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns: blank and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: a letter before white space or closing punctuation: a pre-token ends between them, and no special string holds such a place
AFTER_LETTER = re.compile("(?<=[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])(?=[ \\n\\t,.;:!?\u3001\u3002\uff0c\uff01\uff1f])")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts become empty, every other column is left out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def ascii_lower(text):
    """A-Z to a-z and nothing else (``lower`` would fold other scripts too)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; only where it is unset, and Spark is one process (tests), a local one is made."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))


def checkpointed(df: DataFrame, files: int | None = None) -> DataFrame:
    """Lineage cut by reliable checkpoint, in at most ``files`` files."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if files is None else df.coalesce(max(1, files))).checkpoint(eager=True)


_HELD: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Kept for reuse in memory or on executors' disks; what a lost executor held is computed anew from its lineage."""
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> None:
    """Lets go of all that was held so far; what still needs it computes it anew."""
    while _HELD:
        _HELD.pop().unpersist()


_REMEMBERED: list = []


def alone(cached=None):
    """Workers serve one operator after another: when another starts, what the earlier one remembers (an lru_cache) goes."""
    while _REMEMBERED and _REMEMBERED[-1] is not cached:
        _REMEMBERED.pop().cache_clear()
    if cached is not None and not _REMEMBERED:
        _REMEMBERED.append(cached)
    return cached


def release_memory() -> None:
    """At the end of a task: freed memory goes back to the system, where the C library can do that."""
    alone()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: what is broadcast is counted first, and at most this large; beyond it a sort-merge join takes over
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, to be broadcast if ``rows`` rows (counted) of ``row_bytes`` fit the bound."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def few_files(spark: SparkSession) -> int:
    """Files for a checkpoint of a result far smaller than the input; still in proportion to it."""
    return max(1, shuffle_partitions(spark) // 8)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, which bounds a worker's memory when texts are long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_binary(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())
