"""From raw documents to packed sequences: quality rules, exact and near deduplication, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null texts count as empty, which the rules reject. Rows that share an id are told apart, ties of a group go to the
row that is read first, other columns are carried along whatever their names, and empty tables give empty results.
A stage first lets go of what the stages before it held, as their results are written by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, quality_rules, simhash_dedup, suffix_dedup
from millrace.llm.common import ascii_lower, bounded, ensure_checkpoint_dir, held, read, release
from millrace.llm.queries import packed


def _with_size(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return _with_size(quality_rules.clean(docs), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, ids before null; of rows that repeat both one stays."""
    release()
    told = exact_dedup.exact_dedup(docs).where("group_size > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept")
    told = held(told.groupBy("id", "sha", "kept").agg(F.count("*").alias("n")))
    own = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), own.alias("_sha"), F.monotonically_increasing_id().alias("_place"))
    same = lambda of: rows["_id"].eqNullSafe(of["id"]) & (rows["_sha"] == of["sha"])
    gone, twins = told.where("not kept"), told.where("kept and n > 1")
    left = rows.join(bounded(gone, gone.count(), 160), same(gone), "left_anti")
    if n := twins.count():
        twin = rows.join(bounded(twins, n, 160), same(twins), "left_semi")
        first = twin.groupBy("_id", "_sha").agg(F.min("_place").alias("_place")).select("_place")
        left = left.join(bounded(twins, n, 160), same(twins), "left_anti").unionByName(rows.join(first, "_place", "left_semi").select(left.columns))
    return left.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, Jaccard similarity 0.8) the row with the smallest doc_id, ids before null."""
    release()
    return simhash_dedup.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat an earlier string of 100 bytes; no character is cut."""
    release()
    done = suffix_dedup.remove_repeats(docs, whole_chars=True, carry=tuple(c for c in docs.columns if c != "text"))
    return _with_size(done.withColumn("text", F.decode("kept", "UTF-8")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    release()
    return packed(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("suffix_array_dedup", passages), ("best_fit_packing", packing)]

#: tokens and suffix arrays are beyond SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # nothing reads the table before any more; the last one is what the result is made of
                release()
                gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
                gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
