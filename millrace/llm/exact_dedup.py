"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every source block (a run of rows of one input partition) sends its distinct hashes, sorted and
   Golomb-coded, to the owners of their ranges; about ten bits a document cross the network.
2. An owner decodes what it gets, finds hashes that came from more than one block, and returns one
   bitmap per block.
3. A block marks as suspects the rows that a bitmap names or that repeat within the block.
4. Only suspects' texts are read again and compared byte for byte, as keys of an aggregation that
   combines equal texts before its shuffle, so a group holding a third of all rows stays cheap.

Hash length follows the row count (eight bits beyond its logarithm), so about one row in 256 is
suspected without cause, whatever the size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, bounded, held, shuffle_partitions, texts

BLOCK_BITS = 17
#: hashes that one owner handles at once
OWNER_ROWS = 4_000_000
NULL_ID = -(1 << 63)


def golomb_parameter(span: int, n: int) -> int:
    """Bits of the remainder for n sorted values out of span (Golomb's code with a power of two)."""
    return max(0, round(math.log2(max(1.0, 0.69 * span / max(n, 1)))))


def golomb_encode(values: np.ndarray, low: int, bits: int) -> bytes:
    """Sorted distinct values >= low, as their gaps: quotients in unary, then remainders of ``bits`` bits."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.int64(low))
    ends = np.cumsum((gaps >> bits) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = (((gaps & ((1 << bits) - 1))[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(code: bytes, n: int, low: int, bits: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(code, np.uint8)
    tail = (n * bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(raw[len(raw) - tail :])[: n * bits].reshape(n, bits).astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return low + np.cumsum((quotients.astype(np.int64) << bits) | rest)


def _ranges(owners: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // owners for i in range(owners + 1)], np.int64)


def _send(owners: int, bits: int):
    edges = _ranges(owners, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def coded(src: int, own: list[np.ndarray]) -> pa.RecordBatch:
            values = np.unique(np.concatenate(own))
            cut = np.searchsorted(values, edges)
            to = [o for o in range(owners) if cut[o] < cut[o + 1]]
            ns = [int(cut[o + 1] - cut[o]) for o in to]
            ps = [golomb_parameter(int(edges[o + 1] - edges[o]), n) for o, n in zip(to, ns, strict=True)]
            codes = [golomb_encode(values[cut[o] : cut[o + 1]], int(edges[o]), p) for o, p in zip(to, ps, strict=True)]
            return pa.record_batch([pa.array([src] * len(to), pa.int64()), pa.array(to, pa.int32()), pa.array(ns, pa.int32()), pa.array(ps, pa.int32()), pa.array(codes, pa.binary())], ["src", "owner", "n", "p", "code"])

        src, own = None, []
        for batch in batches:
            blocks, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in pd.unique(blocks):  # a partition's blocks follow each other
                if src is not None and block != src:
                    yield coded(src, own)
                    own = []
                src = int(block)
                own.append(values[blocks == block])
        if src is not None:
            yield coded(src, own)

    return send


def _own(owners: int, bits: int):
    edges = _ranges(owners, bits)

    def own(got: pd.DataFrame) -> pd.DataFrame:
        low = int(edges[int(got["owner"].iloc[0])])
        parts = [golomb_decode(c, n, low, p) for c, n, p in zip(got["code"], got["n"], got["p"], strict=True)]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[counts > 1]
        maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in parts]
        return pd.DataFrame({"src": got["src"], "owner": got["owner"], "n": got["n"], "bitmap": maps})

    return own


def _mark(block: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
    values, inverse, counts = np.unique(block["v"].to_numpy(), return_inverse=True, return_counts=True)
    order = maps.sort_values("owner")
    flags = [np.unpackbits(np.frombuffer(m, np.uint8))[:n] for m, n in zip(order["bitmap"], order["n"], strict=True)]
    named = np.concatenate(flags).astype(bool) if flags else np.zeros(len(values), bool)
    return pd.DataFrame({"doc_id": block["doc_id"], "sha": block["sha"], "suspect": (named | (counts > 1))[inverse]})


def fingerprint_suspects(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, suspect) for every row of (doc_id, text): steps 1 to 3."""
    spark = docs.sparkSession
    norm = ascii_lower(F.col("text"))
    side = docs.select(F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("src"), "doc_id", F.xxhash64(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    side = held(side)
    n = side.count()
    bits = min(60, math.ceil(math.log2(max(n, 2))) + 8)
    owners = max(1, min(shuffle_partitions(spark), n), n // OWNER_ROWS)
    side = side.withColumn("v", F.shiftrightunsigned("h", 64 - bits))
    sent = side.select("src", "v").mapInArrow(_send(owners, bits), "src long, owner int, n int, p int, code binary")
    maps = sent.groupBy("owner").applyInPandas(_own(owners, bits), "src long, owner int, n int, bitmap binary")
    return side.select("src", "doc_id", "v", "sha").groupBy("src").cogroup(maps.groupBy("src")).applyInPandas(_mark, "doc_id long, sha binary, suspect boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The row with the
    largest id of equal texts stays. Repeated rows (same id, same text) can't be told apart: they
    count in group_size and share one verdict. A group whose ids are all null keeps all its rows.
    Other columns are ignored whatever their names; an empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    marked = held(fingerprint_suspects(rows))
    key = lambda c: F.coalesce(c, F.lit(NULL_ID))
    ids = marked.where("suspect").select(key(F.col("doc_id")).alias("key")).distinct()
    n = marked.where("suspect").count()
    suspects = rows.join(bounded(ids, n, 16), key(rows["doc_id"]) == ids["key"], "left_semi")
    # equal bytes meet as keys of the aggregation; its map side combines copies
    classes = suspects.groupBy(ascii_lower(F.col("text")).alias("norm")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share one SHA-256"))).otherwise(F.max("group_size"))
    classes = classes.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), one.alias("group_size"))
    joined = marked.where("suspect").join(bounded(classes, n, 72), "sha", "left").select("doc_id", "keep_id", "group_size", "sha")
    alone = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return joined.unionByName(alone).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
