"""Language identification by mixture inference.

Training counts hashed character trigrams per language over all training rows, as an aggregation in
Spark; the model is BUCKETS numbers for each language, whatever the corpus' size. A text is explained
as a mixture: expectation-maximisation estimates the proportions of a set of languages, sets grow by
the next likeliest language while the likelihood gained exceeds a penalty per language (log n each, as
in Schwarz's criterion, times PENALTY because neighbouring trigrams aren't independent).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices

BUCKETS = 1 << 16
PENALTY = 5.0
ROUNDS = 12
UNKNOWN = "und"


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Lower-cased letters by code point; a blank for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's trigrams (words with a blank on each side) and their counts; none without letters."""
    cps = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    cps = np.concatenate(([32], cps, [32])).astype(np.uint64)
    cps = cps[np.append(True, (cps[1:] != 32) | (cps[:-1] != 32))]
    if len(cps) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = cps[:-2] * np.uint64(0x9E3779B97F4A7C15) + cps[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + cps[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(48)).astype(np.int64)[cps[1:-1] != 32]
    if len(bucket) > BUCKETS:
        counts = np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(bucket, return_counts=True)


def train(rows: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (BUCKETS x languages) from rows (text, lang); null texts or languages teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bucket, n = trigrams(text)
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] += n
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    counted = rows.where("text is not null and lang is not null").select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most BUCKETS rows a language
    langs = sorted(set(table.column(0).to_pylist()))
    counts = np.full((BUCKETS, len(langs)), smoothing)
    where = {lang: k for k, lang in enumerate(langs)}
    counts[table.column(1).to_numpy(), [where[x] for x in table.column(0).to_pylist()]] += table.column(2).to_numpy()
    return langs, counts / counts.sum(axis=0)


def proportions(counts: np.ndarray, likelihood: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the mixture's proportions, and the log likelihood."""
    share, n = np.full(likelihood.shape[1], 1 / likelihood.shape[1]), counts.sum()
    for _ in range(rounds):
        share = share * (likelihood.T @ (counts / (likelihood @ share))) / n
    return share, float(counts @ np.log(likelihood @ share))


def mixture(bucket: np.ndarray, counts: np.ndarray, model: np.ndarray, log_model: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of all languages (zero outside the chosen set), and the share of the leading one as its score."""
    langs, n = model.shape[1], int(counts.sum())
    alone = counts @ log_model[bucket]
    first = int(alone.argmax())
    share = np.zeros(langs)
    share[first] = 1.0
    best = float(alone[first])
    score = float(1 / np.exp(alone - best).sum())
    if langs > 1:
        likelihood = model[bucket]
        everything, _ = proportions(counts, likelihood)
        order = [first, *(int(k) for k in np.argsort(-everything, kind="stable") if k != first)]
        for size in range(2, langs + 1):
            own, fit = proportions(counts, likelihood[:, order[:size]])
            if fit - best <= PENALTY * np.log(n + 1):
                break
            best, share = fit, np.zeros(langs)
            share[order[:size]] = own
            score = float(own.max())
    return share, score


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture map<string, double>) for every row; und, 0 and no mixture without letters or without a model.

    Ties go to the first language in order of name. Repeated rows repeat, other columns are ignored, an empty table gives an empty result.
    """
    log_model = np.log(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            preds, scores, mixes = [], [], []
            for text in batch.column(1).to_pylist():
                bucket, counts = trigrams(text or "")
                if len(bucket) and langs:
                    share, score = mixture(bucket, counts, model, log_model)
                    preds.append(langs[int(share.argmax())])
                    scores.append(min(1.0, score))
                    mixes.append([(langs[k], float(share[k])) for k in np.flatnonzero(share)])
                else:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    mixes.append([])
            yield pa.record_batch([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")
