"""Token packing: best-fit decreasing over a segment tree of remaining capacities.

Documents are tokenised where they are read. Only (keys, lengths, what the caller wants to carry) are
shuffled, into shards of about SHARD_DOCS documents whatever the key's skew (the shard is a hash of the
document id and the piece number, and ids don't repeat much). In a shard, pieces go from the longest to
the shortest into the fullest sequence that still has room: the tree holds the number of open sequences
by remaining capacity, so the tightest one is found in O(log capacity). A shard fills thousands of
sequences and leaves at most a few of them slack, so sharding costs next to nothing in density.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import alone, slices, texts

SHARD_DOCS = 50_000
#: words and stems whose ids a worker remembers; when a memory is full, its older half is forgotten
WORDS, STEMS = 800_000, 600_000
#: words that are encoded in one text; characters of a text that are split into words at once
TOGETHER, PART = 256, 1 << 20
#: documents that are encoded at once: few, so that their words stay in the processor's caches
ROWS = 32

#: one plain letter (ASCII or Latin-1) in UTF-8; words of such letters, one a line; ASCII punctuation between such a letter and the line's end
LETTER = rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
PLAIN = re.compile(rb"^" + LETTER + rb"+$", re.MULTILINE)
TAIL = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))[!-/:-@\[-`{-~]+$", re.MULTILINE)
#: fixed values: what the tokenizer file must say for words to be encoded one by one
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class Memory:
    """A bounded dictionary of two generations: what is asked for moves to the young one; the old one goes when the young one is full."""

    def __init__(self, size: int):
        self.half, self.young, self.old = size // 2, {}, {}

    def missing(self, keys: set) -> set:
        """Those that are known to neither generation; the others are in the young one afterwards."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        absent = keys.difference(self.young)
        new = absent.difference(self.old)
        old = self.old
        self.young.update([(k, old[k]) for k in absent - new])
        return new


class WordTokenizer:
    """A lower-casing tokenizer whose tokens never cross ASCII white space or run from a letter into punctuation.

    Words are encoded once and remembered; in them, closing punctuation and capitals are taken off first.
    A tokenizer file of another kind is used as it is, text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.stems = Tokenizer.from_file(path), Memory(WORDS), Memory(STEMS)
        told = json.loads(self.tokenizer.to_str())
        splitter = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_words = (
            (told["normalizer"] or {}).get("normalizers") == NORMALIZERS and splitter[0].get("pattern") == {"Regex": SPLIT} and [x["type"] for x in splitter[1:]] == ["ByteLevel"]
            and told["model"]["type"] == "BPE" and told["model"]["end_of_word_suffix"] == WORD_END and all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in told["added_tokens"])
        )
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # of the tokens that end a word
        self.closes[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        # for words of plain lower-case letters, which normalising leaves as they are
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def learn(self, words: set[bytes]) -> None:
        if special := [w for w in words if b"<|" in w]:  # may hold special strings, which are sought before letters are made small
            self.known.young.update(zip(special, self.whole(special), strict=True))
            words = words.difference(special)
        words = list(words)
        lines = b"\n".join(words).lower()
        stems, small = TAIL.sub(b"", lines).split(b"\n"), lines.split(b"\n")
        tails = [(w, s, x[len(s) :]) for w, s, x in zip(words, stems, small, strict=False) if len(s) < len(x)]
        new = self.stems.missing({t for _, _, t in tails}.union(stems))
        told = self.stems.young
        told.update(self.coded(new))
        self.known.young.update(zip(words, map(told.__getitem__, stems), strict=False))
        self.known.young.update([(w, told[s] + told[t]) for w, s, t in tails])

    def coded(self, stems: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Stems with their ids. Those of plain letters are single words to the tokenizer, so texts of many are encoded and split at word ends."""
        plain = PLAIN.findall(b"\n".join(stems))
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.plain.encode(b" ".join(some).decode().lower(), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            raw = ids.tobytes()
            yield from zip(some, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True)
        others = list(stems.difference(plain))
        yield from zip(others, self.whole(others), strict=True)

    def whole(self, words: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(words), TOGETHER):
            for code in self.tokenizer.encode_batch_fast([x.decode() for x in words[at : at + TOGETHER]], add_special_tokens=False):
                yield np.array(code.ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        split = [t.encode("utf-8", "replace").split() for t in texts]
        if new := self.known.missing(set().union(*split)):
            self.learn(new)
        known = self.known.young
        return [b"".join([known[w] for w in words]) for words in split]

    def encode(self, text: str) -> bytes:
        """One text of any length: its words are looked up part by part."""
        return b"".join([self.encode_batch([x])[0] for x in word_parts(text, PART)])


def word_parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end before ASCII white space."""
    at = 0
    while len(text) - at > size and (cut := re.compile(r"[ \t-\r]").search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): a document's ids, then end_id, cut at every ``capacity`` tokens.

    ids is binary: little-endian unsigned 32-bit. Null and empty texts give one piece of end_id alone;
    repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = alone(word_tokenizer)(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches, ROWS):
            ids, piece, start, length, code = [], [], [], [], []
            found = batch.column(1).to_pylist()
            codes = coder.encode_batch(found) if sum(map(len, found)) <= 4 * PART else map(coder.encode, found)
            for doc, raw in zip(batch.column(0).to_pylist(), codes, strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    ids.append(doc)
                    piece.append(k)
                    start.append(k * capacity)
                    length.append(min(step, len(raw) - at) // 4)
                    code.append(raw[at : at + step])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(code, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class CapacityTree:
    """Counts of open bins by remaining capacity; finds the least capacity that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)

    def change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need of an open bin, or -1."""
        counts, at = self.counts, need + self.size
        if counts[at]:
            return need
        while at > 1:
            if not at & 1 and counts[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if counts[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; lengths are 1 to capacity."""
    tree, open_bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        room = tree.tightest(need)
        if room < 0:
            own, room, n = n, capacity, n + 1
        else:
            own = open_bins[room].pop()
            tree.change(room, -1)
        bins[item], offsets[item] = own, capacity - room
        if room > need:
            open_bins[room - need].append(own)
            tree.change(room - need, 1)
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with (doc_id, piece, length); all their columns are carried along.

    n_docs, the number of documents, sets the number of shards. Lengths outside 1..capacity are an error. Of equal lengths
    the smaller (doc_id, piece) is placed first; repeated rows are placed each; an empty table gives an empty result.
    """
    shards = max(1, -(-n_docs // SHARD_DOCS))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, rows = int(rows["_shard"].iloc[0]), rows.drop(columns="_shard").sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(np.int64(shard) << 40) | bins, offset=offsets)

    return sharded.groupBy("_shard").applyInPandas(run, schema)
