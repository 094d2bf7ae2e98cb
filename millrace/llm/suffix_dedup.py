"""Repeated passages across documents, found with suffix arrays and removed byte for byte.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller document, or earlier
in the same one). All such strings (windows) of the corpus are compared, in three stages.

1. Anchors. Every window is assigned to the least-hashed K-gram inside it, so equal windows have equal
   anchors at equal offsets, and the windows of one anchor are consecutive. Per anchor only hashes
   travel: of the K-gram, and two of all the bytes its windows cover. Equal coverage makes all but the first
   occurrence repeated outright; a task sends one row for each distinct coverage, so that a passage in a
   third of all documents costs each task one row. Anchors seen with one coverage only are finished.
   Anchors that a sample shows with many coverages (a passage in ever new surroundings) would meet in
   one task; of those the digests of all windows are dealt out by content instead.
2. Suffix arrays. Anchors seen with several coverages (ends of passages, edited copies) need their bytes.
   They are cut from the documents, brought together by anchor, and sorted in bounded texts: suffixes
   smaller than their successors directly, the others induced from them by a scan of the buckets; then
   common prefixes of neighbours show equal windows. An anchor with more than GROUP_ROWS coverages leaves
   the suffix arrays for an exact exchange of window digests, which splits it by content.
3. Documents meet their repeated ranges and lose them. The texts are shuffled once; Spark reuses that
   exchange for stages 2 and 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import held, release_memory, shuffle_partitions, slices

LENGTH, K = 100, 40
SPAN = LENGTH - K + 1  # K-grams in a window
BLOCK = 1 << 18  # windows of a document that are treated at once
FLUSH_ROWS = 600_000
TEXT_BYTES = 1 << 20  # of one suffix array
GROUP_ROWS = 10_000
#: rows (or one in 500, if more) in which anchors with over GROUP_ROWS coverages are sought, how often those must show, and how many are told to all tasks
SAMPLE_ROWS, HOT_SEEN, HOT_ANCHORS = 8000, 20, 1_000_000
PARTITION_BYTES = 64 << 20
NULL_ID = -(1 << 63)

ROW = np.dtype([("h", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<u4"), ("n", "u1"), ("off", "u1")])
DIGEST = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<u4")])
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * M1)


@lru_cache(maxsize=1)
def other_codes() -> np.ndarray:
    return mixed(byte_codes() + M2)


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    size, base = BLOCK + LENGTH + 1, 0x9E3779B97F4A7C15
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all K-grams, put together from those of lengths that are powers of two."""
    n, at, out, grams, d = len(codes) - K + 1, 0, np.zeros(len(codes) - K + 1, np.uint64), codes, 1
    while d <= K:
        if K & d:
            out = out * M1 + grams[at : at + n]
            at += d
        grams = grams[:-d] * M1 + (grams[d:] ^ (grams[d:] >> np.uint64(31))) * M2
        d *= 2
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width``, from running minima of blocks to the left and to the right."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block: K-gram hash, two coverage hashes, first window, number of windows, anchor's offset in the first window."""
    codes = byte_codes()[data]
    h = gram_hashes(codes)
    place = np.uint64((1 << 20) - 1)
    least = sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), SPAN)
    where = (least & place).astype(np.int64)  # ties go to the first
    first = np.flatnonzero(np.diff(where, prepend=-1))
    n = np.diff(first, append=len(where))
    end = first + n + LENGTH - 1
    cover = [mixed(x + n.astype(np.uint64) * M2) for x in spans_hashed(data, first, end)]
    return h[where[first]], *cover, first, n, where[first] - first


def spans_hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two polynomials of the bytes of each span."""
    up, down = powers()
    sums, out = np.zeros(len(data) + 1, np.uint64), []
    for codes in (byte_codes(), other_codes()):
        np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
        out.append((sums[end] - sums[start]) * down[start])
    return out


def window_digests(data: np.ndarray, n: int) -> np.ndarray:
    """DIGEST rows (h and c) of the first n windows."""
    rows, at = np.empty(n, DIGEST), np.arange(n)
    rows["h"], rows["c"] = (mixed(x) for x in spans_hashed(data, at, at + LENGTH))
    return rows


def blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        yield at, data[at : at + BLOCK + LENGTH - 1]


def in_order(rows: np.ndarray, *first: str) -> np.ndarray:
    return rows[np.lexsort([rows[k] for k in ("at", "tag", "doc", *reversed(first))])]


def changes(rows: np.ndarray, *fields: str) -> np.ndarray:
    """True where a row differs from the one before."""
    out = np.ones(len(rows), bool)
    if len(rows):
        out[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in fields])
    return out


def once(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence of each (h, c), the other occurrences); a row that repeats a document is no occurrence of its own."""
    rows = in_order(rows, "h", "c")
    rows = rows[changes(rows, "h", "c", "doc", "tag", "at")]
    new = changes(rows, *(k for k in ("h", "c", "c2") if k in rows.dtype.names))
    return rows[new], rows[~new]


def ranges(rows: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of place with runs of windows joined: (row at the start of a run, its number of windows)."""
    order = np.lexsort((rows["at"], rows["tag"], rows["doc"]))
    rows, start = rows[order], rows["at"][order].astype(np.int64)
    stop = start + (n[order] if isinstance(n, np.ndarray) else n)
    new = changes(rows, "doc", "tag")
    if len(rows):
        new[1:] |= start[1:] > stop[:-1]
    first = np.flatnonzero(new)
    return rows[first], (np.maximum.reduceat(stop, first) if len(first) else stop) - start[first]


# Rows between stages: key, and what belongs to it. kind 0: coverages (payload of ROW); 1: repeated range of a
# document; 2 and 3: an anchor whose bytes are wanted (3: as window digests); 4: snippets; 5: digests.
SCHEMA = "key long, kind int, doc long, tag int, at long, n long, off int, payload binary"
NAMES = ["key", "kind", "doc", "tag", "at", "n", "off", "payload"]


def batch_of(kind: int, key, doc=None, tag=None, at=None, n=None, off=None, payload=None) -> pa.RecordBatch:
    size = len(key)
    column = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.record_batch([pa.array(key, pa.int64()), pa.array(np.full(size, kind, np.int32)), column(doc, pa.int64()), column(tag, pa.int32()), column(at, pa.int64()), column(n, pa.int64()), column(off, pa.int32()), column(payload, pa.binary())], NAMES)


def repeated(rows: np.ndarray, n: np.ndarray | int) -> pa.RecordBatch:
    start, n = ranges(rows, n)
    return batch_of(1, mixed(start["doc"].view(np.uint64) * M1).view(np.int64), start["doc"], start["tag"], start["at"].astype(np.int64), n)


def to_owners(kind: int, rows: np.ndarray, owners: int) -> pa.RecordBatch:
    owner = (rows["h"] >> np.uint64(33)) % np.uint64(owners)
    order = np.argsort(owner, kind="stable")
    rows, owner = rows[order], owner[order].astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return batch_of(kind, owner[first], payload=[p.tobytes() for p in np.split(rows, first[1:])])


def _anchor(owners: int, hot: np.ndarray):
    """hot: sorted hashes of the anchors whose windows are sent as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts: list[np.ndarray], digests: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for kind, some in ((0, parts), (5, digests)):
                if some:
                    first, again = once(np.concatenate(some))
                    yield to_owners(kind, first, owners)
                    if len(again):
                        yield repeated(again, again["n"] if kind == 0 else 1)

        parts, digests, size = [], [], 0
        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for at, block in blocks(data):
                    h, c, c2, first, n, off = anchors(block)
                    rows = np.empty(len(h), ROW)
                    rows["h"], rows["c"], rows["c2"], rows["doc"], rows["tag"], rows["at"], rows["n"], rows["off"] = h, c, c2, doc, tag, first + at, n, off
                    if len(hot):
                        known = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                        for i in np.flatnonzero(known):
                            some = window_digests(block[first[i] : first[i] + n[i] + LENGTH - 1], int(n[i]))
                            some["doc"], some["tag"], some["at"] = doc, tag, first[i] + at + np.arange(n[i])
                            digests.append(some)
                            size += len(some)
                        rows = rows[~known]
                    parts.append(rows)
                    size += len(rows)
                    if size >= FLUSH_ROWS:
                        yield from send(parts, digests)
                        parts, digests, size = [], [], 0
        yield from send(parts, digests)
        release_memory()

    return run


def hot_anchors(rows: DataFrame, n: int, group_rows: int) -> np.ndarray:
    """Sorted hashes of anchors with over group_rows coverages in the n rows (doc, tag, data), by a sample; it decides only the way they take."""
    if n <= group_rows:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [anchors(block)[:2] for text in batch.column(2) for _, block in blocks(np.frombuffer(text.as_buffer(), np.uint8))]
            if found:
                yield pa.record_batch([pa.array(np.concatenate([x[k] for x in found]).view(np.int64)) for k in (0, 1)], ["h", "c"])

    share = min(1.0, max(SAMPLE_ROWS / n, 1 / 500))
    some = rows.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = some.mapInArrow(run, "h long, c long").distinct().groupBy("h").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= max(HOT_SEEN, int(group_rows * share))).orderBy(F.desc("n"), "h").limit(HOT_ANCHORS)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def _payloads(batch: pa.RecordBatch, kind: int, dtype: np.dtype) -> list[np.ndarray]:
    kinds = batch.column(1).to_numpy()
    return [np.frombuffer(batch.column(7)[int(i)].as_buffer(), dtype) for i in np.flatnonzero(kinds == kind)]


def _pass(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return batch.filter(pa.array(batch.column(1).to_numpy() == kind))


def _meet(group_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, digests = [], []
        for batch in batches:
            if (through := _pass(batch, 1)).num_rows:
                yield through
            got += _payloads(batch, 0, ROW)
            digests += _payloads(batch, 5, DIGEST)
        if digests:
            _, again = once(np.concatenate(digests))
            if len(again):
                yield repeated(again, 1)
        if not got:
            return
        first, again = once(np.concatenate(got))
        if len(again):
            yield repeated(again, again["n"])
        new = changes(first, "h")
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group]
        for kind, wanted in ((2, (many > 1) & (many <= group_rows)), (3, many > group_rows)):
            rows = first[wanted]
            if len(rows):
                yield batch_of(kind, rows["h"].view(np.int64), rows["doc"], rows["tag"], rows["at"].astype(np.int64), rows["n"].astype(np.int64), rows["off"].astype(np.int32))
        release_memory()

    return run


def _cut(owners: int):
    """Cuts the wanted bytes from (doc, tag, data, wanted array<struct<h, kind, at, n>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, size = [], 0
        for batch in batches:
            wanted = batch.column(3)
            sizes = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            h, kind, at, n = (flat.field(k).to_numpy() for k in range(4))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            docs, tags = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            texts = [x.as_buffer() for x in batch.column(2)]
            if (some := np.flatnonzero(kind == 2)).size:
                owner = ((h[some].view(np.uint64) >> np.uint64(33)) % np.uint64(owners)).astype(np.int64)
                cut = [texts[r][int(a) : int(a + k) + LENGTH - 1].to_pybytes() for r, a, k in zip(row[some], at[some], n[some], strict=True)]
                # off carries the owner; key is the anchor, by which snippets are brought together
                yield pa.record_batch([pa.array(h[some]), pa.array(np.full(len(some), 4, np.int32)), pa.array(docs[some]), pa.array(tags[some]), pa.array(at[some]), pa.array(n[some]), pa.array(owner.astype(np.int32)), pa.array(cut, pa.binary())], NAMES)
            for i in np.flatnonzero(kind == 3):
                rows = window_digests(np.frombuffer(texts[row[i]], np.uint8)[int(at[i]) : int(at[i] + n[i]) + LENGTH - 1], int(n[i]))
                rows["doc"], rows["tag"], rows["at"] = docs[i], tags[i], at[i] + np.arange(int(n[i]))
                digests.append(rows)
                size += len(rows)
            if size >= FLUSH_ROWS:
                first, again = once(np.concatenate(digests))
                yield to_owners(5, first, owners)
                if len(again):
                    yield repeated(again, 1)
                digests, size = [], 0
        if digests:
            first, again = once(np.concatenate(digests))
            yield to_owners(5, first, owners)
            if len(again):
                yield repeated(again, 1)

    return run


def words_at(symbols: np.ndarray, n: int) -> np.ndarray:
    """The eight symbols from each of n places as one big-endian number."""
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | symbols[j : j + n]
    return out


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage sorting of all suffixes, by at least ``depth`` symbols (uint8; the last one must be 0, the least).

    Suffixes smaller than their successors are sorted directly. In a scan of the order so far, the
    predecessor of each suffix, if larger than it, goes to the next free place of its symbol's bucket.
    """
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(depth + 16, np.uint8)))
    ahead = padded[1 : n + 1]
    # equal neighbours have the type of the next place that differs
    differs = np.append(np.flatnonzero(symbols != ahead), n - 1)
    decides = differs[np.searchsorted(differs, np.arange(n))]
    small = symbols[decides] < padded[decides + 1]
    small[n - 1] = True
    direct = np.flatnonzero(small)
    words = words_at(padded, n + depth + 8)
    order = direct[np.lexsort([words[direct + at] for at in range(8 * (-(-depth // 8) - 1), -1, -8)])]
    counts = np.bincount(symbols, minlength=256)
    ends = np.cumsum(counts)
    own = np.bincount(symbols[direct], minlength=256)
    sa = np.full(n, -1, np.int64)
    rank_in_bucket = np.arange(len(order)) - np.repeat(np.cumsum(own) - own, own)
    sa[(ends - own)[symbols[order]] + rank_in_bucket] = order
    found, heads, large, text = sa.tolist(), (ends - counts).tolist(), (~small).tolist(), symbols.tolist()
    for j in range(n):
        k = found[j] - 1
        if k >= 0 and large[k]:
            c = text[k]
            found[heads[c]] = k
            heads[c] += 1
    return np.array(found, np.int64)


def common_prefix_reaches(symbols: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each place of the order but the first: whether it shares ``length`` symbols with its neighbour before."""
    words = words_at(np.concatenate((symbols, np.zeros(length + 16, np.uint8))), len(symbols) + length + 8)
    same = np.arange(1, len(sa))
    for at in [*range(0, length - 8, 8), length - 8]:
        same = same[words[sa[same] + at] == words[sa[same - 1] + at]]
    out = np.zeros(len(sa), bool)
    out[same] = True
    return out


def equal_windows(snippets: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, snippet, window in it) of every window; a snippet holds n windows and LENGTH - 1 bytes more."""
    joined = np.frombuffer(b"\xff".join(snippets) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255; it becomes 0
    sizes = np.fromiter(map(len, snippets), np.int64, len(snippets)) + 1
    starts = np.cumsum(sizes) - sizes
    sa = suffix_array(joined, LENGTH)
    group = np.cumsum(~common_prefix_reaches(joined, sa, LENGTH))
    owner = np.repeat(np.arange(len(snippets)), sizes)[sa]
    window = sa - starts[owner]
    real = window < n[owner]
    return group[real], owner[real], window[real]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets (kind 4) and digests (kind 5) of a partition, snippets in order of their anchor."""

    def sort(held_: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tag, at, n = (np.concatenate([x[k] for x in held_]) for k in range(1, 5))
        group, owner, window = equal_windows([s for x in held_ for s in x[5]], n)
        rows = np.empty(len(group), DIGEST)
        rows["h"], rows["c"], rows["doc"], rows["tag"], rows["at"] = group, 0, doc[owner], tag[owner], at[owner] + window
        _, again = once(rows)
        if len(again):
            yield repeated(again, 1)

    parts, size, digests = [], 0, []
    for batch in batches:
        if (through := _pass(batch, 1)).num_rows:
            yield through
        digests += _payloads(batch, 5, DIGEST)
        batch = _pass(batch, 4)
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cols = [batch.column(k).to_numpy() for k in (2, 3, 4, 5)]
        cut = batch.column(7).to_pylist()
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
            if size >= TEXT_BYTES and parts[-1][0] != key[a]:
                yield from sort(parts)
                parts, size = [], 0
            parts.append((key[a], *(c[a:b] for c in cols), cut[a:b]))
            size += sum(map(len, cut[a:b]))
    if parts:
        yield from sort(parts)
    if digests:
        _, again = once(np.concatenate(digests))
        if len(again):
            yield repeated(again, 1)
    release_memory()


def _finish(whole_chars: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            found = batch.column(2)
            for i, text in enumerate(batch.column(1)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if not found[i].is_valid:
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                packed = np.sort(found[i].values.to_numpy())
                start, n = packed >> 31, packed & ((1 << 31) - 1)
                stop = start + n + LENGTH - 1
                reach = np.maximum.accumulate(stop)
                new = np.append(True, start[1:] > reach[:-1])
                a, b = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
                if whole_chars:  # a character that is removed in part stays
                    part = np.append((data & 0xC0) == 0x80, False)
                    while (cut := part[a] & (a < b)).any():
                        a = a + cut
                    while (cut := part[b] & (a < b)).any():
                        b = b - cut
                gone = np.zeros(len(data) + 1, np.int64)
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
                kept.append(data[np.cumsum(gone[:-1]) == 0].tobytes())
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True) if x < y])
            yield pa.record_batch([*batch.columns[3:], pa.array([len(t.as_buffer()) for t in batch.column(1)], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_chars: bool = False, group_rows: int = GROUP_ROWS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the columns named in carry, n_bytes, spans array<struct<start, end>>, kept binary) for every row.

    Texts are UTF-8 bytes; null counts as empty. Strings are judged on the input, and matches never
    cross documents. Rows that repeat both id and text are one document: they get equal results and
    don't count against each other. Rows with one id and different texts are ordered by a hash of the
    text; a null id comes before all others. whole_chars leaves characters whole that a span would
    cut. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    data = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc"), F.hash(data).alias("tag"), data.cast("binary").alias("data"), F.struct(*[docs[c] for c in carry]).alias("row"))
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.count("*")).first()
    owners = max(shuffle_partitions(spark), -(-total // PARTITION_BYTES))
    bare = rows.select("doc", "tag", "data")
    met = held(bare.mapInArrow(_anchor(owners, hot_anchors(bare, n, group_rows)), SCHEMA).repartition(owners, "key").mapInArrow(_meet(group_rows), SCHEMA))
    dealt = rows.repartition(owners, "doc", "tag")
    wanted = met.where("kind in (2, 3)").groupBy("doc", "tag").agg(F.collect_list(F.struct(F.col("key").alias("h"), "kind", "at", "n")).alias("wanted"))
    cut = dealt.join(wanted.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "data", "wanted", "row").mapInArrow(_cut(owners), SCHEMA)
    sorted_ = cut.repartition(owners, F.when(F.col("kind") == 4, F.col("off")).otherwise(F.col("key"))).sortWithinPartitions("key").mapInArrow(_sort, SCHEMA)
    found = met.where("kind = 1").unionByName(sorted_).groupBy("doc", "tag").agg(F.collect_list(F.shiftleft("at", 31).bitwiseOR(F.col("n"))).alias("found"))
    out = dealt.join(found.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "data", "found", "row.*")
    schema = T.StructType([*out.schema.fields[3:], *T.StructType.fromDDL("n_bytes long, spans array<struct<start:long,end:long>>, kept binary").fields])
    return out.mapInArrow(_finish(whole_chars, schema.names), schema)
