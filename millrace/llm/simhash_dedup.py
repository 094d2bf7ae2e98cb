"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints of all documents are reduced to distinct ones, so copies cost nothing further. Two
fingerprints that differ in at most d bits agree on one of d + 1 parts of the word, and in the rest on
one of d + 1 parts again; each fingerprint therefore goes to (d + 1)^2 blocks that fix over half of its
bits, and every link shows in a block. In a block, fingerprints are sorted by Gray rank; runs of them
become nodes that hold the bits all share, upper nodes take over what their children share, and a
search walks down adding differences, so that a node whose sum exceeds d drops its whole subtree.

A block beyond BLOCK_ROWS (fingerprints that agree on those bits, such as a huge group of near copies)
leaves the index for an exact exchange: every member visits all words within d/2 bits of it, and two
members link if they meet; no meeting holds more than a ball's worth of distinct fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import as_binary, bounded, checkpointed, few_files, held, release_memory, slices, texts
from millrace.llm.components import components
from millrace.llm.shingles import majority, mixed, shingle_sets

BLOCK_ROWS = 4096
FANOUT = 8
#: rows that a task searches at once, and searches in flight
CHUNK_ROWS, SEARCHES = 1 << 17, 256
#: rows (or a hundredth, if more) in which common shingles are sought, how often they are seen there, and how many are told to all tasks
SAMPLE_ROWS, COMMON_SEEN, COMMON = 8000, 3, 200_000
#: partners of a row that the first round of near-duplicates tries; the later ones miss none
EARLY = 8
#: places from a row, among a token's rows by size, to which likely links are sought before all pairs meet; bits of a set's parities; shared tokens told of a row
REACH, PARITIES, TOLD = 256, 1024, 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64 bits: bit set where more than half of the shingles' XXH64 have it; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_digest
    grams = [joined[i:j] for i, j in zip(starts, stops, strict=True)]
    return majority(np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of (doc_id, text); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def gray_rank(words: np.ndarray) -> np.ndarray:
    rank = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def part_masks(max_bits: int) -> list[int]:
    """Masks of the (d + 1)^2 keys: one part of the word plus one part of the rest."""
    cut = lambda bits, k: [bits[len(bits) * i // k : len(bits) * (i + 1) // k] for i in range(k)]
    k, out = max_bits + 1, []
    for outer in cut(list(range(64)), k):
        rest = [b for b in range(64) if b not in set(outer)]
        out += [sum(1 << b for b in [*outer, *inner]) for inner in cut(rest, k)]
    return out


class GrayIndex:
    """The hierarchy over blocks of fingerprints that are sorted by (block, Gray rank)."""

    def __init__(self, block: np.ndarray, words: np.ndarray):
        self.words, first = words, np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
        low, high, level_first = words, words, first
        size = len(words)
        self.levels = []  # from the leaves' parents up: (child range starts, ends, shared mask, shared bits)
        while True:
            sizes = np.diff(level_first, append=size)
            nodes = -(-sizes // FANOUT)
            node_first = np.concatenate(([0], np.cumsum(nodes)[:-1]))
            inside = np.arange(nodes.sum()) - np.repeat(node_first, nodes)
            starts = np.repeat(level_first, nodes) + inside * FANOUT
            ends = np.minimum(starts + FANOUT, np.repeat(level_first + sizes, nodes))
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            shared = ~(low ^ high)
            self.levels.append((starts, ends, shared, low & shared))
            level_first, size = node_first, len(starts)
            if (nodes == 1).all():
                break
        self.root_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(words)))
        span = np.arange(len(words))
        self.last = []  # the largest leaf below each node, to look only at later leaves
        for starts, ends, _, _ in self.levels:
            span = span[ends - 1]
            self.last.append(span)

    def links(self, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later leaf) of one block that differ in at most max_bits bits."""
        q, node = queries, self.root_of[queries]
        _, _, shared, bits = self.levels[-1]
        acc = np.bitwise_count((self.words[q] ^ bits[node]) & shared[node]).astype(np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            starts, ends, above, _ = self.levels[level]
            many = ends[node] - starts[node]
            child = np.repeat(starts[node] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            q, acc, parent = np.repeat(q, many), np.repeat(acc, many), np.repeat(node, many)
            if level:
                mask, bits, last = self.levels[level - 1][2], self.levels[level - 1][3], self.last[level - 1]
                own, value, later = mask[child] & ~above[parent], bits[child], last[child] > q
            else:
                own, value, later = ~above[parent], self.words[child], child > q
            acc = acc + np.bitwise_count((self.words[q] ^ value) & own)
            keep = (acc <= max_bits) & later
            q, node, acc = q[keep], child[keep], acc[keep]
        return q, node


def _join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union by minimum with pointer jumping."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up


def block_stars(keys: np.ndarray, words: np.ndarray, max_bits: int, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links inside blocks as stars: (word, first word of its local component), or if direct, (word, first word that it links to itself)."""
    order = np.lexsort((gray_rank(words), keys))
    keys, words = keys[order], words[order]
    index = GrayIndex(keys, words)
    root = np.arange(len(words))
    for at in range(0, len(words), SEARCHES):
        a, b = index.links(np.arange(at, min(at + SEARCHES, len(words))), max_bits)
        if direct:
            np.minimum.at(root, b, a)
        else:
            root = _join_up(root, a, b)
    moved = np.flatnonzero(root != np.arange(len(words)))
    return words[moved], words[root[moved]]


def _search(max_bits: int, block_rows: int, direct: bool):
    """Streams rows sorted by key. Out: (a, b) links; b null marks a member of a block beyond the bound."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], ["a", "b"])

    def flush(keys: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        size = counts[inverse]
        if (big := size > block_rows).any():
            yield out(words[big], None)
        if (some := (size > 1) & ~big).any():
            a, b = block_stars(keys[some], words[some], max_bits, direct)
            if len(a):
                yield out(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_k, own_w = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot = None
        for batch in batches:
            k, w = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if hot is not None:  # the rest of a block that is already known to be large
                more = k == hot
                if more.any():
                    yield out(w[more], None)
                k, w = k[~more], w[~more]
                if not len(k):
                    continue
                hot = None
            own_k, own_w = np.concatenate((own_k, k)), np.concatenate((own_w, w))
            if len(own_k) < CHUNK_ROWS:
                continue
            open_ = own_k == own_k[-1]
            yield from flush(own_k[~open_], own_w[~open_])
            own_k, own_w = own_k[open_], own_w[open_]
            if len(own_k) > block_rows:
                hot = int(own_k[-1])
                yield out(own_w, None)
                own_k, own_w = own_k[:0], own_w[:0]
        if len(own_k):
            yield from flush(own_k, own_w)

    return run


def fingerprint_links(words: DataFrame, max_bits: int = 2, block_rows: int = BLOCK_ROWS, direct: bool = False) -> DataFrame:
    """(a, b): links that connect all of the distinct words (fp long) which differ in at most max_bits bits, an even number.

    direct: every pair returned differs in at most max_bits itself; each block then names for every word the first one it links to.
    """
    if max_bits % 2 or max_bits < 0:
        raise ValueError("max_bits must be even")
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for i, m in enumerate(part_masks(max_bits))])
    dealt = words.select(F.explode(keys).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = held(dealt.mapInArrow(_search(max_bits, block_rows, direct), "a long, b long"))
    meet = found.where("b is null").select("a").distinct().withColumn("at", F.col("a"))
    for _ in range(max_bits // 2):  # the word itself and the words one bit away, again and again
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        meet = meet.select("a", F.explode(F.concat(F.array("at"), F.transform(flips, lambda x: F.col("at").bitwiseXOR(x)))).alias("at"))
    met = meet.groupBy("at").agg(F.collect_set("a").alias("all")).where(F.size("all") > 1)
    exact = met.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b")
    return found.where("b is not null").unionByName(exact)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row.

    component_id is the smallest doc_id reachable over links, itself included. Null and empty texts
    have fingerprint zero and link like any other; fewer words than a shingle make one shingle.
    Repeated rows repeat in the result. Null ids take part and are never the smallest. Other columns
    are ignored; an empty table gives an empty result.
    """
    prints = held(fingerprints(texts(docs, id_col, text_col), shingle, seed))
    words = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(fingerprint_links(words.select("fp"), max_bits, block_rows))
    rooted = words.join(joined, words["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_word = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_word, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(shingle: int, least: float):
    """Keeps pairs (a, b, text_a, text_b) whose sets of word shingles have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, keep = batch.column(2).to_pylist(), []
            other = batch.column(3).to_pylist()
            at = {t: i for i, t in enumerate(dict.fromkeys(own + other))}  # a text may be in many pairs
            sets = shingle_sets(list(at), shingle)[0]
            for x, y in zip(own, other, strict=True):
                both = np.concatenate((sets[at[x]], sets[at[y]]))
                both.sort(kind="stable")  # two sorted runs: a merge
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= least * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    return run


def parities(hashes: np.ndarray) -> bytes:
    """For each of PARITIES classes of hashes whether an odd number is in the set: two sets differ in at least as many hashes as bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(65 - PARITIES.bit_length())).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def _prints(shingle: int, seeds: tuple[int, ...]):
    """(row, doc_id, 128 bits of the shingle set, fingerprint over distinct words for each seed, parities of the set) of (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, words, counts = shingle_sets(batch.column(2).to_pylist(), shingle)
            ends = np.cumsum(counts)
            own = [np.unique(words[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            fps = [majority(mixed(w + np.uint64(seed))) for w in own for seed in seeds]
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.tobytes()) for x in sets]), np.int64).reshape(-1, 2)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.array(fps, np.uint64).view(np.int64)), len(seeds)).cast(pa.list_(pa.int64()))
            odd = as_binary([parities(x) for x in sets])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists, odd], ["row", "doc_id", "s1", "s2", "fps", "bits"])
        release_memory()

    return run


def common_shingles(rows: DataFrame, n: int, shingle: int) -> np.ndarray:
    """Hashes of frequent shingles, the rarest first, by a sample of the n rows (row, text). Only the order of prefixes depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shingle_sets(batch.column(1).to_pylist(), shingle)[0]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    one_of = max(1, n // max(SAMPLE_ROWS, n // 100))
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(one_of)) == 0)
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_SEEN)
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow().column("h").to_numpy()
    return top[::-1].astype(np.int64).view(np.uint64)


def prefix(hashes: np.ndarray, least: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first hashes in an order that all texts share (common ones last, by rank): two sets of that similarity meet in them."""
    n = len(hashes)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        if (known := common[at] == hashes).any():
            hashes = np.concatenate((hashes[~known], hashes[known][np.argsort(rank[at[known]])]))
    return hashes[: n - math.ceil(least * n - 1e-9) + 1]


def _prefixes(shingle: int, least: float, common: np.ndarray):
    """(token, row, root, size << 32 | place) of the prefix of each (row, text, root)."""
    order = np.argsort(common)
    known = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), shingle)[0]
            tokens = [prefix(h, least, known, order) for h in sets]
            many = np.fromiter(map(len, tokens), np.int64, len(tokens))
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            size = np.repeat(np.fromiter(map(len, sets), np.int64, len(sets)), many)
            told = [np.repeat(batch.column(c).to_numpy(), many) for c in (0, 2)]
            yield pa.record_batch([pa.array(x) for x in (np.concatenate(tokens).view(np.int64), *told, size << 32 | place)], ["token", "row", "root", "shape"])
        release_memory()

    return run


def _by_token(flush):
    """Streams prefix rows sorted by token; flush gets the columns of whole tokens: (token, row, root, shape), then where
    they are given parities as words of 64 bits, and the first TOLD of the row's shared tokens by place, zeros after them."""

    def columns(batch: pa.RecordBatch) -> tuple:
        rows = tuple(batch.column(c).to_numpy() for c in range(4))
        if batch.num_columns == 4:
            return rows
        bits = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        many = np.diff(batch.column(5).offsets.to_numpy())
        told = np.zeros((batch.num_rows, TOLD), np.int64)
        told[np.arange(TOLD) < many[:, None]] = batch.column(5).flatten().to_numpy()
        return *rows, bits, told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            rows = columns(batch)
            own = rows if own is None else tuple(np.concatenate(c) for c in zip(own, rows, strict=True))
            if len(own[0]) >= (CHUNK_ROWS if len(own) == 4 else CHUNK_ROWS // 4) and own[0][0] != own[0][-1]:
                open_ = own[0] == own[0][-1]
                yield from flush(tuple(c[~open_] for c in own))
                own = tuple(c[open_] for c in own)
        if own is not None and len(own[0]):
            yield from flush(own)

    return run


def _shared(least: float):
    """Keeps (token, row, shape) of prefix rows whose token has a row of another root and of a size that allows to be similar."""

    def flush(rows: tuple) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((rows[3], rows[0]))
        token, row, root, shape = (c[order] for c in rows)
        size, n = shape >> 32, len(token)
        # rows of one token and root that follow each other by size: those beside them are the nearest in size of another root
        first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (root[1:] != root[:-1]))))
        many = np.diff(first, append=n)
        before, after = np.repeat(first - 1, many), np.repeat(first + many, many)
        at = lambda i: np.clip(i, 0, n - 1)
        keep = (before >= 0) & (token[at(before)] == token) & (size[at(before)] >= least * size - 1e-9)
        keep |= (after < n) & (token[at(after)] == token) & (size >= least * size[at(after)] - 1e-9)
        if keep.any():
            yield pa.record_batch([pa.array(c[keep]) for c in (token, row, shape)], ["token", "row", "shape"])

    return _by_token(flush)


def _meetings(least: float, reach: int | None = None):
    """Streams prefix rows sorted by token. Out: all pairs (a, b) of a token, of different roots, that size, place and parities allow to be similar.

    A pair of which the told tokens show where it meets first comes from there alone.
    reach: no more than likely links that connect a token's roots, as far as they show in pairs so many places apart
    by size. Their number is below that of the rows, and they need parities.
    """

    def possible(rows: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x, left_x), (y, left_y) = ((rows[3][k] >> 32, (rows[3][k] >> 32) - (rows[3][k] & 0xFFFFFFFF)) for k in (i, j))
        small, large, left = np.minimum(x, y), np.maximum(x, y), np.minimum(left_x, left_y)  # what may be shared from here on
        keep = (rows[2][i] != rows[2][j]) & (small >= least * large - 1e-9) & (left * (1 + least) >= least * (small + large) - 1e-6)
        i, j = i[keep], j[keep]
        if len(rows) > 4 and len(i):
            differ = np.bitwise_count(rows[4][i] ^ rows[4][j]).sum(axis=1, dtype=np.int64)
            if reach is not None:  # hashes that differ, as so many odd classes let expect
                differ = -PARITIES / 2 * np.log1p(-2 * np.minimum(differ, PARITIES // 2 - 1) / PARITIES)
            keep = differ * (1 + least) <= (1 - least) * (small[keep] + large[keep]) + 1e-6
            i, j = i[keep], j[keep]
        return i, j

    def first_met(rows: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Both rows' told tokens are in the one order of prefixes, so the first in both is where the pair meets first."""
        x, y = rows[5][i], rows[5][j]
        both = ((x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]).any(axis=2)
        return ~both.any(axis=1) | (x[np.arange(len(x)), both.argmax(axis=1)] == rows[0][i])

    def out(rows: tuple, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 1 << 14):
            some, other = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            if len(rows) > 4 and reach is None:
                keep = first_met(rows, some, other)
                some, other = some[keep], other[keep]
            if len(some):
                a, b = rows[1][some], rows[1][other]
                yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def steps(rows: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs. Rows are sorted by token and size, so a partner that is too large ends a row's search."""
        token, size, i, step = rows[0], rows[3] >> 32, np.arange(len(rows[0])), 1
        while (reach is None or step <= reach) and len(i := i[i + step < len(token)]):
            i = i[(token[i] == token[i + step]) & (size[i] >= least * size[i + step] - 1e-9)]
            yield i, i + step
            step += 1

    def all_pairs(rows: tuple) -> Iterator[pa.RecordBatch]:
        for i, j in steps(rows):
            yield from out(rows, *possible(rows, i, j))

    def forest(rows: tuple) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((rows[2], rows[0]))
        token, root = rows[0][order], rows[2][order]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.concatenate(([False], (token[1:] != token[:-1]) | (root[1:] != root[:-1]))))
        up = np.arange(len(order))
        for i, j in steps(rows):
            apart = up[group[i]] != up[group[j]]
            i, j = possible(rows, i[apart], j[apart])
            if len(i):
                ends = np.sort(np.stack((up[group[i]], up[group[j]])), axis=0)
                k = np.unique(ends, axis=1, return_index=True)[1]
                yield from out(rows, i[k], j[k])
                up = _join_up(up, group[i[k]], group[j[k]])

    def flush(rows: tuple) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((rows[3], rows[0]))
        rows = tuple(c[order] for c in rows)
        first = np.flatnonzero(np.diff(rows[0], prepend=rows[0][:1] - 1))
        many = np.diff(first, append=len(rows[0]))
        mixed = np.minimum.reduceat(rows[2], first) != np.maximum.reduceat(rows[2], first)
        if reach is not None:
            yield from forest(tuple(c[np.repeat(mixed, many)] for c in rows))
            return
        large = np.zeros(len(rows[0]), bool)
        for k in np.flatnonzero(mixed & (many > 256)):  # the largest group's own pairs are left out, not just dropped
            block = np.arange(first[k], first[k] + many[k])
            roots, counts = np.unique(rows[2][block], return_counts=True)
            inside = rows[2][block] == roots[counts.argmax()]
            most, others = block[inside], block[~inside]
            for n in others:
                yield from out(rows, *possible(rows, np.repeat(n, len(most)), most))
            yield from all_pairs(tuple(c[others] for c in rows))
            large[block] = True
        small = np.repeat(mixed, many) & ~large
        yield from all_pairs(tuple(c[small] for c in rows))

    return _by_token(flush)


def near_rows(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 4, seeds: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(row, doc_id, component_id, kept) of the rows (row long, unique; doc_id long; text string) that belong to a group of near-duplicates.

    Two texts are linked if their sets of word shingles have at least the given Jaccard similarity, and
    every such pair ends in one group (up to equal 64-bit hashes). Of a group the row with the smallest
    (doc_id, row) is kept, ids before null; component_id is its doc_id.

    Rows of equal sets are one. Candidates of a first round are pairs whose fingerprints over distinct
    words differ in at most max_bits bits for one of the seeds, one partner a block; it joins large
    groups early. Then texts of different groups meet in all shingles of their prefixes (the rarest
    fifth, at 0.8), which similar sets must share: a second round proposes, for each shingle, likely
    links that connect its texts, fewer than those are, and a third all pairs that are then still of
    different groups, and whose sizes, places and parities allow the similarity. Each pair that could
    still join two groups is verified by its sets: first two partners of each text, then of what
    that leaves open many times more, until nothing is open. Texts without words are similar to each
    other; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    few = few_files(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs comes from a checkpoint: plans that hold plans of persisted tables grow on the driver."""
        n = pairs.count()
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        told = rows.join(bounded(ids, 2 * n, 16), rows["row"] == ids["id"], "left_semi")  # no aggregation: Spark can then split a hot text's pairs
        of = lambda side: told.select(F.col("row").alias(side), F.col("text").alias(f"text_{side}"))
        checked = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(shingle, similarity), "a long, b long")
        return checkpointed(checked, few)

    prints = held(rows.select("row", "doc_id", "text").mapInArrow(_prints(shingle, seeds), "row long, doc_id long, s1 long, s2 long, fps array<long>, bits binary"))
    n = prints.count()
    least = prints.groupBy("s1", "s2").agg(F.min("row").alias("b"), F.max("row").alias("most")).where("b <> most").drop("most")
    equal = checkpointed(prints.join(least, ["s1", "s2"]).where("row <> b").select(F.col("row").alias("a"), "b"), few)
    gone = bounded(equal.select(F.col("a").alias("row")), equal.count(), 32)
    single = prints.join(gone, "row", "left_anti").select("row", F.explode("fps").alias("fp"))
    first = held(single.groupBy("fp").agg(F.min("row").alias("first")))
    links = fingerprint_links(first.select("fp"), max_bits, direct=True).distinct()
    named = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"row_{side}"))
    across = links.join(named("a"), "a").join(named("b"), "b").select("row_a", "row_b")
    within = single.join(first, "fp").select(F.col("row").alias("row_a"), F.col("first").alias("row_b"))
    pairs = across.unionByName(within).where("row_a <> row_b").select(F.greatest("row_a", "row_b").alias("a"), F.least("row_a", "row_b").alias("b")).distinct()

    def some_of(pairs: DataFrame, many: int) -> DataFrame:
        """Of each row's partners so many, drawn by hash."""
        order = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))
        return checkpointed(pairs.withColumn("k", order).where(F.col("k") <= many).select("a", "b"), few)

    early = verified(some_of(pairs, EARLY)).unionByName(equal)
    every, joined, tested = early, held(components(early)), None
    root_of = lambda side: bounded(joined.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), joined.count(), 32)
    left = rows.select("row", "text").join(gone, "row", "left_anti")
    left = left.join(root_of("row"), "row", "left").select("row", "text", F.coalesce("root_row", "row").alias("root"))
    tokens = left.mapInArrow(_prefixes(shingle, similarity, common_shingles(rows.select("row", "text"), n, shingle)), "token long, row long, root long, shape long")
    shared = held(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_shared(similarity), "token long, row long, shape long"))
    by_place = F.slice(F.array_sort(F.collect_list(F.struct(F.col("shape").bitwiseAND(0xFFFFFFFF).alias("place"), "token"))), 1, TOLD)
    told = held(shared.groupBy("row").agg(by_place["token"].alias("told")))
    for reach in (REACH, None):
        rooted = prints.select("row", "bits").join(root_of("row"), "row", "left").select("row", F.coalesce("root_row", "row").alias("root"), "bits")
        meet = shared.join(rooted.join(told, "row"), "row").select("token", "row", "root", "shape", "bits", "told").repartition("token").sortWithinPartitions("token")
        met = meet.mapInArrow(_meetings(similarity, reach), "a long, b long").distinct()
        open_, many = checkpointed(met if tested is None else met.join(tested, ["a", "b"], "left_anti"), few), 2
        while not open_.isEmpty():
            tried = some_of(open_, many)
            tested = tried if tested is None else tested.unionByName(tried)
            every = every.unionByName(verified(tried))
            joined = held(components(every))
            left = open_.join(tried, ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
            open_ = checkpointed(left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), few)
            many *= 32
    members = prints.select("row", "doc_id").join(bounded(joined, joined.count(), 32), prints["row"] == joined["node"]).select("row", "doc_id", "root")
    best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    return members.join(best, "root").select("row", "doc_id", F.col("best.doc_id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, component_id, kept) of the rows that belong to a group of near-duplicates; see near_rows.

    Null texts count as empty. Rows that share an id are told apart; one without id is never the
    smallest. Other columns are ignored whatever their names.
    """
    return near_rows(numbered(docs, id_col, text_col), **settings).select("doc_id", "component_id", "kept")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text): row is the place of a row in its scan, the same whenever the same files are read."""
    return texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs, all its columns, without the rows that near_rows doesn't keep."""
    dropped = checkpointed(near_rows(numbered(docs, id_col, text_col), **settings).where("not kept").select(F.col("row").alias("_row")), few_files(docs.sparkSession))
    named = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[c] for c in docs.columns]).alias("_kept"))
    return named.join(bounded(dropped, dropped.count(), 32), "_row", "left_anti").select(*[F.col("_kept").getField(c).alias(c) for c in docs.columns])
