"""Token counts by finite-state transducers, compiled from a byte-level BPE tokenizer file.

Two deterministic transducers in a cascade.

* The splitter has eight states over classes of characters; a transition emits whether a pre-token
  starts there. A batch of texts is one sequence of classes, cut into chunks. All chunks advance in
  lockstep from all eight states, which gives each chunk's state map; the maps compose associatively,
  so a parallel prefix scan finds every chunk's start state, and a second lockstep reads the emissions.
* The merger reads a pre-token's bytes; a transition emits the change of the token count. A state
  holds, for every place where a token could still begin, the token that ends there and the count at
  that place relative to now: all that future counts depend on, and finite because tokens are.
  States are built when first reached and forgotten together when STATES is passed, so memory is bounded.

Why pairs suffice: a sequence of tokens is the BPE result of its bytes exactly if each neighbouring
pair is the result of its own bytes. So of the tokens that may end a prefix exactly one fits what
ends where it begins.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import AFTER_LETTER, alone, texts

CHUNK, BATCH_CHARS = 256, 1 << 22
STATES, WORDS = 150_000, 200_000

# symbols: letter, number, other, apostrophe before a one- or two-letter suffix, blank and other white
# space before a non-space (…N) or before white space or the end (…S), and the cut between texts
L, N, O, A1, A2, BN, BS, WN, WS, CUT = range(10)
# states: at a start, inside runs of letters, numbers, others, after a leading blank, inside white space, one or two letters of a suffix left
START, LET, NUM, OTH, LEAD, SPACE, ONE, TWO = range(8)
#: White_Space of Unicode
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission (1: a pre-token starts at this character) by state and symbol."""
    fresh = {L: LET, N: NUM, O: OTH, A1: ONE, A2: TWO, BN: LEAD, BS: SPACE, WN: START, WS: SPACE, CUT: START}
    goes_on = {LET: {L: LET}, NUM: {N: NUM}, OTH: {O: OTH, A1: OTH, A2: OTH}, LEAD: {L: LET, N: NUM, O: OTH, A1: OTH, A2: OTH}, SPACE: {BS: SPACE, WS: SPACE}, ONE: {L: START}, TWO: {L: ONE}, START: {}}
    step, emit = np.zeros((8, 10), np.uint8), np.ones((8, 10), np.uint8)
    for state in range(8):
        for symbol in range(10):
            if symbol in goes_on[state]:
                step[state, symbol], emit[state, symbol] = goes_on[state][symbol], 0
            else:
                step[state, symbol] = fresh[symbol]
    return step, emit


STEP, EMIT = splitter_tables()


@lru_cache(maxsize=1)
def class_of() -> np.ndarray:
    """Letter, number, other, blank (as BN) or other white space (as WN) by code point."""
    out = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = L if kind == "L" else N
    out[SPACES] = WN
    out[32] = BN
    return out


def symbols(cps: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """cps: code points of all texts; cuts: places that hold no character but separate texts."""
    sym = class_of()[cps]
    sym[cuts] = CUT
    after = np.append(sym[1:], CUT)
    space = (sym == BN) | (sym == WN)
    sym[space & ((after == BN) | (after == WN) | (after == CUT))] += 1  # …N to …S
    quote = np.flatnonzero(cps == 39)
    if len(quote := quote[sym[quote] == O]):
        pad = np.append(cps, [0, 0])
        pad[cuts] = 0
        x, y = pad[quote + 1], pad[quote + 2]
        sym[quote[np.isin(x, [ord(c) for c in "stmd"])]] = A1
        pair = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        sym[quote[pair]] = A2
    return sym


def scan(maps: np.ndarray) -> np.ndarray:
    """Exclusive prefix composition of state maps (chunks x states), by doubling: log2(chunks) rounds."""
    out = np.vstack((np.arange(maps.shape[1], dtype=maps.dtype)[None], maps[:-1]))
    gap = 1
    while gap < len(out):
        out = np.vstack((out[:gap], np.take_along_axis(out[gap:], out[:-gap], axis=1)))
        gap *= 2
    return out


def boundaries(sym: np.ndarray) -> np.ndarray:
    """1 where a pre-token (or a cut) starts."""
    n = len(sym)
    lanes = np.full(-(-n // CHUNK) * CHUNK, CUT, np.uint8)
    lanes[:n] = sym
    lanes = np.ascontiguousarray(lanes.reshape(-1, CHUNK).T)
    flat = STEP.ravel()
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes.shape[1], 8))
    for row in lanes:
        maps = flat[maps * np.uint8(10) + row[:, None]]
    state = scan(maps)[:, START]
    out, emit = np.empty_like(lanes), EMIT.ravel()
    for t, row in enumerate(lanes):
        at = state * np.uint8(10) + row
        out[t], state = emit[at], flat[at]
    return out.T.ravel()[:n]


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The lazily built transducer from bytes to changes of the token count."""

    def __init__(self, vocab: dict[str, int], merges: list):
        to_bytes = byte_alphabet()
        raw = {k: bytes(to_bytes[c] for c in k) for k in vocab if all(c in to_bytes for c in k)}
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.rank = {}
        made: dict[bytes, tuple[bytes, bytes, int]] = {}
        for i, (a, b) in enumerate(pairs):
            a, b = raw[a], raw[b]
            self.rank.setdefault((a, b), i)
            made.setdefault(a + b, (a, b, i))
        self.made = made
        self.tokens = {bytes([b]) for b in range(256)} | set(made)
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        start = ((b"", None, 0),)  # (bytes since a place where a token may begin, token that ends there, its count less the count now)
        self.states, self.ids, self.next = [start], {start: 0}, {}
        self.words: dict[bytes, int] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """Pieces of a token at its right (side 1) or left (0) end while it is merged, each with the rank that uses it up."""
        out, used = [(token, float("inf"))], None
        while made := self.made.get(token):
            token, used = made[side], made[2]
            out.append((token, used))
        return out

    def fit(self, a: bytes, b: bytes) -> bool:
        """No merge takes place across the boundary of a and b. At equal ranks the merge further left comes first."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 4 * STATES:
                self.fits.clear()
            rank = self.rank
            found = not any((r := rank.get((x, y))) is not None and r < till_x and r <= till_y for x, till_x in self._spine(a, 1) for y, till_y in self._spine(b, 0))
            self.fits[a, b] = found
        return found

    def build(self, state: int, byte: int) -> int:
        """The transition, packed as next state * 256 + change + 128."""
        places = [(since + bytes([byte]), last, count) for since, last, count in self.states[state]]
        for since, last, count in places:  # from the furthest place on
            if since in self.tokens and (last is None or self.fit(last, since)):
                token, change = since, count + 1
                break
        new = tuple((since, last, count - change) for since, last, count in places if since in self.prefixes) + ((b"", token, 0),)
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        packed = self.next[state << 8 | byte] = to << 8 | change + 128
        return packed

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self.forget()
        state, total, get = 0, 0, self.next.get
        for byte in word:
            packed = get(state << 8 | byte)
            if packed is None:
                packed = self.build(state, byte)
            state, total = packed >> 8, total + (packed & 255) - 128
        return total


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only byte-level BPE without normaliser is compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merger = Merger(spec["model"]["vocab"], spec["model"]["merges"])

    def segments(self, text: str) -> tuple[list[str], int]:
        """Texts between special strings, and how many of those there are."""
        parts = [text]
        for s in self.special:
            parts = [x for p in parts for x in p.split(s)]
        return parts, len(parts) - 1

    def counts(self, batch: list[str]) -> list[int]:
        """Token counts of the texts."""
        out, owner, segments = [0] * len(batch), [], []
        for i, text in enumerate(batch):
            parts, out[i] = self.segments(text)
            for p in parts:
                if p:
                    owner.append(i)
                    segments.append(p)
        if not segments:
            return out
        joined = "\n".join(segments) + "\n"  # the line feeds stand at cuts
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        cuts = np.cumsum(lengths + 1) - 1
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(boundaries(symbols(cps, cuts)))
        sizes = np.ones(len(cps), np.int64) + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        data, at = joined.encode(), offsets[starts].tolist()
        merger, known, per_word = self.merger, self.merger.words, []
        for a, b in zip(at[:-1], at[1:], strict=True):
            word = data[a:b]
            n = known.get(word)
            if n is None:
                n = merger.count(word)
                known = merger.words
                if len(known) >= WORDS:
                    known.clear()
                known[word] = n
            per_word.append(n)
        per_word.append(0)
        # a cut is a start of its own and counts nothing; what comes before it belongs to its segment
        per_word = np.array(per_word, np.int64)
        cut_at = np.searchsorted(starts, cuts)
        per_word[cut_at] = 0
        total = np.concatenate(([0], np.cumsum(per_word)))
        ends = total[cut_at]
        for i, n in zip(owner, np.diff(ends, prepend=0).tolist(), strict=True):
            out[i] += n
        return out


def pieces(text: str, size: int) -> Iterator[str]:
    """Cuts of about ``size`` characters at safe places; together they are the text."""
    at = 0
    while len(text) - at > size and (cut := AFTER_LETTER.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, repeated rows too.

    Null and empty texts have no tokens. A text over BATCH_CHARS is counted in pieces that end at safe places.
    Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = alone(counter)(tokenizer_path).counts

        def done(ids: list, held: list[str]) -> pa.RecordBatch:
            n = count(held)
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in held], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        ids, held, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) > BATCH_CHARS:
                    n = sum(count([x])[0] for x in pieces(text, BATCH_CHARS // 4))
                    yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([len(text.encode())], pa.int64()), pa.array([n], pa.int64()), pa.array([n > limit], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
                    continue
                ids.append(doc)
                held.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield done(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield done(ids, held)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
