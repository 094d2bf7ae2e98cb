"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding (words that enough training documents have) beside one made from
its characters (trigrams, and its first four and six characters). The network reads windows of WINDOW
words, every STRIDE words and the last, which cover all words of the text; a text's score is that of its
most suspicious window. Training sees documents only: each epoch finds every document's most
suspicious window and learns from that one and a random one (multiple-instance learning).

Training takes a bounded sample of labelled rows, by hash order, on one executor; scoring is a narrow
pass without shuffle. Words are projected once and remembered, within a bound.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import alone, slices, texts
from millrace.llm.shingles import M1, mixed

#: bounds of the training sample
POSITIVES, NEGATIVES = 3000, 5000
WINDOW, STRIDE = 48, 24
#: characters of a word; longer ones are cut into pieces
WORD_CHARS = 24
EMBED, HIDDEN, ATTEND, VOCAB, MIN_DOCS, CHAR_BUCKETS = 12, 12, 12, 20_000, 3, 1 << 13
WORDS, PART = 250_000, 25_000
EPOCHS, BATCH, RATE = 7, 128, 0.01
#: windows that are read together
MANY = 512
STEPS_OF_WINDOW = np.arange(WINDOW)
#: of the update, reset and new gates: see infer
SCALE = np.repeat(np.array([-1, -1, 2], np.float32), HIDDEN)
#: small samples are gone over more often, until there were about STEPS steps, up to MOST_EPOCHS times
STEPS, MOST_EPOCHS = 400, 40


def words_of(text: str) -> list[str]:
    """Words in lower case; an over-long one, as in text without blanks, is cut into pieces that each count as a word."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= WORD_CHARS:
        return words
    return [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]*#$%&|<>") or word


def char_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words one after the other, number of each): of the first four and six bytes, then of the trigrams of bytes."""
    raw = [b"^%b$" % w.encode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8).astype(np.uint64)
    n = len(data) - 8
    bucket = lambda x: (mixed(x * M1) % np.uint64(CHAR_BUCKETS)).astype(np.int64)
    begin = np.zeros(len(raw), np.uint64)
    for j in range(7):
        begin |= np.where(size > j, data[start + j], np.uint64(0)) << np.uint64(8 * (7 - j))
    trigrams = bucket((data[:n] << np.uint64(16)) | (data[1 : n + 1] << np.uint64(8)) | data[2 : n + 2])
    many = size  # two prefixes and size - 2 trigrams
    out = np.empty(n, np.int64)
    out[start], out[start + 1] = bucket(begin & ~np.uint64((1 << 24) - 1)), bucket(begin | np.uint64(1))
    inside = np.arange(n) - np.repeat(start, many)
    out[inside >= 2] = trigrams[inside < np.repeat(many - 2, many)]
    return out, many


class Inputs:
    """What the network sees of a list of words: their vocabulary ids and character buckets."""

    def __init__(self, words: list[str], vocab: dict[str, int]):
        self.ids = np.array([vocab.get(w, 0) for w in words], np.int64)
        self.flat, self.sizes = char_buckets(words)
        self.first = np.cumsum(self.sizes) - self.sizes

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.sizes[which]
        at = np.repeat(self.first[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.ids[which], self.flat[at], sizes


def windows(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters p; word id 0 is the unknown word, and padding is masked."""

    def __init__(self, vocab: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.vocab = {w: i + 1 for i, w in enumerate(vocab)}
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"words": normal(0.1, len(vocab) + 1, EMBED), "chars": normal(0.1, CHAR_BUCKETS, EMBED)}
        for d in "fb":
            self.p |= {f"wx{d}": normal(0.2, 2 * EMBED, 3 * HIDDEN), f"bx{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": normal(0.2, HIDDEN, 3 * HIDDEN)}
        self.p |= {"wa": normal(0.3, 2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": normal(0.3, ATTEND), "wo": normal(0.3, 2 * HIDDEN), "bo": np.full(1, -2, np.float32)}

    def embed(self, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs of words, weights of their character buckets)."""
        starts = np.cumsum(sizes) - sizes
        # prefixes count fully, trigrams by their mean
        weight = np.repeat(1 / np.maximum(sizes - 2, 1), sizes).astype(np.float32)
        weight[starts] = weight[starts + 1] = 1
        return np.hstack((self.p["words"][ids], np.add.reduceat(self.p["chars"][flat] * weight[:, None], starts, axis=0))), weight

    def tables(self, words: Inputs) -> np.ndarray:
        """Gates of both directions by word (2 x words x 3 hidden), scaled for infer; word 0 pads."""
        x, _ = self.embed(words.ids, words.flat, words.sizes)
        return np.stack([(x @ self.p[f"wx{d}"] + self.p[f"bx{d}"]) * SCALE for d in "fb"])

    def infer(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of windows, as forward gives them; ids: steps x batch, rows of table, 0 where there is no word.

        Gates come scaled by -1, -1 and 2, so that every sigmoid and tanh is one exponential; both directions go together.
        """
        p, (steps, batch), full = self.p, ids.shape, bool(ids.all())
        u = np.stack((p["uf"], p["ub"])) * SCALE
        mask = None if full else (ids > 0).astype(np.float32)
        h, g = np.zeros((2, batch, HIDDEN), np.float32), np.empty((2, batch, 3 * HIDDEN), np.float32)
        out = np.empty((steps, batch, 2 * HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.take(table[0], ids[t], axis=0, out=g[0], mode="clip")
                np.take(table[1], ids[-1 - t], axis=0, out=g[1], mode="clip")
                hu = h @ u
                zr = g[:, :, : 2 * HIDDEN] + hu[:, :, : 2 * HIDDEN]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                n = hu[:, :, 2 * HIDDEN :] * zr[:, :, HIDDEN:]
                n += g[:, :, 2 * HIDDEN :]
                np.exp(n, out=n)
                n += 1
                np.divide(-2, n, out=n)
                n += 1
                n -= h
                n *= 1 - zr[:, :, :HIDDEN]
                if not full:
                    n[0] *= mask[t][:, None]
                    n[1] *= mask[-1 - t][:, None]
                h += n
                out[t, :, :HIDDEN], out[-1 - t, :, HIDDEN:] = h[0], h[1]
            e = out.reshape(-1, 2 * HIDDEN) @ (2 * p["wa"])
            e += 2 * p["ba"]
            np.exp(e, out=e)
        e += 1
        np.reciprocal(e, out=e)
        s = (e @ (-2 * p["va"])).reshape(steps, batch)  # less a constant, which doesn't matter to attention
        if not full:
            s -= 1e4 * (1 - mask)
        s -= s.max(axis=0)
        np.exp(s, out=s)
        return (s * (out @ p["wo"])).sum(axis=0) / s.sum(axis=0) + p["bo"][0]

    def read(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """One direction. gates: steps x batch x 3 hidden, from the inputs; mask: steps x batch."""
        steps, batch = mask.shape
        h, out, tape = np.zeros((batch, HIDDEN), np.float32), np.empty((steps, batch, HIDDEN), np.float32), []
        for t in range(steps):
            hu = h @ u
            zr = sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = n + z * (h - n)
            if keep:
                tape.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = h + m * (new - h)
            out[t] = h
        return out, tape

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; gates: steps x batch x 6 hidden."""
        p, k = self.p, 3 * HIDDEN
        hf, tf = self.read(gates[:, :, :k], mask, p["uf"], keep)
        hb, tb = self.read(gates[::-1, :, k:], mask[::-1], p["ub"], keep)
        h = np.concatenate((hf, hb[::-1]), axis=2)
        a = np.tanh(h @ p["wa"] + p["ba"])
        s = a @ p["va"] - 1e4 * (1 - mask)
        e = np.exp(s - s.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", att, h)
        logit = pooled @ p["wo"] + p["bo"][0]
        return logit, (h, a, att, pooled, tf, tb)

    def unread(self, gates_shape, mask, u, tape, dout):
        """Gradients of one direction: by the gates and by u."""
        steps, batch = mask.shape
        dg, du, dh = np.empty(gates_shape, np.float32), np.zeros_like(u), np.zeros((batch, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, hn = tape[t]
            dh = dh + dout[t]
            m = mask[t][:, None]
            dnew = dh * m
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dg[t] = np.hstack((dz, dr, dn))
            dhu = np.hstack((dz, dr, dn * r))
            du += h.T @ dhu
            dh = dh * (1 - m) + dnew * z + dhu @ u.T
        return dg, du

    def backward(self, gates, mask, cache, dlogit):
        p, k = self.p, 3 * HIDDEN
        h, a, att, pooled, tf, tb = cache
        g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["wo"]
        datt = np.einsum("bh,tbh->tb", dpooled, h)
        ds = att * (datt - (att * datt).sum(axis=0))
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        g |= {"va": np.einsum("tb,tba->a", ds, a), "wa": np.einsum("tbh,tba->ha", h, da), "ba": da.sum(axis=(0, 1))}
        dh = att[:, :, None] * dpooled + da @ p["wa"].T
        dgf, g["uf"] = self.unread((*mask.shape, k), mask, p["uf"], tf, dh[:, :, :HIDDEN])
        dgb, g["ub"] = self.unread((*mask.shape, k), mask[::-1], p["ub"], tb, dh[::-1, :, HIDDEN:])
        return g, np.concatenate((dgf, dgb[::-1]), axis=2)


class Adam:
    def __init__(self, p: dict):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def fit(docs: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    split = [[bare(w) for w in words_of(t)] for t in docs]
    in_docs = Counter(w for ws in split for w in set(ws))
    net = Network([w for w, n in sorted(in_docs.items(), key=lambda x: (-x[1], x[0]))[:VOCAB] if n >= MIN_DOCS], seed)
    index = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
    names = ["", *index]
    words = Inputs(names, net.vocab)
    rows, owner = [], []
    for k, ws in enumerate(split):
        ids = np.zeros(max(WINDOW, len(ws)), np.int32)
        ids[: len(ws)] = [index[w] for w in ws]
        starts = windows(len(ws))
        rows.append(ids[np.array(starts)[:, None] + np.arange(WINDOW)])
        owner += [k] * len(starts)
    rows, owner = np.concatenate([np.zeros((0, WINDOW), np.int32), *rows]), np.array(owner)
    first = np.searchsorted(owner, np.arange(len(docs)))
    count = np.diff(first, append=len(owner))
    adam, epochs = Adam(net.p), min(MOST_EPOCHS, max(EPOCHS, -(-STEPS * BATCH // max(1, len(docs)))))
    for epoch in range(epochs):
        chosen = [first + (rng.random(len(docs)) * count).astype(np.int64)]
        if epoch >= epochs // 4:
            table, logits = net.tables(words), np.empty(len(rows), np.float32)
            for at in range(0, len(rows), MANY):
                logits[at : at + MANY] = net.infer(table, np.ascontiguousarray(rows[at : at + MANY].T))
            order = np.lexsort((-logits, owner))
            # a negative document is negative everywhere; a positive one only where it is worst
            chosen = [order[first], np.where(labels == 0, chosen[0], order[first])]
        chosen = np.unique(np.concatenate(chosen))
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            own = chosen[at : at + BATCH]
            ids, inverse = np.unique(rows[own].T, return_inverse=True)
            inverse = inverse.reshape(WINDOW, len(own))
            mask = (rows[own].T > 0).astype(np.float32)
            word, flat, sizes = words.take(ids)
            x, weight = net.embed(word, flat, sizes)
            wx, bx = np.hstack((net.p["wxf"], net.p["wxb"])), np.concatenate((net.p["bxf"], net.p["bxb"]))
            gates = (x @ wx + bx)[inverse]
            logit, cache = net.forward(gates, mask, keep=True)
            target, w = labels[owner[own]], weights[owner[own]]
            g, dgates = net.backward(gates, mask, cache, ((sigmoid(logit) - target) * w / w.sum()).astype(np.float32))
            per_word = np.zeros((len(ids), 6 * HIDDEN), np.float32)
            np.add.at(per_word, inverse.ravel(), dgates.reshape(-1, 6 * HIDDEN))
            dwx, dx = x.T @ per_word, per_word @ wx.T
            k = 3 * HIDDEN
            g |= {"wxf": dwx[:, :k], "wxb": dwx[:, k:], "bxf": per_word[:, :k].sum(axis=0), "bxb": per_word[:, k:].sum(axis=0)}
            g["words"], g["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(g["words"], word, dx[:, :EMBED])
            np.add.at(g["chars"], flat, np.repeat(dx[:, EMBED:], sizes, axis=0) * weight[:, None])
            adam.step(net.p, g, RATE * (1 - epoch / epochs))
    return net


class Scorer:
    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.known, self.raw = {}, {}
        self.table, self.used = np.zeros((2, 4096, 3 * HIDDEN), np.float32), 1

    def ids(self, words: list[str]) -> list[int]:
        raw = self.raw
        if new := set(words).difference(raw):
            if len(raw) + len(new) > 3 * WORDS or self.used + len(new) > WORDS:
                self.forget()
                raw, new = self.raw, set(words)
            stems = {w: bare(w) for w in new}
            if fresh := list(set(stems.values()).difference(self.known)):
                if self.used + len(fresh) > self.table.shape[1]:
                    self.table = np.concatenate((self.table, np.zeros((2, max(self.table.shape[1], len(fresh)), 3 * HIDDEN), np.float32)), axis=1)
                self.table[:, self.used : self.used + len(fresh)] = self.net.tables(Inputs(fresh, self.net.vocab))
                self.known.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
                self.used += len(fresh)
            known = self.known
            raw.update([(w, known[s]) for w, s in stems.items()])
        return list(map(raw.__getitem__, words))

    def scores(self, batch: list[str]) -> np.ndarray:
        """Of each text, the probability of its worst window; an empty text is one empty window."""
        out = np.full(len(batch), -np.inf)
        split = [words_of(text) for text in batch]
        parts = [(k, words[at : at + PART + WINDOW]) for k, words in enumerate(split) for at in range(0, max(len(words), 1), PART)]  # a huge text's parts overlap
        while parts:
            some, size = [], 0
            while parts and (not some or size + len(parts[-1][1]) <= 4 * PART):
                some.append(parts.pop())
                size += len(some[-1][1])
            self._score(some, out)
        return sigmoid(out)

    def _score(self, parts: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        flat = np.array(self.ids([w for _, words in parts for w in words]), np.int32)
        rows, owner, at = [], [], 0
        for k, words in parts:
            n = len(words)
            if n < WINDOW:
                rows.append(np.concatenate((flat[at : at + n], np.zeros(WINDOW - n, np.int32)))[None])
            else:
                rows.append(flat[at + np.array(windows(n))[:, None] + STEPS_OF_WINDOW])
            owner.append(np.full(len(rows[-1]), k))
            at += n
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        short = rows[:, -1] == 0
        for some in (np.flatnonzero(~short), np.flatnonzero(short)):  # full windows need no mask
            for i in range(0, len(some), MANY):
                own = some[i : i + MANY]
                np.maximum.at(out, owner[own], self.net.infer(self.table, np.ascontiguousarray(rows[own].T)))


@lru_cache(maxsize=1)
def scorer(model: bytes) -> Scorer:
    return Scorer(load(model))


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(doc_id, text, label, weight): up to so many rows of each label, by hash of the id; weights restore the labels' ratio."""
    labelled = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def take(label: int, most: int) -> DataFrame:
        n = totals.get(label, 0)
        return labelled.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(n / max(1, min(n, most))))

    chosen = F.broadcast(take(1, positives).unionByName(take(0, negatives)))  # at most positives + negatives ids
    return docs.join(chosen, "doc_id").select("doc_id", "text", "label", "weight")


def train(rows: DataFrame) -> bytes:
    """A fitted network, pickled, from (doc_id, text, label, weight); fitted by one task, since the rows are bounded. Empty without rows."""

    def run(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("doc_id", kind="stable")
        net = fit(got["text"].tolist(), got["label"].to_numpy(np.float32), got["weight"].to_numpy(np.float32))
        return pd.DataFrame({"model": [pickle.dumps((list(net.vocab), net.p))]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else b""


def load(model: bytes) -> Network:
    vocab, p = pickle.loads(model) if model else ([], None)
    net = Network(vocab)
    if p is not None:
        net.p = p
    return net


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; null counts as empty. Without a model (nothing to learn from) every score is 0.

    All words of a text of any length are read, in parts that overlap. Repeated rows repeat, other columns are
    ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = alone(scorer)(model)
        for batch in slices(batches):
            held = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(own.scores(held) if model else np.zeros(len(held)), pa.float64())], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
