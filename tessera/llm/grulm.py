"""A gated recurrent language model in numpy that scores whole documents.

Tokens are the words of the lower-cased text and one end. The model's symbols are the ``VOCAB`` commonest training tokens
(the end among them) and ``SUFFIXES`` classes of all other words by their last three bytes. The output softmax is
factored: first a class of symbols, then the symbol within its class. A word outside the vocabulary has the probability
of its suffix class times its share of the class, (c + 1) / Z, c being its count over all training documents and Z the sum of
c + 1 over the class, plus 1.

Counts cover all training documents. A second pass over the texts writes each document as its symbols, with a number of its own; learning
and scoring read that table, so texts are cut into words twice in all and never moved.

The network learns from every token of the training documents: the table is read in place, each task
cuts its own into shards of about ``SHARD_TOKENS`` tokens, each shard runs truncated backpropagation over parallel streams
that together hold the whole shard, and the shards' weights are averaged, position by position, in Spark; so the
driver gets one vector per round, of a fixed size. The output biases start at the symbols' frequencies.

Scoring reads each document whole: documents are run side by side, longest first, in windows of ``WINDOW`` tokens, and the
state is carried from each window to the next, so a score is the complete document's log-likelihood.

The counts of words outside the vocabulary are looked up by a join of (document, word, times) with the counts table; no
dictionary of the corpus is held anywhere. Words are 64-bit hashes there.

Defined cases: a null or empty text is the end alone; a null doc_id is a training document; repeated rows are scored and
counted each; with no training document all counts are 0 and every symbol is equally likely at the start; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

FOLDS, HELD_OUT = 7, 2
VOCAB, SUFFIXES, HIDDEN = 1024, 96, 16
#: further words whose counts tasks hold: a fixed number
COMMON = 32_000
LEAST_TOKENS, SHARD_TOKENS, ROUNDS, LEAST_UPDATES = 800_000, 2_400_000, 1, 150
STREAMS, MOST_STREAMS, WINDOW, RATE = 64, 512, 32, 0.01
SEED = 3
BATCH_TOKENS = 2_000_000
_SPLIT_MOST = 300_000


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def suffix(word: bytes) -> int:
    """The last three bytes of the word without closing ASCII punctuation, as a number."""
    return int.from_bytes((word.rstrip(b".,;:!?\"')|*%&$#") or word)[-3:], "big")


def held_out(doc_id) -> bool:
    return doc_id is not None and not pd.isna(doc_id) and zlib.crc32(str(int(doc_id)).encode()) % FOLDS == HELD_OUT


@dataclass
class Symbols:
    """Words to ids, and ids to symbols. Symbol 0 is the end, then come the vocabulary, a class per suffix, and one for all other
    words. Ids are the same, but that the common words, whose counts are known here, have ids of their own before the classes."""

    vocab: np.ndarray  # hashes, commonest first
    vocab_counts: np.ndarray
    common: np.ndarray  # hashes of the next ones
    common_counts: np.ndarray
    common_suffixes: np.ndarray
    suffixes: list[int]
    mass: np.ndarray  # Z of each suffix class
    n_docs: int
    n_words: int
    n_types: int

    def __post_init__(self) -> None:
        self.first = 1 + len(self.vocab)
        self.size = self.first + len(self.mass)
        classes = {s: i for i, s in enumerate(self.suffixes)}
        n = len(self.common)
        self.by_hash = {int(h): i + 1 for i, h in enumerate([*self.vocab, *self.common])}
        self.by_suffix = {s: self.first + n + i for s, i in classes.items()}
        self.other = self.first + n + len(self.mass) - 1
        counts = np.concatenate(([self.n_docs], self.vocab_counts)).astype(np.float64)
        of_common = np.array([classes.get(int(s), len(self.mass) - 1) for s in self.common_suffixes], np.int32)
        self.symbol = np.concatenate((np.arange(self.first), self.first + of_common, np.arange(self.first, self.size))).astype(np.int32)
        #: by id: log10(c + 1) as far as known here; whether the word is known; what a score adds to its symbol's probability
        more = np.log10(self.common_counts.astype(np.float64) + 1)
        self.own = np.concatenate((np.log10(counts + 1), more, np.zeros(len(self.mass))))
        self.seen = np.concatenate((counts > 0, np.ones(n, bool), np.zeros(len(self.mass), bool))).astype(np.int64)
        self.share = np.concatenate((np.zeros(self.first), more - np.log10(self.mass)[of_common], -np.log10(self.mass)))
        self.weight = np.concatenate((counts, self.mass)) + 1.0
        self.known = Known(self.by_hash, self.by_suffix, self.other)

    @property
    def train_tokens(self) -> int:
        return self.n_words + self.n_docs

    @property
    def train_types(self) -> int:
        return self.n_types + (self.n_docs > 0)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _SPLIT_MOST:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.known = Known(self.by_hash, self.by_suffix, self.other)


class Known(dict):
    """Ids of the words met so far."""

    def __init__(self, by_hash: dict[int, int], by_suffix: dict[int, int], other: int):
        super().__init__()
        self.by_hash, self.by_suffix, self.other = by_hash, by_suffix, other

    def __missing__(self, w: bytes) -> int:
        self[w] = s = self.by_hash.get(xxhash.xxh3_64_intdigest(w)) or self.by_suffix.get(suffix(w), self.other)
        return s


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def count_words(df: DataFrame) -> DataFrame:
    """(h, suffix, c) over the training documents, for every distinct word. df: doc_id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"h": [_signed(xxhash.xxh3_64_intdigest(w)) for w in seen], "suffix": [suffix(w) for w in seen], "c": list(seen.values())})
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not held_out(doc_id):
                    seen.update(tokens(text))
                    if len(seen) > _SPLIT_MOST:
                        yield flush()
        yield flush()

    return df.mapInPandas(run, "h long, suffix int, c long").groupBy("h").agg(F.max("suffix").alias("suffix"), F.sum("c").alias("c"))


def symbols(counts: DataFrame, n_docs: int, vocab: int = VOCAB, suffixes: int = SUFFIXES, more: int = COMMON) -> Symbols:
    """Collects the vocabulary, the common words and the suffix classes: rows of a number fixed by the parameters."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    most = vocab - 1 + more
    # the level of counts from which on there are enough words: a few thousand rows tell it, so no task sends more than its share
    level = F.floor(F.log2("c") * 64).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    held, least = 0, 0
    for row in sizes:
        held, least = held + row["count"], row["level"]
        if held >= most:
            break
    every = counts.where(level >= least).orderBy(F.desc("c"), "h").limit(most).toPandas()
    top, next_ = every.iloc[: vocab - 1], every.iloc[vocab - 1 :]
    common = counts.sparkSession.createDataFrame(top[["h"]]) if len(top) else counts.select("h").limit(0)
    rest = counts.join(F.broadcast(common), "h", "left_anti").groupBy("suffix").agg(F.sum(F.col("c") + 1).alias("mass"))
    best = rest.orderBy(F.desc("mass"), "suffix").limit(suffixes - 1).toPandas()
    all_mass = rest.agg(F.sum("mass")).first()[0] or 0
    mass = np.append(best["mass"].to_numpy(np.float64), float(all_mass) - float(best["mass"].sum())) + 1.0
    hashes = lambda f: f["h"].to_numpy(np.int64).view(np.uint64)
    return Symbols(hashes(top), top["c"].to_numpy(np.int64), hashes(next_), next_["c"].to_numpy(np.int64), next_["suffix"].to_numpy(np.int64), [int(x) for x in best["suffix"]], mass, n_docs, int(total["n"] or 0), int(total["v"]))


class Network:
    """Weights in one flat vector: embedding, gates, class and symbol outputs. Symbols come in order of weight (but for the end,
    which is first) and are dealt to classes of about equal sums of square roots of weights: common symbols share small ones."""

    def __init__(self, weight: np.ndarray, hidden: int = HIDDEN, dtype=np.float32):
        n_symbols = len(weight)
        self.n, self.h, self.dtype = n_symbols, hidden, dtype
        share = np.cumsum(np.sqrt(weight))
        bins = np.minimum((share / share[-1] * np.ceil(np.sqrt(n_symbols))).astype(int), int(np.ceil(np.sqrt(n_symbols))) - 1)
        self.bounds = np.append(np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1]))), n_symbols)
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)).astype(np.int32)
        self.k = len(self.bounds) - 1
        h = hidden
        self.shapes = {"E": (self.n, h), "W": (h, 3 * h), "U": (h, 3 * h), "b": (3 * h,), "C": (h, self.k), "bc": (self.k,), "O": (self.n, h), "bo": (self.n,)}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, weight: np.ndarray, seed: int = SEED) -> np.ndarray:
        """weight: of each symbol in the network's order."""
        rng = np.random.default_rng(seed)
        flat = np.zeros(sum(int(np.prod(s)) for s in self.shapes.values()), self.dtype)
        p = self.views(flat)
        for name in ("E", "W", "U"):
            p[name][:] = rng.normal(0, 1 / np.sqrt(self.h), p[name].shape)
        # each softmax's largest bias is 0; states stay within -1..1, so exponentials need no guard
        of_class = np.add.reduceat(weight, self.bounds[:-1])
        p["bo"][:] = np.log(weight / np.maximum.reduceat(weight, self.bounds[:-1])[self.class_of])
        p["bc"][:] = np.log(of_class / of_class.max())
        return flat

    def step(self, p: dict[str, np.ndarray], xw: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.h
        hu = h @ p["U"]
        g = 1 / (1 + np.exp(-(xw[:, : 2 * n] + hu[:, : 2 * n])))
        c = np.tanh(xw[:, 2 * n :] + g[:, n:] * hu[:, 2 * n :])
        return c + g[:, :n] * (h - c), g, c, hu[:, 2 * n :]

    def by_class(self, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        k = self.class_of[y].astype(np.int16)
        order = np.argsort(k, kind="stable")
        ends = np.searchsorted(k[order], np.arange(self.k + 1))
        for c in range(self.k):
            if ends[c] < ends[c + 1]:
                yield c, order[ends[c] : ends[c + 1]]

    def log_prob(self, p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability after the states h."""
        out = np.empty(len(y), self.dtype)
        ones, k = np.ones(max(self.k, self.n), self.dtype), self.class_of[y]
        for at in range(0, len(y), 4096):  # blocks that stay in the cache
            own = slice(at, at + 4096)
            z = h[own] @ p["C"]
            z += p["bc"]
            picked = z[np.arange(len(z)), k[own]]
            np.exp(z, out=z)
            out[own] = picked - np.log(z @ ones[: self.k])
        for c, rows in self.by_class(y):
            a, b = self.bounds[c], self.bounds[c + 1]
            if b - a == 1:
                continue
            z = h[rows] @ p["O"][a:b].T
            z += p["bo"][a:b]
            picked = z[np.arange(len(rows)), y[rows] - a]
            np.exp(z, out=z)
            out[rows] += picked - np.log(z @ ones[: b - a])
        return out

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h0: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of targets y [time, stream] after inputs x, its gradient and the last state; states
        are zeroed where fresh."""
        p, grad = self.views(flat), np.zeros_like(flat)
        d = self.views(grad)
        t_n, b_n, n = *x.shape, self.h
        table = p["E"] @ p["W"] + p["b"]
        live = (~fresh).astype(self.dtype)[:, :, None]
        before, hs, kept = np.empty((t_n, b_n, n), self.dtype), np.empty((t_n, b_n, n), self.dtype), []
        h = h0
        for t in range(t_n):
            h = np.multiply(h, live[t], out=before[t])
            new, g, c, hu = self.step(p, table[x[t]], h)
            kept.append((g, c, hu))
            hs[t] = h = new
        m = t_n * b_n
        total, dh = self.outputs(p, d, hs.reshape(m, n), y.ravel())
        dh = dh.reshape(t_n, b_n, n)
        da, du = np.empty((t_n, b_n, 3 * n), self.dtype), np.empty((t_n, b_n, 3 * n), self.dtype)
        carry, back = np.zeros((b_n, n), self.dtype), np.ascontiguousarray(p["U"].T)
        for t in reversed(range(t_n)):
            h, (g, c, hu) = before[t], kept[t]
            dn = dh[t] + carry
            zg, rg = g[:, :n], g[:, n:]
            dc = dn * (1 - zg) * (1 - c * c)
            da[t, :, :n] = dn * (h - c) * zg * (1 - zg)
            da[t, :, n : 2 * n] = dc * hu * rg * (1 - rg)
            da[t, :, 2 * n :] = dc
            du[t, :, : 2 * n] = da[t, :, : 2 * n]
            du[t, :, 2 * n :] = dc * rg
            carry = (dn * zg + du[t] @ back) * live[t]
        d["U"][:] = before.reshape(m, n).T @ du.reshape(m, 3 * n)
        dtable = np.zeros_like(table)
        order = np.argsort(x.ravel().astype(np.int16 if self.n < 1 << 15 else np.int32), kind="stable")
        own = x.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        dtable[own[first]] = np.add.reduceat(da.reshape(m, 3 * n)[order], first, axis=0)
        d["E"][:], d["W"][:], d["b"][:] = dtable @ p["W"].T, p["E"].T @ dtable, dtable.sum(axis=0)
        grad /= m
        return float(total / m), grad, hs[-1]

    def outputs(self, p: dict[str, np.ndarray], d: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The summed negative log-likelihood of targets y after the states h, and its gradient by them; those by the outputs'
        weights are added to d. Rows go in order of their classes."""
        k = self.class_of[y].astype(np.int16)
        order = np.argsort(k, kind="stable")
        h, y, k = h[order], y[order], k[order]
        dh, total, ones = np.empty_like(h), 0.0, np.ones(max(self.k, self.n), self.dtype)
        weights = np.ascontiguousarray(p["C"].T)
        for at in range(0, len(y), 4096):  # blocks that stay in the cache
            own = slice(at, at + 4096)
            q = h[own] @ p["C"]
            q += p["bc"]
            np.exp(q, out=q)
            q *= (1 / (q @ ones[: self.k]))[:, None]
            i = np.arange(len(q)), k[own]
            total -= np.log(q[i] + 1e-30).sum()
            q[i] -= 1
            d["C"] += h[own].T @ q
            d["bc"] += q.sum(axis=0)
            dh[own] = q @ weights
        ends = np.searchsorted(k, np.arange(self.k + 1))
        for c in range(self.k):
            own = slice(ends[c], ends[c + 1])
            a, b = self.bounds[c], self.bounds[c + 1]
            if b - a == 1 or ends[c] == ends[c + 1]:
                continue
            q = h[own] @ p["O"][a:b].T
            q += p["bo"][a:b]
            np.exp(q, out=q)
            q *= (1 / (q @ ones[: b - a]))[:, None]
            i = np.arange(len(q)), y[own] - a
            total -= np.log(q[i] + 1e-30).sum()
            q[i] -= 1
            d["O"][a:b], d["bo"][a:b] = q.T @ h[own], q.sum(axis=0)
            dh[own] += q @ p["O"][a:b]
        out = np.empty_like(dh)
        out[order] = dh
        return total, out

    def train(self, flat: np.ndarray, docs: list[np.ndarray], seed: int, streams: int = STREAMS, window: int = WINDOW, rate: float = RATE, least: int = LEAST_UPDATES) -> np.ndarray:
        """Adam over truncated windows of parallel streams, each of which carries its state on. Every epoch reads every token: the
        documents are laid end to end in a permutation and cut evenly into the streams."""
        rng = np.random.default_rng(seed)
        flat = flat.astype(self.dtype).copy()
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        total = sum(map(len, docs))
        # a large shard has more streams, a very small one fewer
        streams = max(1, min(MOST_STREAMS, max(streams, total // (window * least)), total // window))
        each = -(-total // (streams * window))
        updates = each * max(1, min(10, -(-least // each)))  # a small shard is read ten times at most
        h = np.zeros((streams, self.h), self.dtype)
        last = np.zeros(streams, np.int32)
        for k in range(1, updates + 1):
            at = (k - 1) % each * window
            if not at:  # the last windows are filled up from the beginning
                lanes = np.resize(np.concatenate([docs[i] for i in rng.permutation(len(docs))]), (streams, each * window))
                h, last = np.zeros_like(h), np.zeros_like(last)
            y = np.ascontiguousarray(lanes[:, at : at + window].T)
            x = np.concatenate((last[None], y[:-1]))
            last = y[-1]
            _, grad, h = self.loss(flat, x, y, x == 0, h)
            norm = float(np.sqrt((grad * grad).sum()))
            grad *= min(1.0, 1.0 / (norm + 1e-12))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            flat -= (rate * (1 - 0.9 * k / updates) / (1 - 0.9**k)) * m / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        return flat

    def score(self, flat: np.ndarray, docs: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
        """Natural log-likelihood of each document (symbols, the end included), state carried across windows."""
        p = self.views(flat)
        table = p["E"] @ p["W"] + p["b"]
        sizes = np.array([len(x) for x in docs])
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        all_y = np.concatenate(docs) if docs else np.empty(0, np.int32)
        out = np.zeros(len(docs))
        longest = int(sizes.max()) if len(docs) else 0
        alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
        h = np.zeros((len(docs), self.h), self.dtype)
        x = np.zeros(len(docs), np.int32)
        for at in range(0, longest, window):
            states, targets, owners = [], [], []
            for t in range(at, min(at + window, longest)):
                n = alive[t]
                h = self.step(p, table[x[:n]], h[:n])[0]
                x = all_y[starts[:n] + t]
                states.append(h)
                targets.append(x)
                owners.append(n)
            lp = self.log_prob(p, np.concatenate(states), np.concatenate(targets))
            end = 0
            for n in owners:
                out[order[:n]] += lp[end : end + n]
                end += n
        return out


def network(words: Symbols, hidden: int = HIDDEN) -> tuple[Network, np.ndarray, np.ndarray]:
    """(the network, its weights at the start, its place of each symbol)."""
    place = np.empty(words.size, np.int32)
    order = np.append(0, 1 + np.argsort(-words.weight[1:], kind="stable"))  # the end stays 0
    place[order] = np.arange(words.size)
    net = Network(words.weight[order], hidden)
    return net, net.start(words.weight[order]), place


def encode(docs: DataFrame, words: Symbols, place: np.ndarray) -> DataFrame:
    """Per document its symbols by place (16 or 32 bits each), what is known of its tokens here, and its words whose counts are not:
    their hashes and how often they occur."""
    kind = "<u2" if words.size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = place[words.symbol].astype(kind)
        rare = len(words.by_hash) + 1  # ids from here on are classes of suffixes
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for text in batch["text"]:
                own = tokens(text)
                ids = np.append(words(own), 0)
                found = np.flatnonzero(ids >= rare)
                h, n = np.unique(np.fromiter((xxhash.xxh3_64_intdigest(own[i]) for i in found.tolist()), np.uint64, len(found)), return_counts=True)
                row = (of[ids].tobytes(), len(ids), int(words.seen[ids].sum()), words.own[ids].sum(), words.share[ids].sum(), h.view(np.int64), n.astype(np.int32))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": [held_out(x) for x in batch["doc_id"]]} | dict(zip(("ids", "n_tokens", "known", "own", "share", "h", "n"), cols, strict=True)))

    return docs.mapInPandas(run, "doc_id long, held_out boolean, ids binary, n_tokens long, known long, own double, share double, h array<long>, n array<int>")


def learn(train: DataFrame, net: Network, flat: np.ndarray, words: Symbols, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> np.ndarray:
    """The weights. train: ids of all training documents, as encoded."""
    if not words.n_docs:
        return flat
    kind = "<u2" if words.size <= 1 << 16 else "<u4"
    # partitions of few tokens go together, without a shuffle
    parts = train.select("ids").coalesce(max(1, words.train_tokens // LEAST_TOKENS))
    for r in range(rounds):

        def run(batches: Iterator[pd.DataFrame], flat: np.ndarray = flat, r: int = r) -> Iterator[pd.DataFrame]:
            total, n, docs, held = np.zeros(len(flat)), 0, [], 0
            for batch in batches:
                for own in batch["ids"]:
                    docs.append(np.frombuffer(own, kind).astype(np.int32))
                    held += len(docs[-1])
                    if held >= shard_tokens:
                        total += held * net.train(flat, docs, SEED + r).astype(np.float64)
                        n, docs, held = n + held, [], 0
            if held:
                total += held * net.train(flat, docs, SEED + r).astype(np.float64)
                n += held
            if n:
                yield pd.DataFrame({"v": [total / n], "n": [float(n)]})

        trained = parts.mapInPandas(run, "v array<double>, n double")
        mean = trained.select(F.posexplode("v").alias("i", "x"), "n").groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        flat = mean.toPandas().sort_values("i")["x"].to_numpy(np.float32)
    return flat


def score(df: DataFrame, vocab: int = VOCAB, suffixes: int = SUFFIXES, hidden: int = HIDDEN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of df (doc_id, text)."""
    stages = Stages(df.sparkSession, "grulm")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1))
    train = docs.where(fold != HELD_OUT)
    counts = stages.put(count_words(train), "counts")
    words = symbols(counts, train.count(), vocab, suffixes)
    net, flat, place = network(words, hidden)
    encoded = stages.put(encode(docs, words, place).withColumn("row", F.monotonically_increasing_id()), "encoded")  # fixed by being written
    flat = learn(encoded.where("not held_out"), net, flat, words)
    kind = "<u2" if words.size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, found = 0, []
            while at < len(batch):
                own, held = [], 0
                for x in batch["ids"].iloc[at:]:
                    own.append(np.frombuffer(x, kind).astype(np.int32))
                    held += len(own[-1])
                    if held >= BATCH_TOKENS:
                        break
                found.append(net.score(flat, own) / np.log(10))
                at += len(own)
            if found:
                yield batch.drop(columns="ids").assign(model=np.concatenate(found))

    terms = encoded.select("row", F.explode(F.arrays_zip("h", "n")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.n").alias("n")).join(counts.select("h", "c"), "h", "left")
    of_doc = terms.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    fields = "row long, doc_id long, held_out boolean, n_tokens long, known long, own double, share double"
    each = encoded.select(*[x.split()[0] for x in fields.split(", ")], "ids").mapInPandas(run, fields + ", model double")
    out = each.join(of_doc, "row", "left")
    rare_sum, rare_known = F.coalesce("rare", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    n_all = F.lit(words.train_tokens).cast("long")
    base = F.col("own") + rare_sum - F.col("n_tokens") * F.log10(F.lit(float(words.train_tokens + words.train_types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + rare_known).cast("long").alias("n_known"), n_all.alias("train_tokens"), base.alias("base_score"), (F.col("model") + F.col("share") + rare_sum).alias("score"))
