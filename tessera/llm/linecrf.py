"""Document quality from a linear-chain conditional random field that labels every line good or bad.

Each line has features of its own characters and words and those of the lines before and after it. The chain's two
states share weights on the features and a table of transitions. Training maximises the conditional likelihood of the
labelled documents, whose lines all carry the document's label, by exact forward-backward gradients. A document's score
is the mean of its lines' marginal probabilities of being good, weighted by their lengths in characters (plus one), and set
on the scale of the label's probability by a monotone curve of two numbers.

The weights are learnt from at most ``TRAIN_DOCS`` labelled documents, those with the least hashes, of at most
``TRAIN_LINES`` lines each; only their features reach the driver. Documents whose crc32 of the id as text is 0 modulo 5
are never learnt from. Ids, languages, sources and labels are no features. All texts are scored whole.

Defined cases: a null or empty text is one empty line; without usable labels every score is 0.5; a null label or a null id
is not learnt from, a null id is not held out; repeated rows are scored each; an empty table gives no rows; extra columns
stay with ``with_score`` and are ignored by the query.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS, TRAIN_LINES = 3000, 500
FOLDS, HELD_OUT = 5, 0
KEEP = 0.3
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
BATCH_CHARS = 2_000_000

_LETTER, _UPPER, _DIGIT, _SPACE, _POINT, _BANG, _OTHER = range(7)


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane, by its general category."""
    out = np.full(1 << 16, _OTHER, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        out[c] = _UPPER if kind == "Lu" else _LETTER if kind[0] in "LM" else _DIGIT if kind == "Nd" else _SPACE if kind == "Zs" or c in (9, 11, 12, 13) else _OTHER
    for c in ".,;:?'\"-()":
        out[ord(c)] = _POINT
    out[ord("!")] = _BANG
    return out


class LineFeatures:
    OWN = 15
    NEAR = slice(2, 11)
    SIZE = OWN + 2 * 9 + 2

    def __init__(self) -> None:
        self.table = _classes()
        self.place = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features of each line, its length, lines of each text) of several texts at once."""
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.table[np.where(cp < 1 << 16, cp, 0x4E00)]
        brk = np.flatnonzero(cp == 10)
        n_lines = np.array([t.count("\n") + 1 for t in texts])
        starts = np.concatenate(([0], brk[:-1] + 1))
        size = brk - starts
        sums = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))[np.stack((starts, brk))], axis=0)[0]
        gap = (kind == _SPACE) | (cp == 10)
        begin = ~gap & np.concatenate(([True], gap[:-1]))
        upper, digit, space, point, bang, other = (sums(kind == k) for k in (_UPPER, _DIGIT, _SPACE, _POINT, _BANG, _OTHER))
        letter = sums(kind == _LETTER) + upper
        words = sums(begin)
        at = np.flatnonzero(begin)
        again = np.zeros(len(cp), bool)
        if len(at):
            inside = np.arange(len(cp)) - np.repeat(np.concatenate(([0], at)), np.diff(np.concatenate(([0], at, [len(cp)]))))
            value = np.where(gap, np.uint64(0), (cp.astype(np.uint64) + np.uint64(1)) * self.place[inside & 63])
            code = np.add.reduceat(value, at)
            again[at[1:][code[1:] == code[:-1]]] = True
        again = sums(again)
        # digits say nothing of quality: shares are of the other characters
        n, w = np.maximum(size - digit, 1), np.maximum(words, 1)
        full = size > 0
        last = np.where(full, cp[np.maximum(brk - 1, 0)], 0)
        own = np.stack((
            np.ones(len(n)), np.log1p(size) / 6, letter / n, upper / np.maximum(letter, 1), 4 * other / n, np.minimum(20 * other / n, 1), 8 * bang / n, np.minimum(4 * point / n, 0.4), 4 * space / n, np.minimum((size - space) / w / 10, 3), again / w,
            np.log1p(words) / 5, full & (kind[starts] == _UPPER), np.isin(last, (46, 63, 33)), ~full,
        ), axis=1).astype(np.float64)
        ends = np.cumsum(n_lines)
        first, final = ends - n_lines, ends - 1
        before, after = np.roll(own[:, self.NEAR], 1, axis=0), np.roll(own[:, self.NEAR], -1, axis=0)
        is_first, is_final = np.zeros((len(n), 1)), np.zeros((len(n), 1))
        before[first], after[final], is_first[first], is_final[final] = 0, 0, 1, 1
        return np.concatenate((own, before, after, is_first, is_final), axis=1), size, n_lines


class Chain:
    """The field: weights of the good state's features against the bad state's, and transitions by [from, to]."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.moves, self.slope, self.shift = weights, moves, slope, shift

    @staticmethod
    def _by_place(n_lines: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Line numbers by place: the t-th holds the lines of all texts with more than t lines, longest texts first."""
        order = np.argsort(-n_lines, kind="stable")
        first = (np.cumsum(n_lines) - n_lines)[order]
        alive = np.searchsorted(-n_lines[order], -np.arange(n_lines.max()), side="left")
        return order, [first[:k] + t for t, k in enumerate(alive)]

    def marginals(self, x: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(each line's probability of good, the expected moves, the sum of log partition functions)."""
        emit = np.stack((np.zeros(len(x)), x @ self.weights), axis=1)
        _, at = self._by_place(n_lines)
        fwd, back = np.empty_like(emit), np.zeros_like(emit)
        fwd[at[0]] = emit[at[0]]
        for t in range(1, len(at)):
            prev = fwd[at[t - 1][: len(at[t])]]
            fwd[at[t]] = emit[at[t]] + np.logaddexp(prev[:, :1] + self.moves[0], prev[:, 1:] + self.moves[1])
        for t in range(len(at) - 2, -1, -1):
            nxt = at[t + 1]
            if len(nxt):
                s = emit[nxt] + back[nxt]
                back[at[t][: len(nxt)]] = np.logaddexp(self.moves[:, 0] + s[:, :1], self.moves[:, 1] + s[:, 1:])
        total = np.logaddexp.reduce(fwd + back, axis=1)
        good = np.exp(fwd[:, 1] + back[:, 1] - total)
        moves = np.zeros((2, 2))
        for t in range(1, len(at)):
            prev = at[t - 1][: len(at[t])]
            both = fwd[prev][:, :, None] + self.moves + (emit[at[t]] + back[at[t]])[:, None, :] - total[at[t]][:, None, None]
            moves += np.exp(both).sum(axis=0)
        return good, moves, float(total[at[0]].sum())

    @classmethod
    def fit(cls, x: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Chain:
        """labels: of texts. Adam on the mean log-likelihood."""
        y = np.repeat(labels.astype(np.float64), n_lines)
        stay = np.array([(n_lines - 1)[labels == k].sum() for k in (0, 1)], np.float64)
        p = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for k in range(1, steps + 1):
            chain = cls(p[:-4], p[-4:].reshape(2, 2))
            good, moves, _ = chain.marginals(x, n_lines)
            grad = np.concatenate((x.T @ (y - good), (np.diag(stay) - moves).ravel())) / len(x) - ridge * p
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            p = p + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls(p[:-4], p[-4:].reshape(2, 2))

    def means(self, x: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The log odds of each text's mean, weighted by length."""
        good, _, _ = self.marginals(x, n_lines)
        first = np.cumsum(n_lines) - n_lines
        weight = size + 1.0
        mean = np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))

    def calibrate(self, odds: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> None:
        """Two numbers that make the means probabilities of the label, by Newton's method; the order of scores stays."""
        z = np.stack((odds, np.ones(len(odds))), axis=1)
        p = np.array([1.0, 0.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(z @ p, -40, 40)))
            step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge * np.eye(2), z.T @ (labels - q) - ridge * (p - [1.0, 0.0]))
            p = p + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        self.slope, self.shift = max(float(p[0]), 1e-3), float(p[1])

    def scores(self, x: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.means(x, size, n_lines) + self.shift, -40, 40)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(df: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Chain | None:
    """From df (doc_id, text) and labels (doc_id, quality)."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # the least hashes: a share of about twice the bound is sorted, so no task sends more than its part of it
    usable = usable.withColumn("at", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    share = min(1.0, 2 * most_docs / max(1, usable.count()))
    chosen = usable.where(F.col("at").cast("double") <= share * 2.0**63).orderBy("at", "doc_id").limit(most_docs).drop("at")
    texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.where(F.char_length("text") - F.char_length(F.translate("text", "\n", "")) < most_lines)
    # one row an id, so that the bound on ids is one on rows, however often an id is repeated
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = LineFeatures()
        for batch in batches:
            rows = [(*features([t])[:2], q) for t, q in zip(batch["text"], batch["quality"], strict=True)]
            yield pd.DataFrame({"x": [r[0].astype(np.float32).tobytes() for r in rows], "size": [r[1] for r in rows], "quality": [r[2] for r in rows]})

    rows = texts.select("text", F.col("quality").cast("int").alias("quality")).mapInPandas(run, "x binary, size array<long>, quality int").orderBy(F.xxhash64("x"), "x").collect()
    if not rows:
        return None
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, LineFeatures.SIZE) for r in rows]
    lines, n_lines, quality = np.concatenate(x).astype(np.float64), np.array([len(a) for a in x]), np.array([r["quality"] for r in rows])
    chain = Chain.fit(lines, n_lines, quality)
    chain.calibrate(chain.means(lines, np.concatenate([r["size"] for r in rows]), n_lines), quality)
    return chain


def scorer(chain: Chain | None):
    """A column function of texts."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = LineFeatures()
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            if chain is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            out: list[np.ndarray] = []
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= BATCH_CHARS):
                    held += len(texts[end])
                    end += 1
                out.append(chain.scores(*features(texts[at:end])))
                at = end
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return score


def with_score(df: DataFrame, labels: DataFrame, column: str = "quality_score") -> DataFrame:
    return df.withColumn(column, scorer(train(df, labels))(F.col("text")))


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = with_score(df.select("doc_id", "text"), labels, "score")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).cast("int").alias("predicted"))
