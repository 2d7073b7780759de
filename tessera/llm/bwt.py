"""Repeated byte strings, found by merging Burrows-Wheeler transforms of shards.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same document or another, is removed.

1. Anchors. In each window of ``length`` bytes the least hash of its ``GRAM``-byte grams is the window's anchor. Equal
   windows have equal anchors, so windows whose anchor value occurs nowhere else are unique and done. A run of windows with
   one anchor is a context: the bytes that the run covers. Contexts are counted by anchor and content: where a context
   occurs twice, all its windows are repeated.
2. The distinct contexts of anchors that have several, or that stand at several places in one, go, dealt by anchor, to tasks that take them in blocks. A block is cut into
   shards; each shard's suffixes are sorted and kept as its Burrows-Wheeler transform. The transforms are merged without sorting
   suffixes again: the walk from each suffix to the one that starts later in the text comes from the transform alone, and the interleaving of the
   shards is refined step by step, from the order by h symbols to the order by 2 h, each shard's own order staying as it is.
   Neighbours in the merged order that agree in all steps have a common prefix of ``length``; runs of such neighbours are the
   repeated intervals.
3. An anchor with more distinct contexts than a block holds is dealt by the windows' own hashes instead (128 bits), with no cap, so that
   a passage in very many surroundings isn't one task's.

Positions of repeated windows come back to all occurrences of a context, become spans of the document and are cut out.

Beside that, passages of ``WORDS`` words are counted that another row holds too, to the byte: they may be shorter than ``length``, are
told and not removed. They have anchors (least hash of ``WORD_GRAM`` words) and contexts as above, which travel with the others, and
the contexts whose anchor has several are decided by the hashes of their windows (128 bits): within tasks in blocks as in 2, beyond a block as in 3.

Defined cases: rows of one id and text count as one row in n_shared, and only there; a null text is empty; texts shorter than ``length`` stay; rows with one id are documents of their own, so
equal rows repeat each other; a null doc_id is allowed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

LENGTH, GRAM = 400, 48
WORDS, WORD_GRAM = 50, 12
BLOCK, SHARD = 2_000_000, 400_000
SEED = 9
_M64 = (1 << 64) - 1
_IN_WORD = np.array([x != 32 and not 9 <= x <= 13 for x in range(256)])

_rng = np.random.default_rng(SEED)
_BASES = [int(x) * 2 + 1 for x in _rng.integers(1, 1 << 63, 2, dtype=np.uint64)]
_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Grams:
    """64-bit hashes of all strings of one length in a text, by running sums of powers of an odd base."""

    def __init__(self, which: int = 0):
        self.base, self.values = _BASES[which], _VALUES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, self.base, np.uint64))))
            self.down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, self.inverse, np.uint64))))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[text] * self.up[:n], dtype=np.uint64)))

    def __call__(self, text: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums(text) if sums is None else sums
        return self._mixed((sums[k:] - sums[:-k]) * self.down[: len(text) - k + 1])

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the strings from each start to its end."""
        return self._mixed((sums[end] - sums[start]) * self.down[start])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h) - w + 1
    x = np.concatenate((h, np.full(-len(h) % w, _M64, np.uint64))).reshape(-1, w)
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(x, axis=1).ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(text: bytes, grams: Grams, length: int = LENGTH, gram: int = GRAM, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor value, first window start, last window start, whether the anchor stands at several places in the run) of each
    run of windows with one anchor value. A run whose first anchor is in its last window too can't repeat a window itself."""
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h, w = grams(np.frombuffer(text, np.uint8), gram, sums), length - gram + 1
    least = window_minima(h, w)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(least)])) - 1
    several = np.fromiter((i + h[i : i + w].argmin() < j for i, j in zip(first.tolist(), last.tolist(), strict=True)), bool, len(first))
    return least[first].view(np.int64), first, last, several


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    within = np.zeros(len(text) + 2, bool)
    within[1:-1] = _IN_WORD[text]
    edges = np.flatnonzero(within[1:] != within[:-1])
    return edges[::2], edges[1::2]


def word_anchors(text: np.ndarray, grams: Grams, sums: np.ndarray, words: int = WORDS, gram: int = WORD_GRAM) -> tuple[np.ndarray, ...]:
    """(anchor value, hash of the context, its first byte, its end, number of windows) of each run of windows of so many words with one anchor value."""
    start, end = word_bounds(text)
    n = len(start) - words + 1
    if n < 1:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    least = window_minima(grams.between(sums, start[: len(start) - gram + 1], end[gram - 1 :]), words - gram + 1)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [n])) - 1
    a, b = start[first], end[last + words - 1]
    return least[first].view(np.int64), grams.between(sums, a, b).view(np.int64), a, b, last - first + 1


def windows_of(contexts: list[bytes], words: int, one: Grams, two: Grams) -> tuple[np.ndarray, ...]:
    """(context, number in it, and two hashes) of every window of so many words of the contexts."""
    text = np.frombuffer(b"\n".join(contexts), np.uint8)
    start, end = word_bounds(text)
    begins = np.cumsum([0] + [len(x) + 1 for x in contexts[:-1]])
    of = np.searchsorted(begins, start, side="right") - 1
    at = np.flatnonzero(of[: len(of) - words + 1] == of[words - 1 :])
    a, b = start[at], end[at + words - 1]
    return of[at], at - np.searchsorted(start, begins)[of[at]], one.between(one.sums(text), a, b), two.between(two.sums(text), a, b)


class Shard:
    """The Burrows-Wheeler transform of several strings, each with an end of its own below all bytes."""

    def __init__(self, strings: list[bytes]):
        n = sum(len(s) + 1 for s in strings)
        sym = np.zeros(n, np.int64)  # a byte plus one; ends are 0
        at = 0
        for s in strings:
            sym[at : at + len(s)] = np.frombuffer(s, np.uint8)
            sym[at : at + len(s)] += 1
            at += len(s) + 1
        self.ends = np.flatnonzero(sym == 0)
        order = self._sorted(sym, self.ends)
        self.starts = order
        self.bwt = sym[order - 1]  # the symbol before each suffix; the last string's end stands before the first suffix
        self.n = n

    @staticmethod
    def _sorted(sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(sym)
        left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(n)  # symbols before the end
        key = np.zeros(n, np.int64)
        for i in range(7):
            part = np.zeros(n, np.int64)
            part[: max(0, n - i)] = sym[i:]
            key = key * 512 + np.where(left >= i, part, 0)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (left[order][1:] < 7)))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        h = 7
        while True:
            tied = np.zeros(n, bool)
            tied[1:] = ~new[1:]
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                return order
            who = order[at]
            key = rank[who] * n + rank[np.minimum(who + h, n - 1)]
            sub = np.argsort(key, kind="stable")
            order[at] = who = who[sub]
            key, short = key[sub], left[who] < 2 * h
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | short[1:]))
            new[at] |= fresh
            rank[who] = at[np.maximum.accumulate(np.where(new[at], np.arange(len(at)), 0))]
            h *= 2

    def step(self) -> np.ndarray:
        """From each suffix's place to the place of the suffix one symbol on, by the transform alone. Ends lead nowhere useful."""
        return np.argsort(self.bwt, kind="stable")


def merge(shards: list[Shard], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For all places of all shards, shard after shard: (class, size of class); suffixes share a class exactly when they agree in their first
    ``length`` symbols, none of them an end."""
    walk = np.concatenate([s.step() + off for s, off in zip(shards, np.cumsum([0] + [x.n for x in shards[:-1]]), strict=True)])
    n = len(walk)
    # by one symbol; every end is a class of its own
    first = np.concatenate([np.sort(s.bwt) for s in shards])
    cls = first * n
    is_end = first == 0
    cls[is_end] = np.arange(is_end.sum())
    active = np.flatnonzero(~is_end)
    h = 1
    walks = {1: walk}
    todo = []
    while 2 * h <= length:
        todo.append(h)
        h *= 2
    if length > h:
        todo.append(length - h)

    # ids of classes keep the order of all: the rank of the class's first member
    order = np.argsort(cls, kind="stable")
    k = cls[order]
    rank = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(n), 0))
    cls[order] = rank
    for shift in todo:
        if not len(active):
            break
        if shift not in walks:
            if shift & (shift - 1) == 0:
                walks[shift] = walks[shift // 2][walks[shift // 2]]
            else:
                w = None
                for bit in range(shift.bit_length()):
                    if shift >> bit & 1:
                        w = walks[1 << bit] if w is None else walks[1 << bit][w]
                walks[shift] = w
        key = cls[active] * n + cls[walks[shift][active]]
        ids = np.sort(cls[active])
        # within a class of size m whose ids start at r the members take r, r + 1, ... by their new order
        runs = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        ids = ids + np.arange(len(ids)) - np.repeat(runs, np.diff(np.concatenate((runs, [len(ids)]))))
        # each shard's keys are nearly in order already: a stable sort merges such runs
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        group = np.cumsum(new) - 1
        cls[active[order]] = ids[np.flatnonzero(new)][group]
        together = np.empty(len(key), bool)
        together[order] = np.bincount(group)[group] > 1
        active = active[together]
    size = np.zeros(n, np.int64)
    if len(active):
        size[active] = np.bincount(cls[active], minlength=n)[cls[active]]
    return cls, size


def repeated_windows(strings: list[bytes], length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """For each string a mask of its window starts: whether that window occurs at another start of any of the strings."""
    shards, part, held, parts = [], [], 0, []
    for k, s in enumerate(strings):
        part.append(k)
        held += len(s) + 1
        if held >= shard or k == len(strings) - 1:
            shards.append(Shard([strings[i] for i in part]))
            parts.append(part)
            part, held = [], 0
    _, size = merge(shards, length)
    out, off = [], 0
    for s, part in zip(shards, parts, strict=True):
        hit = np.zeros(s.n, bool)
        hit[s.starts] = size[off : off + s.n] > 1
        off += s.n
        at = 0
        for k in part:
            out.append(hit[at : at + max(0, len(strings[k]) - length + 1)])
            at += len(strings[k]) + 1
    return out


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def repeated_spans(df: DataFrame, stages: Stages, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, words: int | None = None) -> DataFrame:
    """(key, key2, spans): for documents with repeated windows, the [start, end) of each run of them as covered bytes.
    df: key, key2 (two 64-bit hashes, which together tell rows apart), text. With words also n_shared: how many passages of so many words
    another row holds too."""
    spark = df.sparkSession

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], [], []]
            for key, key2, text in zip(batch["key"], batch["key2"], batch["text"], strict=True):
                own = _bytes(text)
                plain = np.frombuffer(own, np.uint8)
                sums = grams.sums(plain)
                v, a, b, own_several = anchors(own, grams, length, gram, sums)
                cols[0].append(v)
                cols[1].append(np.fromiter((xxhash.xxh3_64_intdigest(own[i : j + length]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a)).view(np.int64))
                cols[2].append(np.full(len(a), key, np.int64))
                cols[3].append(np.full(len(a), key2, np.int64))
                cols[4].append(a)
                cols[5].append(b)
                cols[6].append(own_several)
                cols[7].append(np.zeros(len(a), np.int32))
                if words:
                    v, content, a, end, wins = word_anchors(plain, grams, sums, words)
                    own_keys = np.full(len(a), key, np.int64), np.full(len(a), key2, np.int64)
                    for c, x in zip(cols, (v, content, *own_keys, a, end - length, np.zeros(len(a), bool), wins), strict=True):
                        c.append(x)
            if cols[0]:
                yield pd.DataFrame(dict(zip(("anchor", "content", "key", "key2", "a", "b", "within", "wins"), map(np.concatenate, cols), strict=True)))

    # a context is the bytes from a to b + length; wins: of a context of passages its number of windows, else 0
    everything = stages.put(df.mapInPandas(first, "anchor long, content long, key long, key2 long, a int, b int, within boolean, wins int"), "anchors")
    # the first of each column is of one row, whichever: contexts of one content don't differ
    kinds = everything.groupBy("anchor", "content", "wins").agg(F.count("*").alias("n"), F.min("key").alias("lowest"), F.max("key").alias("highest"), *(F.first(c).alias(c) for c in ("key", "key2", "a", "b", "within")))
    every_kind = stages.put(kinds, "kinds")
    several = every_kind.groupBy("anchor", (F.col("wins") > 0).alias("passage")).agg(F.count("*").alias("kinds"), F.sum(F.col("b") - F.col("a") + length).alias("bytes"), F.bool_or("within").alias("within"), (F.min("lowest") < F.max("highest")).alias("rows"))
    several = stages.put(several.where("(kinds > 1 or within) and (rows or not passage)"), "several")
    found, kinds = everything.where("wins = 0"), every_kind.where("wins = 0")
    # one occurrence of each distinct context whose anchor has several
    marks = several.select("anchor", "passage", (F.col("bytes") > block).alias("large"))
    wanted = every_kind.withColumn("passage", F.col("wins") > 0).join(marks, ["anchor", "passage"])
    per_key = wanted.groupBy("key", "key2").agg(F.collect_list(F.struct("anchor", "content", "a", "b", "large", "passage", "lowest", "highest")).alias("xs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, xs in zip(batch["text"], batch["xs"], strict=True):
                own = _bytes(text)
                rows += [(x["anchor"], x["content"], x["large"], x["passage"], x["lowest"], x["highest"], own[x["a"] : x["b"] + length]) for x in xs]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["anchor", "content", "large", "passage", "lowest", "highest", "own"]
    fields = "anchor long, content long, large boolean, passage boolean, lowest long, highest long, own binary"
    contexts = df.join(per_key, ["key", "key2"]).select("text", "xs").mapInPandas(cut, fields)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pd.DataFrame:
            rows = list({(x[0], x[1]): x for x in held}.values())  # equal rows of the table bring a context twice
            masks = repeated_windows([x[2] for x in rows], length)
            hit = [(x[0], x[1], *_runs(m)) for x, m in zip(rows, masks, strict=True) if m.any()]
            return pd.DataFrame(hit, columns=["anchor", "content", "lo", "hi"])

        for batch in batches:
            for anchor, content, own in zip(batch["anchor"], batch["content"], batch["own"], strict=True):
                if anchor != last and size > block:
                    yield flush()
                    held, size = [], 0
                last = anchor
                held.append((anchor, content, own))
                size += len(own)
        if held:
            yield flush()

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Grams(0), Grams(1)
        for batch in batches:
            for anchor, content, own in zip(batch["anchor"], batch["content"], batch["own"], strict=True):
                text = np.frombuffer(own, np.uint8)
                h = one(text, length)
                yield pd.DataFrame({"anchor": anchor, "content": content, "at": np.arange(len(h), dtype=np.int32), "h1": h.view(np.int64), "h2": two(text, length).view(np.int64)})

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Grams(0), Grams(1)
        for batch in batches:
            if len(batch):
                of, at, h1, h2 = windows_of(batch["own"].tolist(), words, one, two)
                yield batch.drop(columns="own").iloc[of].assign(at=at.astype(np.int32), h1=h1.view(np.int64), h2=h2.view(np.int64))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Grams(0), Grams(1)
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pd.DataFrame:
            rows = list({(x[0], x[1]): x for x in held}.values())
            of, _, h1, h2 = windows_of([x[4] for x in rows], words, one, two)
            order = np.lexsort((h2, h1))
            h1, h2, of = h1[order], h2[order], of[order]
            first = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
            lowest, highest = np.array([x[2] for x in rows])[of], np.array([x[3] for x in rows])[of]
            hit = np.minimum.reduceat(lowest, first) < np.maximum.reduceat(highest, first)
            # a window that stands twice in a context counts twice
            n = np.bincount(of[np.repeat(hit, np.diff(np.append(first, len(of))))], minlength=len(rows))
            return pd.DataFrame([(*x[:2], k) for x, k in zip(rows, n.tolist(), strict=True) if k and x[2] == x[3]], columns=["anchor", "content", "c"])

        for batch in batches:
            for row in zip(*(batch[c] for c in ("anchor", "content", "lowest", "highest", "own")), strict=True):
                if row[0] != last and size > block:
                    yield flush()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every_context = stages.put(contexts, "contexts")
    contexts = every_context.where("not passage").select("anchor", "content", "large", "own")
    small = contexts.where("not large").drop("large").repartition(parts, "anchor").sortWithinPartitions("anchor")
    ranges = small.mapInPandas(find, "anchor long, content long, lo array<int>, hi array<int>")
    if not several.where(~F.col("passage") & (F.col("bytes") > block)).isEmpty():
        windows = stages.put(contexts.where("large").dropDuplicates(["anchor", "content"]).mapInPandas(explode, "anchor long, content long, at int, h1 long, h2 long"), "windows")
        twice = windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
        hits = windows.join(twice, ["h1", "h2"]).groupBy("anchor", "content").agg(F.array_sort(F.collect_list("at")).alias("lo"))
        ranges = ranges.unionByName(hits.select("anchor", "content", "lo", F.col("lo").alias("hi")))
    ranges = stages.put(ranges, "ranges")
    whole = kinds.where("n > 1").select("anchor", "content", F.array(F.lit(0)).alias("lo"), F.array(F.col("b") - F.col("a")).alias("hi"))
    part = ranges.join(kinds.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_anti")
    ranges = whole.unionByName(part)
    hits = found.join(ranges, ["anchor", "content"])
    spans = F.zip_with("lo", "hi", lambda x, y: F.struct((F.col("a") + x).alias("start"), (F.col("a") + y + length).alias("end")))
    out = hits.select("key", "key2", F.explode(spans).alias("span")).groupBy("key", "key2").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    if not words:
        return out
    # passages: those of a context that several rows hold, else those whose hashes stand in contexts of several rows
    shared = every_kind.where("wins > 0 and lowest < highest").select("anchor", "content", F.col("wins").alias("c"))
    others = every_context.where("passage").drop("passage")
    near = others.where("not large").drop("large").repartition(parts, "anchor").sortWithinPartitions("anchor")
    shared = shared.unionByName(near.mapInPandas(told, "anchor long, content long, c int"))
    if not several.where(F.col("passage") & (F.col("bytes") > block)).isEmpty():
        windows = others.where("large").drop("large").mapInPandas(passages, "anchor long, content long, lowest long, highest long, at int, h1 long, h2 long")
        windows = stages.put(windows, "passages")
        twice = windows.groupBy("h1", "h2").agg(F.min("lowest").alias("from"), F.max("highest").alias("to")).where("from < to").select("h1", "h2")
        some = windows.where("lowest = highest").join(twice, ["h1", "h2"]).groupBy("anchor", "content").agg(F.size(F.collect_set("at")).alias("c"))
        shared = shared.unionByName(some)
    held = everything.where("wins > 0").join(stages.put(shared, "shared"), ["anchor", "content"])
    counts = held.groupBy("key", "key2").agg(F.aggregate(F.collect_set(F.struct("a", "c")), F.lit(0).cast("long"), lambda n, x: n + x["c"]).alias("n_shared"))
    return out.join(counts, ["key", "key2"], "full")


def remove_repeats(df: DataFrame, length: int = LENGTH, with_text: bool = False, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared of every row of df (doc_id, text); with_text adds the kept bytes. n_shared: how many
    passages of so many words another row holds too, removed or not."""
    stages = Stages(df.sparkSession, "bwt")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64(F.lit(SEED), "text", "doc_id")})
    spans = stages.put(repeated_spans(rows.select("key", "key2", "text"), stages, length, words=words), "spans")
    stages.drop("anchors", "kinds", "several", "contexts", "windows", "ranges", "passages", "shared")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own_spans, shared in zip(batch["text"], batch["spans"], batch["n_shared"], strict=True):
                own, kept, at, removed, n = _bytes(text), [], 0, 0, 0
                end = -1
                for x in own_spans if own_spans is not None else ():
                    a, b = x["start"], x["end"]
                    if a > end:
                        kept.append(own[at:a])
                        n += 1
                    removed += max(0, b - max(a, at))
                    at = end = max(b, at)
                kept.append(own[at:])
                left = b"".join(kept)
                out.append((len(own), removed, n, hashlib.sha256(left).hexdigest(), shared, left))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame if with_text else frame.drop(columns="kept")

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + (", kept binary" if with_text else "")
    return rows.join(spans, ["key", "key2"], "left").select("doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared")).mapInPandas(cut, schema)
