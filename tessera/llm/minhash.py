"""Near-duplicate documents by MinHash with tensored banding; links are confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct shingles of five words. Two small collections of half keys,
``halves`` in each and ``rows`` minhashes to a half, stand for halves * halves tables: the key of table (i, j) is
the pair of the i-th half of the first collection and the j-th of the second. So 100 tables of six rows cost 60 minhashes instead of 600. A pair with similarity s meets in a table with probability (1 - (1 - s ** rows) ** halves) ** 2: over 0.9998 at 0.85.

1. One pass makes each document's set hash and half keys. Documents with equal sets are one class from here on.
2. Halves that only one class has can't meet in any table, so they go before the keys of tables are formed.
3. Each class in a table's bucket is tied to the bucket's least class: no pairs are made, whatever its size. The
   components of these ties are candidate clusters; every candidate pair lies within one.
4. The sets of clusters' classes, made again from the texts, are dealt by cluster, each once. A task finds all links of
   a cluster exactly, by prefix-filtered set joins, skipping pairs that are already connected. A cluster with more shingles
   than ``most_shingles`` is cut into blocks by set size, and each pair of blocks whose sizes may link is a task of its
   own; the components of all links follow. Nothing is capped.

Defined cases: null, empty or blank text: an empty set, linked with nothing, its own component; fewer than five words:
one shingle; a null doc_id takes part and is its own component's least only if no other id is there (it sorts last); rows
with one id are one node of the graph; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .components import components

WORDS = 5
HALVES, ROWS = 10, 3
THRESHOLD = (85, 100)
MOST_SHINGLES = 1_000_000
SEED = 0x5EED
_NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(SEED)
_MIX = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTHS = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word to 64-bit hash; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, cache: WordHashes, width: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter((cache[x] for x in words), np.uint64, len(words))
    if len(w) < width:
        return _mixed((w * _MIX[: len(w)]).sum(keepdims=True) + _LENGTHS[len(w) : len(w) + 1])
    n = len(w) - width + 1
    s = np.zeros(n, np.uint64)
    for i in range(width):
        s += w[i : i + n] * _MIX[i]
    return np.unique(_mixed(s))


class HalfKeys:
    """The half keys of a set: 2 * halves numbers, each a hash of ``rows`` minhashes."""

    def __init__(self, halves: int = HALVES, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed + 1)
        n = 2 * halves * rows
        self.shape = (2 * halves, rows)
        self.a = (rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.x = rng.integers(1, 1 << 63, n, dtype=np.uint64)[:, None]
        self.fold = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(s), 4096):
            part = (((s[None, at : at + 4096] ^ self.x) * self.a) >> np.uint64(24)).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        return _mixed((low.reshape(self.shape) * self.fold).sum(axis=1, dtype=np.uint64)).view(np.int64)


def features(df: DataFrame, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, tag, n_shingles, set_hash (null for an empty set) and half_keys. df: doc_id, tag, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, keys = WordHashes(), HalfKeys(halves, rows)
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingles(text, cache)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, keys(s) if len(s) else None))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tag": batch["tag"].astype("Int64"), "n_shingles": [x[0] for x in out], "set_hash": [x[1] for x in out], "half_keys": [x[2] for x in out]})

    ids = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("tag").cast("long").alias("tag"), "text")
    return ids.mapInPandas(run, "doc_id long, tag long, n_shingles long, set_hash binary, half_keys array<long>")


def ties(classes: DataFrame, stages: Stages, halves: int = HALVES) -> DataFrame:
    """(a, b): classes tied to the least one of a bucket. classes: rep, half_keys."""
    each = classes.select("rep", F.posexplode("half_keys").alias("pos", "half"))
    shared = each.groupBy("pos", "half").count().where("count > 1").select("pos", "half")
    live = each.join(shared, ["pos", "half"]).groupBy("rep").agg(F.collect_list(F.struct("pos", "half")).alias("xs"))  # at most 2 * halves
    side = lambda first: F.filter("xs", lambda x: (x["pos"] < halves) == F.lit(first))
    keys = F.flatten(F.transform(side(True), lambda x: F.transform(side(False), lambda y: F.xxhash64(x["pos"], y["pos"], x["half"], y["half"]))))
    rows = stages.put(live.select("rep", F.explode(keys).alias("key")), "keys")
    least = rows.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    return rows.join(least, "key").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()


def links_within(sets: list[np.ndarray], block: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """For each set the least index connected with it by links; sets whose blocks agree on two or more blocks are compared
    only across blocks. Exact: a pair that may link shares one of each set's rarest shingles."""
    num, den = threshold
    n = len(sets)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    tokens = [np.sort(token[starts[i] : starts[i + 1]]) for i in range(n)]
    index: dict[int, list[int]] = {}
    mark = np.zeros(len(count), bool)
    two = len(np.unique(block)) > 1
    for i in np.lexsort((np.arange(n), sizes)):
        own, size = tokens[i], sizes[i]
        prefix = own[: size - (num * size + den - 1) // den + 1]
        found: set[int] = set()
        for t in prefix.tolist():
            if count_t := index.get(t):
                found.update(count_t)
        if found:
            ri = find(i)
            left = [j for j in found if den * sizes[j] >= num * size and (not two or block[j] != block[i]) and find(j) != ri]
            for at in range(0, len(left), 256):
                part = [j for j in left[at : at + 256] if find(j) != find(i)]
                if not part:
                    continue
                mark[own] = True
                hits = mark[np.concatenate([tokens[j] for j in part])]
                mark[own] = False
                ends = np.cumsum(sizes[part])
                common = np.diff(np.concatenate(([0], np.cumsum(hits)[ends - 1])))
                for j, c in zip(part, common, strict=True):
                    if den * c >= num * (size + sizes[j] - c):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
        for t in prefix.tolist():
            index.setdefault(t, []).append(i)
    return np.array([find(i) for i in range(n)])


def links(df: DataFrame, clusters: DataFrame, stages: Stages, threshold: tuple[int, int] = THRESHOLD, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(a, b): confirmed links that connect all that is connected within each cluster. clusters: rep, cluster, n_shingles."""
    num, den = threshold
    by_size = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    large = by_size.where(F.col("total") > most_shingles).select("cluster")
    small = clusters.join(large, "cluster", "left_anti").select("rep", F.col("cluster").alias("task"), F.lit(0).alias("block"))
    # blocks by set size: about most_shingles / 2 each, so that two fit a task
    half = most_shingles // 2
    cut = clusters.join(large, "cluster")
    level = F.floor(F.log2("n_shingles") * 8).cast("int")
    cut = cut.withColumn("level", level)
    held = cut.groupBy("cluster", "level").agg(F.sum("n_shingles").alias("held"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    parts = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("held") / half).cast("int"))))
    blocks = parts.select("cluster", "low", "high", F.xxhash64("cluster", "level", "part").alias("block"))
    other = blocks.select(F.col("cluster").alias("c2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, (F.col("cluster") == F.col("c2")) & (F.col("block") <= F.col("block2")) & (den * F.col("high") >= num * F.col("low2")) & (den * F.col("high2") >= num * F.col("low")))
    pairs = pairs.select("block", "block2", F.xxhash64("block", "block2").alias("task"))
    sides = pairs.select("task", "block").unionByName(pairs.select("task", F.col("block2").alias("block"))).distinct()
    salted = cut.join(held.select("cluster", "level", "held"), ["cluster", "level"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.floor(F.col("held") / half) + 1).cast("int"))
    salted = salted.select("rep", F.xxhash64("cluster", "level", "part").alias("block")).join(sides, "block")
    dealt = stages.put(small.select("rep", "task", F.lit(0).cast("long").alias("block")).unionByName(salted.select("rep", "task", "block")), "dealt")

    def make_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "task": batch["task"], "block": batch["block"], "own": [shingles(t, cache).tobytes() for t in batch["text"]]})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, bytes]] = []
        task = None

        def flush() -> pd.DataFrame | None:
            held.sort(key=lambda x: x[0])
            least = links_within([np.frombuffer(x[2], np.uint64) for x in held], np.array([x[1] for x in held]), threshold)
            ids = np.array([x[0] for x in held])
            tied = least != np.arange(len(held))
            return pd.DataFrame({"a": ids[tied], "b": ids[least[tied]]})

        for batch in batches:
            for t, rep, block, own in zip(batch["task"], batch["rep"], batch["block"], batch["own"], strict=True):
                if t != task and held:
                    yield flush()
                    held = []
                task = t
                held.append((rep, block, own))
        if held:
            yield flush()

    ids = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rep"), "text")
    # sorted on both sides at every size, so that a run on little data moves texts as one on much does
    sets = ids.join(dealt.hint("merge"), "rep").mapInPandas(make_sets, "rep long, task long, block long, own binary")
    parts_n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(parts_n, "task").sortWithinPartitions("task").mapInPandas(find, "a long, b long")


def near_duplicates(df: DataFrame, threshold: tuple[int, int] = THRESHOLD, halves: int = HALVES, rows: int = ROWS, most_shingles: int = MOST_SHINGLES, tag: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of df (doc_id, text).

    With tag, a column of whole numbers that comes back as ``tag``, the ids are taken for hashes of rows: if rows of one id have
    different sets, they are rows whose hashes clash, which link with nothing."""
    stages = Stages(df.sparkSession, "minhash")
    each = stages.put(features(df.select("doc_id", F.lit(None).cast("long").alias("tag") if tag is None else F.col(tag).alias("tag"), "text"), halves, rows), "features")
    some = each.where(F.col("set_hash").isNotNull())
    # an id whose rows have different sets is one node all the same, but for clashing hashes
    several = (some if tag is None else each).groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y"), F.count_if(F.col("set_hash").isNull()).alias("empty"))
    several = several.where("x <> y or x is not null and empty > 0").select("doc_id")
    if tag is not None:
        several = stages.put(several, "clashes")
        some = some.join(several, "doc_id", "left_anti")
    classes = some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("half_keys").alias("half_keys"), F.first("n_shingles").alias("n_shingles"))
    classes = stages.put(classes, "classes")
    clusters = components(ties(classes, stages, halves), stages, "candidates")
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clusters = stages.put(clusters.join(classes.select("rep", "n_shingles"), "rep"), "clusters")
    confirmed = links(df, clusters, stages, threshold, most_shingles)
    if tag is None:
        confirmed = confirmed.unionByName(some.join(several, "doc_id").join(classes, "set_hash").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    confirmed = stages.put(confirmed, "links")
    found = components(confirmed, stages, "linked")
    stages.drop("keys", "clusters", "dealt", "links")
    of_class = classes.join(found, classes["rep"] == found["node"], "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = some.join(of_class, "set_hash").select("doc_id", "tag", "n_shingles", "component_id")
    alone = each.where(F.col("set_hash").isNull())
    if tag is not None:
        alone = each.join(several, "doc_id").unionByName(alone.join(several, "doc_id", "left_anti"))
    out = out.unionByName(alone.select("doc_id", "tag", "n_shingles", F.col("doc_id").alias("component_id")))
    doc = F.when(F.col("doc_id") == _NO_ID, F.lit(None)).otherwise(F.col("doc_id"))
    comp = F.when(F.col("component_id") == _NO_ID, F.lit(None)).otherwise(F.col("component_id"))
    out = out.select(doc.cast("long").alias("doc_id"), "n_shingles", comp.cast("long").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"), "tag")
    return out.drop("tag") if tag is None else out
