"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the nearest vertex of the
cross-polytope, that is the coordinate of greatest magnitude with its sign, is its hash. A table joins some hashes
to a code. Each vector stands in its own bucket and, by multiprobing, in the buckets whose vertices it misses by
the least; two vectors meet where one of them is at home. Only vectors of one label and one length are compared.

Equal vectors of a label are one class with a count, so copies don't fill buckets. In a bucket those at home are compared with all
classes by cosine in double precision, in blocks; a pair that meets in several buckets counts in the first of them only, which
both sides' codes tell, so counts need no list of pairs and only sums and spanning ties leave a task.

A label whose classes fit one task (``GROUP_BYTES``) is dealt by table: a class goes to ``FEW[0]`` tasks, which hash it and hold all buckets of
their table. A larger label is dealt by bucket, with more hashes to a code the larger it is, so that buckets stay of one size; a
bucket of more than ``bucket`` classes is cut into parts, and each pair of parts is a task.

Defined cases: a vector that is null, zero or holds null or non-finite components, and
one with a null label, has no links and is its own component; repeated rows count as other vectors; a null vec_id
takes part and sorts last; an empty table gives no rows; extra columns are ignored.
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

THRESHOLD = 0.93
PROBES = 3
BUCKET = 4000
#: hashes to a code -> tables, for a recall over 0.99 at the threshold
TABLES = {1: 6, 2: 10, 3: 18, 4: 30}
#: tables and probes of labels that fit a task, of one hash to a code: as many buckets as of the former in half the copies
FEW = (3, 8)
#: what a label's vectors may take in a task, and beside its components each vector's bytes there
GROUP_BYTES, EACH_BYTES = 48_000_000, 400
SEED = 71
_NO_ID = (1 << 63) - 1


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """Along the last axis, whose length is a power of two; orthonormal."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    def __init__(self, dim: int, tables: int, hashes: int, probes: int = PROBES, seed: int = SEED):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, min(probes, self.width - 1)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + probes): the home code, then the probes' codes, nearest first."""
        n, base = len(v), 2 * self.width
        x = np.zeros((n, self.width))
        x[:, : self.dim] = v
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        rows = np.arange(n)[:, None]
        for t in range(self.tables):
            own = np.zeros(n, np.int64)
            near, loss = [], []
            for k in range(self.hashes):
                y = x
                for r in range(3):
                    y = fast_hadamard(y * self.signs[t, k, r])
                m = np.abs(y)
                top = np.argsort(-m, axis=1, kind="stable")[:, : self.probes + 1]
                code = 2 * top + (y[rows, top] < 0)
                size = m[rows, top]
                own += code[:, 0] * base**k
                near.append((code[:, 1:] - code[:, :1]) * base**k)
                loss.append(size[:, :1] - size[:, 1:])
            near_, loss_ = np.concatenate(near, 1), np.concatenate(loss, 1)
            best = np.argsort(loss_, axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + near_[rows, best]
        return out


def classes(df: DataFrame) -> DataFrame:
    """vec_id, label, dim, own: the bytes of a usable vector, and class_hash; the last three null otherwise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, key, dim = [], [], []
            for e, label in zip(batch["embedding"], batch["label"], strict=True):
                v = None
                if e is not None and not pd.isna(label):
                    v = np.asarray(e, np.float64) + 0.0  # nulls become not-a-number; no negative zeros
                    v = v if np.isfinite(v).all() and v.any() else None
                own.append(None if v is None else v.tobytes())
                key.append(None if v is None else xxhash.xxh3_128_digest(own[-1] + int(label).to_bytes(8, "little", signed=True)))
                dim.append(None if v is None else len(v))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"].astype("Int64"), "dim": pd.array(dim, "Int32"), "own": own, "class_hash": key})

    ids = df.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return ids.mapInPandas(run, "vec_id long, label long, dim int, own binary, class_hash binary")


def _units(own: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(own), np.float64).reshape(len(own), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares of very large or small components finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first table, and in it the lesser code, in which pairs meet: table * 2 ** 48 + code. a, b: (pairs, tables, 1 + probes)."""
    none = np.int64((1 << 62) - 1)
    a_home, b_home = a[:, :, 0], b[:, :, 0]
    at_a = np.where((b == a_home[:, :, None]).any(axis=2), a_home, none)
    at_b = np.where((a == b_home[:, :, None]).any(axis=2), b_home, none)
    code = np.minimum(at_a, at_b)
    t = (code != none).argmax(axis=1)
    return t.astype(np.int64) * (1 << 48) + code[np.arange(len(t)), t]


def links_in_bucket(ids: np.ndarray, units: np.ndarray, counts: np.ndarray, codes: np.ndarray, part: np.ndarray, cross: bool, bucket: int, threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each class the copies of others linked with it that count in this bucket, and the least index it is tied to.
    cross: only pairs of two parts are compared."""
    n = len(ids)
    found, root = np.zeros(n, np.int64), np.arange(n)
    home = codes[:, bucket >> 48, 0] == bucket & ((1 << 48) - 1)
    at_home = np.flatnonzero(home)
    for p in range(0, len(at_home), block):
        own = at_home[p : p + block]
        for q in range(0, n, block):
            i, j = np.nonzero(units[own] @ units[q : q + block].T >= threshold - 1e-9)
            i, j = own[i], j + q
            keep = (i != j) & (~home[j] | (i < j))
            if cross:
                keep &= part[i] != part[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            exact = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
            i, j = i[exact], j[exact]
            first = first_meeting(codes[i], codes[j]) == bucket
            np.add.at(found, i[first], counts[j[first]])
            np.add.at(found, j[first], counts[i[first]])
            while True:
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                if (before == root).all():
                    break
    while (root[root] != root).any():
        root = root[root]
    return found, root


def _rows(ids: np.ndarray, found: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    tied = (root != np.arange(len(ids))) | (found > 0)
    return pd.DataFrame({"rep": ids[tied], "n": found[tied], "to": ids[root[tied]]})


def links_by_table(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, to) of labels that fit a task: a task holds all buckets of one table of a label. reps: rep, copies, label, dim, own."""
    tables, probes = FEW

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = None
        hashers: dict[int, CrossPolytope] = {}

        def flush() -> Iterator[pd.DataFrame]:
            t, ids, copies, own = held[0][0], *zip(*(x[1:] for x in held), strict=True)
            ids, copies, units = np.array(ids), np.array(copies), _units(list(own))
            dim = units.shape[1]
            hasher = hashers.setdefault(dim, CrossPolytope(dim, tables, 1, probes))
            codes = np.concatenate([hasher.codes(units[k : k + 4096]) for k in range(0, len(units), 4096)])
            flat, who = codes[:, t].ravel(), np.repeat(np.arange(len(ids)), codes.shape[2])
            order = np.lexsort((who, flat))
            flat, who = flat[order], who[order]
            cut = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1], [True])))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    k = who[a:b]
                    yield _rows(ids[k], *links_in_bucket(ids[k], units[k], copies[k], codes[k], k, False, (t << 48) + int(flat[a]), threshold))

        def summed() -> pd.DataFrame:
            every = pd.concat([*flush(), pd.DataFrame({"rep": [], "n": [], "to": []}, dtype=np.int64)])
            return every.groupby(["rep", "to"], as_index=False)["n"].sum()[["rep", "n", "to"]]

        for batch in batches:
            for row in zip(batch["task"], batch["t"], batch["rep"], batch["copies"], batch["own"], strict=True):
                if row[0] != at and len(held) > 1:
                    yield summed()
                if row[0] != at:
                    held = []
                at = row[0]
                held.append(row[1:])
        if len(held) > 1:
            yield summed()

    each = reps.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).select(F.xxhash64("label", "dim", "t").alias("task"), "t", "rep", "copies", "own", "label", "dim")
    parts_n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(parts_n, "task").sortWithinPartitions("task", "t", "label", "dim").drop("label", "dim").mapInPandas(find, "rep long, n long, to long")


def settings(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """length -> (hashes to a code, tables) of labels dealt by bucket. sizes: how many vectors have a length."""
    out = {}
    for dim, n in sizes.items():
        width = 2 * (1 << max(1, (dim - 1).bit_length()))
        k = next((k for k in (1, 2, 3) if n <= 4000 * width**k or width ** (k + 1) >= 1 << 48), 4)
        out[dim] = k, TABLES[k]
    return out


def links_by_bucket(reps: DataFrame, stages: Stages, threshold: float, probes: int, bucket: int, of: dict[int, tuple[int, int]]) -> DataFrame:
    """(rep, n, to) of labels that outgrow a task: buckets are dealt, and large ones cut. of: length -> (hashes to a code, tables)."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashers = {d: CrossPolytope(d, t, k, probes) for d, (k, t) in of.items()}
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                c = hashers[dim].codes(_units(list(own["own"])))
                yield own.assign(codes=list(c.reshape(len(own), -1)), wide=c.shape[2])

    coded = stages.put(reps.mapInPandas(code, "class_hash binary, rep long, copies long, label long, dim int, own binary, codes array<long>, wide int"), "coded")
    table_of = F.expr("transform(codes, (c, i) -> shiftleft(cast(i div wide as bigint), 48) + c)")
    rows = coded.select("class_hash", "label", "dim", F.explode(F.array_distinct(table_of)).alias("bucket"))
    size = rows.groupBy("label", "dim", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / (bucket // 2)).cast("int"))
    size = size.withColumn("parts", F.when(F.col("n") <= bucket, 1).otherwise(F.col("parts")))
    rows = rows.join(size.select("label", "dim", "bucket", "parts"), ["label", "dim", "bucket"])
    part = F.pmod(F.xxhash64("class_hash"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.xxhash64("label", "dim", "bucket", F.least("part", "other"), F.greatest("part", "other"))
    dealt = rows.select("class_hash", "bucket", "part", (F.col("part") != F.col("other")).alias("cross"), task.alias("task")).join(coded.select("class_hash", "rep", "copies", "own", "codes", "wide"), "class_hash").drop("class_hash")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = None

        def flush() -> pd.DataFrame:
            bucket_of, part, cross, ids, copies, own, codes, wide = zip(*held, strict=True)
            ids = np.array(ids)
            codes = np.stack(codes).reshape(len(held), -1, wide[0])
            return _rows(ids, *links_in_bucket(ids, _units(list(own)), np.array(copies), codes, np.array(part), cross[0], bucket_of[0], threshold))

        for batch in batches:
            for row in zip(batch["task"], batch["bucket"], batch["part"], batch["cross"], batch["rep"], batch["copies"], batch["own"], batch["codes"], batch["wide"], strict=True):
                if row[0] != at and held:
                    if len(held) > 1:
                        yield flush()
                    held = []
                at = row[0]
                held.append(row[1:])
        if len(held) > 1:
            yield flush()

    parts_n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts_n, "task").sortWithinPartitions("task").mapInPandas(find, "rep long, n long, to long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, bucket: int = BUCKET, group_bytes: int = GROUP_BYTES, tables: int | None = None, hashes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df (vec_id, embedding, label). tables, hashes: of labels dealt by bucket,
    instead of those that their size asks for."""
    stages = Stages(df.sparkSession, "crosspolytope")
    made = classes(df.select("vec_id", "embedding", "label"))
    reps = made.where(F.col("class_hash").isNotNull()).groupBy("class_hash").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("own").alias("own"))
    reps = stages.put(reps, "classes")
    sizes = stages.put(reps.groupBy("label", "dim").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") * (8 * F.col("dim") + EACH_BYTES) > group_bytes).select(F.col("label").alias("l"), F.col("dim").alias("d"))
    same = (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))
    linked = links_by_table(reps.join(large, same, "left_anti"), threshold)
    if not large.isEmpty():
        per_length = {r["d"]: r["n"] for r in sizes.groupBy(F.col("dim").alias("d")).agg(F.sum("n").alias("n")).collect()}  # a row for each length of vectors
        of = {d: (k := hashes or k0, tables or TABLES[k]) for d, (k0, _) in settings(per_length).items()}
        linked = linked.unionByName(links_by_bucket(reps.join(large, same, "left_semi"), stages, threshold, probes, bucket, of))
    linked = stages.put(linked, "links")
    counts = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(linked.select(F.col("rep").alias("a"), F.col("to").alias("b")), stages)
    stages.drop("coded", "sizes")
    result = reps.select("class_hash", "rep", "copies").join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    result = result.select("class_hash", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    every = made.select("vec_id", "class_hash")
    out = every.join(result, "class_hash", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    id_ = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return out.select(id_("vec_id"), "n_links", id_("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
