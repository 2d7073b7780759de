"""Centroid clustering (Lloyd's rounds) in which nearest centroids are found by annulus search.

Centroids are sorted by their norms. A vector's distance to the centroid of nearest norm is an upper bound u of its least distance; a
centroid nearer than u, or as near, has a norm within u of the vector's (triangle inequality), so two binary searches in the sorted norms
give all candidates, the edges of the annulus included. Candidates are compared exactly, in integers; ties go to the smaller number.

A round is one job: each task searches its batches and gives a row a centroid, count and sums of its vectors; the rows are summed, and the
driver holds k sums, k being a parameter. The bound needs nothing from the round before, so no table of assignments is written between
rounds, and a lost executor costs its tasks. The integers are written once, in the shared folder.

Defined cases: a vector that is null, has another number of entries, or holds a null, a NaN or an infinity is left out; entries beyond
LARGEST in amount count as that, so that squared distances fit a long. With fewer vectors than centroids each is a centroid; vectors without an id
start a centroid only if others don't suffice, and among equal ids the one of lesser entries comes first. Equal rows stay apart; empty tables
give no rows; columns beyond vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

ENTRIES, SCALE, LARGEST = 64, 1024, 1 << 26
CENTROIDS, ROUNDS, SALT = 8, 10, "3"


def quantised(vectors: DataFrame, entries: int = ENTRIES, scale: int = SCALE) -> DataFrame:
    """vec_id, q (integers) of the vectors that are kept."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = vectors.where((F.size("embedding") == entries) & fine)
    limit = lambda v: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), v))
    return whole.select("vec_id", F.transform("embedding", lambda c: F.floor(limit(c.cast("double") * scale)).cast("int")).alias("q"))


class Annulus:
    """Centroids in the order of their norms, numbered as given."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, dtype=np.int64)
        norms = np.sqrt((c.astype(float) ** 2).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], c[self.number]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid."""
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        at = np.searchsorted(self.norms, norm)
        left, right = np.maximum(at - 1, 0), np.minimum(at, len(self.norms) - 1)
        pilot = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        best = ((q - self.centroids[pilot]) ** 2).sum(axis=1)
        number = self.number[pilot].copy()
        bound = np.sqrt(best.astype(float))
        slack = 1e-9 * (norm + bound + self.norms[-1] + 1)  # rounding of the norms; the comparison itself is exact
        low = np.searchsorted(self.norms, norm - bound - slack, side="left")
        high = np.searchsorted(self.norms, norm + bound + slack, side="right")
        for k in range(int(low.min(initial=len(self.norms))), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= k) & (k < high) & (pilot != k))
            d = ((q[rows] - self.centroids[k]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (self.number[k] < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = d[nearer], self.number[k]
        return number, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)


def _sums(table: DataFrame, centroids: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    """(number, vectors, sum of each entry) of each centroid that has any."""
    search, entries = Annulus(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), entries), np.int64)
        for b in batches:
            q = _matrix(b)
            number, _ = search.nearest(q)
            n += np.bincount(number, minlength=len(n))
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            s[own] += np.add.reduceat(q[order], first, axis=0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": own.tolist(), "n": n[own].tolist(), "s": s[own].tolist()}, schema=pa.schema([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    each = table.select("q").mapInArrow(run, "c int, n long, s array<long>").select("c", "n", F.posexplode("s").alias("k", "s"))
    cells = each.groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict = {}
    for r in cells.collect():  # k centroids' entries
        out.setdefault(r["c"], (r["n"], {}))[1][r["k"]] = int(r["s"])
    return [(c, n, [s[k] for k in range(entries)]) for c, (n, s) in sorted(out.items())]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each kept vector."""
    stages = Stages(vectors.sparkSession, "annulus")
    table = stages.put(quantised(vectors, entries, scale), "integers")
    start = table.select(F.sha2(F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string")), 256).alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k)
    centroids = [list(r["q"]) for r in start.collect()]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for c, n, s in _sums(table, centroids):
            centroids[c] = [v // n for v in s]
    search = Annulus(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, distance = search.nearest(_matrix(b))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = stages.put(table.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    stages.drop("integers")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    own = of([_long(inertia.get(c, 0)) for c in range(len(centroids))]).cast("long")
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(_long(sum(inertia.values()))).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"))


def _long(v: int) -> int | None:
    """None where it exceeds a long."""
    return v if v < 1 << 63 else None
