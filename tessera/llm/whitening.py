"""Embedding whitening by a tiled covariance.

Rows are cut into row blocks and their dimensions into column blocks. Each pair of column blocks is a tile key; a row block's column
blocks are shuffled to the tile keys that need them, the two of a tile are multiplied where they meet, products are summed per tile, first
within a task and then by key, and the sums are assembled to the covariance, whose eigenvectors whiten every row. No task holds more
than a batch of rows and the tiles it has met (together the covariance's half), and the driver holds the covariance alone: its size is
that of the vectors' length, squared.

Entries become integers, x = floor(64 c) + 1,000,000. Sums of x are exact, and x is centred before it is multiplied, without rounding of
the large mean: blocks carry x less an integer origin, from which the fraction of the mean is taken.

Defined cases: a vector that is null or holds a null, a NaN or an infinity is dropped; shorter vectors are filled up with zeros to the
longest; entries beyond LARGEST count as that. Components without variance (up to rounding) whiten to 0 and stay out of the identity
error. Where the deviation exceeds a long it is null. Equal ids and rows stay apart; empty tables, or vectors of no entries, give no rows;
columns beyond vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 31
#: Columns of a tile's side, rows of a row block, components returned.
TILE, BLOCK, COMPONENTS = 32, 8192, 32
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
Rows = Callable[[pa.RecordBatch], np.ndarray]


def usable(vectors: DataFrame) -> DataFrame:
    """Those that aren't null and hold neither nulls nor numbers that aren't finite."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.col("embedding").isNotNull()
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(fine, F.lit(False)))


def integers(width: int) -> Rows:
    """The batch's x, one row a vector, filled up to the width."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.asarray(lists.value_lengths())
        x = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + OFFSET
        if (size == width).all():
            return x.reshape(len(batch), width)
        out = np.full((len(batch), width), OFFSET, np.int64)
        out[np.arange(width) < size[:, None]] = x
        return out

    return of


def column_sums(vectors: DataFrame, rows: Rows, kind: str) -> tuple[int, list]:
    """(number of rows, sum of each column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            own = rows(b).sum(axis=0)
            n, total = n + len(b), own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [total.tolist()]}, schema=pa.schema([("n", pa.int64()), ("s", pa.list_(pa.int64() if kind == "long" else pa.float64()))]))

    each = vectors.mapInArrow(run, f"n long, s array<{kind}>").select("n", F.posexplode("s").alias("k", "s"))
    found = each.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()  # a row a dimension
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def _narrow(block: np.ndarray) -> np.ndarray:
    """Integers in the fewest bytes that hold them."""
    if block.dtype != np.int64:
        return block
    lo, hi = int(block.min(initial=0)), int(block.max(initial=0))
    return block.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def tiled_covariance(vectors: DataFrame, rows: Rows, n: int, origin: np.ndarray, rest: np.ndarray, tile: int = TILE, block: int = BLOCK) -> np.ndarray:
    """The covariance, divisor n, of columns whose means are origin + rest: origin, of the rows' own type, goes off before the shuffle and the rest after."""
    width = len(origin)
    parts = range(-(-width // tile))
    schema = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("kind", pa.string()), ("cells", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for b in batches:
            whole = rows(b) - origin
            for at in range(0, len(whole), block):
                cut = [_narrow(whole[at : at + block, k * tile : (k + 1) * tile]) for k in parts]
                yield pa.RecordBatch.from_pydict({"block": [first] * len(cut), "k": list(parts), "kind": [c.dtype.str for c in cut], "cells": [np.ascontiguousarray(c).tobytes() for c in cut]}, schema=schema)
                first += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for i, j, sides in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("sides").to_pylist(), strict=True):
                own = {s["k"]: np.frombuffer(s["cells"], s["kind"]).reshape(-1, min(tile, width - s["k"] * tile)) - rest[s["k"] * tile : (s["k"] + 1) * tile] for s in sides}
                product = own[i].T @ own[j]
                total[i, j] = total[i, j] + product if (i, j) in total else product
        if total:
            yield pa.RecordBatch.from_pydict({"i": [i for i, _ in total], "j": [j for _, j in total], "product": [p.ravel().tolist() for p in total.values()]}, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("product", pa.list_(pa.float64()))]))

    cut = vectors.mapInArrow(blocks, "block long, k int, kind string, cells binary")
    # a column block goes to each tile key that it is a side of
    other = F.explode(F.sequence(F.lit(0), F.lit(parts[-1]))).alias("other")
    keyed = cut.select("block", F.struct("k", "kind", "cells").alias("side"), other).select("block", F.least("side.k", "other").alias("i"), F.greatest("side.k", "other").alias("j"), "side")
    met = keyed.groupBy("block", "i", "j").agg(F.collect_list("side").alias("sides"))  # one or two
    tiles = met.select("i", "j", "sides").mapInArrow(multiply, "i int, j int, product array<double>")
    cells = tiles.select("i", "j", F.posexplode("product").alias("cell", "v")).groupBy("i", "j", "cell").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.collect():  # half a square of the vectors' length
        side = min(tile, width - r["j"] * tile)
        a, b = r["i"] * tile + r["cell"] // side, r["j"] * tile + r["cell"] % side
        out[a, b] = out[b, a] = r["v"] / n
    return out


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, each with its largest entry positive), so many at most."""
    e, v = np.linalg.eigh(covariance)
    order = np.argsort(-e, kind="stable")[:most]
    e, v = e[order], v[:, order]
    return e, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def squares(y: np.ndarray) -> list:
    """The exact sum of each row's squares; None beyond a long."""
    top = int(np.abs(y).max(initial=0))
    if top * top * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    exact = (sum(int(v) * int(v) for v in row) for row in y)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, most: int = COMPONENTS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable vector and component."""
    kept = usable(vectors)
    width = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not width:
        return vectors.sparkSession.createDataFrame([], RESULT)
    x = integers(width)
    n, total = column_sums(kept, x, "long")
    sums = np.array(total, dtype=np.int64)
    origin, rest = sums // n, (sums % n) / n
    covariance = tiled_covariance(kept, x, n, origin, rest, tile, block)
    e, axes = components(covariance, most)
    live = e > max(e[0], 0) * width * np.finfo(float).eps
    scaled = axes * np.where(live, 1 / np.sqrt(np.where(live, e, 1)), 0.0)

    def white(b: pa.RecordBatch) -> np.ndarray:
        return ((x(b) - origin) - rest) @ scaled

    _, again = column_sums(kept, white, "double")
    second = tiled_covariance(kept, white, n, np.zeros(len(e)), np.array(again) / n, tile, block)
    off = np.abs(second - np.eye(len(e)))[np.ix_(live, live)]
    error = float(off.max(initial=0.0))
    trace = float(np.trace(covariance))
    explained = (e / trace if trace > 0 else np.zeros(len(e))).tolist()
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, k = len(b), len(e)
            own = np.repeat(np.arange(m), k)
            deviation = pa.array(squares(n * x(b) - sums), pa.int64()).take(pa.array(own))
            columns = [b.column("vec_id").cast(pa.int64()).take(pa.array(own)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), deviation, white(b).ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return kept.mapInArrow(rows, RESULT)
