"""Pairwise distances between rows of two sets of vectors.

The result has a row for every pair, so its size is the product of the two; that is what
is asked for. Rows are grouped in blocks, blocks are dealt to a grid of tasks, and a block
pair is one NumPy call, made of differences and not of dot products, so that near-equal
vectors don't cancel. Within one set a run of distances is followed by the same run with the
sides swapped, near enough for the codec of a Parquet file to keep it once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "manhattan", "chebyshev")
#: Vectors of a block on either side.
BLOCK = 256
#: Pairs of a task, where that makes more tasks than TASKS for each core.
PAIRS = 8_000_000
TASKS = 4
#: Distances in a row before they come again with the sides swapped. Snappy misses most of what is repeated after longer runs, and shorter ones take more for the ids.
RUN = 32


def block_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of x to all rows of y."""
    if x.shape[1] != y.shape[1]:
        raise ValueError("the vectors differ in dimension")
    if metric == "cosine":
        a, b = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out = 1 - (x @ y.T) / (a[:, None] * b[None])
        none = (a == 0)[:, None] | (b == 0)[None]
        both = (a == 0)[:, None] & (b == 0)[None]
        return np.where(both, 0.0, np.where(none, 1.0, out))
    # Entries are added in their order, as SQL does it, for all of y at once.
    entries, out = np.ascontiguousarray(y.T), np.empty((len(x), len(y)))
    away = np.empty_like(entries)
    for i, row in enumerate(x):
        np.subtract(entries, row[:, None], out=away)
        if metric == "euclidean":
            out[i] = np.sqrt(np.multiply(away, away, out=away).sum(0))
        else:
            np.abs(away, out=away)
            out[i] = away.sum(0) if metric == "manhattan" else away.max(0, initial=0)
    return out


def _round(d: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as DuckDB's round() does it. No minus zeros."""
    with np.errstate(over="ignore", invalid="ignore"):  # infinite numbers stay as they are
        scaled = d * 10.0**digits
        whole = np.trunc(scaled)
        out = (whole + np.copysign(np.abs(scaled - whole) >= 0.5, scaled)) / 10.0**digits
    return np.where(np.isfinite(out), out, d) + 0.0


def distance(a: DataFrame, b: DataFrame | None = None, *, id: str, vector: str, metric: str = "euclidean", digits: int | None = None) -> DataFrame:
    """All pairs (id_a, id_b, distance). Without ``b`` pairs within ``a``, of which the diagonal is 0 and one triangle is computed. Null entries of vectors count as 0. With ``digits`` distances are rounded, a block at once: Spark's round takes a BigDecimal a row."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}: there are {', '.join(METRICS)}")
    own = b is None
    b = a if own else b
    clean = F.transform(F.col(vector).cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))

    size_a = a.count()
    size_b = size_a if own else b.count()
    blocks_a, blocks_b = (max(1, -(-n // BLOCK)) for n in (size_a, size_b))
    # The grid of tasks: as square as the blocks allow.
    tasks = max(TASKS * a.sparkSession.sparkContext.defaultParallelism, -(-size_a * size_b // PAIRS))
    parts_b = min(blocks_b, max(math.isqrt(tasks - 1) + 1, -(-tasks // blocks_a)))
    parts_a = min(blocks_a, -(-tasks // parts_b))

    def blocks(df: DataFrame, side: str, n: int, parts: int) -> DataFrame:
        # Blocks of ids that hash alike, about BLOCK vectors each.
        rows = df.select(F.pmod(F.xxhash64(id), F.lit(n)).alias(f"block_{side}"), F.struct(F.col(id).alias("id"), clean.alias("v")).alias("row"))
        return rows.repartition(parts, f"block_{side}").groupBy(f"block_{side}").agg(F.collect_list("row").alias(f"rows_{side}")).coalesce(parts)

    # Not broadcast: a side has few partitions, and without the grid they would be all tasks.
    pairs = blocks(a, "a", blocks_a, parts_a).hint("shuffle_replicate_nl").crossJoin(blocks(b, "b", blocks_b, parts_b))
    if own:
        pairs = pairs.where("block_a <= block_b")
    kind = dict(a.dtypes)[id]
    kind_b = dict(b.dtypes)[id]

    def measure(batches):
        for batch in batches:
            yield from _measured(batch, metric, own, digits)

    return pairs.mapInArrow(measure, f"id_a {kind}, id_b {kind_b}, distance double")


def _measured(batch: pa.RecordBatch, metric: str, own: bool, digits: int | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of each block pair, both ways round if the blocks are of one set."""

    def measured(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = block_distances(x, y, metric)
        return d if digits is None else _round(d, digits)

    for ra, rb, ka, kb in zip(batch.column("rows_a"), batch.column("rows_b"), batch.column("block_a").to_pylist(), batch.column("block_b").to_pylist(), strict=True):
        ia, x = _block(ra.values)
        if own and ka == kb:  # not rb: the same rows, which may have come in another order
            d = measured(x, x)
            np.fill_diagonal(d, 0.0)
            yield _rows(ia, ia, d)
        else:
            ib, y = _block(rb.values)
            yield (_both_ways if own else _rows)(ia, ib, measured(x, y))


def _block(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Ids and the matrix of a block's vectors, without an object a number."""
    ids, vectors = pc.struct_field(rows, "id"), pc.struct_field(rows, "v")
    sizes = vectors.value_lengths()
    if sizes.null_count or len(pc.unique(sizes)) > 1:
        raise ValueError("the vectors differ in dimension")
    return ids, vectors.flatten().to_numpy().reshape(len(rows), sizes[0].as_py())


def _rows(a: pa.Array, b: pa.Array, d: np.ndarray) -> pa.RecordBatch:
    i, j = np.divmod(np.arange(d.size), max(1, len(b)))
    return pa.RecordBatch.from_arrays([a.take(pa.array(i)), b.take(pa.array(j)), pa.array(d.ravel())], names=["id_a", "id_b", "distance"])


def _both_ways(a: pa.Array, b: pa.Array, d: np.ndarray) -> pa.RecordBatch:
    """Distances from one of a to a run of b, and right after them the same from that run to the one."""
    runs = np.split(np.arange(len(b)), range(RUN, len(b), RUN))
    at = np.concatenate([np.tile(run, 2) for run in runs])
    turned = np.concatenate([np.repeat([False, True], len(run)) for run in runs])
    i, j = np.arange(len(a))[:, None], len(a) + at
    ids = pa.concat_arrays([a, b])
    first, second = (ids.take(pa.array(np.where(turned, *sides).ravel())) for sides in ((j, i), (i, j)))
    return pa.RecordBatch.from_arrays([first, second, pa.array(d[:, at].ravel())], names=["id_a", "id_b", "distance"])
