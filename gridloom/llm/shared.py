"""Pieces the operators share: reading tables, cutting lineage, Arrow batches, vectorised word hashing.

Words are found and hashed for a whole Arrow batch at once, straight from the
UTF-8 bytes: a 256-entry table says which bytes belong to words, prefix sums of
a polynomial give every word's 64-bit hash, and no Python object is made per word.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes that are hashed at once; longer inputs are hashed piece by piece.
PIECE = 1 << 21
#: Bytes of an Arrow batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or where all run in one process one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors. ``codec`` is Parquet's, the session's if not given."""
    return _written(df, name, codec)[0]


def _written(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


class Workspace:
    """Tables written on the way to a result, removed when that is written too."""

    def __init__(self):
        self.paths: list[str] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _written(df, name)
        self.paths.append(path)
        return table

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the result, then removes all else."""
        out = materialize(df, name)
        for path in self.paths:
            discard(df.sparkSession, path)
        self.paths.clear()
        return out


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table; after the session has ended there is nothing left to ask."""
    if spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot if it has more than one in HOT of all rows; so there are fewer than HOT of them. A hot key is dealt to SALTS tasks.
HOT, SALTS = 1000, 32


def hot_keys(rows: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys that more than one in HOT of all rows have: fewer than HOT numbers, whatever the table holds."""
    least = rows.count() // HOT + 1
    return [r[0] for r in rows.groupBy(F.xxhash64(*keys).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("key").collect()]


def salt(keys: list[str], hot: list[int], deal: str | None = None) -> Column:
    """Of a row with a hot key one of SALTS numbers, by the column ``deal``, or all of them in an array; 0 for other keys."""
    own = F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int") if deal else F.sequence(F.lit(0), F.lit(SALTS - 1))
    return F.when(F.xxhash64(*keys).isin(hot), own).otherwise(F.lit(0) if deal else F.array(F.lit(0)))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], deal: str, counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Joins rows to a table with one row a key; rows of hot keys are dealt to several tasks by the column ``deal``.

    ``counted`` holds the keys of ``many`` where that is dearer to read. A merge join at every size, so that what is shuffled grows as the input does.
    """
    hot = hot_keys(many if counted is None else counted, keys)
    if not hot:
        return many.join(one.hint("merge"), keys, how)
    left, right = many.withColumn("_salt", salt(keys, hot, deal)), one.withColumn("_salt", F.explode(salt(keys, hot)))
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def byte_table(separators) -> np.ndarray:
    """True for the bytes that belong to words."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Words are runs of anything but space and the control characters 9 to 13.
PLAIN = byte_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, U(_BASE), np.uint64)
        down = np.full(size, U(pow(_BASE, -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def split_words(data: np.ndarray, offsets: np.ndarray, words: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (rows + 1 entries)."""
    inside = words[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        piece = data[lo:hi]
        up, down = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((LOWER[piece] if lower else piece).astype(np.uint64) * up[: hi - lo] + up[: hi - lo], out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = (sums[e] - sums[s]) * down[s]
        at = stop
    return mixed(out + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def rolling(hashes: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of every k consecutive entries; it is up to the caller to leave out those that cross rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(seed | 1)
        out += hashes[j : j + n]
    return mixed(out ^ U(seed))


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For items dealt to rows by ``bounds`` (rows + 1 entries): the row of each."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


#: What operators keep in a Python worker between tasks: a name, and how to let go of it.
KEEPERS: dict[str, Callable[[], None]] = {}


def release(keeper: str | None = None) -> None:
    """Workers are used by one operator after the other: lets go of what all but ``keeper`` have kept."""
    for name in [n for n in KEEPERS if n != keeper]:
        KEEPERS.pop(name)()
        gc.collect()


def spans(batches, column: str, most: int = PIECE, keeper: str | None = None):
    """The rows of Arrow batches, dealt anew: parts with about ``most`` bytes in a text column, one row at least."""
    release(keeper)
    waiting, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, before + most - held, "right"))
            if stop == batch.num_rows and held + int(ends[-1]) - before < most:
                waiting.append(batch.slice(at))
                held += int(ends[-1]) - before
                break
            stop = max(stop, at + (not waiting))
            if stop > at:
                waiting.append(batch.slice(at, stop - at))
            yield _one(waiting)
            waiting, held, at = [], 0, stop
    if waiting:
        yield _one(waiting)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def bounded(spark: SparkSession) -> None:
    """Lets Arrow batches end at BATCH_BYTES: by default they end at 10,000 rows, whatever these hold."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", spark.conf.get(key, "2147483647"))[0]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slots(spark: SparkSession) -> int:
    """Partitions to deal work to: as many as the session shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, by the installed package or its folder."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)
