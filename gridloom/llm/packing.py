"""Packing of token ids into fixed-length rows by best-fit decreasing.

Documents are encoded (by the automaton of ``bpe``), cut without loss into pieces of at
most LENGTH tokens, and gathered in pools of POOL pieces as the scan delivers them. A
pool is packed on its own: pieces by falling length, each into the open row with the
least room that still holds it. A segment tree over capacities finds that row in
log2(LENGTH) steps. Packing is one narrow map without a shuffle; a lost task packs the
same pool again.

A packed row holds the ids as one row of the matrix (unsigned 16-bit little-endian where
the vocabulary allows, filled up with PAD), the cumulative lengths of its segments from 0
on, the positions at which a position counter starts again, and for each segment the
doc_id and the place in that document's ids.

Which pieces share a pool depends on how the scan deals rows to tasks; what is packed does
not, and rows are full to a pool's rest. Null and empty texts have no tokens and are in no
row. Rows with equal doc_id are packed each for itself. Pieces of one length are taken in the
order of the scan (ties). An empty table gives an empty result; columns but doc_id and text
are not read. A very long document is cut into pieces and fills pools of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPAN, tokenizer
from .shared import bounded, spans

LENGTH = 2048
PAD = 49407
#: Pieces packed together, at most, and tokens held for them.
POOL, POOL_TOKENS = 16_384, 8 << 20


class Capacities:
    """A segment tree over capacities 0..n that knows which of them an open row has left."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.base + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> int | None:
        """A row with the smallest capacity of ``least`` or more, taken out; None if there is none."""
        node = self.base + least
        count = self.count
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if count[2 * node] else 2 * node + 1
        row = self.rows[node - self.base].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of indices into ``sizes`` (each from 1 to length), in the order they were put in."""
    free, rows, room = Capacities(length), [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        row = free.take(sizes[i])
        if row is None:
            row = len(rows)
            rows.append([])
            room.append(length)
        rows[row].append(i)
        room[row] -= sizes[i]
        if room[row]:
            free.add(room[row], row)
    return rows


SCHEMA = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{key}>, doc_offsets array<long>"


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """Packed rows of all documents: pack_id, n_tokens (without padding), ids, cu_seqlens, position_resets, doc_ids and doc_offsets."""
    bounded(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def packed(pool, first: int, id_type):
        rows = best_fit_decreasing([len(p[2]) for p in pool], length)
        dtype = "<u2" if max(len(tokenizer(path).names), pad + 1) <= 1 << 16 else "<u4"
        matrix = np.full((len(rows), length), pad, dtype)
        cumulative = []
        for out, members in zip(matrix, rows, strict=True):
            at = [0]
            for i in members:
                out[at[-1] : at[-1] + len(pool[i][2])] = pool[i][2]
                at.append(at[-1] + len(pool[i][2]))
            cumulative.append(at)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(first, first + len(rows)), pa.int64()),
                pa.array([c[-1] for c in cumulative], pa.int32()),
                pa.array([m.tobytes() for m in matrix], pa.binary()),
                pa.array(cumulative, pa.list_(pa.int32())),
                pa.array([c[:-1] for c in cumulative], pa.list_(pa.int32())),
                pa.array([[pool[i][0] for i in members] for members in rows], pa.list_(id_type)),
                pa.array([[pool[i][1] for i in members] for members in rows], pa.list_(pa.int64())),
            ],
            names=["pack_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"],
        )

    def run(batches):
        own = tokenizer(path)
        first = TaskContext.get().partitionId() << 33
        pool, tokens, id_type = [], 0, None
        for part in spans(batches, "text", SPAN, "bpe"):
            id_type = part.schema.field(0).type
            flat, cuts = own.encode_column(part.column("text"))
            for doc_id, begin, end in zip(part.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids = flat[begin:end]
                for at in range(0, len(ids), length):
                    pool.append((doc_id, at, ids[at : at + length]))
                    tokens += min(length, len(ids) - at)
                    if len(pool) >= POOL or tokens >= POOL_TOKENS:
                        out = packed(pool, first, id_type)
                        first += out.num_rows
                        pool, tokens = [], 0
                        yield out
        if pool:
            yield packed(pool, first, id_type)

    return rows.mapInArrow(run, SCHEMA.format(key=kind))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files: one row of the id matrix, its lengths and resets each."""
    packed.write.mode("overwrite").parquet(path)


def read_back(packed: DataFrame) -> DataFrame:
    """The pieces of all documents (of 16-bit ids): doc_id, doc_offset and ids."""
    piece = F.explode(F.arrays_zip("doc_ids", "doc_offsets", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("begin"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("end"))).alias("p")
    return packed.select("ids", piece).select(F.col("p.doc_ids").alias("doc_id"), F.col("p.doc_offsets").alias("doc_offset"), F.expr("substring(ids, 2 * p.begin + 1, 2 * (p.end - p.begin))").alias("ids"))
