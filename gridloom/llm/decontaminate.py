"""Benchmark decontamination by winnowing.

A window is 13 consecutive words. Of the 7-word grams inside a window the one with
the smallest hash is its fingerprint, so any two equal windows have the same
fingerprint at the same place: joining the fingerprints of training and benchmark
texts finds every shared span of 13 words or more. A hit is then extended: each
document carries, beside a fingerprint, two 64-bit hashes of every window around it,
and those equal to a benchmark window at the same offset are matches. Benchmark
items of fewer words are one window each, fingerprinted whole.

A bitmap of fixed size, made of the benchmark's fingerprints, goes to the executors
and holds back document fingerprints that can't match before they are shuffled. It
only saves work: a full bitmap lets everything through and the join decides.

Null and empty texts have no words: n_words 0, not contaminated. Items without words
match nothing. Repeated rows of the benchmark count once per item_id; an item without an
item_id counts for n_hit and is in no list. Every row of the documents has a row of its own
in the result, whether others have its doc_id (or none) and text or not. Very long texts are
read piece by piece of the batch they come in, whole all the same. An empty benchmark hits
nothing, an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, U, bounded, hash_words, materialize, mixed, rolling, salted_join, spans, split_words, text_bytes

WINDOW = 13
GRAM = 7
#: The bitmap is this many bytes, whatever the size of the benchmark.
BITMAP = 1 << 21
_SECOND = 0x5851F42D4C957F2D

_HITS = "array<struct<fp:bigint,wins:array<struct<o:int,at:int,h1:bigint,h2:bigint>>>>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of w grams the index of the leftmost smallest."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        less = grams[j : j + n] < best
        at[less] = np.flatnonzero(less) + j
        np.copyto(best, grams[j : j + n], where=less)
    return at


def windows_of(hashes: np.ndarray, bounds: np.ndarray, length: int, gram: int | None = None):
    """Windows of ``length`` words that lie in one text: row, start, fingerprint, its offset, and two hashes of the whole window."""
    n = len(hashes) - length + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty, empty.view(np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(row[:n] == row[length - 1 :])
    whole = rolling(hashes, length)
    if gram is None:
        return row[starts], starts, whole[starts], np.zeros(len(starts), np.int64), whole
    grams = rolling(hashes, gram, 0x9FB21C651E98DF25)
    at = window_minima(grams, length - gram + 1)[starts]
    return row[starts], starts, grams[at], at - starts, whole


def _item_windows(batches):
    for part in spans(batches, "text"):
        data, offsets = text_bytes(part.column("text"))
        starts, ends, bounds = split_words(data, offsets, ALNUM)
        hashes = hash_words(data, starts, ends, lower=True)
        second = mixed(hashes ^ U(_SECOND))
        counts = np.diff(bounds)
        out = [[] for _ in range(6)]
        for length in [WINDOW, *np.unique(counts[(counts > 0) & (counts < WINDOW)]).tolist()]:
            row, at, fp, o, whole = windows_of(hashes, bounds, length, GRAM if length == WINDOW else None)
            keep = counts[row] >= WINDOW if length == WINDOW else counts[row] == length
            row, at, fp, o = row[keep], at[keep], fp[keep], o[keep]
            other = rolling(second, length, _SECOND)
            for column, values in zip(out, (row, np.full(len(row), length), _signed(fp), o, _signed(whole[at]), _signed(other[at])), strict=True):
                column.append(values)
        row, length, fp, o, h1, h2 = (np.concatenate(x) for x in out)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(x) for x in (length.astype(np.int32), fp, o.astype(np.int32), h1, h2))], names=["item_id", "length", "fp", "o", "h1", "h2"])


def _bitmap(windows: DataFrame) -> bytes:
    """One bit for each fingerprint of the benchmark, built by the executors and joined there: BITMAP bytes reach the driver."""

    def paint(batches):
        bits = np.zeros(BITMAP * 8, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) % U(BITMAP * 8)] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    parts = windows.select("fp").mapInArrow(paint, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BITMAP // 8, np.int64)
    words[parts.column("at").to_numpy()] = parts.column("bits").to_numpy()
    return words.tobytes()


def _document_hits(bitmap, lengths: list[int], key: str):
    def run(batches):
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
        number = TaskContext.get().partitionId() << 40
        for part in spans(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, bounds = split_words(data, offsets, ALNUM)
            hashes = hash_words(data, starts, ends, lower=True)
            second = None
            out = [[] for _ in range(6)]
            for length in [WINDOW, *lengths]:
                row, at, fp, o, whole = windows_of(hashes, bounds, length, GRAM if length == WINDOW else None)
                keep = np.flatnonzero(bits[fp % U(len(bits))])
                if len(keep):
                    row, at, fp, o = row[keep], at[keep], fp[keep], o[keep]
                    second = mixed(hashes ^ U(_SECOND)) if second is None else second
                    other = rolling(second, length, _SECOND)
                    for column, values in zip(out, (row, at - bounds[row] + o, o, _signed(fp), _signed(whole[at]), _signed(other[at])), strict=True):
                        column.append(values)
            if out[0]:
                row, place, o, fp, h1, h2 = (np.concatenate(x) for x in out)
                order = np.lexsort((o, fp, place, row))
                row, place, o, fp, h1, h2 = (x[order] for x in (row, place, o, fp, h1, h2))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (fp[1:] != fp[:-1])
                first = np.flatnonzero(new)
            else:
                row = place = o = fp = h1 = h2 = first = np.zeros(0, np.int64)
            wins = pa.StructArray.from_arrays([pa.array(o.astype(np.int32)), pa.array((place - o).astype(np.int32)), pa.array(h1), pa.array(h2)], names=["o", "at", "h1", "h2"])
            per_hit = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), wins)
            hit = pa.StructArray.from_arrays([pa.array(fp[first]), per_hit], names=["fp", "wins"])
            per_row = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(part.num_rows + 1)).astype(np.int32)), hit)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + part.num_rows)), part.column(0), pa.array(np.diff(bounds)), per_row], names=["row", key, "n_words", "hits"])
            number += part.num_rows

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside benchmark windows), items (the item_ids as sorted strings) and contaminated.

    Shuffles only the fingerprints that the bitmap lets through, and one small row per document.
    """
    spark = docs.sparkSession
    bounded(spark)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    id_type = items.schema["item_id"].dataType.simpleString()
    windows = materialize(items.mapInArrow(_item_windows, f"item_id {id_type}, length int, fp long, o int, h1 long, h2 long"), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())  # at most 12
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))
    same = windows.groupBy("fp", "length", "o", "h1", "h2").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    tests = same.groupBy("fp").agg(F.collect_list(F.struct("length", "o", "h1", "h2", "items")).alias("tests"))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    # Rows are numbered and written: the numbers must not change if a part of the job runs again.
    found = materialize(rows.mapInArrow(_document_hits(bitmap, lengths, "doc_id"), f"row long, doc_id {doc_type}, n_words long, hits {_HITS}"), "document-hits")
    hits = found.where(F.size("hits") > 0).select("row", "doc_id", "n_words", F.explode("hits").alias("hit")).select("row", "doc_id", "n_words", "hit.fp", "hit.wins")
    joined = salted_join(hits, tests, ["fp"], "row", how="left").select(
        "row",
        "doc_id",
        "n_words",
        F.expr("""flatten(transform(wins, w -> transform(
            filter(coalesce(tests, array()), t -> t.o = w.o and t.h1 = w.h1 and t.h2 = w.h2),
            t -> struct(w.at as at, w.at + t.length as upto, t.items as items))))""").alias("matches"),
    )
    per_row = joined.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    covered = F.expr("""aggregate(array_sort(array_distinct(transform(matches, m -> struct(m.at as at, m.upto as upto)))),
        struct(0L as n, 0 as upto),
        (s, m) -> struct(s.n + greatest(0, m.upto - greatest(m.at, s.upto)) as n, greatest(s.upto, m.upto) as upto),
        s -> s.n)""")
    hit = per_row.select("doc_id", "n_words", covered.alias("n_hit"), F.expr("array_sort(array_distinct(flatten(transform(matches, m -> m.items))))").alias("items"))
    out = found.where(F.size("hits") == 0).select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items")).union(hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
