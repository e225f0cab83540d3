"""Quality by compression: how much better a text compresses with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are trained on samples of labelled documents. Every text is
cut into blocks, all of them compressed with both; the difference of the compressed
sizes is normalised by the size of the text (not by the compressed sizes, which are
next to nothing for text that repeats itself). An isotonic fit on labelled documents
that were not used for the dictionaries turns it into a probability.

Fitting uses at most SAMPLE labelled documents of each class, those with the smallest hash
of doc_id (ties: doc_id). One half of them gives the dictionaries, trained on the BLOCKS
blocks with the smallest hashes of all blocks of their whole texts; the other half gives
the curve, measured by the executors on whole texts. Scoring uses whole texts. Null and empty
texts score what the curve gives for no difference. Where one class has no labelled document,
every text scores the other class's share. Rows are scored one by one: repeated rows score
alike. Repeated labels and documents count as often as they pair. An empty table gives an
empty result; columns but the key and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, spans

#: Labelled documents of each class that are used for fitting, at most.
SAMPLE = 3000
#: Blocks of each class that a dictionary is trained on, at most.
BLOCKS = 16_384
DICTIONARY = 112 << 10
BLOCK = 512
LEVEL = 3


def blocks(text: bytes) -> list[bytes]:
    """The text in blocks of about BLOCK bytes, of nearly equal size."""
    n = -(-len(text) // BLOCK)
    return [text[i * len(text) // n : (i + 1) * len(text) // n] for i in range(n)]


class Compressor:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_dict_id=False).compress)

    def difference(self, text: bytes) -> float:
        """(bad - good) / size, of the compressed sizes and the text's own; 0 for an empty text."""
        good, bad = self.pair
        parts = blocks(text)
        if not parts:
            return 0.0
        g, b = sum(len(good(x)) for x in parts), sum(len(bad(x)) for x in parts)
        return (b - g) / len(text)


def _dictionary(parts: list[bytes]) -> bytes:
    size = max(256, min(DICTIONARY, sum(map(len, parts)) // 8))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes are the dictionary
        return b"".join(parts)[-size:] or b"\0" * 8


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression, by Newton's method with a light ridge."""
    scale = max(float(np.abs(x).max(initial=0)), 1e-6)
    data = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-data @ w))
        step = np.linalg.solve(data.T * (p * (1 - p) + 1e-9) @ data + np.diag([1e-2, 1e-9]), data.T @ (y - p) - np.array([1e-2, 0]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _steps(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Isotonic regression by pooling adjacent violators: mean x and share of y of each pool, rising in both."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([w[i] * x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    # Small pools are drawn to one half, which must not put them under the one before.
    return [a / n for a, _, n in pools], np.maximum.accumulate([(b + 0.5) / (n + 1) for _, b, n in pools]).tolist()


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """The steps of the isotonic fit, joined by lines; a twentieth of the logistic curve keeps the order within a step."""
    if "good" not in model:
        return np.full(len(x), model["share"])
    smooth = 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["level"], -500, 500)))
    return 0.95 * np.interp(x, *model["steps"]) + 0.05 * smooth


def _blocks(batches):
    for part in spans(batches, "text"):
        for label, h, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            cut = blocks(text)
            for a in range(0, len(cut), 4096):
                some = cut[a : a + 4096]
                keys = [xxhash.xxh3_64_intdigest(f"{h} {a + i}") - (1 << 63) for i in range(len(some))]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.int32()), pa.array(keys, pa.int64()), pa.array(some, pa.binary())], names=["quality", "h", "block"])


def _differences(good: bytes, bad: bytes):
    def run(batches):
        measure = Compressor(good, bad).difference
        for part in spans(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([measure(x) for x in part.column(2).to_pylist()], pa.float64())], names=["quality", "difference"])

    return run


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """A model from texts by doc_id and quality (0 or 1) by doc_id: two dictionaries and a curve.

    The labels choose the sample, at most 2 * SAMPLE ids, before any text is touched, and these are broadcast. The driver gets
    2 * BLOCKS blocks and one number a sampled document.
    """
    bounded(documents.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    first, second = (known.where(F.col("quality") == label).orderBy("h", "doc_id").limit(SAMPLE) for label in (0, 1))
    chosen = first.union(second)
    rows = documents.select("doc_id", F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    # Which half a document is in, another hash tells; a class of few has all of them in both.
    half = lambda n: rows.join(F.broadcast(chosen.where(F.pmod(F.xxhash64("h"), F.lit(2)) == n)), "doc_id").select("quality", "h", "text")
    every = rows.join(F.broadcast(chosen), "doc_id").select("quality", "h", "text")
    if not all(counts.get(k) for k in (0, 1)):
        return {"share": 1.0 if counts.get(1) else 0.0 if counts.get(0) else 0.5}

    def trained(source: DataFrame, label: int) -> list[bytes]:
        parts = source.mapInArrow(_blocks, "quality int, h long, block binary").where(F.col("quality") == label)
        return [bytes(r[0]) for r in parts.orderBy("h", "block").limit(BLOCKS).select("block").collect()]

    learned = {k: trained(half(0), k) or trained(every, k) for k in (0, 1)}
    good, bad = _dictionary(learned[1]), _dictionary(learned[0])
    measured = [tuple(r) for r in half(1).mapInArrow(_differences(good, bad), "quality int, difference double").collect()]
    if len({k for k, _ in measured}) < 2:
        measured = [tuple(r) for r in every.mapInArrow(_differences(good, bad), "quality int, difference double").collect()]
    n = {k: sum(1 for q, _ in measured if q == k) for k in (0, 1)}
    if not all(n.values()):  # labels without documents
        return {"share": 1.0 if n[1] else 0.0 if n[0] else 0.5}
    measured.sort()
    x, y = np.array([d for _, d in measured]), np.array([k for k, _ in measured], float)
    # Both classes are sampled alike up to SAMPLE; beyond, the curve is moved back to the labels' own balance.
    slope, level = _curve(x, y)
    level += np.log(counts[1] / counts[0]) - np.log(n[1] / n[0])
    weight = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
    return {"good": good, "bad": bad, "slope": slope, "level": float(level), "steps": _steps(x, y, weight * len(y) / weight.sum())}


def score(documents: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """Each row's key, difference (of compressed sizes) and score."""
    bounded(documents.sparkSession)
    rows = documents.select(F.col(key), F.col("text").cast("string").alias("text"))

    def run(batches):
        measure = Compressor(model["good"], model["bad"]).difference if "good" in model else None
        for part in spans(batches, "text"):
            texts = part.column("text").to_pylist()
            x = np.array([measure((t or "").encode()) if measure else 0.0 for t in texts])
            p = probability(model, x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x), pa.array(p)], names=[key, "difference", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())]))
