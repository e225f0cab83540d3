"""Language identification by multilingual mixture inference.

Every language has a smoothed distribution over hashed byte n-grams, learned from all
training documents. A document is a mixture: each of its words comes from one language,
with a likelihood that is the product over the word's n-grams. Expectation-maximisation
estimates the document's language shares; the set of its languages is the one with the
least penalised likelihood among the nested sets of the largest shares, and the
prediction is the largest share of that set.

Null texts and texts without a letter are ``und`` with score 0 and no languages, and so
is everything if there is nothing to learn from. Ties go to the language that sorts
first. Words are runs of ASCII letters, without regard to case, and bytes beyond ASCII.
Rows are judged one by one, so repeated rows get equal results; whole texts count, at any
length. An empty table gives an empty result, and columns but those asked for are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import U, bounded, byte_table, mixed, spans, split_words, text_bytes

#: n-grams are hashed to this many bins for each language.
BINS = 1 << 16
GRAM = 4
SMOOTHING = 0.5
#: A document's shares are found when no one of them moves by more than this; steps at most, should one never settle.
SETTLED, ITERATIONS = 1e-3, 500
#: Added to a language's word count before shares are taken.
PRIOR = 0.05
#: Distinct languages that a model may have: it is held whole by every worker.
MOST_LANGUAGES = 512
LETTERS = byte_table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[LETTERS] = np.arange(256, dtype=np.uint8)[LETTERS]
_FOLD[0x41:0x5B] += 32


def word_grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all n-grams, the first n-gram of each word, and the first word of each row (rows + 1 entries).

    A word of n bytes has n + 1 grams: the four bytes that end at each of its bytes and at the space after it, with spaces for what lies before the word.
    """
    data, offsets = text_bytes(column)
    starts, ends, bounds = split_words(data, offsets, LETTERS)
    sizes = ends - starts + 1
    first = np.append(0, np.cumsum(sizes))
    index = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    at = np.repeat(starts, sizes) + index
    folded = np.append(_FOLD[data], np.uint8(0x20))
    code = np.where(index < np.repeat(sizes - 1, sizes), folded[np.minimum(at, len(data))], np.uint8(0x20)).astype(np.uint64)
    for back in range(1, GRAM):
        before = np.where(index >= back, folded[at - back], np.uint8(0x20)).astype(np.uint64)
        code += before << U(8 * back)
    return (mixed(code) % U(BINS)).astype(np.int32), first[:-1], bounds


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def learn(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bin, from the text and the non-null lang of all rows given.

    Workers count whole partitions; what reaches the driver is at most BINS numbers a language.
    """
    bounded(documents.sparkSession)
    rows = documents.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in spans(batches, "text", 1 << 20):
            bins, first, bounds = word_grams(part.column("text"))
            per_row = np.append(first, len(bins))[bounds]
            codes = part.column("lang").dictionary_encode()
            owner = np.repeat(codes.indices.to_numpy(), np.diff(per_row)).astype(np.int64)
            names = codes.dictionary.to_pylist()
            table = np.bincount(owner * BINS + bins, minlength=len(names) * BINS).reshape(-1, BINS)
            for name, counts in zip(names, table, strict=True):
                sums[name] = sums[name] + counts if name in sums else counts
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bin", "n"])

    counted = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    found = counted.toArrow()
    totals = np.full((len(names), BINS), SMOOTHING)
    row = pc.index_in(found.column("lang"), pa.array(names, pa.string())).to_numpy()
    totals[row, found.column("bin").to_numpy()] += found.column("n").to_numpy()
    return names, np.log(totals / totals.sum(axis=1, keepdims=True)).T.astype(np.float32)


def _add_up(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between bounds, 0 for empty stretches."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def _expect(likelihood: np.ndarray, bounds: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected words of each language in each document, and the log-likelihood (less that of each word's best language)."""
    joint = likelihood * np.repeat(shares, np.diff(bounds), axis=0).astype(np.float32)
    total = joint.sum(axis=1)
    np.maximum(total, 1e-37, out=total)
    joint /= total[:, None]
    return _add_up(joint, bounds), _add_up(np.log(total), bounds)


def infer(bins: np.ndarray, first: np.ndarray, bounds: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: shares of the languages, and which of them are in its set."""
    langs, docs = model.shape[1], len(bounds) - 1
    words = np.diff(bounds)
    log = np.empty((len(first), langs), np.float32)
    for a in range(0, len(first), 1 << 16):
        b = min(len(first), a + (1 << 16))
        stop = first[b] if b < len(first) else len(bins)
        log[a:b] = np.add.reduceat(model[bins[first[a] : stop]], first[a:b] - first[a], axis=0)
    if len(log):
        log -= log.max(axis=1, keepdims=True)
    likelihood = np.exp(log)
    shares = np.full((docs, langs), 1 / langs)
    active, some, cut = np.arange(docs), likelihood, bounds
    for _ in range(ITERATIONS):
        expected, _ = _expect(some, cut, shares[active])
        now = (expected + PRIOR) / (words[active][:, None] + PRIOR * langs)
        moving = np.abs(now - shares[active]).max(axis=1, initial=0) > SETTLED
        shares[active] = now
        if not moving.any():
            break
        if not moving.all():  # those that have settled are done
            some = some[np.repeat(moving, np.diff(cut))]
            active = active[moving]
            cut = np.append(0, np.cumsum(words[active]))
    order = np.argsort(-shares, axis=1, kind="stable")
    chosen = np.zeros((docs, langs), bool)
    chosen[np.arange(docs), order[:, 0]] = True
    if langs > 1:
        # Where the second share is not to be told from the prior, there is one language.
        doubt = np.flatnonzero((words > 1) & (shares[np.arange(docs), order[:, 1]] * words > 0.5))
        if len(doubt):
            take = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in doubt])
            some, cut = likelihood[take], np.append(0, np.cumsum(words[doubt]))
            best = np.full(len(doubt), np.inf)
            for m in range(1, langs + 1):
                inside = np.zeros((len(doubt), langs), bool)
                np.put_along_axis(inside, order[doubt, :m], True, axis=1)
                own = np.where(inside, shares[doubt], 0)
                own /= own.sum(axis=1, keepdims=True)
                for _ in range(3 if m > 1 else 1):
                    expected, fit = _expect(some, cut, own)
                    own = expected / words[doubt][:, None]
                cost = -2 * fit + (m - 1) * 2 * np.log(words[doubt])
                less = cost < best
                best[less] = cost[less]
                chosen[doubt[less]] = inside[less]
                # A language more costs 2 log(words) and gains at most what is left of the misfit, which is never below 0.
                more = np.flatnonzero(2 * m * np.log(words[doubt]) < best)
                if not len(more):
                    break
                take = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in more])
                some, doubt, best = some[take], doubt[more], best[more]
                cut = np.append(0, np.cumsum(words[doubt]))
    return shares, chosen


def identify(documents: DataFrame, names: list[str], model: np.ndarray, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``carry`` columns, lang_pred, score (the share of lang_pred) and languages (the chosen set with shares)."""
    bounded(documents.sparkSession)
    rows = documents.select(*[F.col(c) for c in carry if c != "text"], F.col("text").cast("string").alias("text"))
    sent = documents.sparkSession.sparkContext.broadcast(model)  # BINS floats a language, at most MOST_LANGUAGES
    kept = [c for c in rows.columns if c in carry]

    def run(batches):
        for part in spans(batches, "text", 1 << 20):
            bins, first, bounds = word_grams(part.column("text"))
            shares, chosen = infer(bins, first, bounds, sent.value) if names else (np.zeros((part.num_rows, 0)),) * 2
            best = shares.argmax(axis=1) if names else []
            letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\pL"), False).to_pylist()
            pred, score, sets = [], [], []
            for i, ok in enumerate(letters):
                if not ok or not names or bounds[i] == bounds[i + 1]:
                    pred.append("und"), score.append(0.0), sets.append([])
                    continue
                pred.append(names[best[i]]), score.append(float(min(1.0, shares[i, best[i]])))
                sets.append([{"lang": names[j], "share": float(shares[i, j])} for j in np.flatnonzero(chosen[i])])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names=[*kept, "lang_pred", "score", "languages"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), *T._parse_datatype_string("lang_pred string, score double, languages array<struct<lang:string,share:double>>").fields]))
