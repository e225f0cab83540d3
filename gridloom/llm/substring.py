"""Exact substring deduplication over a De Bruijn graph of word k-mers.

Every run of K words of a document is an edge of the graph, from its first K-1 words
to its last K-1. An edge is repeated if it also starts in a document with a smaller
doc_id; consecutive repeated edges of a document form a path without a branch and are
compacted to one span, given in word positions of the source, which is cut out.

Documents are dealt to chunks of neighbouring doc_ids, a few MB each at every size of the
corpus. A chunk sends each of its different edges once, as sorted 64-bit hashes, to the
bucket of the hash; a join of all chunks within the bucket tells every chunk but the first
to hold an edge that the edge is repeated, and which chunk held it last before. The words of
each run of edges from one chunk are sent to that chunk, each different run once a chunk. There the run
is compacted to paths along which it and the source go on together: a path ends at a node
from which the two have different edges, a branch. Every path is compared with the words at
its source coordinates, and where these differ word by word, edge by edge: equal hashes
alone make no repeat. The same is done for edges that are repeated inside a chunk. So a
passage in a third of all documents costs no more than one entry a chunk, no pair of
documents is ever formed, and what a task holds is bounded by the chunk.

Words are runs of anything but space and the control characters 9 to 13; null and
empty texts have none and come out as empty text. Texts shorter than K words are never
cut, very long ones are a chunk of their own. Rows that share a doc_id don't count as each
other's source, whatever they hold, and lie in one chunk; each has its own row in the result.
An empty table gives an empty result; columns but doc_id and text are not read. Should an
edge have the hash of another one in the chunk that held the hash last, it is kept.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import PLAIN, U, bounded, hash_words, release, rolling, row_of, spans, split_words, text_bytes

K = 13
#: Text in a chunk, about, and text of which the edges meet in one bucket.
CHUNK_BYTES = BUCKET_BYTES = 4 << 20
#: Ends between chunks that are looked for; beyond that many chunks each range between two ends is split evenly.
ENDS = 1 << 14
#: Words of source texts that are held split, about.
MOST_WORDS = 1 << 20
#: Stands for a missing doc_id while chunks are made.
NO_ID = -(1 << 63)


def chunk_of(ids: np.ndarray, ends: np.ndarray, split: int) -> np.ndarray:
    """Chunks of doc_ids, rising as these do: ranges between ``ends``, each in ``split`` parts of equal width."""
    at = np.searchsorted(ends, ids, "left")
    if split == 1 or len(ends) < 2:
        return at.astype(np.int32)
    low, high = ends[np.maximum(at - 1, 0)].astype(np.float64), ends[np.minimum(at, len(ends) - 1)].astype(np.float64)
    width = np.where(high > low, high - low, (float(ends[-1]) - float(ends[0])) / (len(ends) - 1))
    low = np.where(at == 0, ends[0] - width, low)
    part = np.clip(np.floor((ids.astype(np.float64) - low) / np.maximum(width, 1) * split), 0, split - 1)
    return (at * split + part).astype(np.int32)


def _deal(ends: np.ndarray, split: int):
    """Rows as (chunk, doc_id, compressed text)."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in spans(batches, "text"):
            chunk = chunk_of(part.column(0).to_numpy(zero_copy_only=False), ends, split)
            packed = [pack((x or "").encode()) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(chunk), part.column(0), pa.array(packed, pa.binary()), *part.columns[2:]], names=["chunk", "doc_id", "packed", *part.schema.names[2:]])

    return run


class Chunk:
    """The documents of a chunk in ascending doc_id (``order`` tells their rows), and their edges."""

    def __init__(self, table: pa.Table, k: int):
        release()
        ids = table.column("doc_id").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        unpack = zstandard.ZstdDecompressor().decompress
        packed = table.column("packed").to_pylist()
        self._fill(ids[order], [unpack(packed[i]) for i in order], k)
        self.order = order

    @classmethod
    def of(cls, ids: np.ndarray, texts: list[bytes], k: int) -> "Chunk":
        out = cls.__new__(cls)
        out._fill(ids, texts, k)
        return out

    def _fill(self, ids: np.ndarray, texts: list[bytes], k: int) -> None:
        self.ids, self.texts, self.k = ids, texts, k
        data, offsets = text_bytes(pa.array(texts, pa.large_binary()))
        starts, ends, self.bounds = split_words(data, offsets, PLAIN)
        words = hash_words(data, starts, ends)
        row = row_of(self.bounds)
        n = max(0, len(words) - k + 1)
        #: Where an edge starts, among all words of the chunk, and in which document.
        self.at = np.flatnonzero(row[:n] == row[k - 1 :]) if n else np.zeros(0, np.int64)
        self.row = row[self.at]
        self.edges = rolling(words, k)[self.at] if n else np.zeros(0, np.uint64)


def _pack(edges: np.ndarray) -> bytes:
    """Sorted hashes as 6-byte differences, or whole where one doesn't fit."""
    steps = np.diff(edges, prepend=U(0))
    if (steps[1:] >> U(48)).any():
        return b"\1" + edges.tobytes()
    return b"\0" + edges[:1].tobytes() + np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    if blob[0] == 1:
        return np.frombuffer(blob, np.uint64, n, 1)
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    steps[1:, :6] = np.frombuffer(blob, np.uint8, 6 * (n - 1), 9).reshape(-1, 6)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


_EDGES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("edges", pa.binary())])
_REPEATED = pa.schema([("chunk", pa.int32()), ("edges", pa.binary()), ("owners", pa.binary())])
_ASKED = pa.schema([("chunk", pa.int32()), ("asker", pa.int32()), ("runs", pa.binary())])
_ANSWERED = pa.schema([("chunk", pa.int32()), ("owner", pa.int32()), ("held", pa.binary())])


def _send_edges(buckets: int, k: int):
    def run(key, table):
        own = Chunk(table, k)
        edges = np.unique(own.edges)
        bucket = ((edges >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        full, cuts = np.unique(bucket, return_index=True)
        cuts = np.append(cuts, len(edges))
        blobs = [_pack(edges[a:b]) for a, b in itertools.pairwise(cuts.tolist())]
        return pa.Table.from_arrays([pa.array(full.astype(np.int32)), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array(np.diff(cuts).astype(np.int32)), pa.array(blobs, pa.binary())], schema=_EDGES)

    return run


def _join_edges(key, table):
    """Of one bucket: for every chunk, the edges that a chunk before it holds too, and the last such chunk.

    The last and not the first: so a passage that all chunks have makes each of them ask another one, and none is asked by all.
    """
    chunk = table.column("chunk").combine_chunks().to_numpy()
    order = np.argsort(chunk, kind="stable")
    sizes, blobs = table.column("n").to_pylist(), table.column("edges").to_pylist()
    edges = np.concatenate([_unpack(blobs[i], sizes[i]) for i in order])
    holder = np.repeat(chunk[order], [sizes[i] for i in order])
    by = np.argsort(edges, kind="stable")
    edges, holder = edges[by], holder[by]
    new = np.ones(len(edges), bool)
    new[1:] = edges[1:] != edges[:-1]
    again = np.flatnonzero(~new)
    edges, holder, source = edges[again], holder[again], holder[again - 1]
    by = np.argsort(holder, kind="stable")
    edges, holder, source = edges[by], holder[by], source[by]
    chunks, cuts = np.unique(holder, return_index=True)
    cuts = [*cuts.tolist(), len(holder)]
    parts = [(edges[a:b].tobytes(), source[a:b].tobytes()) for a, b in itertools.pairwise(cuts)]
    return pa.Table.from_arrays([pa.array(chunks, pa.int32()), *(pa.array([p[n] for p in parts], pa.binary()) for n in (0, 1))], schema=_REPEATED)


class Runs:
    """The runs of consecutive edges of a chunk that one earlier chunk holds, and the words that are sent to it: each different run once."""

    def __init__(self, own: Chunk, repeated: pa.Table):
        edges = np.frombuffer(b"".join(repeated.column("edges").to_pylist()), np.uint64)
        owners = np.frombuffer(b"".join(repeated.column("owners").to_pylist()), np.int32)
        order = np.argsort(edges)
        edges, owners = edges[order], owners[order]
        #: The chunk that each edge is repeated from, or -1.
        owner = np.full(len(own.edges), -1, np.int32)
        if len(edges) and len(own.edges):
            at = np.minimum(np.searchsorted(edges, own.edges), len(edges) - 1)
            owner = np.where(edges[at] == own.edges, owners[at], np.int32(-1))
        held = owner >= 0
        goes_on = np.zeros(len(held), bool)
        goes_on[1:] = held[1:] & (owner[1:] == owner[:-1]) & (own.at[1:] == own.at[:-1] + 1) & (own.row[1:] == own.row[:-1])
        begins = np.flatnonzero(held & ~goes_on)
        ends = np.flatnonzero(held & ~np.append(goes_on[1:], False)) + 1 if len(held) else begins
        #: By owner: the words of the different runs, in the order of their first occurrence.
        self.asked: dict[int, dict[bytes, int]] = {}
        #: First edge, end, owner and place among its owner's runs, of every run.
        self.all: list[tuple[int, int, int, int]] = []
        words, last = [], -1
        for begin, end, row, o in zip(begins.tolist(), ends.tolist(), own.row[begins].tolist(), owner[begins].tolist(), strict=True):
            if row != last:
                words, last = own.texts[row].split(), row
            at = int(own.at[begin] - own.bounds[row])
            runs = self.asked.setdefault(o, {})
            self.all.append((begin, end, o, runs.setdefault(b" ".join(words[at : at + end - begin + own.k - 1]), len(runs))))


def _ask(k: int):
    """Of every chunk: the runs that it sends to the chunks that hold their edges."""

    def run(key, docs, repeated):
        if not docs.num_rows or not repeated.num_rows:
            return _ASKED.empty_table()
        pack = zstandard.ZstdCompressor(level=1).compress
        asked = Runs(Chunk(docs, k), repeated).asked
        return pa.Table.from_arrays([pa.array(list(asked), pa.int32()), pa.array([key[0].as_py()] * len(asked), pa.int32()), pa.array([pack(b"\n".join(runs)) for runs in asked.values()], pa.binary())], schema=_ASKED)

    return run


def same_words(row: np.ndarray, at: np.ndarray, texts: list[bytes], source_row: np.ndarray, source_at: np.ndarray, sources: list[bytes], k: int) -> np.ndarray:
    """Which edges (given by text and place of their first word there) have the very words of their sources.

    Edges that go on together on both sides are one path, of which the words are compared as a whole; where they differ, each edge by itself.
    """
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    on = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (source_row[1:] == source_row[:-1]) & (source_at[1:] == source_at[:-1] + 1)
    begins = np.flatnonzero(np.append(True, ~on))
    split: dict[int, list[bytes]] = {}
    room = MOST_WORDS
    words, last = [], -1
    for begin, end in itertools.pairwise([*begins.tolist(), len(at)]):
        if row[begin] != last:
            last = int(row[begin])
            words = texts[last].split()
        r = int(source_row[begin])
        source = split.get(r)
        if source is None:
            source = sources[r].split()
            if len(source) > room:
                split.clear()
                room = MOST_WORDS
            room -= len(source)
            split[r] = source
        a, b, n = int(at[begin]), int(source_at[begin]), end - begin
        if words[a : a + n + k - 1] == source[b : b + n + k - 1]:
            out[begin:end] = True
        else:
            out[begin:end] = [words[a + i : a + i + k] == source[b + i : b + i + k] for i in range(n)]
    return out


def _answer(k: int):
    """Of every chunk that is asked: one bit for each edge of each run, whether the chunk has its words."""

    def run(key, docs, asked):
        if not docs.num_rows or not asked.num_rows:
            return _ANSWERED.empty_table()
        own = Chunk(docs, k)
        order = np.argsort(own.edges, kind="stable")
        edges = own.edges[order]
        unpack = zstandard.ZstdDecompressor().decompress
        asks = [unpack(x).split(b"\n") for x in asked.column("runs").to_pylist()]
        runs = list(itertools.chain.from_iterable(asks))
        other = Chunk.of(np.arange(len(runs)), runs, k)
        at = np.minimum(np.searchsorted(edges, other.edges), len(edges) - 1)
        source = order[at]
        held = edges[at] == other.edges
        held[held] = same_words(other.row[held], (other.at - other.bounds[other.row])[held], runs, own.row[source[held]], (own.at - own.bounds[own.row])[source[held]], own.texts, k)
        cuts = np.searchsorted(other.row, np.cumsum([0, *map(len, asks)])).tolist()
        answers = [np.packbits(held[a:b]).tobytes() for a, b in itertools.pairwise(cuts)]
        return pa.Table.from_arrays([asked.column("asker").combine_chunks(), pa.array([key[0].as_py()] * len(answers), pa.int32()), pa.array(answers, pa.binary())], schema=_ANSWERED)

    return run


def _cut(k: int, schema: pa.Schema, as_is: bool = False, carried: tuple[str, ...] = ()):
    def run(key, docs, told):
        if not docs.num_rows:
            return schema.empty_table()
        own = Chunk(docs, k)
        answered = told.filter(pc.is_valid(told.column("held")))
        runs = Runs(own, told.filter(pc.is_null(told.column("held"))))
        answers = {}
        for o, bits in zip(answered.column("owner").to_pylist(), answered.column("held").to_pylist(), strict=True):
            ends = np.cumsum([x.count(b" ") + 2 - k for x in runs.asked[o]])
            answers[o] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(ends[-1])).astype(bool), [0, *ends.tolist()]
        gone = np.zeros(len(own.edges), bool)
        for begin, end, o, place in runs.all:
            bits, cuts = answers[o]
            gone[begin:end] = bits[cuts[place] : cuts[place + 1]]
        # Edges that a document before holds in the same chunk.
        by = np.argsort(own.edges, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = own.edges[by][1:] != own.edges[by][:-1]
        source = np.empty(len(by), np.int64)
        source[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
        place = own.at - own.bounds[own.row]
        here = np.flatnonzero(~gone & (own.ids[own.row] > own.ids[own.row[source]]))
        gone[here] = same_words(own.row[here], place[here], own.texts, own.row[source[here]], place[source[here]], own.texts, k)

        at, row = own.at[gone], own.row[gone]
        # Repeated edges that touch or overlap are one path: its words run from the first edge's start to the last edge's end.
        joins = np.zeros(len(at), bool)
        joins[1:] = (row[1:] == row[:-1]) & (at[1:] <= at[:-1] + k)
        heads = np.flatnonzero(~joins)
        tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
        path_row, begin, end = row[heads], at[heads] - own.bounds[row[heads]], at[tails] + k - own.bounds[row[heads]]
        cuts = np.searchsorted(path_row, np.arange(len(own.ids) + 1))
        counts = np.diff(own.bounds)
        removed = np.zeros(len(own.ids), np.int64)
        np.add.at(removed, path_row, end - begin)
        kept = []
        for i, text in enumerate(own.texts):
            if as_is and not removed[i]:
                kept.append(text)
                continue
            words = text.split()
            for j in range(cuts[i + 1] - 1, cuts[i] - 1, -1):
                del words[begin[j] : end[j]]
            kept.append(b" ".join(words))
        cut = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["begin", "end"]))
        return pa.Table.from_arrays([pa.array(own.ids), pa.array(counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), cut.cast(schema.field("paths").type), *(docs.column(c).combine_chunks().take(pa.array(own.order)) for c in carried)], schema=schema if not carried else None, names=[*schema.names, *carried] if carried else None)

    return run


def remove_repeats(docs: DataFrame, k: int = K, as_is: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, text (the words kept, one space between), paths (the spans cut, in words), and a struct ``carried`` of the columns in ``carry``.

    ``as_is`` leaves texts of which nothing is removed as they are, white space and all. ``doc_id`` is an integer; a null one counts as the smallest. Texts are shuffled once, compressed, and used four times; hashes of all edges once.
    """
    bounded(docs.sparkSession)
    carried = {f"c{i}": c for i, c in enumerate(carry)}  # no name of theirs is one of ours
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(o) for o, c in carried.items()])
    more = [rows.schema[o] for o in carried]
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), max(1, min((1 << 31) - 1, -(-total // BUCKET_BYTES)))
    ranges = min(chunks, ENDS)
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] if ranges > 1 else []
    kinds = lambda columns: T.StructType([*T._parse_datatype_string(columns).fields, *more])
    dealt = rows.mapInArrow(_deal(np.unique(np.array(found or [], np.int64)), -(-chunks // ranges)), kinds("chunk int, doc_id long, packed binary"))

    # All uses take the same columns, so that they share one exchange.
    edges = dealt.groupBy("chunk").applyInArrow(_send_edges(buckets, k), "bucket int, chunk int, n int, edges binary")
    repeated = edges.groupBy("bucket").applyInArrow(_join_edges, "chunk int, edges binary, owners binary")
    asked = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_ask(k), "chunk int, asker int, runs binary")
    answered = dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_answer(k), "chunk int, owner int, held binary")
    told = repeated.select("chunk", "edges", "owners", F.lit(None).cast("int").alias("owner"), F.lit(None).cast("binary").alias("held")).union(answered.select("chunk", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "owner", "held"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("paths", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
    cut = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_cut(k, schema, as_is, tuple(carried)), kinds("doc_id long, n_words long, n_removed long, text string, paths array<struct<begin:bigint,end:bigint>>"))
    own = [F.struct(*[F.col(o).alias(c) for o, c in carried.items()]).alias("carried")] if carried else []
    return cut.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "text", "paths", *own)
