"""MinHash near-deduplication with DartMinHash signatures.

A document is a weighted set: its five-word shingles, weighted by how often they occur.
Every (shingle, unit of weight) is a region at which darts are thrown: their ranks are
the points of a Poisson process along the region, drawn by hashing the region, so equal
regions get equal darts in every document. A document looks at its darts up to a rank
that leaves about N_DARTS of them, whatever its length, and each of the COORDINATES
coordinates keeps the earliest dart hashed to it; a document with an empty coordinate
looks twice as far. Two documents agree in a coordinate with a probability equal to
their weighted Jaccard similarity, and a long document costs one draw a shingle.

Signatures are banded (BANDS of ROWS coordinates). Texts that are equal in words are one
class from the start. In every bucket of a band the members are linked to two centres,
the member that shares the most buckets and the one with the smallest id: never to each
other. Links are verified by the exact weighted Jaccard of the texts; classes are the
connected components of the links that hold.

That leaves members of different classes that share a bucket but no centre. They are not
paired: the documents of buckets that still hold several classes go through an exact join
by their rarest regions. With the regions of each in one order, rare ones first, the first
region that two texts of the wanted similarity share lies within the first ninth of the
shorter one and the first fifth of the longer one. So only pairs that share such a region,
lie in different classes and can still reach the similarity by their weights and by what
follows the region are verified. Texts that share a template and differ in the rest have
their rare parts first and are no candidates, however many they are.

A key with more than one in HOT of all rows (at most HOT keys can have) is salted in the
joins by bucket, digest, representative, class, hub and region.

Words are ASCII letters and digits and everything beyond ASCII, without regard to the
case of A-Z. Texts of one to four words are one shingle. Texts without a word (null and
empty ones too) are near to nothing: each is its own class. Rows that repeat a doc_id are
one document; where they differ in text, the one with the smallest digest stands for it in
the buckets, and a link holds if it does for any of its texts. Rows without a doc_id can't
be named: each comes out with class_id null and no links. doc_id is of any type that can be
ordered. Ties (a class has several smallest texts, a bucket several centres) go to the smallest
doc_id. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ALNUM, U, Workspace, bounded, hash_words, hot_keys, mixed, rolling, row_of, salt, salted_join, spans, split_words, text_bytes

SHINGLE = 5
SIMILARITY = 0.8
#: What the rarest regions of two texts of that similarity must share: overlap is at least 4/5 of the larger weight, 8/9 of the smaller, 4/9 of both.
LONGER, SHORTER, BOTH = (4, 5), (8, 9), (4, 9)
BANDS = 25
ROWS = 5
COORDINATES = BANDS * ROWS
N_DARTS = 980.0
#: Shingles that are compared in one go, at least.
PART = 1 << 25


def weighted_regions(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: region hashes (a shingle and a unit of its weight), bounds by row, and a 64-bit digest of its words."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = split_words(data, offsets, ALNUM)
    words = hash_words(data, starts, ends, lower=True)
    counts = np.diff(bounds)
    row = row_of(bounds)
    n = max(0, len(words) - SHINGLE + 1)
    at = np.flatnonzero(row[:n] == row[SHINGLE - 1 :]) if n else np.zeros(0, np.int64)
    shingles, owner = rolling(words, SHINGLE)[at] if n else np.zeros(0, np.uint64), row[at]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(counts == k)
        if len(short):
            shingles = np.append(shingles, rolling(words, k)[bounds[short]])
            owner = np.append(owner, short)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    index = np.arange(len(order))
    unit = index - np.maximum.accumulate(np.where(new, index, 0)) if len(order) else index
    place = np.arange(len(words)) - bounds[row] if len(words) else np.zeros(0, np.int64)
    sums = np.append(U(0), np.cumsum(mixed(words + place.astype(np.uint64) * U(0x9E3779B97F4A7C15))))
    digest = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + counts.astype(np.uint64))
    return mixed(shingles + unit.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)), np.searchsorted(owner, np.arange(len(counts) + 1)), digest


def dart_signatures(regions: np.ndarray, bounds: np.ndarray, darts: float = N_DARTS) -> np.ndarray:
    """COORDINATES dart identities for every row with a region (rows without one get zeros)."""
    rows, k = len(bounds) - 1, COORDINATES
    weight = np.diff(bounds)
    best = np.full(rows * k, np.inf)
    owner = row_of(bounds)
    reach = darts / np.maximum(weight, 1)
    live, rank, throw = np.arange(len(regions)), np.zeros(len(regions)), 0
    thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        throw += 1
        dart = mixed(regions[live] + U(throw * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        rank = rank - np.log(((dart >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        inside = np.flatnonzero(rank <= reach[owner[live]])
        live, rank, dart = live[inside], rank[inside], dart[inside]
        slot = owner[live] * k + (mixed(dart ^ U(0x8CB92BA72F3D8DD7)) % U(k)).astype(np.int64)
        np.minimum.at(best, slot, rank)
        thrown.append((slot, rank, dart))
    out = np.zeros(rows * k, np.uint64)
    for slot, rank, dart in thrown:
        first = best[slot] == rank
        out[slot[first]] = dart[first]
    out = out.reshape(rows, k)
    short = np.flatnonzero(np.isinf(best.reshape(rows, k)).any(axis=1) & (weight > 0))
    if len(short):
        some = np.concatenate([regions[bounds[i] : bounds[i + 1]] for i in short])
        out[short] = dart_signatures(some, np.append(0, np.cumsum(weight[short])), 2 * darts)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.zeros((len(signatures), BANDS), np.uint64)
    for j in range(ROWS):
        key = mixed(key * U(0x9FB21C651E98DF25) + parts[:, :, j])
    return key


def _sign(batches):
    for part in spans(batches, "text"):
        regions, bounds, digest = weighted_regions(part.column("text"))
        has = np.diff(bounds) > 0
        keys = band_keys(dart_signatures(regions, bounds))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(has, BANDS, 0))).astype(np.int32)), pa.array(keys[has].ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest.view(np.int64)), pa.array(np.diff(bounds)), lists], names=["doc_id", "digest", "weight", "bands"])


def _regions(batches):
    for part in spans(batches, "text"):
        regions, bounds, _ = weighted_regions(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row_of(bounds))), pa.array(regions.view(np.int64))], names=["doc_id", "region"])


def _similarity(batches):
    """Exact weighted Jaccard of the two texts of each pair."""
    for part in spans(batches, "text_a", 1 << 20):
        sides = [weighted_regions(part.column(c)) for c in ("text_a", "text_b")]
        keys = np.concatenate([s[0] for s in sides])
        pair = np.concatenate([row_of(s[1]) for s in sides])
        order = np.lexsort((keys, pair))
        keys, pair = keys[order], pair[order]
        both = np.bincount(pair[1:][(keys[1:] == keys[:-1]) & (pair[1:] == pair[:-1])], minlength=part.num_rows)
        total = np.diff(sides[0][1]) + np.diff(sides[1][1]) - both
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both / np.maximum(total, 1))], names=["a", "b", "similarity"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents with the similarity of their texts, those of SIMILARITY or more."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = salted_join(salted_join(pairs.select("a", "b"), one, ["a"], "b"), other, ["b"], "a", pairs).select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(_similarity, f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= SIMILARITY).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def components(links: DataFrame, keep: Workspace) -> DataFrame:
    """Connected components of links (a, b): doc_id and class_id, the smallest id of its component.

    Alternates two star operations until nothing changes: every id passes the smallest of its neighbours to the
    larger ones, then to the smaller ones. Both are aggregations by id, and each round is written out.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_join(ways, least, ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"], "v").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = keep(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("class_id"))
        seen = now


def _beyond(weight, share: tuple[int, int]):
    """The last place, from 0, at which the first shared region may lie for an overlap of that share of the weight."""
    return weight - F.floor((weight * share[0] + share[1] - 1) / share[1])


def rare_pairs(open_: DataFrame, texts: DataFrame, keep: Workspace) -> DataFrame:
    """Pairs (a, b) of documents (doc_id, class_id, weight) in different classes that may reach SIMILARITY by their rarest regions, with the weight of both."""
    regions = keep(texts.join(open_.select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(_regions, texts.select("doc_id", F.lit(0).cast("bigint").alias("region")).schema).distinct(), "regions")
    counts = regions.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    common = salted_join(regions, counts, ["region"], "doc_id")
    own = Window.partitionBy("doc_id")
    # Regions of one text alone come first and meet nobody: they only shift the places of the others.
    placed = common.withColumn("rank", F.row_number().over(own.orderBy("n", "region"))).withColumn("many", F.count("*").over(own))
    placed = placed.join(open_.hint("merge"), "doc_id").withColumn("place", F.col("weight") - F.col("many") + F.col("rank") - 1)
    prefixes = keep(placed.where(F.col("place") <= _beyond(F.col("weight"), LONGER)).select("region", "doc_id", "class_id", "weight", "place"), "prefixes")
    hot = hot_keys(prefixes, ["region"])
    a, b = (
        side.select("region", "salt", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "class_id", "weight", "place")])
        for x, side in (
            ("a", prefixes.where(F.col("place") <= _beyond(F.col("weight"), SHORTER)).withColumn("salt", F.explode(salt(["region"], hot)))),
            ("b", prefixes.withColumn("salt", salt(["region"], hot, "doc_id"))),
        )
    )
    shorter = "weight_a < weight_b or weight_a = weight_b and doc_id_a < doc_id_b"
    least = f"{BOTH[1]} * least(weight_a - place_a, weight_b - place_b) >= {BOTH[0]} * (weight_a + weight_b)"
    pairs = a.join(b.hint("merge"), ["region", "salt"]).where(f"class_id_a <> class_id_b and ({shorter}) and {LONGER[1]} * weight_a >= {LONGER[0]} * weight_b and {least}")
    return pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"), (F.col("weight_a") + F.col("weight_b")).alias("asked")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (the smallest doc_id of its class), class_size, n_links (verified links) and similarity (its best link, 1 for equal words)."""
    bounded(docs.sparkSession)
    keep = Workspace()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    named = rows.where(F.col("doc_id").isNotNull())
    signed = named.mapInArrow(_sign, f"doc_id {kind}, digest long, weight long, bands array<bigint>")
    signed = keep(signed.groupBy("doc_id").agg(F.min(F.struct("digest", "weight", "bands")).alias("s")).select("doc_id", "s.*"), "signatures")
    told = signed.select("doc_id", "digest", "weight")
    same = told.where("weight > 0").groupBy("digest", "weight").agg(F.min("doc_id").alias("rep"))
    member = keep(salted_join(told, same, ["digest", "weight"], "doc_id", how="left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "members")

    reps = signed.where("weight > 0").join(member.where("doc_id = rep").select("doc_id").hint("merge"), "doc_id", "left_semi")
    banded = keep(reps.select("doc_id", "weight", F.posexplode("bands").alias("band", "key")).select("doc_id", "weight", F.xxhash64("band", "key").alias("bucket")), "bands")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = keep(salted_join(banded, sizes, ["bucket"], "doc_id"), "shared")
    popular = shared.groupBy("doc_id").agg(F.sum("size").alias("met"))
    entries = keep(shared.select("bucket", "doc_id", "weight").join(popular.hint("merge"), "doc_id"), "buckets")
    # Texts of documents that share a bucket, shuffled once; a merge join at every size, so that disk grows as the input does.
    texts = keep(named.join(popular.select("doc_id").hint("merge"), "doc_id", "left_semi"), "texts")

    centres = entries.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("met"), "doc_id")).getField("doc_id").alias("hub"), F.min("doc_id").alias("low"))
    near = salted_join(entries.select("bucket", "doc_id"), centres, ["bucket"], "doc_id")
    pairs = near.select(F.col("doc_id").alias("a"), F.explode(F.array("hub", "low")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = keep(verify(keep(pairs, "pairs"), texts), "verified")
    classes = components(links, keep)

    # Documents of the buckets that still hold several classes.
    placed = salted_join(entries, classes, ["doc_id"], "bucket", how="left").select("bucket", "doc_id", "weight", F.coalesce("class_id", "doc_id").alias("class_id"))
    several = placed.groupBy("bucket").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high").select("bucket")
    open_ = keep(salted_join(placed, several, ["bucket"], "doc_id").select("doc_id", "class_id", "weight").distinct(), "open")
    rest = keep(rare_pairs(open_, texts, keep), "rest")
    # In parts that ask for no more text at once than there is (or PART), so that disk grows as the input does.
    asked, given = rest.agg(F.sum("asked")).first()[0] or 0, signed.agg(F.sum("weight")).first()[0] or 0
    parts = -(-asked // max(PART, given))
    found = [keep(verify(rest.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part), texts), "verified") for part in range(parts)]
    found = [more for more in found if not more.isEmpty()]
    if found:
        for more in found:
            links = links.union(more)
        classes = components(links, keep)

    # All that a document gets is known of its representative; the sizes of classes are sums over representatives.
    ends = links.select(F.col("a").alias("rep"), "similarity").union(links.select(F.col("b").alias("rep"), "similarity")).groupBy("rep").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    copies = member.groupBy("rep").agg(F.count("*").alias("copies"))
    known = copies.join(classes.select(F.col("doc_id").alias("rep"), "class_id").hint("merge"), "rep", "left").join(ends.hint("merge"), "rep", "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    known = keep(known, "representatives")
    sized = salted_join(known, known.groupBy("class_id").agg(F.sum("copies").alias("class_size")), ["class_id"], "rep")
    all_ = salted_join(member, keep(sized, "sized"), ["rep"], "doc_id")
    best = F.when(F.col("doc_id") != F.col("rep"), F.lit(1.0)).otherwise(F.coalesce("similarity", F.when(F.col("class_size") > 1, F.lit(1.0))))
    out = all_.select("doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), best.alias("similarity"))
    nameless = rows.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("double").alias("similarity"))
    return keep.finish(out.union(nameless), "classes")
