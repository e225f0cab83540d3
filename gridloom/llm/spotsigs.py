"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot is an occurrence of an anchor, a very common word; its signature is the anchor
with the chain of up to CHAIN content words that follow before the next anchor. The set of
all signatures of a text, hashed, is its fingerprint: frequent in prose, rare in menus and
lists. A text without a spot has its own words for signatures. Fingerprints are compared
by Jaccard similarity.

``near_pairs`` finds all pairs of different fingerprints that reach a threshold. Sets are
partitioned by length, in steps of the threshold: two sets that reach it lie in the same or
in neighbouring partitions. Within these the rarest signatures are joined, as many of each
set as must hold a shared one; what the lengths and the places of the shared signature keep
under the threshold is pruned, and what is left is intersected. Equal fingerprints are one
set, with a table of its members beside. No pairs are formed within groups but those that
share a rare signature; signatures with many sets are dealt to several tasks.

``compare_with_edits`` compares each document with two given texts, so there nothing is to
be searched, and likenesses are exact, without a threshold.

Words are runs of letters and digits, without regard to case. Null counts as empty; an
empty text has an empty fingerprint, equal (1) to another empty one and unlike (0) any
other. Equal texts have equal fingerprints. Documents follow each other by doc_id, then
text (equal rows in any order, which changes nothing); a null doc_id comes first, and the
last document is followed by the first; a document alone follows itself. An empty table gives
an empty result, other columns are not read, and texts are taken whole at any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, hot_keys, salt, salted_join, slots

CHAIN = 3
#: Anchors.
# Very common words of English, French, German and Spanish.
ANCHORS = """a an and are as at be but by for from had has have he in is it not of on or she that the this to was were which with
au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui sur un une
als am auch auf aus bei das dass dem den der des die ein eine einer es für ich im ist mit nicht sich sie und von zu zum
al como con del el ella era las lo los más muy no o para pero por se sin su sus una y""".split()


def signatures(text: Column) -> Column:
    """Matches of spots in a text as strings, or its words where it has none; with repeats."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    anchor = "(?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (w[0], -len(w), w))) + ")"
    spots = F.regexp_extract_all(words, F.lit(f"(?<= ){anchor}(?: (?!{anchor} )[^ ]++){{1,{CHAIN}}}+"), 0)
    return F.struct(words.alias("words"), spots.alias("spots"))


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column ``out``: the sorted distinct 64-bit signature hashes of column ``text``."""
    held = df.withColumn("_found", signatures(F.col(text)))
    chosen = F.when(F.size("_found.spots") > 0, F.col("_found.spots")).otherwise(F.filter(F.split("_found.words", " "), lambda x: x != ""))
    return held.withColumn(out, F.array_sort(F.array_distinct(F.transform(chosen, lambda x: F.xxhash64(x))))).drop("_found")


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as hexadecimal numbers with a space between."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two fingerprints; 0 without intersecting where the lengths alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * F.lit(least)), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def near_pairs(prints: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b, similarity) of different fingerprints of likeness ``least`` or more, and the members (doc_id, rep) of each.

    ``prints`` has doc_id and fingerprint; a fingerprint stands under the smallest doc_id that has it, its rep. Empty ones are near to none.
    """
    keep = Workspace()
    prints = keep(prints.where("doc_id is not null").select("doc_id", "fingerprint", F.xxhash64("fingerprint").alias("digest")), "prints")
    same = prints.groupBy("digest", "fingerprint").agg(F.min("doc_id").alias("rep"))
    members = keep(salted_join(prints.select("doc_id", "digest", "fingerprint"), same, ["digest", "fingerprint"], "doc_id").select("doc_id", "rep"), "members")
    sets = keep(same.where(F.size("fingerprint") > 0).select(F.col("rep").alias("doc_id"), "fingerprint", F.size("fingerprint").alias("size")), "sets")
    # The length partition: sizes that differ by less than the threshold's factor lie in one or in neighbours.
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(least)) + 1e-9)
    spread = sets.select("doc_id", "size", step.alias("part"), F.explode("fingerprint").alias("signature"))
    counts = spread.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("doc_id")
    # Signatures of one set alone come first and meet nobody: they only shift the places of the others.
    placed = salted_join(spread, counts, ["signature"], "doc_id").withColumn("place", F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "signature")) - 1)
    both = least / (1 + least)
    bound = lambda share: F.col("size") - F.ceil(F.col("size") * F.lit(share) - 1e-9)
    entries = keep(placed.where(F.col("place") <= bound(least)).select("signature", "part", "doc_id", "size", "place"), "entries")
    hot = hot_keys(entries, ["signature"])
    small = entries.where(F.col("place") <= bound(2 * both)).withColumn("salt", F.explode(salt(["signature"], hot)))
    large = entries.withColumn("salt", salt(["signature"], hot, "doc_id")).withColumn("near", F.explode(F.array("part", F.col("part") - 1)))
    left = small.select("signature", "salt", "part", F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    right = large.select("signature", "salt", F.col("near").alias("part"), F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    shorter = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    reach = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1e-9 >= (F.col("size_a") + F.col("size_b")) * F.lit(both)
    pairs = keep(left.join(right.hint("merge"), ["signature", "salt", "part"]).where(shorter & (F.col("size_a") + 1e-9 >= F.col("size_b") * F.lit(least)) & reach).select("a", "b").distinct(), "pairs")
    for end in ("a", "b"):
        pairs = salted_join(pairs, sets.select(F.col("doc_id").alias(end), F.col("fingerprint").alias(f"print_{end}")), [end], "b" if end == "a" else "a")
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("print_a"), F.col("print_b"), least).alias("similarity"))
    return found.where(F.col("similarity") >= least), members


def with_next(df: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for the columns in ``carry`` from the row that follows by ``order``; the first of these is an integer.

    Rows are dealt to ranges of nearly equal counts of that column; the last row of a range gets the first one of the next range by a join
    of one row a range. No task sees more than a range.
    """
    key = order[0]
    rows = df.where(F.col(key).isNotNull())
    count = rows.count()
    # Ends of at most 65,536 ranges are told; a range holds 2,048 rows or, of more than 134 million, its share.
    ranges = int(max(1, min(65_536, max(3 * slots(df.sparkSession), count // 2048))))
    found = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] if ranges > 1 else []
    ends = sorted(set(found or []))
    step = max(1, int(len(ends) ** 0.5))
    coarse, groups = ends[step - 1 :: step], [ends[i : i + step] for i in range(0, len(ends), step)]
    # Two short searches: the group of ends, then the end within the group.
    lower = lambda column: F.size(F.filter(column, lambda x: x < F.coalesce(F.col(key), F.lit(-(1 << 63)))))
    longs = lambda values: F.lit(values) if values else F.array().cast("array<bigint>")
    table = F.array(*[longs([int(x) for x in g]) for g in groups]) if groups else None
    dealt = df.withColumn("_group", lower(longs([int(x) for x in coarse]).cast("array<bigint>")))
    place = F.col("_group") * step + F.coalesce(lower(F.get(table, F.col("_group"))), F.lit(0)) if table is not None else F.lit(0)
    # Never null, and no row limit pushed below it: so the three uses of the dealt rows share one exchange.
    dealt = dealt.withColumn("_range", F.coalesce(place, F.lit(0))).drop("_group")
    by = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    # Plain columns are led, not a struct of them, which would be shuffled beside the columns.
    led = dealt.select("*", *[F.lead(c).over(by).alias(f"next_{c}") for c in carry], F.lag(F.lit(1)).over(by).alias("_head"), F.lead(F.lit(1)).over(by).alias("_tail"))
    first = led.where("_head is null").select("_range", *[F.col(c).alias(f"_first_{c}") for c in carry])
    turn = Window.orderBy("_range")  # one row a range
    heads = dealt.groupBy("_range").agg(F.lit(1).alias("one")).withColumn("_before", F.coalesce(F.lag("_range").over(turn), F.max("_range").over(Window.partitionBy(F.lit(1)))))
    follow = first.join(heads, "_range").select(F.col("_before").alias("_range"), *[f"_first_{c}" for c in carry])
    columns = [*df.columns, *[f"next_{c}" for c in carry]]
    inner = led.where("_tail is not null").select(columns)
    last = led.where("_tail is null").join(follow, "_range").withColumns({f"next_{c}": F.col(f"_first_{c}") for c in carry}).select(columns)
    return inner.unionByName(last)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, its fingerprint, and its likeness to the next document and to a text whose second half is the next document's start."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = fingerprinted(rows, "text", "own")
    paired = with_next(own, ["doc_id", "text"], ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.select("doc_id", n.cast("bigint").alias("n_chars"), "own", F.col("next_own").alias("following"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    return fingerprinted(edited, "edited", "changed").select(
        "doc_id", "n_chars", "edited", F.col("own").alias("fingerprint"), F.col("changed").alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next")
    )
