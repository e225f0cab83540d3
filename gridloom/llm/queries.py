"""The ten operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_extract, langid, minhash, packing, quality, spotsigs, substring
from .shared import materialize, table


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies, and links, of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of the text decoded from them."""
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.default_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many are repeats of an earlier document, and a digest of the rest."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    names, model = langid.learn(docs.where(~langid.held_out()))
    out = langid.identify(docs, names, model)
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses."""
    out = spotsigs.compare_with_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.as_text(F.col("fingerprint")).alias("fingerprint"), spotsigs.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, fitted on labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels.where(~langid.held_out())))
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations"))
    kind = dict(turns.dtypes)["conv_id"]
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast(kind).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = chat.read_back(chat.format_turns(turns.union(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, packed into rows of a matrix."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe.default_path())


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {
    f.__name__: f
    for f in (op1_dart_minhash, op2_bpe_automaton, op3_debruijn_substrings, op4_language_mixture, op5_page_differencing, op6_spotsigs, op7_compression_quality, op8_chat_formatting, op9_best_fit_packing, op10_winnowing)
}


# Stages of corpus_pipeline.py: each takes the documents that the one before has kept.


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that can be told; those without a letter go, and those of which the languages of their set hold less than 0.3 together."""
    names, model = langid.learn(docs.where(~langid.held_out()))
    own = {c: c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)}  # no name of theirs is one of the results'
    judged = langid.identify(docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()]), names, model, carry=tuple(own.values()))
    told = F.aggregate("languages", F.lit(0.0), lambda total, x: total + x["share"])
    return judged.where((F.col("lang_pred") != "und") & (told >= 0.3)).select(*[F.col(o).alias(c) for c, o in own.items()])


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every class of near copies.

    Rows are told apart by doc_id and text: of equal rows one stays, rows with one doc_id (or none) and different texts are judged each for itself.
    """
    key = F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text"))
    first = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).where("doc_id = class_id").select(F.col("doc_id").alias("_key"))
    once = Window.partitionBy("_key").orderBy(*docs.columns)  # of the partitioning that the join has anyway
    return docs.withColumn("_key", key).join(first.hint("merge"), "_key", "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; a document with nothing left goes, one without words too. doc_id is told apart by integer; a null one counts as the smallest."""
    cut = substring.remove_repeats(docs, as_is=True, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    kept = cut.where("n_words > n_removed")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text")}
    return kept.select(*[(own[c] if c in own else F.col(f"carried.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window, however long they are. Rows are judged by their text: those with one doc_id each for itself."""
    key = F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text"))
    hits = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(hits, "_key", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document and the text decoded from them."""
    return bpe.encode_documents(docs, bpe.default_path())


STAGES = [("language_id", keep_known_language), ("near_dedup", keep_one_of_each_class), ("substring_dedup", cut_repeats), ("decontamination", drop_contaminated), ("bpe_encoding", encode)]


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
