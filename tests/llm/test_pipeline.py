"""The pipeline against brute force, and the queries that name every operator."""

import __spark_entry__ as entry
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import bpe
from tests.llm.conftest import words
from tests.llm.test_minhash import classes
from tests.llm.test_text_operators import brute_hits, brute_repeats


def test_pipeline(spark, docs, corpus, tmp_path):
    text = dict(corpus)
    items = [(1, " ".join(text[14].split())), (2, "nothing of this is there")]
    extra = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars")
    # A long document with one short passage of a benchmark item: far under a twentieth of its words.
    long = spark.createDataFrame([(90, " ".join([*words(700, 90), *text[14].split(), *words(700, 91)]), "en", "s", 0)], docs.schema)
    every = docs.where("doc_id <> 4").unionByName(extra).unionByName(long)
    every.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(r.doc_id, r.text) for r in every.collect() if any(c.isalpha() for c in r.text or "")]
    top = classes(kept)
    kept = [(i, t) for i, t in kept if top[i] == i]
    cut = brute_repeats(kept)
    kept = [(i, t if not cut[i][1] else cut[i][2]) for i, t in kept if cut[i][0] > cut[i][1]]
    hits = brute_hits(kept, items)
    kept = [(i, t) for i, t in kept if not hits[i][1]]
    library = Tokenizer.from_file(bpe.default_path())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 14 not in got and 5 not in got and 1 not in got
    assert 90 not in got and hits[90][1:] == (12, ["1"], False)


def test_rows_without_or_with_one_id(spark, docs):
    from gridloom.llm import queries

    rows = [(None, "a b c d e f g"), (None, "h i j k l m n"), (None, "a b c d e f g"), (1, "o p q r s t u"), (1, "v w x y z a b"), (1, "v w x y z a b"), (2, "h i j k l m n")]
    kept = queries.keep_one_of_each_class(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema), "").collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "a"), (0, "h"), (1, "o"), (1, "v")]


def test_stages_keep_columns(spark, docs):
    name, stage = corpus_pipeline.STAGES[0]
    assert stage(spark, docs, "").columns == docs.columns
    named = docs.select("doc_id", "text", "lang", docs.source.alias("score"), docs.n_chars.alias("lang_pred"))
    assert stage(spark, named, "").columns == named.columns and stage(spark, named, "").count() == stage(spark, docs, "").count() == 11
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]


def test_stages_of_empty_and_odd_tables(spark, docs, corpus, none, tmp_path):
    """Empty tables, nulls, repeated rows and columns with clashing names, in every stage."""
    spark.createDataFrame([(1, "never seen words here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs.union(docs.where("doc_id < 8")).selectExpr("doc_id", "text", "lang", "source as n_words", "source as hits", "source as chunk", "n_chars", "source as class_id")
    cut = brute_repeats(corpus)
    left = [i for i, _ in [*corpus, *[x for x in corpus if x[0] < 8]] if cut[i][0] > cut[i][1]]
    want = {"language_id": odd.where("text rlike '[a-zA-Z]'").count(), "near_dedup": len(set(classes(corpus).values())), "substring_dedup": len(left)}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns or name == "bpe_encoding"
        assert got.count() == want.get(name, odd.count()), name


def test_entry_names_all():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert [int(q[2:].split("_")[0]) for q in names] == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
