"""Near-dedup against brute force over all pairs."""

import collections
import re

import numpy as np
import pyarrow as pa

from gridloom.llm import minhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k)


def classes(corpus):
    sets = {i: shingles(t) for i, t in corpus}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = sum((sets[a] & sets[b]).values())
            if a < b and both and both / sum((sets[a] | sets[b]).values()) >= 0.8:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in sets}


def test_classes(docs, corpus):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    want = classes(corpus)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())
    assert got[5].class_id == 2 and got[9].class_id == 2 and got[9].n_links >= 1 and got[9].similarity >= 0.8
    assert got[3].class_id == 3 and got[1].class_id == 1


def test_many_near_copies(spark):
    import random

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(150):
        own = list(base)
        own[r.randrange(200)] = f"x{r.randrange(10**6)}"
        own[r.randrange(200)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    r.shuffle(texts)
    corpus = list(enumerate(texts))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == classes(corpus)


def test_signatures_estimate_similarity():
    def signed(texts):
        regions, bounds, _ = minhash.weighted_regions(pa.array(texts))
        return minhash.dart_signatures(regions, bounds)

    a = [f"a{i}" for i in range(400)]
    b = a[:300] + [f"b{i}" for i in range(100)]
    one, two, again = signed([" ".join(a), " ".join(b), " ".join(a)])
    assert (one == again).all() and (one != 0).all()
    sa, sb = shingles(" ".join(a)), shingles(" ".join(b))
    true = sum((sa & sb).values()) / sum((sa | sb).values())
    assert abs(np.mean(one == two) - true) < 0.16
    assert (signed(["one"]) != 0).all() and (signed(["x " * 3000]) != 0).all()


def test_repeated_rows_and_empty(spark, docs, none):
    twice = docs.union(docs.where("doc_id in (2, 9)")).withColumn("bucket", docs.source).withColumn("digest", docs.source)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(twice).collect()} == {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert minhash.near_duplicates(none).count() == 0
    lost = docs.union(docs.where("doc_id in (2, 9)").selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    got = [r for r in minhash.near_duplicates(lost).collect() if r.doc_id is None]
    assert [(r.class_id, r.class_size, r.n_links, r.similarity) for r in got] == [(None, 1, 0, None)] * 2


def test_hot_keys_are_dealt(spark, docs, corpus, monkeypatch):
    """Every key that occurs twice is hot, and dealt to several tasks: the classes stay what they are."""
    from gridloom.llm import shared

    monkeypatch.setattr(shared, "HOT", 10**9)
    monkeypatch.setattr(minhash, "PART", 200)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs.union(docs)).collect()}
    assert got == classes(corpus)


def test_ids_of_any_kind(spark, corpus):
    df = spark.createDataFrame([(f"d{i:03}", t) for i, t in corpus], "doc_id string, text string")
    assert {int(r.doc_id[1:]): int(r.class_id[1:]) for r in minhash.near_duplicates(df).collect()} == classes(corpus)


def test_table_against_all_pairs(spark):
    """The documents of a test table: classes equal those of brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    corpus = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == classes(corpus)


def test_pairs_in_buckets_of_a_template(spark):
    import random

    r = random.Random(2)
    base = [f"w{i}" for i in range(600)]

    def changed(words, n):
        out = list(words)
        for at in r.sample(range(0, 600, 5), n):
            out[at] = f"x{r.randrange(10**9)}"
        return out

    own = [changed(base, 8) for _ in range(60)]  # each two about 0.77 alike
    own += [changed(own[i], 11) for i in range(6)]
    texts = [" ".join(x) for x in own]
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
