"""Language ID, page text, fingerprints, quality and chat formatting."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, html_extract, langid, quality, queries, spotsigs

DIR = "/root/testdata/sf0.01"


def test_language(spark, none):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names, model = langid.learn(docs.where(~langid.held_out()))
    odd = spark.createDataFrame([(1, None, "x", 0), (2, "", "x", 0), (3, "123 !!", "x", 0), (4, "the", "x", 0)], "doc_id long, text string, score string, lang_pred int")
    got = {r.doc_id: r for r in langid.identify(odd, names, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[4].lang_pred == "en"
    held = langid.identify(docs, names, model).join(docs.select("doc_id", "lang").where(langid.held_out()), "doc_id")
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98
    two = docs.where("lang = 'en'").limit(1).first().text + "\n" + docs.where("lang = 'fr'").orderBy(F.desc("n_chars")).limit(1).first().text[:3000]
    mixed = langid.identify(spark.createDataFrame([(1, two[-6000:])], "doc_id long, text string"), names, model).first()
    assert "fr" in {x.lang for x in mixed.languages}
    assert langid.learn(none)[0] == [] and langid.identify(odd, [], model[:, :0]).first().lang_pred == "und"
    assert langid.identify(none, names, model).count() == 0


PAGE = """<html><head><title>t</title></head><body><nav>menu</nav><div class="cookie-notice">c</div>
<article><header><h1>Title &amp; more</h1></header><p>One  <b>two</b>.<br>three<p>four<script>x</script><aside>no</aside><div class="comments"><p>bad</p></div></article>
<footer>f</footer></body></html>"""


def test_page_lines():
    lines, marks = html_extract.page_lines(PAGE)
    assert [x for x, m in zip(lines, marks) if m == html_extract.MAIN] == ["Title & more", "One two. three", "four"]
    assert [x for x, m in zip(lines, marks) if m == html_extract.FRAME] == ["menu", "c", "no", "bad", "f"]
    kinds = lambda page: dict(zip(*html_extract.page_lines(page)))
    assert kinds('<article><p class="market-share">a</p><div class="share">b</div><svg><text>c</text></svg><math>d</math><div class="ad-slot">e</div></article>') == {"a": 1, "b": 2, "cd": 1, "e": 2}
    assert kinds('<main class="has-sidebar"><p>a</p></main><article class="comment"><p>b</p></article><div class="no-ads"><p>c</p></div>x <span class="ad">y</span> z') == {"a": 1, "b": 2, "c": 0, "y": 2, "x z": 0}
    for cut in range(len(PAGE)):
        html_extract.page_lines(PAGE[:cut])
    assert html_extract.page_lines("") == ([], [])
    assert html_extract.page_lines("a < b <p>c")[0] == ["a < b", "c"]


def frame(body):
    return f"<body><div>Our site</div><div>{body}</div><div>All rights reserved</div></body>"


def test_differencing(spark):
    """Frames without any telling markup go by comparison alone; copies and pages on their own keep them."""
    rows = [(i, f"http://h.example/a/{i:02}", frame(f"<p>own text {i}</p><p>and more {i}</p>")) for i in range(30)]
    rows += [(100, "http://alone.example/x", frame("<p>only</p>")), (101, None, None), (102, "http://h.example/a/03", rows[3][2])]
    rows += [(200 + i, f"http://copies.example/{i}", frame("<p>again</p>")) for i in range(5)]
    rows += [(7, "http://h.example/a/07", rows[7][2])]
    got = {}
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("range", F.lit("x"))).collect():
        got.setdefault(r.page_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {r[0]: 1 + (r[0] == 7) for r in rows}
    for i in [*range(30), 102]:
        assert {r.text for r in got[i]} == {f"own text {i % 99}\n\nand more {i % 99}"}
    assert got[101][0].text == "" and got[101][0].neighbour is None
    assert got[100][0].text == "Our site\n\nonly\n\nAll rights reserved"
    assert all(got[200 + i][0].text == "Our site\n\nagain\n\nAll rights reserved" for i in range(5))
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    named = spark.createDataFrame([(f"p{i}", u, h) for i, u, h in rows[:9]], "page_id string, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(named).collect()} == {f"p{i}": f"own text {i}\n\nand more {i}" for i in range(9)}


def test_switching_the_comparison_off_changes_results(spark, monkeypatch):
    assert html_extract.deleted([1, 2, 3], [0, 0, 0], [[1, 9, 3]]) == [True, False, True]
    monkeypatch.setattr(html_extract, "shared_lines", lambda own, other: [False] * len(own))
    assert html_extract.deleted([1, 2, 3], [0, 0, 0], [[1, 9, 3]]) == [False] * 3


def test_pages_against_brute_force(spark):
    """The test tables' pages, with their articles' markup taken away: page by page, by a plain search for the neighbours and a plain table of lengths."""
    pages = [(r.page_id, r.url, re.sub("</?article>|</?nav>|</?footer>", "", r.html).replace(' class="ad"', "")) for r in spark.read.parquet(f"{DIR}/pages.parquet").where("page_id < 80").collect()]
    pages += [(1000 + i, pages[i][1], pages[i][2]) for i in range(0, 60, 7)]
    site = lambda u, h: h.replace("<body>", f"<body><div>Site of {html_extract.url_parts(u)[0]}</div>").replace("</body>", "<p>Imprint</p></body>")
    pages = [(i, u, site(u, h)) for i, u, h in pages]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    read = {i: html_extract.page_lines(h) for i, u, h in pages}
    hosts = {}
    for i, u, h in pages:
        host, path = html_extract.url_parts(u)
        hosts.setdefault(host, []).append((path, str(i).zfill(20), i))

    def subsequence(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        return size[-1][-1]

    changed = 0
    for rows in hosts.values():
        rows.sort()
        for at, (path, _, i) in enumerate(rows):
            lines, marks = read[i]
            beside = []
            for step in (-1, 1):
                j = at + step
                while 0 <= j < len(rows) and read[rows[j][2]] == read[i]:
                    j += step
                if 0 <= j < len(rows):
                    other = rows[j][0]
                    beside.append((-next((k for k, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other))), j))
            beside.sort(key=lambda x: x[0])
            kept = [x for x, m in zip(lines, marks) if m != html_extract.FRAME]
            text = got[i].split("\n\n") if got[i] else []
            n = len(lines)
            want = {len(kept)} if not beside else set()
            for _, j in beside:
                shared = subsequence(lines, read[rows[j][2]][0])
                if shared < n:
                    want.add(n - shared - (len(lines) - len(kept)) if len(lines) == len(kept) else None)
                    break
            if None not in want and want:
                assert len(text) in want, (i, len(text), want)
                changed += len(text) < len(kept)
            rest = iter(kept)
            assert all(x in rest for x in text)
    assert changed > 20


def test_longest_common_subsequence(monkeypatch):
    import random

    r = random.Random(2)
    for turn in range(600):
        monkeypatch.setattr(html_extract, "CELLS", (1 << 28, 0, 12)[turn % 3])  # whole tables, halves down to lines, halves
        a, b = ([r.randrange(4) for _ in range(r.randrange(10))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        shared = html_extract.shared_lines(a, b)
        rest = iter(b)
        assert sum(shared) == size[-1][-1] and all(x in rest for x, s in zip(a, shared) if s)


def test_pages_query(spark):
    got = {r.page_id: r for r in queries.op5_page_differencing(spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|$)", r.html)[1]
        import html

        want = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_fingerprints(spark, docs, corpus, none):
    got = {r.doc_id: r for r in spotsigs.compare_with_edits(docs.withColumn("next", docs.source)).collect()}
    order = sorted((i, t or "") for i, t in corpus)
    sets = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - half] + u[:half]
        sets[i] = set(got[i].fingerprint)
    for (i, _), (j, _) in zip(order, order[1:] + order[:1]):
        a, b = sets[i], sets[j]
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        c = set(got[i].edited_fingerprint)
        assert got[i].near_edited == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert got[2].fingerprint == got[5].fingerprint != got[9].fingerprint and got[1].fingerprint == []
    assert spotsigs.compare_with_edits(none).count() == 0
    one = spotsigs.compare_with_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited == "abab" and one.near_next == 1.0
    rows = [(1, "the cat sat"), (1, "the cat sat"), (1, "of dogs"), (None, "x"), (None, None)]
    got = spotsigs.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 1), (1, 7), (1, 11), (1, 11)]
    assert {r.edited for r in got if r.n_chars == 11} == {"the cathe c", "the ca"}


def test_spots(spark):
    df = spark.createDataFrame([("The cat of Spain ran. The THE dog",)], "t string")
    assert df.select(spotsigs.signatures(df.t)["spots"]).first()[0] == ["the cat", "of spain ran", "the dog"]
    assert df.select(spotsigs.likeness(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)), 0.6)).first()[0] == 0.0


def test_spots_against_brute_force(spark, docs, corpus):
    anchors = set(spotsigs.ANCHORS)
    tail = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 80").collect()
    texts = [(i, t) for i, t in corpus] + [(1000 + r.doc_id, r.text) for r in tail]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in df.select("text", spotsigs.signatures(F.col("text"))["spots"].alias("spots")).collect():
        words, want, at = re.findall(r"[^\W_]+", (r.text or "").lower()), [], 0
        while at < len(words):
            chain = []
            if words[at] in anchors:
                for w in words[at + 1 : at + 1 + spotsigs.CHAIN]:
                    if w in anchors:
                        break
                    chain.append(w)
            if chain:
                want.append(" ".join([words[at], *chain]))
            at += 1 + len(chain)
        if not re.search(r"[^\x00-\x7f\u00c0-\u024f\s.,*]", r.text or ""):  # marks that are no letters in one of the two languages' classes
            assert r.spots == want


def test_near_pairs(spark, monkeypatch):
    import random

    r = random.Random(8)
    base = [r.randrange(10**6) for _ in range(60)]
    sets = [sorted(set(base[: r.randrange(45, 61)] + [r.randrange(10**6) for _ in range(r.randrange(0, 14))])) for _ in range(70)]
    sets += [sorted({r.randrange(40) for _ in range(r.randrange(1, 25))}) for _ in range(70)]
    sets += [[], [], sets[0], sets[3], sets[3], [5], [5, 6], [1, 2, 3, 4], [1, 2, 3, 4, 5]]
    rows = list(enumerate(sets))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, fingerprint array<long>")
    rep = {i: min(j for j, s in rows if s == x) for i, x in rows}
    for least in (0.8, 0.5):
        want = {}
        for i, a in rows:
            for j, b in rows:
                if i < j and rep[i] == i and rep[j] == j and a and b:
                    x = len(set(a) & set(b)) / len(set(a) | set(b))
                    if x >= least:
                        want[i, j] = pytest.approx(x)
        pairs, members = spotsigs.near_pairs(df, least)
        assert {(p.a, p.b): p.similarity for p in pairs.collect()} == want and len(want) > 20
        assert {m.doc_id: m.rep for m in members.collect()} == rep
    from gridloom.llm import shared

    monkeypatch.setattr(shared, "HOT", 10**9)
    assert {(p.a, p.b) for p in spotsigs.near_pairs(df, 0.5)[0].collect()} == set(want)
    assert spotsigs.near_pairs(df.limit(0))[0].count() == 0


def test_quality(spark):
    got = queries.op7_compression_quality(spark, DIR)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.9 and got.where("score < 0 or score > 1 or score is null").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    known = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, known)).collect()} == {1.0}
    assert {r.score for r in quality.score(odd, quality.fit(odd, known.limit(0))).collect()} == {0.5}
    both = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality.score(odd, quality.fit(odd, both)).count() == 3
    assert quality.blocks(b"") == [] and b"".join(quality.blocks(b"x" * 5000)) == b"x" * 5000


def test_quality_against_brute_force(spark, monkeypatch):
    """Scores by plain loops over whole texts; repeated rows, ties, clashing names and an empty table."""
    import numpy as np
    import zstandard

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 40").collect()]
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, "lorem ipsum " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("difference", F.lit(1))
    got = {}
    for r in quality.score(df, model).collect():
        got.setdefault(r.doc_id, []).append((r.difference, r.score))
    assert len(got[1000]) == 2 and len({*got[1000], *got[1001], *got[rows[3][0]]}) == 1 and quality.score(df.limit(0), model).count() == 0
    xs, ys = model["steps"]
    assert ys == sorted(ys) and xs == sorted(xs)
    for i, t in rows:
        raw, sizes = (t or "").encode(), [0, 0]
        n = -(-len(raw) // quality.BLOCK)
        for k, content in enumerate((model["good"], model["bad"])):
            pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(pack.compress(raw[j * len(raw) // n : (j + 1) * len(raw) // n])) for j in range(n))
        x = (sizes[1] - sizes[0]) / len(raw) if raw else 0.0
        step = ys[0] if x <= xs[0] else ys[-1] if x >= xs[-1] else next(a + (b - a) * (x - u) / (v - u) for u, v, a, b in zip(xs, xs[1:], ys, ys[1:]) if u <= x <= v)
        want = 0.95 * step + 0.05 / (1 + np.exp(-np.clip(model["slope"] * x + model["level"], -500, 500)))
        assert got[i][0] == (pytest.approx(x), pytest.approx(want)), i
    monkeypatch.setattr(quality, "BLOCKS", 1)
    assert 0 <= quality.score(df, quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))).first().score <= 1


def test_language_against_brute_force(spark):
    """Counts, likelihoods and shares by plain loops over words; repeated rows, ties and clashing names."""
    import math

    from gridloom.llm import shared
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, (r.text or "")[:400], r.lang) for r in docs.collect()]

    def grams(text):
        out = []
        raw = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in text.encode())
        for w in re.findall(rb"[a-z\x80-\xff]+", raw):
            padded = b"   " + w + b" "
            codes = [sum(padded[i + 3 - k] << (8 * k) for k in range(4)) for i in range(len(w) + 1)]
            out.append([int(shared.mixed(np.array([c], np.uint64))[0]) % langid.BINS for c in codes])
        return out

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, model = langid.learn(df)
    assert names == sorted({r[2] for r in rows if r[2]})
    counts = {n: {} for n in names}
    for _, t, lang in rows:
        if lang:
            for w in grams(t):
                for g in w:
                    counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {n: sum(c.values()) + langid.SMOOTHING * langid.BINS for n, c in counts.items()}
    again = spark.createDataFrame([(r[0], r[1], "x", 1) for r in rows + rows[:5]], "doc_id long, text string, lang_pred string, score int")
    got = {}
    for r in langid.identify(again, names, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(len(set(v)) == 1 for v in got.values()) and sum(map(len, got.values())) == len(rows) + 5
    checked = 0
    for i, t, _ in rows:
        words = grams(t)
        if not words or not any(c.isalpha() for c in t):
            assert got[i][0] == ("und", 0.0)
            continue
        logs = [[sum(math.log((counts[n].get(g, 0) + langid.SMOOTHING) / total[n]) for g in w) for n in names] for w in words]
        like = [[math.exp(x - max(row)) for x in row] for row in logs]
        shares = [1 / len(names)] * len(names)
        for _ in range(langid.ITERATIONS):
            expected = [0.0] * len(names)
            for row in like:
                joint = [a * b for a, b in zip(row, shares)]
                for k, x in enumerate(joint):
                    expected[k] += x / sum(joint)
            now = [(e + langid.PRIOR) / (len(words) + langid.PRIOR * len(names)) for e in expected]
            done = max(abs(a - b) for a, b in zip(now, shares)) <= langid.SETTLED
            shares = now
            if done:
                break
        best = max(range(len(names)), key=lambda k: shares[k])
        if sorted(shares)[-1] - sorted(shares)[-2] > 1e-3:
            assert got[i][0] == (names[best], pytest.approx(min(1.0, shares[best]), abs=2e-3)), i
            checked += 1
    assert checked > 30
    tie = langid.infer(np.array([0, 1], np.int32), np.array([0, 1]), np.array([0, 2]), np.zeros((langid.BINS, 3), np.float32))[0]
    assert tie[0].argmax() == 0 and np.allclose(tie[0], 1 / 3)


LAYOUTS = {
    "messages": ("conv_id long, messages array<struct<role:string,content:string>>, extra int", [(1, [("user", "q"), ("assistant", "a")], 5)]),
    "from and value": ("conv_id long, conversations array<struct<`from`:string,value:string>>", [(1, [("human", "q"), ("gpt", "a")])]),
    "prompt and completion": ("conv_id long, prompt string, completion string", [(1, "q", "a")]),
    "prompt and response": ("conv_id long, prompt string, response string", [(1, "q", "a")]),
    "instruction and output": ("conv_id long, instruction string, output string", [(1, "q", "a")]),
    "instruction, input and output": ("conv_id long, instruction string, input string, output string", [(1, "q", "", "a")]),
    "turn rows": ("conv_id long, turn int, role string, text string", [(1, 0, "user", "q"), (1, 1, "assistant", "a")]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, name):
    schema, rows = LAYOUTS[name]
    df = spark.createDataFrame(rows, schema)
    assert chat.layout_of(df.schema) == name
    assert sorted(tuple(r) for r in chat.canonical_turns(df).collect()) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]


def test_layouts_with_clashing_names(spark):
    """Columns that other layouts know don't hide a layout; conversations without turns have no row."""
    for name in ("text", "turn", "role", "prompt", "input", "response"):
        schema, rows = LAYOUTS["messages"]
        df = spark.createDataFrame(rows, schema).withColumn(name, F.lit("x"))
        assert chat.layout_of(df.schema) == "messages" and chat.canonical_turns(df).count() == 2
    schema, rows = LAYOUTS["turn rows"]
    assert chat.layout_of(spark.createDataFrame(rows, schema).withColumn("prompt", F.lit("x")).withColumn("completion", F.lit("x")).schema) == "turn rows"
    none = spark.createDataFrame([(1, None, 5), (2, [], 5), (3, [("user", "q")], 5)], LAYOUTS["messages"][0])
    assert [r.conv_id for r in chat.canonical_turns(none).collect()] == [3]
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1).schema)


def test_chat_round_trip(spark, tmp_path):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\\\", "###", "####", "</turn>", "<\\/turn>", "\\c\\#", "### user: x</turn>\n", "", None, "a: b\n", "\\\\###\\"]
    rows = [(c, t, r, x) for c, roles in ((1, ("user", "assistant")), (2, ("sys: ###\\", None, "assistant"))) for t, x in enumerate(nasty * 30) for r in [roles[t % len(roles)]]]
    rows += [(3, None, "assistant", "late"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (None, 1, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(chat.canonical_turns(df.withColumn("block", F.lit(1))))
    whole = {r.conv_id: r for r in chat.assembled(formatted).collect()}
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda v: v)
        assert [(t.role, t.text) for t in got[c].turns] == [v[2:] for v in own]
        assert got[c].loss == [v[3] for v in own if v[2] == "assistant"]
        assert got[c].formatted_chars == len(whole[c].formatted)
        spans = [whole[c].formatted[s.begin : s.end] for s in whole[c].loss_spans]
        assert len(spans) == len(got[c].loss) and all("</turn>" not in s and "###" not in s for s in spans)
    df.where("false").write.parquet(str(tmp_path / "conversations.parquet"))
    only = queries.op8_chat_formatting(spark, str(tmp_path)).collect()
    text = "\\### Assistant: </turn> ok"
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in only] == [(-7, 2, len(text), hashlib.sha256(text.encode()).hexdigest())]


def test_four_languages():
    import numpy as np

    # Four languages, of which each word is sure; a fifth that no word is in.
    model = np.full((langid.BINS, 5), -9.0, np.float32)
    for k in range(4):
        model[k, k] = -1.0
    bins = np.array([0, 1, 2, 3] * 100 + [0] * 50, np.int32)
    shares, chosen = langid.infer(bins, np.arange(len(bins)), np.array([0, 400, 450]), model)
    assert chosen.tolist() == [[True] * 4 + [False], [True] + [False] * 4]
    assert shares[0].max() < 0.3


def test_stage_keeps_four_languages(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"{c}{c}{c}{i % 7}{c}{w}" for w in "abcdefgh"), c) for i in range(40) for c in "wxyz"], "doc_id long, text string, lang string")
    even = spark.createDataFrame([(1000, " ".join(f"{c}{c}{c}{i % 7}{c}{w}" for i in range(7) for w in "abcdefgh" for c in "wxyz"), None)], "doc_id long, text string, lang string")
    kept = queries.keep_known_language(spark, docs.union(even), str(tmp_path))
    assert kept.where("doc_id = 1000").count() == 1
