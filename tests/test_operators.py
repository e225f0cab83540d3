"""Edges of lookups, reshaping, series, text, numbers, dates, JSON and files."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import jsonx, regex, text
from gridloom.operators import cache, dates, distance, lookup, numeric, reshape, series
from gridloom.plans import ranges
from gridloom.sources import files


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_exact_lookup(spark):
    probes = spark.createDataFrame([(1, "A"), (2, "x"), (3, None), (4, "b")], "id int, p string")
    keys = spark.createDataFrame([(1, "a", "first"), (2, "A", "second"), (3, None, "blank"), (4, "B", None)], "o int, k string, r string")
    assert rows(lookup.xlookup(probes, "p", keys, "k", ["r"], order_by="o", if_not_found="?").select("id", "r"), "id") == [(1, "first"), (2, "?"), (3, "blank"), (4, None)]
    numbers = spark.createDataFrame([(1, 5.0)], "o int, k double")
    assert rows(lookup.xlookup(spark.createDataFrame([("5",)], "p string"), "p", numbers, "k", ["o"], order_by="o")) == [("5", None)]
    assert rows(lookup.block_lookup(spark.createDataFrame([("5",)], "p string"), 0, numbers.select("k", "o"), [1], order_by="o")) == [("5", 1)]
    with pytest.raises(ValueError):
        lookup.xlookup(probes, "p", keys, "k", ["r"], order_by="o", match_mode=2)
    with pytest.raises(ValueError):
        lookup.vlookup(probes, "p", keys, [9], order_by="o")


@pytest.mark.parametrize("few", [0, 2, lookup.FEW])
def test_floor_lookup(spark, monkeypatch, few):
    """Alike whether the table is laid out or its keys are literals."""
    monkeypatch.setattr(lookup, "FEW", few)
    keys = spark.createDataFrame([(1, 10.0, "a"), (2, 10.0, "b"), (3, 10.0, "c"), (4, 20.0, None)], "o int, k double, r string")
    probes = spark.createDataFrame([(1, 10.0), (2, 9.9), (3, 15.0), (4, 25.0), (5, None), (6, 10.0)], "id int, p double")
    got = rows(lookup.xlookup(probes, "p", keys, "k", ["r"], order_by="o", match_mode=-1, if_not_found="?").select("id", "r"), "id")
    assert got == [(1, "c"), (2, "?"), (3, "c"), (4, None), (5, "?"), (6, "c")]
    empty = keys.limit(0)
    assert {r[1] for r in rows(lookup.lookup_floor(probes, "p", empty, "k", ["r"], order_by="o").select("id", "r"))} == {None}
    # Cells that are no finite numbers are blanks, as keys and as probes.
    nan, odd = float("nan"), [7.0, 3.0, -4.0, 5.0, 11.0, 0.0]
    many = spark.createDataFrame([(i, k, str(k)) for i, k in enumerate([*odd, nan, None, float("-inf")])], "o int, k double, r string")
    asked = [-9.0, -4.0, -1.0, -0.0, 0.5, 3.0, 4.9, 5.0, 6.0, 10.9, 11.0, 1e300, nan]
    got = rows(lookup.lookup_floor(spark.createDataFrame(list(enumerate(asked)), "id int, p double"), "p", many, "k", ["r"], order_by="o").select("id", "r"), "id")
    below = [max((k for k in odd if k <= p), default=None) for p in asked]
    assert got == [(i, None if k is None else str(k)) for i, k in enumerate(below)]


def test_ranges_cover_all(spark):
    df = spark.range(5000).withColumn("x", F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") * 7919) % 1000).cast("double"))
    dealt = ranges.deal(df, "x", least=100)
    bounds = dealt.where("x is not null").groupBy(ranges.RANGE).agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy(ranges.RANGE).collect()
    assert len(bounds) > 5 and all(p.b < q.a for p, q in zip(bounds, bounds[1:]))


def test_moving_windows_over_range_borders(spark):
    n = 3000
    x = np.random.default_rng(1).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    got = [r.moving for r in series.moving(df, "v", 50, "sum", order_by="i", min_periods=1).orderBy("i").collect()]
    assert np.allclose(got, [x[max(0, i - 49) : i + 1].sum() for i in range(n)])
    with pytest.raises(ValueError):
        series.moving(df, "v", 0, "sum", order_by="i")


def test_running_and_fill(spark):
    df = spark.createDataFrame([(1, None, ""), (2, 2.0, "a"), (3, None, None), (4, 3.0, "")], "i int, v double, t string")
    assert [r[1] for r in rows(series.running(df, "v", "product", order_by="i").select("i", "running"), "i")] == [0, 2, 2, 6]
    assert [r[1] for r in rows(series.running(df, "v", "average", order_by="i").select("i", "running"), "i")] == [None, 2, 2, 2.5]
    assert [r[2] for r in rows(series.fill_forward(df, ["t"], order_by="i"), "i")] == [None, "a", "a", "a"]
    assert [r[1] for r in rows(series.fill_forward(df, ["v"], order_by="i", direction="up"), "i")] == [2, 2, 3, 3]


def test_ranks_and_outliers(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 1.0)], "i int, v double")
    want = {"eq": [1, 1, None, 3], "avg": [1.5, 1.5, None, 3], "dense": [1, 1, None, 2], "ordinal": [1, 2, None, 3]}
    for ties, ranks in want.items():
        assert [r[1] for r in rows(series.rank(df, "v", ties=ties, order_by="i").select("i", "rank"), "i")] == ranks
    assert series.percent_rank(df.limit(1), "v").first()["percent_rank"] is None
    flat = spark.createDataFrame([(i, 1.0) for i in range(9)] + [(9, 2.0)], "i int, v double")
    flags = {m: [r[1] for r in rows(series.outliers(flat, "v", m).select("i", "outlier"), "i")] for m in ("iqr", "mad")}
    assert flags["iqr"] == [False] * 9 + [True] and not any(flags["mad"])
    assert rows(series.quantiles(df, "v", [0.5, 2.0])) == [(0.5, 5.0), (2.0, None)]


def test_reshape_edges(spark):
    df = spark.createDataFrame([(1, "a|b", " x   y "), (2, "c", None), (3, None, "")], "i int, t string, u string")
    assert [r[1:] for r in rows(reshape.split_column(df, "t", "|").select("i", "t_1", "t_2"), "i")] == [("a", "b"), ("c", ""), ("", "")]
    assert reshape.trim_block(df).orderBy("i").first()["u"] == "x y"
    assert [r[0] for r in rows(reshape.join_columns(df, "-", ["i", "u"]).orderBy("i").select("joined"))][1:] == ["2-", "3-"]
    assert [r[0] for r in rows(reshape.unique(df, order_by="i", columns=["t"]))] == ["a|b", "c"]
    assert rows(reshape.find_replace(df, "([a-z])\\|", "<$1>$$", regex=True, columns=["t"]).select("t"))[0] == ("<a>$b",)
    with pytest.raises(ValueError):
        reshape.split_column(df, "t", "")
    import hashlib

    want = hashlib.sha256("".join(f"{t or ''}\x1f{u or ''}\x1f\x1e" for _, t, u in rows(df, "i")).encode()).hexdigest().upper()
    assert reshape.sha256_block(df, order_by="i").first()[0] == want
    other = df.withColumn("i", 4 - F.col("i"))
    assert reshape.hash_block(df, order_by="i").first()[0] != reshape.hash_block(other, order_by="i").first()[0]
    assert rows(reshape.sort_block(spark.createDataFrame([(1, "10"), (2, "9"), (3, "b"), (4, None), (5, "9")], "i int, k string"), ["k"], True, order_by="i").select("i")) == [(3,), (4,), (1,), (2,), (5,)]


def test_text(spark):
    df = spark.createDataFrame([("o'neil-smith 2nd",), ("NASA hello",), ("aaaa",), ("",), (None,)], "t string")
    one = lambda f: [r[0] for r in df.select(f(df.t)).collect()]
    assert one(text.proper)[0] == "O'Neil-Smith 2Nd"
    assert one(text.title_case)[:2] == ["O'neil-Smith 2Nd", "NASA Hello"]
    assert one(text.camel_case)[0] == "oNeilSmith2nd"
    assert one(lambda c: text.substitute(c, "aa", "b", 2))[2] == "aab"
    assert one(lambda c: text.substitute(c, "aa", "b", 3))[2] == "aaaa"
    assert one(lambda c: text.pad_left(c, 3, "0")) == ["o'neil-smith 2nd", "NASA hello", "aaaa", "", None]
    assert one(lambda c: text.repeat(c, 0))[0] == ""
    assert df.select(text.reverse(F.lit("a😀b"))).first()[0] == "b😀a"
    with pytest.raises(ValueError):
        text.repeat(df.t, -1)


def test_regex(spark):
    df = spark.createDataFrame([("ab12cd",), (None,)], "t string")
    assert [r[0] for r in df.select(regex.regex_match(df.t, "B1", True)).collect()] == [True, False]
    assert [r[0] for r in df.select(regex.regex_count(df.t, r"\d")).collect()] == [2, 0]
    assert df.select(regex.regex_extract(df.t, r"(\d)(x)?", 2), regex.regex_extract(df.t, r"(\d)", 5)).first()[:] == ("", "")
    assert regex.groups(r"(a)(?:b)(?<n>c)[(]\(") == 2
    assert df.select(regex.regex_split(df.t, r"(\d)")).collect()[0][0] == ["ab", "1", "", "2", "cd"]
    assert df.select(regex.regex_split(df.t, r"([a-z])(\d)?")).collect()[0][0] == ["", "a", "", "", "b", "1", "2", "c", "", "", "d", "", ""]


def test_workdays(spark):
    start = [dt.date(2024, 3, 1) + dt.timedelta(d) for d in range(12)]
    off = [dt.date(2024, 3, 4), dt.date(2024, 3, 13), dt.date(2024, 3, 9)]
    for mask in ("0000011", "1000000", "0101010"):
        df = spark.createDataFrame([(s, n) for s in start for n in range(-15, 16)], "s date, n int")
        for s, n, got in rows(dates.workday_add(df, "s", "n", mask, off)):
            d, left = s, abs(n)
            while left:
                d += dt.timedelta(1 if n > 0 else -1)
                left -= mask[d.weekday()] == "0" and d not in off
            assert got == d, (s, n, mask)
    with pytest.raises(ValueError):
        dates.workday_add(df, "s", "n", "1111111")


def test_distance(spark):
    a = spark.createDataFrame([(1, [1e8, 0.0]), (2, [1e8 + 1, 0.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    got = {(r.id_a, r.id_b): r.distance for r in distance.distance(a, id="id", vector="v").collect()}
    assert len(got) == 9 and got[1, 2] == got[2, 1] == 1.0 and got[1, 1] == 0.0
    cosine = {(r.id_a, r.id_b): r.distance for r in distance.distance(a, id="id", vector="v", metric="cosine").collect()}
    assert cosine[3, 3] == 0.0 and cosine[1, 3] == 1.0
    with pytest.raises(ValueError):
        distance.distance(a, id="id", vector="v", metric="none")
    named = spark.createDataFrame([("x", [None, 3.0]), ("y", [4.0, float("nan")])], "id string, v array<double>")
    got = {(r.id_a, r.id_b): r.distance for r in distance.distance(a, named, id="id", vector="v", metric="manhattan").collect()}
    assert len(got) == 6 and got[3, "x"] == 3.0 and got[3, "y"] == 4.0
    with pytest.raises(Exception, match="dimension"):
        distance.distance(a.union(spark.createDataFrame([(4, [1.0])], a.schema)), id="id", vector="v").collect()


def test_moving_median(spark, monkeypatch):
    """Against plain loops: blanks, series, several ranges and windows longer than a batch."""
    import random
    import statistics

    r = random.Random(3)
    cells = [(i, r.choice("ab"), None if r.random() < 0.2 else float(r.randrange(50))) for i in range(700)]
    df = spark.createDataFrame(cells, "i int, k string, v double").repartition(5)

    def want(series, window, least):
        out = {}
        for n, (i, _, _) in enumerate(series):
            frame = [v for _, _, v in series[max(0, n - window + 1) : n + 1] if v is not None]
            out[i] = statistics.median(frame) if frame and len(frame) >= least else None
        return out

    monkeypatch.setattr(ranges, "ROWS", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        for window, least in ((1, None), (5, 2), (40, 1), (90, 0), (1000, 1)):
            got = {x.i: x.moving for x in series.moving(df, "v", window, "median", order_by="i", min_periods=least).collect()}
            assert got == want(cells, window, window if least is None else least), window
            got = {x.i: x.moving for x in series.moving(df, "v", window, "median", order_by="i", min_periods=1, partition_by=["k"]).collect()}
            assert got == {i: v for k in "ab" for i, v in want([c for c in cells if c[1] == k], window, 1).items()}, window
        assert rows(series.moving(df.limit(0), "v", 3, "median", order_by="i")) == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_percentiles_of_groups_over_ranges(spark, monkeypatch):
    """One group with most rows, a null key and a group without numbers, against NumPy."""
    import random

    from gridloom.operators.aggregates import exact_percentiles

    r = random.Random(4)
    cells = [(r.choice(["hot"] * 8 + ["b", None]), float(r.randrange(300)) if r.random() < 0.9 else None) for _ in range(900)] + [("none", None), ("one", 7.0)]
    df = spark.createDataFrame(cells, "k string, v double")
    asked = [0.0, 0.25, 0.5, 0.9, 1.0]
    for held in (ranges.ROWS, 25):
        monkeypatch.setattr(ranges, "ROWS", held)
        got = {x.k: list(x)[1:] for x in exact_percentiles(df, F.col("v"), asked, ["k"]).collect()}
        assert set(got) == {"hot", "b", None, "one"}
        for k, values in got.items():
            assert values == pytest.approx(np.quantile([v for o, v in cells if o == k and v is not None], asked).tolist())
    assert list(exact_percentiles(df, F.col("v"), asked).first()) == pytest.approx(np.quantile([v for _, v in cells if v is not None], asked).tolist())
    assert exact_percentiles(df.limit(0), F.col("v"), [0.5]).first()[0] is None


def test_numbers(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, 3.0)], "i int, a double, b double")
    assert rows(numeric.normalize(df.select("a", "b").where("false"), ["a"])) == []
    assert [r[0] for r in rows(numeric.row_reduce(df, ["a", "b"], "min").orderBy("i").select("reduced"))] == [0, 0]
    assert [r[0] for r in rows(numeric.poly_eval(df, "a", [1, 1]).orderBy("i").select("value"))] == [3, 0]
    with pytest.raises(ValueError):
        numeric.row_reduce(df, ["a"], "nothing")
    assert numeric.capabilities(spark).count() == 1


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b c": [1, 2]}, "id": 1234567890123456789}'), (2, "{"), (3, None), (4, '{"a": null}')], "i int, j string")
    assert [r[0] for r in df.orderBy("i").select(jsonx.json_path(df.j, "a['b c'][1]")).collect()] == ["2", None, None, None]
    assert df.orderBy("i").select(jsonx.json_path(df.j, "$.id")).first()[0] == "1234567890123456789"
    assert [r[0] for r in df.orderBy("i").select(jsonx.json_path_status(df.j, "a")).collect()] == ["ok", "malformed", "blank", "null"]
    with pytest.raises(ValueError):
        jsonx.json_path(df.j, "a[")
    nested = spark.createDataFrame([(1, '[{"z": 1, "a": 2}, {"m": "x", "z": null}, 7]')], "i int, j string")
    table = jsonx.parse_json(nested, "j", order_by="i")
    assert [r.value for r in table.orderBy("position").collect()] == ['{"z":1,"a":2}', '{"m":"x","z":null}', "7"]
    assert table.columns == ["i", "position", "value"] and table.count() == 3
    mixed = [(1, '[{"z": 1, "key": 2}, {"m": "x", "z": null}]'), (2, '{"a": 7, "b": [1]}'), (3, "[9]"), (4, "5"), (5, '["{a", "b"]'), (6, "[]"), (7, "{}"), (8, "{oops"), (9, None)]
    got = jsonx.parse_json(spark.createDataFrame(mixed, "i int, j string"), "j", order_by="i").orderBy("i", "position")
    assert got.columns == ["i", "position", "key", "value", "z", "key_", "m"]
    blank = (None,) * 3
    assert rows(got) == [(1, 0, None, None, "1", "2", None), (1, 1, None, None, None, None, "x"), (2, 0, "a", "7", *blank), (2, 1, "b", "[1]", *blank), (3, 0, None, "9", *blank), (4, 0, None, "5", *blank), (5, 0, None, "{a", *blank), (5, 1, None, "b", *blank), (6, 0, None, None, *blank), (7, 0, None, None, *blank), (8, 0, None, None, *blank)]
    assert rows(jsonx.parse_json(spark.createDataFrame([(1, "[1, 2]")], "i int, j string"), "j", order_by="i").select("value")) == [("1",), ("2",)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'x,y\r\n1,"a ""q"" b"\r\n2,"two\r\nlines"\r\n3\r\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), header=True)
    assert [tuple(r) for r in df.collect()][:2] == [(1.0, 'a "q" b'), (2.0, "two\nlines")]
    (tmp_path / "bad.csv").write_text('x\n"open\n')
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "blank.csv").write_text("x,y\n1,2\n\n\n3\n")
    got = files.read_csv(spark, str(tmp_path / "blank.csv"), header=True)
    assert sorted(map(str, rows(got))) == ["(1.0, 2.0)", "(3.0, None)", "(None, None)", "(None, None)"]
    assert files.write_csv(df, str(tmp_path / "out"), header=True) == 3
    assert files.read_csv(spark, str(tmp_path / "out"), header=True).count() == 3


def test_csv_empty_text(spark, tmp_path):
    """Empty text, null and NUL inside quotes come back as they were, with and without cells over several lines."""
    cells = [("", "x"), (None, "y"), ("x", ""), ("", None), (None, None), ('a\0"b",\0', '"'), ('"', '""'), (" ", "")]
    for name, more in (("one", [("x", "plain")]), ("over", [("two\nlines", '\n"\0\r\n"')])):
        want = cells + more
        df = spark.createDataFrame(want, "a string, b string").repartition(2)
        assert files.write_csv(df, str(tmp_path / name), header=True) == len(want)
        got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / name), header=True).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    (tmp_path / "by_hand.csv").write_text('n,t\n1,\n"",""\n3\n')
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "by_hand.csv"), header=True).collect()]
    assert got == [(1.0, None), (None, ""), (3.0, None)]


def test_json_files(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"z": 1, "a": "x"}\n\n{"m": true}\n')
    got = files.read_ndjson(spark, str(tmp_path / "a.ndjson"))
    assert got.columns == ["z", "a", "m"] and got.count() == 2
    (tmp_path / "b.ndjson").write_text('{"z": 1}\n{oops\n')
    with pytest.raises(ValueError):
        files.read_ndjson(spark, str(tmp_path / "b.ndjson"))
    assert files.write_json(got.select("a", "z"), str(tmp_path / "j")) == 2
    assert files.read_json(spark, str(tmp_path / "j")).count() == 2
    files.write_json(spark.range(50).repartition(4), str(tmp_path / "ordered"), order_by="id")
    text = next(p for p in os.listdir(tmp_path / "ordered") if p.startswith("part"))
    assert (tmp_path / "ordered" / text).read_text().strip() == "[" + ",".join(f'{{"id":{i}}}' for i in range(50)) + "]"
    assert files.write_json(got.select("a", "z"), str(tmp_path / "k"), records=False) == 2
    import json

    part = next(p for p in os.listdir(tmp_path / "k") if p.startswith("part"))
    assert sorted(map(str, json.loads((tmp_path / "k" / part).read_text()))) == ["['x', 1]", "[None, None]"]


def test_folder_and_info(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "B.tsv").write_text("y\tz\n3\t4\n")
    (tmp_path / "c.jsonl").write_text('{"z": 5}\n')
    df = files.read_folder(spark, str(tmp_path))
    assert sorted(df.columns) == ["file", "x", "y", "z"] and df.count() == 3
    for i in range(5):
        (tmp_path / f"more{i}.csv").write_text(f"y,file\n{i},f\n" if i % 2 else f"x,y\n{i},{i}\n")
    (tmp_path / "d.jsonl").write_text("{oops\n")
    (tmp_path / "e.csv").write_text('x,y\n"open,1\n')
    df = files.read_folder(spark, str(tmp_path))
    assert df.count() == 8 and {r.file.rpartition("/")[2]: r.y for r in df.collect() if r.y} == {"a.csv": "2", "B.tsv": "3", **{f"more{i}.csv": str(i) for i in range(5)}}
    assert str(df._jdf.queryExecution().optimizedPlan()).count("Relation [") <= 6
    info = files.file_info(spark, [str(tmp_path / "a.csv"), str(tmp_path / "no")])
    assert [(r.exists, r.bytes) for r in info.collect()] == [(True, 8), (False, None)]


def test_caches(spark, tmp_path):
    memo = cache.Memo(most=3, evicted=2)
    for k in "abcd":
        memo.memoize(k, spark.range(1))
    assert list(memo.held) == ["c", "d"] and memo.clear("c") == 1 and memo.clear() == 1
    disk = cache.DiskCache(spark, f"file://{tmp_path}")
    assert disk.read("k") is None and disk.write("k", spark.range(3)) == 3 and disk.read("k").count() == 3
    assert disk.clear("k") == 1 and disk.clear("k") == 0
    place = disk._place("k").removeprefix("file://")
    disk.write("k", spark.range(3))
    os.rename(place, place + ".old")  # a write broken off between its moves
    assert disk.read("k").count() == 3 and disk.write("k", spark.range(4)) == 4 and disk.read("k").count() == 4
    for name in os.listdir(place):
        os.remove(os.path.join(place, name))
    with open(os.path.join(place, "part-0.parquet"), "w") as file:
        file.write("no parquet")
    spark.catalog.clearCache()
    assert disk.read("k") is None and not os.path.exists(place)


def test_template(spark):
    df = spark.createDataFrame([("a", 2)], "Name string, n int")
    one = lambda t: text.template_fill(df, t).first().filled
    assert one("{0}-{1}-{2}") == "a-2-{2}" and one("{NAME} { 1 } {+1} {{0}} {{{1}}} {no} {} {") == "a 2 2 {0} {2} {no} {} {" and one("{-1}}") == "{-1}}"


def test_sine_takes_any_number():
    from gridloom.streaming import feeds

    assert [feeds._any_number(x, 1.0) for x in ("-2", "0", "x", "1.5")] == [-2, 0, 1, 1.5] and feeds._number("-2", 7) == 7


def test_negative_threshold_is_the_default(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 100]], "v double")
    for method in ("iqr", "zscore", "mad"):
        assert rows(series.outliers(df, "v", method, -5.0)) == rows(series.outliers(df, "v", method))


def test_feeds(spark, tmp_path):
    from gridloom.streaming import feeds

    with pytest.raises(ValueError):
        feeds.feed(spark, "weather")
    hub, got = feeds.Feeds(spark), []
    receive = lambda topic, value: got.append(value)
    hub.subscribe("counter:200", receive)
    for _ in range(60):
        if len(got) >= 2:
            break
        hub.queries["counter:200"].awaitTermination(0.3)
    hub.unsubscribe("counter:200", receive)
    assert len(got) >= 2 and len(set(got)) == len(got) and not hub.queries

    folder = tmp_path / "watched"
    folder.mkdir()
    query = feeds.watch_folder(spark, str(folder)).writeStream.format("memory").queryName("watched").start()
    try:
        query.processAllAvailable()
        (folder / "new").write_text("x")
        for _ in range(40):
            query.processAllAvailable()
            if spark.table("watched").count():
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    assert spark.table("watched").first()["kind"] == "created"
    with pytest.raises(ValueError):
        feeds.watch_file(spark, "relative")
