"""Distances of all pairs: whole results, their size, and blocks whose rows come in another order."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridloom import catalog
from gridloom.operators import distance

METRICS = ["chebyshev", "cosine", "euclidean", "manhattan"]


@pytest.mark.parametrize("metric", METRICS)
def test_all_pairs_written(spark, tmp_path, metric):
    """Every pair once, as in SQL, in less than the eight bytes that a distance takes when it is kept twice."""
    rng, duck = np.random.default_rng(7), duckdb.connect()
    vectors = pa.table({"vec_id": pa.array(rng.permutation(1000)), "embedding": pa.array(list(rng.normal(size=(1000, 64)).astype("float32")))})
    duck.execute(f"copy vectors to '{tmp_path}/embeddings.parquet' (format parquet)")
    catalog.queries()[f"distance_{metric}"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    size = sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet"))
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    duck.execute(f"create view got as select * from '{tmp_path}/out/*.parquet'")
    assert duck.execute("select count(*), count(distinct (id_a, id_b)) from got").fetchone() == (1_000_000, 1_000_000)
    off = f"select count(*), max(abs(g.distance - w.distance)) from got g join ({catalog.oracles()[f'distance_{metric}']}) w using (id_a, id_b)"
    n, most = duck.execute(off).fetchone()
    assert n == 1_000_000 and most < 1.5e-6
    assert size / n < 6.5


@pytest.mark.parametrize("metric", METRICS)
def test_block_in_two_orders(metric):
    """A block paired with itself: its rows may come in one order on the left and in another on the right."""
    v = np.random.default_rng(3).normal(size=(40, 5))
    rows = [{"id": i, "v": list(x)} for i, x in enumerate(v)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([rows], kind), pa.array([0]), pa.array([rows[::-1]], kind)], names=["block_a", "rows_a", "block_b", "rows_b"])
    got = {(r["id_a"], r["id_b"]): r["distance"] for out in distance._measured(batch, metric, True) for r in out.to_pylist()}
    want = distance.block_distances(v, v, metric)
    assert len(got) == 1600 and all(abs(d - (want[i, j] if i != j else 0)) < 1e-12 for (i, j), d in got.items())
    assert all((d == 0) == (i == j) for (i, j), d in got.items())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_entries_in_order(metric):
    """Entries are added from the first to the last, as SQL does, so that results have the same last bits."""
    x, y = np.random.default_rng(4).normal(size=(2, 50, 64))
    away, want = np.abs(x[:, None] - y[None]), np.zeros((50, 50))
    for i in range(64):
        want = want + (away[..., i] ** 2 if metric == "euclidean" else away[..., i])
    assert np.array_equal(distance.block_distances(x, y, metric), np.sqrt(want) if metric == "euclidean" else want)


def test_rounded_as_sql():
    """Numbers next to the middle of two results, where Spark's round, which goes by the decimal digits, differs from SQL's."""
    ties = (np.random.default_rng(5).integers(-4_000_000, 4_000_000, 20_000) + 0.5) / 1e6
    d = np.concatenate([ties, np.nextafter(ties, 9), np.nextafter(ties, -9), [0.0, -2e-16, 0.49999999999999994e-6, 1e300, np.inf]])
    duck = duckdb.connect()
    duck.register("numbers", pa.table({"d": d}))
    want = duck.execute("select round(d, 6) as d from numbers").fetchnumpy()["d"]
    got = distance._round(d, 6)
    assert np.array_equal(got, want) and not np.signbit(got[got == 0]).any()
    assert np.isnan(distance._round(np.array([np.nan]), 6)).all()


def test_ties_as_sql(spark, tmp_path):
    """Distances whose seventh digit is a 5 and the last: rows equal SQL's exactly."""
    ties = (np.random.default_rng(6).integers(1_000_000, 4_000_000, 99) + 0.5) / 1e6
    vectors = np.zeros((100, 64), "float32")
    left = ties.copy()
    for i in range(3):  # three floats hold a double, the first cut off and not rounded
        bits = np.floor(left * 2.0 ** (20 * (i + 1))) / 2.0 ** (20 * (i + 1)) if i < 2 else left
        vectors[1:, i], left = bits, left - bits
    assert np.array_equal(vectors[1:].astype("float64").sum(1), ties)
    duck = duckdb.connect()
    duck.register("made", pa.table({"vec_id": np.arange(100), "embedding": list(vectors)}))
    duck.execute(f"copy made to '{tmp_path}/embeddings.parquet' (format parquet)")
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = duck.execute(catalog.oracles()["distance_manhattan"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["distance_manhattan"](spark, str(tmp_path)).collect()]
    assert len(got) == 10_000 and sorted(got) == sorted(want)
