"""Elementwise, row, column and matrix arithmetic; distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import numeric as N
from ..operators.distance import distance
from .base import EVENTS, events, query, rounded, table

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query(f"select {_KEYS}, round(l_quantity + l_tax, 4) as result from lineitem")
def simd_add(spark, sf_dir):
    return rounded(N.add(_lines(spark, sf_dir), "l_quantity", "l_tax").select(*_KEYS.split(", "), "result"))


@query(f"select event_id, round(coalesce(val, 0) * weight, 4) as result from {EVENTS}")
def simd_multiply(spark, sf_dir):
    return rounded(N.multiply(events(spark, sf_dir), "val", "weight").select("event_id", "result"))


@query(f"select event_id, round(coalesce(val, 0) * 1.5, 4) as val from {EVENTS}")
def simd_scale(spark, sf_dir):
    return rounded(N.scale(events(spark, sf_dir).select("event_id", "val"), ["val"], 1.5))


@query(f"select round(sum(coalesce(val, 0) * weight), 2) as result from {EVENTS}")
def simd_dot(spark, sf_dir):
    return rounded(N.dot(events(spark, sf_dir), "val", "weight"), 2)


@query(f"select round(coalesce(sum(val * weight), 0), 2) as result from {EVENTS}")
def mt_dot(spark, sf_dir):
    return rounded(N.skip_dot(events(spark, sf_dir), "val", "weight"), 2)


@query("select c_custkey, round(c_acctbal + c_nationkey + c_custkey, 4) as row_sum from customer")
def simd_row_sums(spark, sf_dir):
    return rounded(N.row_sums(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey", "c_custkey"]).select("c_custkey", "row_sum"))


@query(f"select event_id, round(coalesce(val, 0) + weight, 4) as row_sum from {EVENTS}")
def mt_row_sums(spark, sf_dir):
    return rounded(N.skip_row_sums(events(spark, sf_dir), ["val", "weight", "kind"]).select("event_id", "row_sum"))


@query("select " + ", ".join(f"round(sum({c}), 2) as {c}" for c in PRICES) + " from lineitem")
def simd_column_sums(spark, sf_dir):
    return rounded(N.column_sums(_lines(spark, sf_dir), PRICES), 2)


@query(f"select event_id, round(coalesce(val, 0) / l, 9) as val, round(weight / l, 9) as weight from {EVENTS}, (select sqrt(sum(coalesce(val, 0) * coalesce(val, 0) + weight * weight)) as l from {EVENTS})")
def simd_normalize(spark, sf_dir):
    return rounded(N.normalize(events(spark, sf_dir).select("event_id", "val", "weight"), ["val", "weight"]), 9)


@query("""with m as (select o_custkey % 20 as i, cast(o_orderkey % 15 as bigint) as j, sum(floor(o_totalprice / 1000)) as v from orders group by 1, 2)
    select a.i, b.i as j, sum(a.v * b.v) as v from m a join m b using (j) group by 1, 2""")
def simd_matmul(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey % 20").alias("i"), F.expr("o_orderkey % 15").alias("j")).agg(F.sum(F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("v"))
    return N.matmul(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query("""select vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double * (i + 1))), 5) as first, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double)), 5) as second from embeddings""")
def matmul_dense(spark, sf_dir):
    b = np.stack([np.arange(1, 65), np.ones(64)], 1)
    out = N.matmul_dense(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", b)
    return rounded(out.select("vec_id", F.col("product")[0].alias("first"), F.col("product")[1].alias("second")), 5)


@query()
def simd_capabilities(spark, sf_dir):
    return N.capabilities(spark)


@query(f"""select event_id, round(coalesce(case when n > 1 and s > 0 then (val - m) / s end, 0), 6) as val_z, round(coalesce(case when n > 1 and s > 0 then (weight - m) / s end, 0), 6) as weight_z,
    round(coalesce(case when n > 1 and s > 0 then (b - m) / s end, 0), 6) as bucket_z from (select event_id, val, weight, bucket::double as b, list_count([val, weight, bucket]) as n, list_avg([val, weight, bucket]) as m, list_stddev_samp([val, weight, bucket]) as s from {EVENTS})""")
def mt_row_zscores(spark, sf_dir):
    return rounded(N.row_zscores(events(spark, sf_dir), ["val", "weight", "bucket"]).select("event_id", "val_z", "weight_z", "bucket_z"), 6)


@query(f"select event_id, round(case when val is null then 0 else 1 + val * (0.5 + val * 0.25) end, 3) as value from {EVENTS}")
def mt_poly_eval(spark, sf_dir):
    return rounded(N.poly_eval(events(spark, sf_dir), "val", [1, 0.5, 0.25]).select("event_id", "value"), 3)


@query(f"select event_id, round(tanh(coalesce(val, 0) / 100), 8) as val from {EVENTS}")
def parallel_tanh(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", (F.col("val") / 100).alias("val"))
    return rounded(N.tanh(df, ["val"]), 8)


_REDUCE = {"sum": "a + b + c", "mean": "(a + b + c) / 3", "min": "least(a, b, c)", "max": "greatest(a, b, c)", "stdev": "list_stddev_samp([a, b, c])"}
for _op, _sql in _REDUCE.items():

    def _run(spark, sf_dir, op=_op):
        return rounded(N.row_reduce(events(spark, sf_dir), ["val", "weight", "bucket"], op).select("event_id", "reduced"))

    query(f"select event_id, round({_sql}, 4) as reduced from (select event_id, coalesce(val, 0) as a, weight as b, bucket::double as c from {EVENTS})", f"row_reduce_{_op}")(_run)


@query("select event_id, round(value * 2 + 1, 4) as doubled from events")
def batch_transform(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(N.batch_transform(df, lambda f: f.assign(doubled=f["value"] * 2 + 1)[["event_id", "doubled"]], "event_id long, doubled double"))


_DISTANCE = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))",
    "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))",
    "chebyshev": "list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))",
    "cosine": "case when a.vec_id = b.vec_id then 0 else 1 - list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / sqrt(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * a.v[i])) * list_sum(list_transform(range(1, 65), lambda i: b.v[i] * b.v[i]))) end",
}
for _metric, _sql in _DISTANCE.items():

    def _run(spark, sf_dir, metric=_metric):
        df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        return distance(df, id="vec_id", vector="embedding", metric=metric, digits=6)

    query(f"with e as (select vec_id, embedding::double[] as v from embeddings) select a.vec_id as id_a, b.vec_id as id_b, round({_sql}, 6) as distance from e a, e b", f"distance_{_metric}")(_run)


@query("""with e as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) t(i) group by 1, 2)
    select vec_id as id_a, label as id_b, round(sqrt(sum((embedding[i]::double - m) * (embedding[i]::double - m))), 6) as distance from
    (select vec_id, embedding from embeddings) x, e group by 1, 2""")
def distance_to_centres(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    each = df.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    return rounded(distance(df.select("vec_id", "embedding"), centres.withColumnRenamed("label", "vec_id"), id="vec_id", vector="embedding"), 6)
