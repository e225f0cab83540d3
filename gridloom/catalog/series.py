"""Running, moving and ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from .base import EVENTS, events, query, rounded


#: Added before rounding, so that means that lie on a half are rounded alike whatever order they were summed in.
NUDGE = 0.0000003


def _base(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "val", "kind", "user_id", "bucket")


@query(f"select event_id, first_value(val ignore nulls) over (order by event_id rows between current row and unbounded following) as val from {EVENTS}")
def fill_forward_up(spark, sf_dir):
    return S.fill_forward(_base(spark, sf_dir).select("event_id", "val"), ["val"], order_by="event_id", direction="up")


@query(f"select event_id, val as a, coalesce(cast(bucket as double), val) as b from (select event_id, val, case when event_id % 3 = 0 then null else bucket end as bucket from {EVENTS})")
def fill_forward_right(spark, sf_dir):
    df = _base(spark, sf_dir).selectExpr("event_id", "val as a", "cast(case when event_id % 3 = 0 then null else bucket end as double) as b")
    return S.fill_forward(df, ["a", "b"], direction="right")


_RUNNING = {"sum": "coalesce(sum(val) over w, 0)", "count": "count(val) over w", "average": "avg(val) over w", "min": "coalesce(min(val) over w, 0)", "max": "coalesce(max(val) over w, 0)"}
for _op, _sql in _RUNNING.items():

    def _run(spark, sf_dir, op=_op):
        return rounded(S.running(_base(spark, sf_dir).select("event_id", "val"), "val", op, order_by="event_id").select("event_id", F.col("running") if op == "count" else (F.col("running") + NUDGE).alias("running")), 5)

    _value = _sql if _op == "count" else f"round({_sql} + {NUDGE}, 5)"
    query(f"select event_id, {_value} as running from {EVENTS} window w as (order by event_id rows unbounded preceding)", f"running_{_op}")(_run)


# Factors and their inverses by turns, so that the product over any number of rows stays finite.
_FACTOR = "case when event_id % 2 = 0 then 1 + val / 1e6 else 1 / (1 + val / 1e6) end as g"


@query(f"select event_id, round(coalesce(product(g) over (order by event_id rows unbounded preceding), 0), 4) as running from (select event_id, {_FACTOR} from {EVENTS})")
def running_product(spark, sf_dir):
    df = _base(spark, sf_dir).selectExpr("event_id", _FACTOR)
    return rounded(S.running(df, "g", "product", order_by="event_id").select("event_id", "running"))


@query(f"select event_id, round(coalesce(sum(val) over (partition by user_id order by event_id rows unbounded preceding), 0), 3) as running from {EVENTS}")
def running_sum_by_user(spark, sf_dir):
    return rounded(S.running(_base(spark, sf_dir), "val", "sum", order_by="event_id", partition_by=["user_id"]).select("event_id", "running"), 3)


_MOVING = {"sum": "sum(val)", "average": "avg(val)", "min": "min(val)", "max": "max(val)", "median": "median(val)", "stdev": "stddev_samp(val)", "count": "count(val)"}
for _op, _sql in _MOVING.items():

    def _run(spark, sf_dir, op=_op):
        return rounded(S.moving(_base(spark, sf_dir).select("event_id", "val"), "val", 20, op, order_by="event_id", min_periods=5).select("event_id", F.col("moving") if op == "count" else (F.col("moving") + NUDGE).alias("moving")), 4)

    _value = f"{_sql} over w" if _op == "count" else f"round({_sql} over w + {NUDGE}, 4)"
    query(f"select event_id, case when count(val) over w >= 5 then {_value} end as moving from {EVENTS} window w as (order by event_id rows between 19 preceding and current row)", f"moving_{_op}")(_run)


@query(f"select event_id, round(case when count(val) over w >= 3 then avg(val) over w end, 3) as moving from {EVENTS} window w as (partition by user_id order by event_id rows between 2 preceding and current row)")
def moving_average_by_user(spark, sf_dir):
    return rounded(S.moving(_base(spark, sf_dir), "val", 3, "average", order_by="event_id", partition_by=["user_id"]).select("event_id", "moving"), 3)


_STATS = {
    "iqr": f"select event_id, coalesce(val < a - 1.5 * (b - a) or val > b + 1.5 * (b - a), false) as outlier from {EVENTS}, (select quantile_cont(val, 0.25) as a, quantile_cont(val, 0.75) as b from {EVENTS})",
    "zscore": f"select event_id, coalesce(abs(val - m) > 3 * s, false) as outlier from {EVENTS}, (select avg(val) as m, stddev_samp(val) as s from {EVENTS})",
    "mad": f"select event_id, coalesce(0.6745 * abs(val - m) > 3 * d, false) as outlier from {EVENTS}, (select median(abs(val - m)) as d, any_value(m) as m from {EVENTS}, (select median(val) as m from {EVENTS}))",
}
for _method, _sql in _STATS.items():

    def _run(spark, sf_dir, method=_method):
        return S.outliers(_base(spark, sf_dir).select("event_id", "val"), "val", method).select("event_id", "outlier")

    query(_sql, f"outliers_{_method}")(_run)


@query(f"select p, round(case p when 0.1 then quantile_cont(val, 0.1) when 0.5 then quantile_cont(val, 0.5) else quantile_cont(val, 0.99) end, 4) as quantile from {EVENTS}, (values (0.1::double), (0.5::double), (0.99::double)) t(p) group by p")
def quantiles(spark, sf_dir):
    return rounded(S.quantiles(_base(spark, sf_dir), "val", [0.1, 0.5, 0.99]))


_RANK = {
    "eq": "rank() over (order by bucket desc)::double",
    "avg": "rank() over (order by bucket desc) + (count(*) over (partition by bucket) - 1) / 2",
    "dense": "dense_rank() over (order by bucket desc)::double",
    "ordinal": "row_number() over (order by bucket desc, event_id)::double",
}
for _ties, _sql in _RANK.items():

    def _run(spark, sf_dir, ties=_ties):
        return S.rank(_base(spark, sf_dir).select("event_id", "bucket"), "bucket", ties=ties, order_by="event_id").select("event_id", "rank")

    query(f"select event_id, {_sql} as rank from {EVENTS}", f"rank_{_ties}")(_run)


@query(f"select event_id, (rank() over (order by bucket) - 1) * 1000 // (count(*) over () - 1) / 1000 as percent_rank from {EVENTS}")
def percent_rank(spark, sf_dir):
    return S.percent_rank(_base(spark, sf_dir).select("event_id", "bucket"), "bucket").select("event_id", "percent_rank")
