"""Conditional aggregates, weighted statistics, grouping, conditional projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import lookup as L
from .base import EVENTS, events, query, rounded, table

CRITERIA = [("l_quantity", ">=24"), ("l_returnflag", "r")]
WHERE = "l_quantity >= 24 and upper(l_returnflag) = 'R'"


def flagship(spark, sf_dir):
    """Order value by market segment and price band: a lookup, a case and a group by."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    found = L.lookup_exact(orders, "o_custkey", customers, "c_custkey", ["c_mktsegment"], order_by="c_custkey", if_not_found="none")
    banded = A.case_when(found, "o_totalprice", [("<100000", "low"), ("<300000", "mid")], "high", out="band")
    return rounded(A.group_by(banded, ["c_mktsegment", "band"], "o_totalprice", "sum", order_by="o_orderkey"), 2)


query(
    """select c_mktsegment, band, min(o_orderkey) as first_seen, round(sum(o_totalprice), 2) as result from (
    select o.*, c.c_mktsegment, case when o_totalprice < 100000 then 'low' when o_totalprice < 300000 then 'mid' else 'high' end as band
    from orders o join customer c on o_custkey = c_custkey) group by 1, 2 order by 3""",
    "flagship_segment_bands",
)(flagship)


def _ifs(name: str, value: str, sql: str, criteria=CRITERIA, digits: int = 4, source: str = "lineitem", where: str = WHERE):
    op = getattr(A, name)

    def run(spark, sf_dir):
        df = events(spark, sf_dir) if source == "events" else table(spark, sf_dir, source)
        return rounded(op(df, criteria) if value == "" else op(df, value, criteria), digits)

    query(f"select {sql} as result from {EVENTS if source == 'events' else source} where {where}", name)(run)


_ifs("count_ifs", "", "count(*)")
_ifs("sum_ifs", "l_extendedprice", "round(coalesce(sum(l_extendedprice), 0), 2)", digits=2)
_ifs("average_ifs", "l_extendedprice", "round(avg(l_extendedprice), 4)")
_ifs("min_ifs", "l_extendedprice", "round(coalesce(min(l_extendedprice), 0), 4)")
_ifs("max_ifs", "l_extendedprice", "round(coalesce(max(l_extendedprice), 0), 4)")
_ifs("median_ifs", "l_extendedprice", "round(median(l_extendedprice), 4)")
_ifs("stdev_ifs", "l_extendedprice", "round(stddev_samp(l_extendedprice), 4)")
_ifs("stdevp_ifs", "l_extendedprice", "round(stddev_pop(l_extendedprice), 4)")
_ifs("var_ifs", "l_discount", "round(var_samp(l_discount), 8)", digits=8)
_ifs("varp_ifs", "l_discount", "round(var_pop(l_discount), 8)", digits=8)
_ifs("geomean_ifs", "l_extendedprice", "round(exp(avg(ln(l_extendedprice))), 4)")
_ifs("harmean_ifs", "l_extendedprice", "round(count(*) / sum(1 / l_extendedprice), 4)")
_ifs("distinct_count_ifs", "kind", "count(distinct upper(nullif(kind, '')))", criteria=[("val", ">100")], source="events", where="val > 100")


@query(f"""select count(*) filter (where kind is null or kind = '') as blank_kind, count(*) filter (where kind <> '') as any_kind,
    count(*) filter (where val is null) as blank_val, count(*) filter (where upper(kind) <> 'VIEW' or kind is null) as not_view,
    count(*) filter (where kind ilike 'p%') as starts_p, count(*) filter (where kind ilike '_ick%' or kind ilike '_lick') as wild,
    count(*) filter (where upper(kind) > 'ERROR') as after_error, count(*) filter (where ts >= timestamp '2024-01-15') as late,
    count(*) filter (where true) as text_against_number, count(*) filter (where val is null or val <> 5) as not_five from {EVENTS}""")
def criteria_grammar(spark, sf_dir):
    df = events(spark, sf_dir)
    ask = [("blank_kind", ("kind", "")), ("any_kind", ("kind", "<>")), ("blank_val", ("val", "=")), ("not_view", ("kind", "<>view")), ("starts_p", ("kind", "p*")), ("wild", ("kind", "?lick")), ("after_error", ("kind", ">error")), ("late", ("ts", ">=2024-01-15")), ("text_against_number", ("kind", "<>5")), ("not_five", ("val", "<>5"))]
    return A.aggregate_ifs(df, [(name, "count", "", [pair]) for name, pair in ask])


@query(f"""select count(*) filter (where val > 100) as n, round(sum(val) filter (where val > 100), 2) as total, round(avg(val) filter (where upper(kind) = 'CLICK'), 4) as clicks,
    round(max(val) filter (where user_id <= 20), 4) as top from {EVENTS}""")
def batched_ifs(spark, sf_dir):
    got = A.aggregate_ifs(events(spark, sf_dir), [("n", "count", "", [("val", ">100")]), ("total", "sum", "val", [("val", ">100")]), ("clicks", "average", "val", [("kind", "click")]), ("top", "max", "val", [("user_id", "<=20")])])
    return rounded(got.withColumn("total", F.round("total", 2)))


@query(f"select round(quantile_cont(l_extendedprice, 0.35), 4) as result from lineitem where {WHERE}")
def percentile_ifs(spark, sf_dir):
    return rounded(A.percentile_ifs(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.35, CRITERIA))


@query("""select x as result from (select p_size::double as x, count(*) as n, min(p_partkey) as o from part where p_brand like 'Brand#1%' group by 1)
    where n > 1 order by n desc, o limit 1""")
def mode_ifs(spark, sf_dir):
    return A.mode_ifs(table(spark, sf_dir, "part"), "p_size", [("p_brand", "Brand#1*")], order_by="p_partkey")


@query("select round(coalesce(product(1 + l_discount / 100), 0), 6) as result from lineitem where l_orderkey <= 40")
def product_ifs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("growth", 1 + F.col("l_discount") / 100)
    return rounded(A.product_ifs(df, "growth", [("l_orderkey", "<=40")]), 6)


@query(f"select arg_min(kind, event_id) as result from {EVENTS} where val > 200 and kind <> ''")
def first_ifs(spark, sf_dir):
    return A.first_ifs(events(spark, sf_dir), "kind", [("val", ">200")], order_by="event_id")


@query(f"select arg_max(kind, event_id) as result from {EVENTS} where val > 200 and kind <> ''")
def last_ifs(spark, sf_dir):
    return A.last_ifs(events(spark, sf_dir), "kind", [("val", ">200")], order_by="event_id")


@query("select string_agg(c_name, '; ' order by c_custkey) as result from customer where upper(c_mktsegment) = 'BUILDING' and c_acctbal > 5000")
def text_join_ifs(spark, sf_dir):
    return A.text_join_ifs(table(spark, sf_dir, "customer"), "c_name", "; ", [("c_mktsegment", "building"), ("c_acctbal", ">5000")], order_by="c_custkey")


@query(f"select round(coalesce(sum(l_extendedprice * l_discount), 0), 2) as result from lineitem where {WHERE}")
def sum_product_ifs(spark, sf_dir):
    return rounded(A.sum_product_ifs(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount", CRITERIA), 2)


@query(f"select round(sum(val * weight) / sum(weight) filter (where val is not null), 6) as result from {EVENTS}")
def weighted_average(spark, sf_dir):
    return rounded(A.weighted_average(events(spark, sf_dir), "val", "weight"), 6)


@query(f"select round(sum(val * weight) / sum(weight) filter (where val is not null), 6) as result from {EVENTS} where upper(kind) = 'VIEW'")
def weighted_average_ifs(spark, sf_dir):
    return rounded(A.weighted_average_ifs(events(spark, sf_dir), "val", "weight", [("kind", "view")]), 6)


@query(f"""select min(x) as result from (select x, sum(w) over (order by x) as upto, sum(w) over () as total from
    (select val as x, sum(weight) as w from {EVENTS} where val is not null and weight > 0 group by 1)) where upto * 2 >= total""")
def weighted_median(spark, sf_dir):
    return A.weighted_median(events(spark, sf_dir), "val", "weight")


@query(f"""select round(sqrt(sum(weight * (val - m) * (val - m)) / sum(weight)), 6) as result from {EVENTS}, (select sum(val * weight) / sum(weight) as m from {EVENTS}
    where val is not null and weight > 0) where val is not null and weight > 0""")
def weighted_stdev(spark, sf_dir):
    return rounded(A.weighted_stdev(events(spark, sf_dir), "val", "weight"), 6)


_GROUP = {
    "sum": "round(coalesce(sum(val), 0), 4)",
    "count": "count(*)",
    "average": "round(avg(val), 4)",
    "min": "coalesce(min(val), 0)",
    "max": "coalesce(max(val), 0)",
    "median": "round(median(val), 4)",
    "stdev": "round(stddev_samp(val), 4)",
    "stdevp": "round(stddev_pop(val), 4)",
    "var": "round(var_samp(val), 2)",
    "varp": "round(var_pop(val), 2)",
    "geomean": "round(exp(avg(ln(val))), 4)",
    "harmean": "round(count(val) / sum(1 / val), 4)",
    "countdistinct": "count(distinct val)",
    "first": "arg_min(val, event_id) filter (where val is not null)",
    "last": "arg_max(val, event_id) filter (where val is not null)",
}
for _op, _sql in _GROUP.items():

    def _run(spark, sf_dir, op=_op):
        return rounded(A.group_by(events(spark, sf_dir), ["kind"], "val", op, order_by="event_id", zeros=True), 2 if op.startswith("var") else 4)

    query(f"select arg_min(kind, event_id) as kind, min(event_id) as first_seen, {_sql} as result from {EVENTS} group by upper(coalesce(kind, '')) order by 2", f"group_by_{_op}")(_run)


@query(f"""with c as (select upper(kind) as k, bucket::double as x, count(*) as n, min(event_id) as o from {EVENTS} group by 1, 2),
    b as (select k, x from (select *, row_number() over (partition by k order by n desc, o) as r from c where n > 1) where r = 1)
    select g.kind, g.first_seen, b.x as result from (select upper(kind) as k, arg_min(kind, event_id) as kind, min(event_id) as first_seen from {EVENTS} group by 1) g left join b using (k) order by 2""")
def group_by_mode(spark, sf_dir):
    return A.group_by(events(spark, sf_dir), ["kind"], "bucket", "mode", order_by="event_id")


# Factors on both sides of 1, so that the product over any number of rows stays finite.
@query("""select l_returnflag, l_linestatus, min(l_orderkey * 10 + l_linenumber) as first_seen, round(product(1 + (l_discount - 0.05) / 1000), 6) as result from lineitem group by 1, 2 order by 3""")
def group_by_product(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("o", F.expr("l_orderkey * 10 + l_linenumber")).withColumn("g", 1 + (F.col("l_discount") - 0.05) / 1000)
    return rounded(A.group_by(df, ["l_returnflag", "l_linestatus"], "g", "product", order_by="o"), 6)


@query(f"""select event_id, case when upper(kind) = 'CLICK' then 'c' when kind ilike 'p%' then 'p' when kind = '' then 'blank' end as result from {EVENTS}""")
def case_when_text(spark, sf_dir):
    return A.case_when(events(spark, sf_dir), "kind", [("click", "c"), ("p*", "p"), ("", "blank")]).select("event_id", "result")


@query(f"select event_id, case when val > 300 then 'A' when val > 100 then 'B' when val is null then 'none' else 'C' end as result from {EVENTS}")
def case_when_number(spark, sf_dir):
    return A.case_when(events(spark, sf_dir), "val", [(">300", "A"), (">100", "B"), ("", "none")], "C").select("event_id", "result")
