"""Lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from .base import EVENTS, events, query, table

BANDS = [(0.0, "low"), (100000.0, "mid"), (300000.0, "high")]
_BANDS = "(values (0.0, 'low'), (100000.0, 'mid'), (300000.0, 'high')) t(k, band)"


@query("""select o_orderkey, coalesce(c_name, '?') as c_name, coalesce(c_mktsegment, '?') as c_mktsegment from
    (select o_orderkey, case when o_orderkey % 9 = 0 then -1 else o_custkey end as probe from orders) left join customer on probe = c_custkey""")
def xlookup_exact(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case when o_orderkey % 9 = 0 then -1 else o_custkey end").alias("probe"))
    return L.xlookup(orders, "probe", table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"], order_by="c_custkey", if_not_found="?").drop("probe")


@query(f"""select e.event_id, f.uid as found from {EVENTS} e left join (select upper(kind) as k, arg_min(user_id, event_id) as uid from {EVENTS} group by 1) f on upper(e.kind) = f.k""")
def xlookup_text_first_match(spark, sf_dir):
    df = events(spark, sf_dir)
    keys = df.select("event_id", F.col("kind").alias("key"), F.col("user_id").alias("found"))
    return L.xlookup(df.select("event_id", "kind"), "kind", keys, "key", ["found"], order_by="event_id").select("event_id", "found")


@query(f"select o_orderkey, band from orders asof left join {_BANDS} on o_totalprice >= k")
def xlookup_floor(spark, sf_dir):
    bands = spark.createDataFrame(BANDS, "k double, band string")
    return L.xlookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "k", ["band"], order_by="k", match_mode=-1).drop("o_totalprice")


@query("""select o_orderkey, e.event_id as found from (select o_orderkey, o_totalprice / 1000 as probe from orders) o asof left join
    (select round(value, 0) as k, max(event_id) as event_id from events group by 1) e on o.probe >= e.k""")
def floor_join_last_of_equals(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.expr("round(value, 0)").alias("k"), "event_id")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("probe"))
    return L.lookup_floor(orders, "probe", keys.withColumn("found", F.col("event_id")), "k", ["found"], order_by="event_id").select("o_orderkey", "found")


@query("select s_suppkey, n_name, n_regionkey from supplier left join nation on s_nationkey = n_nationkey")
def vlookup_exact(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return L.vlookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", nation, [2, 3], order_by="n_nationkey", range_lookup=False).drop("s_nationkey")


@query(f"select c_custkey, band from customer asof left join {_BANDS} on c_acctbal * 50 >= k")
def vlookup_range(spark, sf_dir):
    bands = spark.createDataFrame(BANDS, "k double, band string")
    df = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 50).alias("probe"))
    return L.vlookup(df, "probe", bands, [2], order_by="k").drop("probe")


@query("select n_nationkey, case n_regionkey when 0 then 'zero' when 1 then 'one' end as recoded from nation")
def map_values(spark, sf_dir):
    return L.map_values(table(spark, sf_dir, "nation"), "n_regionkey", [(0, "zero"), (1, "one"), (1, "again")], pass_through=False, out="recoded").select("n_nationkey", "recoded")


@query("select c_custkey, case upper(c_mktsegment) when 'BUILDING' then 'B' when 'MACHINERY' then 'M' else c_mktsegment end as segment from customer")
def map_values_pass_through(spark, sf_dir):
    return L.map_values(table(spark, sf_dir, "customer"), "c_mktsegment", [("building", "B"), ("Machinery", "M")], out="segment").select("c_custkey", "segment")


@query("select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id")
def block_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return L.block_lookup(docs, 1, labels, [1], order_by="id").drop("key")
