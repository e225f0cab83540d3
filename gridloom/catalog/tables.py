"""Cleaning, deduplication, reshaping, sorting, hashing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as R
from .base import EVENTS, events, query, rounded, table


@query("select doc_id, trim(regexp_replace(text, '[\\s\\x{0085}\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}\\v]+', ' ', 'g')) as text from documents")
def trim_block(spark, sf_dir):
    return R.trim_block(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"select event_id, user_text, case when user_text <> 'n/a' then cast(user_text as double) end as user_text_num from {EVENTS}".replace("cast(user_text as double)", "try_cast(user_text as double)"))
def coerce_numeric(spark, sf_dir):
    return R.coerce_numeric(events(spark, sf_dir).select("event_id", "user_text"))


@query("select event_id, trim(event_type) as event_type, cast(user_id as double) as user_text from events")
def clean_range(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("event_type"), F.col("user_id").cast("string").alias("user_text"))
    return R.clean_range(df)


@query(f"select min(event_id) as event_id, kind, user_id from {EVENTS} group by kind, user_id")
def remove_duplicate_rows(spark, sf_dir):
    return R.remove_duplicate_rows(events(spark, sf_dir).select("event_id", "kind", "user_id"), ["kind", "user_id"], order_by="event_id")


@query("""select 'r_name' as key, max(r_name) filter (where r_regionkey = 0) as "0", max(r_name) filter (where r_regionkey = 1) as "1", max(r_name) filter (where r_regionkey = 2) as "2",
    max(r_name) filter (where r_regionkey = 3) as "3", max(r_name) filter (where r_regionkey = 4) as "4" from region""")
def transpose(spark, sf_dir):
    return R.transpose(table(spark, sf_dir, "region"), "r_regionkey")


@query(f"select event_id, coalesce(nullif(kind, ''), 'none') as kind from {EVENTS}")
def fill_blanks(spark, sf_dir):
    return R.fill_blanks(events(spark, sf_dir).select("event_id", "kind"), "none", ["kind"])


@query(f"select event_id, last_value(val ignore nulls) over (order by event_id) as val, last_value(nullif(kind, '') ignore nulls) over (order by event_id) as kind from {EVENTS}")
def fill_down(spark, sf_dir):
    return R.fill_down(events(spark, sf_dir).select("event_id", "val", "kind"), ["val", "kind"], order_by="event_id")


@query("select o_orderkey, split_part(o_orderpriority, '-', 1) as priority_1, split_part(o_orderpriority, '-', 2) as priority_2 from orders")
def split_column(spark, sf_dir):
    return R.split_column(table(spark, sf_dir, "orders"), "o_orderpriority", "-", prefix="priority").select("o_orderkey", "priority_1", "priority_2")


@query(f"select event_id, cast(event_id as varchar) || '|' || coalesce(kind, '') || '|' || cast(user_id as varchar) as joined from {EVENTS}")
def join_columns(spark, sf_dir):
    return R.join_columns(events(spark, sf_dir).select("event_id", "kind", "user_id"), "|").select("event_id", "joined")


@query("select p_partkey, replace(p_brand, 'Brand#', 'B-') as p_brand from part")
def find_replace(spark, sf_dir):
    return R.find_replace(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "Brand#", "B-")


@query("select p_partkey, regexp_replace(p_brand, '([A-Z])[a-z]+#([0-9])', '\\2\\1', 'g') as p_brand from part")
def find_replace_regex(spark, sf_dir):
    return R.find_replace(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "([A-Z])[a-z]+#([0-9])", "$2$1", regex=True)


@query("""select n_nationkey as "row", 0 as column_index, 'n_name' as "column", n_name as value from nation union all
    select n_nationkey, 1, 'n_regionkey', cast(n_regionkey as varchar) from nation""")
def stack_columns(spark, sf_dir):
    return R.stack_columns(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), order_by="n_nationkey")


@query("""select p_partkey, 'p_size' as "Attribute", cast(p_size as double) as "Value" from part union all select p_partkey, 'p_retailprice', p_retailprice from part""")
def unpivot(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return R.unpivot(df, ["p_partkey"])


@query(f"select distinct value from (select kind as value from {EVENTS} union all select cast(user_id as varchar) from {EVENTS}) where value <> ''")
def unique(spark, sf_dir):
    return R.unique(events(spark, sf_dir).select("event_id", "kind", "user_id"), order_by="event_id")


@query(f"select value, count(*) as count from (select kind as value from {EVENTS} union all select user_text from {EVENTS}) where value <> '' group by 1")
def unique_count(spark, sf_dir):
    return R.unique_count(events(spark, sf_dir).select("event_id", "kind", "user_text"), order_by="event_id")


@query("select s_suppkey, row_number() over (order by s_nationkey, s_acctbal desc, s_suppkey) as place from supplier")
def sort_block(spark, sf_dir):
    from pyspark.sql import Window

    df = R.sort_block(table(spark, sf_dir, "supplier"), ["s_nationkey", "s_acctbal"], [False, True], order_by="s_suppkey")
    # The place in the sorted block, by the keys of the sort, so that the order itself is compared.
    return df.select("s_suppkey", F.row_number().over(Window.orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")).cast("bigint").alias("place"))


@query("""select upper(sha256(string_agg(n_name || chr(31) || cast(n_regionkey as varchar) || chr(31) || chr(30), '' order by n_nationkey))) as result from nation""")
def sha256_block(spark, sf_dir):
    return R.sha256_block(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), order_by="n_nationkey")


@query()
def hash_block(spark, sf_dir):
    return R.hash_block(table(spark, sf_dir, "orders"), order_by="o_orderkey")


@query("select round(sum(x), 2) as total, count(*) as n from (select c_acctbal as x from customer union all select s_acctbal from supplier)")
def concat_blocks(spark, sf_dir):
    both = R.concat_blocks(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x")), table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x")))
    return rounded(both.agg(F.sum("x").alias("total"), F.count("*").alias("n")), 2)
