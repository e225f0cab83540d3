"""Text, regular expressions, dates, JSON in cells."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import regex as X
from ..functions import text as T
from ..operators.dates import workday_add
from .base import EVENTS, events, query, table

PHRASE = "concat(event_type, '-', cast(user_id as string), ' o''neil ', event_type)"
_PHRASE = "event_type || '-' || cast(user_id as varchar) || ' o''neil ' || event_type"


def _phrases(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(PHRASE).alias("t"))


def _cap(x: str) -> str:
    return f"upper({x}[1]) || lower({x}[2:])"


@query(f"select event_id, {_cap('event_type')} || '-' || cast(user_id as varchar) || ' O''Neil ' || {_cap('event_type')} as t from events")
def proper(spark, sf_dir):
    return _phrases(spark, sf_dir).select("event_id", T.proper(F.col("t")).alias("t"))


@query(f"select event_id, case when kind = upper(kind) and length(kind) > 1 then kind else {_cap('kind')} end || ' O''neil' as t from {EVENTS}")
def title_case(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", T.title_case(F.concat("kind", F.lit(" o'neil"))).alias("t"))


@query(f"select event_id, lower(event_type) || cast(user_id as varchar) || 'O' || 'Neil' || {_cap('event_type')} as t from events")
def camel_case(spark, sf_dir):
    return _phrases(spark, sf_dir).select("event_id", T.camel_case(F.col("t")).alias("t"))


@query(f"select event_id, case when length(kind) < 6 and kind <> '' then lpad(kind, 6, '*') else kind end as l, case when length(kind) < 6 and kind <> '' then rpad(kind, 6, '.') else kind end as r, case when length(user_text) < 4 then lpad(user_text, 4, '0') else user_text end as z from {EVENTS}")
def padding(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", T.pad_left(F.col("kind"), 6, "*").alias("l"), T.pad_right(F.col("kind"), 6, ".").alias("r"), T.zero_pad(F.col("user_text"), 4).alias("z"))


@query(f"select event_id, repeat(kind, 3) as t, reverse(kind) as r from {EVENTS}")
def repeat_and_reverse(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", T.repeat(F.col("kind"), 3).alias("t"), T.reverse(F.col("kind")).alias("r"))


@query("select doc_id, reverse(text) as r from documents")
def reverse_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.reverse(F.col("text")).alias("r"))


@query("select p_partkey, replace(p_brand, 'Brand', 'B') as every, 'Brand#' || p_brand[7:] || '/' || 'Mark#' || p_brand[7:] as second from part")
def substitute(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.substitute(F.col("p_brand"), "Brand", "B").alias("every"), T.substitute(F.concat("p_brand", F.lit("/"), "p_brand"), "Brand", "Mark", 2).alias("second"))


@query("select p_partkey, replace(replace(p_type, 'E', '3'), 'A', '4') as t from part")
def substitute_all(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.substitute_all(F.col("p_type"), ["E", "", "A"], ["3", "x", "4"]).alias("t"))


@query("select n_nationkey, 'Nation ' || n_name || ' {' || cast(n_regionkey as varchar) || '} ' || cast(n_nationkey as varchar) || '-' || n_name || ' {3} {other}' as filled from nation")
def template_fill(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return T.template_fill(df, "Nation {N_NAME} {{{2}}} {0}-{1} {3} {other}").select("n_nationkey", "filled")


@query(f"select event_id, coalesce(regexp_matches(kind, '(?i)^[cp]'), false) as t, coalesce(length(regexp_replace(kind, '[^eE]', '', 'g')), 0) as n from {EVENTS}")
def regex_match_count(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.regex_match(F.col("kind"), "^[cp]", True).alias("t"), X.regex_count(F.col("kind"), "e", True).cast("bigint").alias("n"))


@query("select doc_id, len(regexp_extract_all(text, '[a-z]+[.]')) as n from documents")
def regex_count_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.regex_count(F.col("text"), "[a-z]+[.]").cast("bigint").alias("n"))


@query("select page_id, regexp_extract(url, '//([^/]+)/([a-z]+)', 1) as host, regexp_extract(url, '//([^/]+)/([a-z]+)', 2) as folder from pages")
def regex_extract(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    return df.select("page_id", *[X.regex_extract(F.col("url"), "//([^/]+)/([a-z]+)", g).alias(n) for g, n in ((1, "host"), (2, "folder"))])


@query("select page_id, array_to_string(regexp_extract_all(url, '[a-z]+'), ',') as words from pages")
def regex_extract_all(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.regex_extract_all(F.col("url"), "[a-z]+"), ",").alias("words"))


@query("select page_id, coalesce(w[1], '') as word_1, coalesce(w[2], '') as word_2, coalesce(w[3], '') as word_3 from (select page_id, regexp_extract_all(url, '[a-z]+') as w from pages)")
def regex_extract_all_spread(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    return X.spread(df, X.regex_extract_all(F.col("url"), "[a-z]+"), "word", 3).select("page_id", "word_1", "word_2", "word_3")


@query("select page_id, array_to_string(string_split_regex(url, '[/.?#]+'), ',') as parts from pages")
def regex_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.regex_split(F.col("url"), "[/.?#]+"), ",").alias("parts"))


@query("""with d as (select cast(x as date) as day, isodow(x) < 6 and x not in (date '1995-12-25', date '1996-01-01', date '1996-07-04') as working from generate_series(date '1985-01-01', date '2035-01-01', interval 1 day) t(x)),
    w as (select day, working, coalesce(sum(working::int) over (order by day rows between unbounded preceding and 1 preceding), 0) as before from d),
    o as (select o_orderkey, cast(o_orderdate as date) as day, cast(o_orderkey % 41 - 20 as bigint) as n from orders),
    s as (select o.*, w.before, w.working from o join w using (day))
    select o_orderkey, case when n = 0 then s.day else t.day end as workday from s left join (select day, before from w where working) t on t.before = case when n > 0 then s.before + n - case when s.working then 0 else 1 end else s.before + n end""")
def workday_add_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.expr("o_orderkey % 41 - 20").alias("n"))
    off = [dt.date(1995, 12, 25), dt.date(1996, 1, 1), dt.date(1996, 7, 4)]
    return workday_add(df, "day", "n", holidays=off).select("o_orderkey", "workday")


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.json_path(F.col("props"), "k").alias("k"))


@query("""select event_id, case event_id % 4 when 0 then 'ok' when 1 then 'missing' when 2 then 'malformed' else 'blank' end as status from events""")
def json_path_status(spark, sf_dir):
    bad = F.expr("case event_id % 4 when 0 then props when 1 then '{\"z\": 1}' when 2 then '{\"k\": ' end")
    return table(spark, sf_dir, "events").select("event_id", J.json_path_status(bad, "$.k").alias("status"))


_FORMS = "case event_id % 4 when 0 then concat('[', props, ', 5, \"x\"]') when 1 then props when 2 then concat('[', props, ', {\"m\": null}]') else '7' end"


@query("""select event_id, cast(p as integer) as position, case when event_id % 4 = 1 then 'k' end as key,
    case event_id % 4 when 0 then case p when 0 then cast(json(props) as varchar) when 1 then '5' else 'x' end when 1 then json_extract_string(props, '$.k') when 3 then '7' end as value,
    case when event_id % 4 = 2 and p = 0 then json_extract_string(props, '$.k') end as k, null::varchar as m
    from events, (values (0), (1), (2)) t(p) where p < case event_id % 4 when 0 then 3 when 2 then 2 else 1 end""")
def parse_json_mixed(spark, sf_dir):
    """Documents of every form in one column, and arrays that hold more than objects."""
    return J.parse_json(table(spark, sf_dir, "events").select("event_id", F.expr(_FORMS).alias("doc")), "doc", order_by="event_id")


@query("""select event_id, cast(p as integer) as position, case p when 0 then json_extract_string(props, '$.k') when 1 then '7' end as k, case p when 1 then event_type end as kind
    from events, (values (0), (1)) t(p)""")
def parse_json(spark, sf_dir):
    text = F.concat(F.lit("["), "props", F.lit(', {"kind": "'), "event_type", F.lit('", "k": 7}]'))
    return J.parse_json(table(spark, sf_dir, "events").select("event_id", text.alias("doc")), "doc", order_by="event_id")
