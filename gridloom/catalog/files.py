"""Files, caches and live feeds. What they write goes below the shared folder of the session."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import functions as F

from ..operators import reshape as R
from ..operators.cache import DiskCache, Memo
from ..sources import files as S
from ..streaming.feeds import Feeds, changes_only, feed, watch_file, watch_folder
from .base import EVENTS, events, query, rounded, table


def _place(spark, name: str) -> str:
    """A new path in the folder that all executors reach; a local one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-files-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/gridloom-files/{name}-{uuid.uuid4().hex}"


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000")
def read_range(spark, sf_dir):
    return S.read_range(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], F.col("o_totalprice") > 200000)


@query(f"select event_id::double as event_id, coalesce(val, 0) as val, 0::double as kind, coalesce(try_cast(user_text as double), 0) as user_text from {EVENTS}")
def read_doubles(spark, sf_dir):
    return S.as_doubles(events(spark, sf_dir).select("event_id", "val", "kind", "user_text"))


@query(f"select cast(event_id as varchar) as event_id, coalesce(kind, '') as kind, user_text from {EVENTS}")
def read_strings(spark, sf_dir):
    return S.as_strings(events(spark, sf_dir).select("event_id", "kind", "user_text"))


@query("select s_suppkey, upper(s_name) as s_name from supplier")
def round_trip(spark, sf_dir):
    return R.round_trip(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), lambda df: df.withColumn("s_name", F.upper("s_name")))


@query("select s_suppkey, upper(s_name) as s_name from supplier")
def block_write(spark, sf_dir):
    """A block changed, written and read again."""
    return R.round_trip(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), lambda df: df.withColumn("s_name", F.upper("s_name")), _place(spark, "block"))


@query("select n_nationkey::double as n_nationkey, n_name, n_regionkey::double as n_regionkey from nation")
def csv_round_trip(spark, sf_dir):
    path = _place(spark, "csv")
    S.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, header=True)
    return S.read_csv(spark, path, header=True)


@query("select doc_id::double as doc_id, text, lang from documents")
def csv_documents(spark, sf_dir):
    path = _place(spark, "csv")
    S.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, header=True)
    return S.read_csv(spark, path, header=True)


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name from nation")
def json_round_trip(spark, sf_dir):
    path = _place(spark, "json")
    S.write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, order_by="n_nationkey")
    return S.read_json(spark, path).select("n_nationkey", "n_name")


@query("select c_custkey, c_name, c_acctbal from customer")
def ndjson_round_trip(spark, sf_dir):
    path = _place(spark, "ndjson")
    S.write_ndjson(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return S.read_ndjson(spark, path)


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, null::varchar as r_name from nation union all select null, null, r_name from region")
def read_folder(spark, sf_dir):
    folder = _place(spark, "folder")
    S.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{folder}/a", header=True, single_file=True)
    S.write_csv(table(spark, sf_dir, "region").select("r_name"), f"{folder}/b", header=True, single_file=True)
    return S.read_folder(spark, folder, "*.csv", recursive=True).drop("file")


@query("select true as present, count(*) as n from region union all select false, 0")
def file_info(spark, sf_dir):
    info = S.file_info(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/no such file"])
    n = table(spark, sf_dir, "region").agg(F.count("*").alias("n"))
    return info.select(F.col("exists").alias("present")).crossJoin(n).select("present", F.when(F.col("present"), F.col("n")).otherwise(0).alias("n"))


@query("select round(sum(s_acctbal), 2) as total, count(*) as n from supplier")
def memoize(spark, sf_dir):
    memo = Memo()
    memo.memoize("suppliers", table(spark, sf_dir, "supplier"))
    out = memo.get("suppliers").agg(F.sum("s_acctbal").alias("total"), F.count("*").alias("n"))
    return rounded(out, 2)


@query("select s_suppkey, s_acctbal from supplier")
def disk_cache(spark, sf_dir):
    cache = DiskCache(spark, _place(spark, "cache"))
    cache.write("suppliers", table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"))
    return cache.read("suppliers")


@query("select event_type, count(*) as n from events group by 1")
def streamed_counts(spark, sf_dir):
    """Events read as a stream, counted by type and read back from the sink."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    name = f"streamed_{uuid.uuid4().hex}"
    counts = stream.groupBy("event_type").agg(F.count("*").alias("n"))
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _place(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _first_values(spark, stream, n: int, order):
    """The first rows of a stream, from a memory sink; the stream is stopped then."""
    name = f"live_{uuid.uuid4().hex}"
    run = stream.writeStream.format("memory").queryName(name).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(50):
            run.awaitTermination(0.3)
            if spark.table(name).count() >= n:
                break
    finally:
        run.stop()
    return spark.table(name).orderBy(order).limit(n)


def _live(topic: str):
    def run(spark, sf_dir):
        return _first_values(spark, feed(spark, topic), 3, "timestamp").select("topic", "value")

    return run


for _topic in ("clock", "sine:0.5:2", "random"):
    query(name=f"live_{_topic.split(':')[0]}")(_live(_topic))
query("select 'counter:200' as topic, cast(i as varchar) as value from range(1, 4) t(i)", "live_counter")(_live("counter:200"))


@query("select 1::bigint as queries, true as both, 0::bigint as rest")
def live_multiplexed(spark, sf_dir):
    """Two subscribers to one topic share a query and get its values; it ends after the last of them."""
    feeds, got = Feeds(spark), {"a": [], "b": []}
    receive = {k: (lambda topic, value, k=k: got[k].append(value)) for k in got}
    for r in receive.values():
        feeds.subscribe("counter:200", r)
    n = len(feeds.queries)
    for _ in range(100):
        if all(got.values()):
            break
        time.sleep(0.2)
    both = bool(set(got["a"]) & set(got["b"]))
    for r in receive.values():
        feeds.unsubscribe("counter:200", r)
    return spark.createDataFrame([(n, both, len(feeds.queries))], "queries long, both boolean, rest long")


@query("select topic, value, n from (values ('a', 'x', 1), ('a', 'y', 3), ('b', 'x', 1)) t(topic, value, n)")
def live_changes_only(spark, sf_dir):
    """Values of topics that differ from the one before, by kept state; the repeats in between are left out."""
    path = _place(spark, "ticks")
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x")]
    spark.createDataFrame(rows, "topic string, n int, value string").coalesce(1).write.parquet(path)
    stream = changes_only(spark.readStream.schema("topic string, n int, value string").parquet(path), at="n")
    name = f"changes_{uuid.uuid4().hex}"
    run = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", _place(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("topic", "value", "n")


def _watched(watch, folder: bool):
    def run(spark, sf_dir):
        place = tempfile.mkdtemp(prefix="gridloom-watch-")  # watches are of the driver's own file system
        target = place if folder else f"{place}/file"
        stream, name = watch(spark, target), f"watch_{uuid.uuid4().hex}"
        run = stream.writeStream.format("memory").queryName(name).start()
        try:
            run.processAllAvailable()
            with open(f"{place}/file", "w") as file:
                file.write("x")
            for _ in range(50):
                run.processAllAvailable()
                if spark.table(name).count():
                    break
                run.awaitTermination(0.2)
        finally:
            run.stop()
        return spark.table(name).select("change", "kind")

    return run


query("select 1::bigint as change, 'created' as kind", "watch_file")(_watched(watch_file, False))
query("select 1::bigint as change, 'created' as kind", "watch_folder")(_watched(watch_folder, True))


@query("select 1 as removed, 1 as rest, 0 as missing")
def cache_clear(spark, sf_dir):
    memo = Memo()
    for key in ("a", "b"):
        memo.memoize(key, table(spark, sf_dir, "region"))
    removed, missing = memo.clear("a"), memo.clear("a")
    return spark.createDataFrame([(removed, memo.clear(), missing)], "removed int, rest int, missing int")


@query("select 1 as removed, 1 as rest, true as missing")
def disk_cache_clear(spark, sf_dir):
    cache = DiskCache(spark, _place(spark, "cache"))
    for key in ("a", "b"):
        cache.write(key, table(spark, sf_dir, "region"))
    removed = cache.clear("a")
    return spark.createDataFrame([(removed, cache.clear(), cache.read("b") is None)], "removed int, rest int, missing boolean")
