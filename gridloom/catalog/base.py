"""Registration of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (query, SQL or None)
ENTRIES: dict[str, tuple] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        ENTRIES[name or f.__name__] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with cells the tables don't have: blanks, empty text, mixed case, numbers as text, a weight."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.expr("case when event_id % 7 = 0 then null else value end").alias("val"),
        F.expr("case when event_id % 11 = 0 then '' when event_id % 2 = 0 then upper(event_type) else event_type end").alias("kind"),
        F.expr("case when event_id % 5 = 0 then 'n/a' else cast(user_id as string) end").alias("user_text"),
        F.expr("cast(case when event_id % 13 = 0 then 0 else user_id end as double)").alias("weight"),
        F.expr("cast(floor(value / 10) as bigint)").alias("bucket"),
        "props",
    )


#: The same for DuckDB.
EVENTS = """(select event_id, ts, user_id, case when event_id % 7 = 0 then null else value end as val,
  case when event_id % 11 = 0 then '' when event_id % 2 = 0 then upper(event_type) else event_type end as kind,
  case when event_id % 5 = 0 then 'n/a' else cast(user_id as varchar) end as user_text,
  cast(case when event_id % 13 = 0 then 0 else user_id end as double) as weight,
  cast(floor(value / 10) as bigint) as bucket, props from events)"""


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
