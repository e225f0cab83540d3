"""Live feeds as streaming DataFrames: clock, counter, sine and random topics, pushed when they change; file and folder watches."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Milliseconds between values of a topic, and between pushes.
CLOCK, COUNTER, SINE, RANDOM, PUSH = 250, 1000, 50, 100, 250
#: Topics of one registry at most.
MOST_TOPICS = 1024


def _number(text: str, default: float) -> float:
    try:
        value = float(text)
    except ValueError:
        return default
    return value if value > 0 and value != float("inf") else default


def _any_number(text: str, default: float) -> float:
    """Zero and negative numbers are what they are."""
    try:
        return float(text)
    except ValueError:
        return default


def _ticks(spark: SparkSession, milliseconds: float) -> DataFrame:
    """A row every so many milliseconds: value (0, 1, 2...) and timestamp."""
    if milliseconds >= 1000:
        per, step = 1, round(milliseconds / 1000)
    else:
        per, step = max(1, round(1000 / milliseconds)), 1
    rows = spark.readStream.format("rate").option("rowsPerSecond", per).option("numPartitions", 1).load()
    return rows.where(F.col("value") % step == 0).withColumn("value", F.floor(F.col("value") / step)) if step > 1 else rows


def feed(spark: SparkSession, topic: str) -> DataFrame:
    """A stream of topic, timestamp and value (text): ``clock``, ``counter:N`` (ms), ``sine:frequency:amplitude`` or ``random``."""
    name, *rest = topic.strip().split(":")
    name = name.lower()
    if name == "clock":
        rows, value = _ticks(spark, CLOCK), F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "HH:mm:ss.SSS")
    elif name == "counter":
        rows, value = _ticks(spark, _number(rest[0], COUNTER) if rest else COUNTER), (F.col("value") + 1).cast("string")
    elif name == "sine":
        frequency, amplitude = (_any_number(rest[i], 1.0) if len(rest) > i else 1.0 for i in (0, 1))
        rows = _ticks(spark, SINE)
        value = (F.lit(amplitude) * F.sin(F.lit(2 * 3.141592653589793 * frequency) * F.unix_micros("timestamp") / 1e6)).cast("string")
    elif name == "random":
        rows, value = _ticks(spark, RANDOM), F.rand().cast("string")
    else:
        raise ValueError(f"no topic {topic!r}")
    return rows.select(F.lit(topic).alias("topic"), "timestamp", value.alias("value"))


class Feeds:
    """One query for each different topic, started by its first subscriber and stopped after its last; subscribers get changed values only."""

    def __init__(self, spark: SparkSession, most: int = MOST_TOPICS, push: int = PUSH):
        self.spark, self.most, self.push = spark, most, push
        self.latest: dict[str, str] = {}
        self.queries: dict[str, object] = {}
        self.subscribers: dict[str, list] = {}

    def subscribe(self, topic: str, receive) -> None:
        """``receive(topic, value)`` is called from then on, at most once a push interval, when the value has changed."""
        if topic not in self.queries:
            if len(self.queries) >= self.most:
                raise ValueError(f"there are {self.most} topics already")
            stream = feed(self.spark, topic)
            self.queries[topic] = stream.writeStream.trigger(processingTime=f"{self.push} milliseconds").foreachBatch(lambda df, n, t=topic: self._push(t, df)).start()
        self.subscribers.setdefault(topic, []).append(receive)

    def _push(self, topic: str, batch: DataFrame) -> None:
        last = batch.agg(F.max_by("value", "timestamp").alias("v")).first()["v"]  # one value
        if last is not None and self.latest.get(topic) != last:
            self.latest[topic] = last
            for receive in list(self.subscribers.get(topic, [])):
                receive(topic, last)

    def unsubscribe(self, topic: str, receive) -> None:
        left = self.subscribers.get(topic, [])
        left.remove(receive)
        if not left:
            self.subscribers.pop(topic)
            self.latest.pop(topic, None)
            self.queries.pop(topic).stop()

    def stop(self) -> None:
        for query in self.queries.values():
            query.stop()
        self.queries.clear(), self.subscribers.clear(), self.latest.clear()


def changes_only(stream: DataFrame, topic: str = "topic", value: str = "value", at: str = "timestamp") -> DataFrame:
    """Rows of a stream whose value differs from the one before it in its topic, by state kept for each topic."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{topic} {kinds[topic]}, {at} {kinds[at]}, {value} {kinds[value]}"

    def run(key, frames: Iterator[pd.DataFrame], state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(at)
        keep = rows[value].ne(rows[value].shift(fill_value=last) if last is not None else rows[value].shift())
        if len(rows):
            state.update((rows[value].iloc[-1],))
        yield rows.loc[keep, [topic, at, value]]

    return stream.groupBy(topic).applyInPandasWithState(run, schema, f"last {kinds[value]}", "append", "NoTimeout")


class _WatchReader(SimpleDataSourceStreamReader):
    """Compares snapshots of a path; a row for every created, changed or deleted entry."""

    def __init__(self, path: str, folder: bool):
        self.path, self.folder = path, folder

    def _snapshot(self) -> dict[str, list]:
        paths = []
        if self.folder:
            with os.scandir(self.path) if os.path.isdir(self.path) else _Nothing() as entries:
                paths = [e.path for e in entries]
        elif os.path.exists(self.path):
            paths = [self.path]
        out = {}
        for p in paths:
            try:
                s = os.stat(p)
                out[p] = [s.st_mtime_ns, s.st_size]
            except OSError:
                pass
        return out

    def initialOffset(self) -> dict:
        return {"count": 0, "files": self._snapshot()}

    def read(self, start: dict):
        before, now = start["files"], self._snapshot()
        rows = []
        for p in sorted({*before, *now}):
            kind = "created" if p not in before else "deleted" if p not in now else "changed" if before[p] != now[p] else None
            if kind:
                rows.append((start["count"] + len(rows) + 1, p, kind))
        return iter(rows), {"count": start["count"] + len(rows), "files": now}

    def readBetweenOffsets(self, start: dict, end: dict):
        before, now, rows = start["files"], end["files"], []
        for p in sorted({*before, *now}):
            if before.get(p) != now.get(p):
                rows.append((start["count"] + len(rows) + 1, p, "created" if p not in before else "deleted" if p not in now else "changed"))
        return iter(rows)


class _Nothing:
    def __enter__(self):
        return []

    def __exit__(self, *_):
        return None


class WatchSource(DataSource):
    """Streaming source ``watch``: options ``path`` and ``folder`` (true or false); rows of change (a counter), path and kind."""

    @classmethod
    def name(cls) -> str:
        return "watch"

    def schema(self) -> str:
        return "change long, path string, kind string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _WatchReader(self.options["path"], self.options.get("folder", "false") == "true")


def _watch(spark: SparkSession, path: str, folder: bool) -> DataFrame:
    if not os.path.isabs(path):
        raise ValueError(f"a watched path is absolute, and {path!r} is not")
    spark.dataSource.register(WatchSource)
    return spark.readStream.format("watch").option("path", path).option("folder", str(folder).lower()).load()


def watch_file(spark: SparkSession, path: str) -> DataFrame:
    """Changes of one file (on the driver's file system)."""
    return _watch(spark, path, False)


def watch_folder(spark: SparkSession, path: str) -> DataFrame:
    """Changes of the entries of a folder, not of those below."""
    return _watch(spark, path, True)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by key and tumbling window of event time; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n"))


__all__ = ["Feeds", "WatchSource", "changes_only", "feed", "watch_file", "watch_folder", "windowed_counts"]
