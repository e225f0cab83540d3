"""Named results: kept in the session, or as Parquet in a folder."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

#: Named results of a session at most, and how many of the oldest go when there are more.
MOST, EVICTED = 4096, 64


class Memo:
    """DataFrames by key, persisted; the ones written longest ago go first."""

    def __init__(self, most: int = MOST, evicted: int = EVICTED):
        self.most, self.evicted = most, evicted
        self.held: OrderedDict[str, DataFrame] = OrderedDict()

    def memoize(self, key: str, df: DataFrame) -> DataFrame:
        """Keeps ``df`` under the key and gives it back."""
        if key in self.held:
            self.held.pop(key).unpersist()
        elif len(self.held) >= self.most:
            for _ in range(min(self.evicted, len(self.held))):
                self.held.popitem(last=False)[1].unpersist()
        self.held[key] = df.persist()
        return self.held[key]

    def get(self, key: str, if_missing: DataFrame | None = None) -> DataFrame | None:
        return self.held.get(key, if_missing)

    def clear(self, key: str | None = None) -> int:
        """Drops one key or all; gives how many there were."""
        keys = [key] if key is not None else list(self.held)
        dropped = [self.held.pop(k) for k in keys if k in self.held]
        for df in dropped:
            df.unpersist()
        return len(dropped)


class DiskCache:
    """DataFrames by key as Parquet below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, key: str) -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"

    def write(self, key: str, df: DataFrame) -> int:
        """Writes beside the place and moves it there at the end, with what was there kept aside till then; gives the number of rows."""
        place, old = self._place(key), f"{self._place(key)}.old"
        df.write.mode("overwrite").parquet(f"{place}.tmp")
        if self.fs.exists(self.path(place)):
            self.fs.delete(self.path(old), True)
            self.fs.rename(self.path(place), self.path(old))
        if not self.fs.rename(self.path(f"{place}.tmp"), self.path(place)):
            raise OSError(f"{place} can't be written")
        self.fs.delete(self.path(old), True)
        return self.spark.read.parquet(place).count()

    def read(self, key: str, if_missing: DataFrame | None = None) -> DataFrame | None:
        """The rows, or ``if_missing`` if there are none or they can't be read; what can't be read is deleted."""
        place = self._place(key)
        if not self.fs.exists(self.path(place)):
            place += ".old"  # a write was broken off between its two moves
            if not self.fs.exists(self.path(place)):
                return if_missing
        try:
            df = self.spark.read.parquet(place)
            df.limit(1).count()
            return df
        except Exception as e:  # noqa: BLE001  only files that are no Parquet are of no use; a lost connection leaves them alone
            if not any(x in str(e) for x in ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "not a Parquet file", "FAILED_READ_FILE.PARQUET")):
                raise
            self.fs.delete(self.path(place), True)
            return if_missing

    def clear(self, key: str | None = None) -> int:
        if key is not None:
            return int(sum(bool(self.fs.delete(self.path(self._place(key) + end), True)) for end in ("", ".old")) > 0)
        if not self.fs.exists(self.path(self.folder)):
            return 0
        return sum(bool(self.fs.delete(s.getPath(), True)) for s in self.fs.listStatus(self.path(self.folder)))
