"""Run history, recent files, presets and cached results as tables that are kept: JSON lines, one folder for each version.

A change writes a new version and then removes those before the last, so readers of the last one are not disturbed and a
writer that dies leaves the table as it was. Versions whose writing did not end have no ``_SUCCESS`` file and are not read. One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state

HISTORY = "source string, output string, profile string, status string, feature_count long, message string, timestamp timestamp"
RECENT = "path string, timestamp timestamp"
PRESETS = "name string, parameters map<string,string>, saved timestamp"
CACHE = "key string, output string, profile_id string, feature_count long, timestamp timestamp"


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        place, fs = self._folder(path)
        return fs.exists(place)

    def versions(self) -> list[int]:
        place, fs = self._folder(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
        return [n for n in numbers if self.exists(f"{self.path}/v{n}/_SUCCESS")]

    def read(self) -> DataFrame:
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(f"{self.path}/v{done[-1]}")

    def write(self, df: DataFrame) -> None:
        done = self.versions()
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").json(f"{self.path}/v{done[-1] + 1 if done else 1}")
        for n in done[:-1]:
            place, fs = self._folder(f"{self.path}/v{n}")
            fs.delete(place, True)

    def add(self, rows: DataFrame, key: Sequence[str] = (), by: str = "timestamp", most: int | None = None) -> None:
        """Adds rows; of those with one ``key`` the newest stays, and of all the ``most`` newest."""
        whole = self.read().unionByName(rows)
        self.write(state.newest(whole, most or (1 << 31) - 1, by=by, key=key).drop("position"))

    def remove(self, where: Column) -> None:
        self.write(self.read().filter(~F.coalesce(where, F.lit(False))))

    def clear(self) -> None:
        self.write(self.read().limit(0))

    def prune(self, column: str) -> int:
        """Removes rows whose file is gone, and says how many files are; paths are asked for by the driver, one by one."""
        paths = [r[0] for r in self.read().select(column).filter(F.col(column).isNotNull()).distinct().toLocalIterator()]
        gone = [p for p in paths if not self.exists(p)]
        if gone:
            lost = self.spark.createDataFrame([(p,) for p in gone], f"{column} string")
            self.write(self.read().join(lost, column, "left_anti"))
        return len(gone)


class History(StateTable):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, HISTORY)

    def record(self, rows: DataFrame) -> None:
        self.add(rows, key=("source", "output", "timestamp"), most=state.HISTORY)

    def of_source(self, source: str) -> DataFrame:
        return self.read().filter(F.col("source") == source).orderBy(F.desc("timestamp"))

    def statistics(self) -> DataFrame:
        return state.history_statistics(self.read())


class ResultCache(StateTable):
    """Outputs by the key of what they were made from; an entry counts as long as its output is there."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, CACHE)

    def get(self, key: str):
        row = self.read().filter(F.col("key") == key).first()
        return row if row is not None and row["output"] and self.exists(row["output"]) else None

    def has(self, key: str) -> bool:
        return self.get(key) is not None

    def put(self, rows: DataFrame) -> None:
        self.add(rows, key=("key",))

    def invalidate(self, key: str) -> None:
        self.remove(F.col("key") == key)

    def statistics(self) -> DataFrame:
        return state.cache_statistics(self.read())
