"""Work beside the caller: a token that stops it, a task in a thread of its own, and batches of rasters."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..errors import TesseraeError
from ..sources import rasters
from . import vectorize

OUTCOME = "source string, output string, status string, message string, feature_count long"


class CancelToken:
    """Says once and for all that work is to stop; asked from any thread."""

    def __init__(self):
        self._said = threading.Event()

    def cancel(self) -> None:
        self._said.set()

    def __call__(self) -> bool:
        return self._said.is_set()

    def check(self) -> None:
        if self():
            raise TesseraeError("cancelled")


class Task:
    """A function run in a thread, its Spark jobs under one tag, so that they can be cancelled together."""

    def __init__(self, spark: SparkSession, work: Callable[[CancelToken], object]):
        self.spark, self.work, self.token, self.tag = spark, work, CancelToken(), f"tesserae-{uuid.uuid4().hex}"
        self.result: object = None
        self.error: BaseException | None = None
        self.status = "pending"
        self.started = self.ended = None
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        self.status, self.started = "running", time.time()
        self.spark.addTag(self.tag)
        try:
            self.token.check()
            self.result = self.work(self.token)
            self.status = "cancelled" if self.token() else "success"
        except BaseException as error:  # noqa: BLE001  the caller is told by ``wait``
            self.error, self.status = error, "cancelled" if self.token() else "failed"
        finally:
            self.ended = time.time()
            self.spark.removeTag(self.tag)

    def start(self) -> Task:
        self._thread.start()
        return self

    def cancel(self) -> None:
        self.token.cancel()
        self.spark.interruptTag(self.tag)

    def wait(self, seconds: float | None = None) -> str:
        self._thread.join(seconds)
        return self.status


def output_path(source: str, folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{PurePosixPath(source).stem}_vectorized.{suffix}"


def batch(
    spark: SparkSession,
    sources: Sequence[str],
    folder: str,
    mode: str = "regional",
    parameters: Mapping | None = None,
    suffix: str = "geojson",
    stop_on_error: bool = False,
    cancelled: Callable[[], bool] = lambda: False,
    told: Callable[[float, str], None] = lambda share, source: None,
) -> DataFrame:
    """Each raster file vectorised to a file of its own, and what became of it: ``source, output, status, message, feature_count``.

    A file that fails doesn't stop the others unless ``stop_on_error``; what is left after that or after ``cancelled`` is
    ``cancelled``. Rasters that need no files of their own are better rows of one DataFrame, which ``vectorize.run`` takes.
    """
    rows: list[tuple] = []
    stopped = False
    for i, source in enumerate(sources):
        path = output_path(source, folder, suffix)
        if stopped or cancelled():
            rows.append((source, None, "cancelled", None, 0))
            continue
        try:
            done = vectorize.run(rasters.read_raster(spark, source), mode, parameters, path, cancelled=cancelled)
            rows.append((source, path, "success", None, done.features.count()))
        except Exception as error:  # noqa: BLE001  one bad file is a row
            rows.append((source, None, "cancelled" if cancelled() else "failed", str(error)[:500], 0))
            stopped = stop_on_error
        told((i + 1) / len(sources), source)
    return spark.createDataFrame(rows, OUTCOME)
