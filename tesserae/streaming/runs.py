"""Streams: run counts by window, and tiles that are vectorised as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder


def landing(df: DataFrame, name: str) -> str:
    """The folder of ``df`` written as files for a stream to read."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream makes of all that is there, read back. State and results lie in the shared folder.

    A micro-batch that is run again after a failure overwrites its own files, so each row counts once: in ``complete`` mode the
    last batch is the whole result, in ``append`` mode each batch has a folder.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")


def windowed_counts(runs: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs by window and kind, batch or streaming. As a stream, rows later than ``late`` are left out."""
    rows = runs.withWatermark(time, late) if runs.isStreaming else runs
    return rows.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def tile_histograms(tiles: DataFrame) -> DataFrame:
    """Value counts of arriving tiles; each tile is complete in itself, so nothing is kept between batches."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            for t in batch.itertuples():
                v, n = np.unique(np.frombuffer(t.data, np.uint8), return_counts=True)
                yield pd.DataFrame({"raster_id": t.raster_id, "ty": t.ty, "tx": t.tx, "v": v.astype("int32"), "n": n.astype("int64")})

    return tiles.mapInPandas(run, "raster_id string, ty int, tx int, v int, n long")
