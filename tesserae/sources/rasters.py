"""Rasters as pixels: from tables, matrices and files.

A pixel row is ``raster_id string, y int, x int, v int``; of several bands ``bands array<int>``. A tile row has the
same pixels as bytes: ``raster_id, ty, tx, y_off, x_off, height, width, data``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError, DependencyError
from ..functions import pixels

TILE = 256
SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg", "bmp", "gif", "webp")
TILE_SCHEMA = "raster_id string, ty int, tx int, y_off int, x_off int, height int, width int, data binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_raster(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``embeddings`` as one grayscale raster: a row for each vector, a column for each component.

    ``dealt``: the vectors are dealt out by ``y`` before they become pixels, so windows along a row need no exchange of pixels.
    """
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), "embedding")
    if dealt:
        vectors = vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "y")
    rows = vectors.select("y", F.posexplode("embedding").alias("x", "c"))
    v = pixels.clamp(F.rint((F.col("c").cast("double") + 0.5) * 255)).cast("int")
    return rows.select(F.lit("emb").alias("raster_id"), "y", F.col("x").cast("int").alias("x"), v.alias("v"))


def lineitem_raster(spark: SparkSession, sf_dir: str, size: int = 64, gain: int = 4) -> DataFrame:
    """``lineitem`` as an RGB heat map: counts by part and supplier, a band for each return flag."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % size).cast("int").alias("y"), (F.col("l_suppkey") % size).cast("int").alias("x"), "l_returnflag"
    )
    count = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    counts = rows.groupBy("y", "x").agg(*(count(f).alias(n) for f, n in (("A", "r"), ("N", "g"), ("R", "b"))))
    grid = spark.range(size * size).select((F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    level = lambda n: F.least(F.lit(255), F.coalesce(F.col(n), F.lit(0)) * gain).cast("int").alias(n)
    return grid.join(counts, ["y", "x"], "left").select(F.lit("li").alias("raster_id"), "y", "x", level("r"), level("g"), level("b"))


def normalise_pixel(value) -> tuple[int, ...]:
    if isinstance(value, (bool, int, np.integer, np.bool_)):
        return (int(value),)
    if isinstance(value, Sequence) and not isinstance(value, str) and len(value):
        return tuple(int(v) for v in value)
    raise ConfigurationError(f"{value!r} is no pixel")


def from_matrix(spark: SparkSession, matrix: Sequence[Sequence], raster_id: str = "matrix") -> DataFrame:
    """``raster_id, y, x, bands`` of a matrix whose rows are equally long; the first pixel tells the number of bands."""
    rows = [[normalise_pixel(v) for v in row] for row in matrix]
    if not rows or not rows[0]:
        raise ConfigurationError("an empty matrix")
    if {len(r) for r in rows} != {len(rows[0])} or {len(p) for r in rows for p in r} != {len(rows[0][0])}:
        raise ConfigurationError("rows or pixels of unequal length")
    cells = [(raster_id, y, x, list(p)) for y, r in enumerate(rows) for x, p in enumerate(r)]
    return spark.createDataFrame(cells, "raster_id string, y int, x int, bands array<int>")


def gray(df: DataFrame) -> DataFrame:
    """``bands`` to ``v``: one band as it is, two with a blue of 0, further bands unread."""
    b = F.col("bands")
    many = pixels.grayscale(F.get(b, F.lit(0)), F.get(b, F.lit(1)), F.coalesce(F.get(b, F.lit(2)), F.lit(0)))
    return df.withColumn("v", F.when(F.size("bands") == 1, pixels.clamp(F.get(b, F.lit(0))).cast("int")).otherwise(many)).drop("bands")


def to_tiles(df: DataFrame, tile: int = TILE, value: str = "v") -> DataFrame:
    """Pixels (0 to 255) gathered to tiles; missing ones are 0. A task holds one tile at a time."""
    size = tile

    def pack(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        raster, ty, tx = key
        y, x = cells["y"].to_numpy() - ty * size, cells["x"].to_numpy() - tx * size
        data = np.zeros((y.max() + 1, x.max() + 1), np.uint8)
        data[y, x] = cells[value]
        return pd.DataFrame([(raster, ty, tx, ty * size, tx * size, *data.shape, data.tobytes())])

    at = lambda c: F.expr(f"{c} div {size}").cast("int")
    dealt = df.withColumn("ty", at("y")).withColumn("tx", at("x"))
    return dealt.groupBy("raster_id", "ty", "tx").applyInPandas(pack, TILE_SCHEMA)


def from_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles to pixels."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                y, x = np.divmod(np.arange(t.height * t.width), t.width)
                yield pd.DataFrame({"raster_id": t.raster_id, "y": (y + t.y_off).astype(np.int32), "x": (x + t.x_off).astype(np.int32), "v": np.frombuffer(t.data, np.uint8).astype(np.int32)})

    return tiles.mapInPandas(unpack, "raster_id string, y int, x int, v int")


def is_raster_path(path: Column) -> Column:
    """Whether a path or URL ends in a known suffix, before any query or fragment."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)).isin(*SUFFIXES)


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, (width, height, top) = fields[0], map(int, fields[1:])
    bands = 3 if kind in (b"P3", b"P6") else 1
    if top > 255:
        raise DependencyError("only 8 bits a sample are read")
    raw = np.frombuffer(data[at + 1 :], np.uint8) if kind in (b"P5", b"P6") else np.array(data[at:].split(), np.uint8)
    return raw[: width * height * bands].reshape(height, width, bands)


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, head = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += n + 12
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace:
        raise DependencyError("only PNG files with 8 bits a sample and no interlacing are read")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width * bands + 1)
    out = np.zeros((height, width * bands), np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(width * bands, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up & 255
        else:
            own = np.zeros(width * bands + bands, np.int32)
            for i in range(width * bands):
                a, b, c = own[i], up[i], up[i - bands] if i >= bands else 0
                p = int(a) + int(b) - int(c)
                guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i + bands] = line[i] + guess & 255
            out[y] = own[bands:]
    image = out.reshape(height, width, bands)
    if colour == 3:
        return palette[image[:, :, 0]]
    return image[:, :, : {2: 1, 4: 3}.get(bands, bands)]


def _bmp(data: bytes) -> np.ndarray:
    start, width, height, depth, packing = struct.unpack("<10xI4xii2xHI", data[:34])
    if packing or depth not in (24, 32):
        raise DependencyError("only uncompressed BMP files with 24 or 32 bits are read")
    step = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * depth // 8]
    image = rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    return image[::-1] if height > 0 else image


def _tiff(data: bytes) -> tuple[np.ndarray, dict]:
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        code = {1: "B", 2: "B", 3: "H", 4: "I", 12: "d"}.get(kind)
        if code:
            size = struct.calcsize(code) * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = struct.unpack(f"{e}{n}{code}", data[where : where + size])
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    packing = tags.get(259, (1,))[0]
    if set(tags.get(258, (8,))) != {8} or packing not in (1, 8, 32946) or 322 in tags or tags.get(284, (1,))[0] != 1 or tags.get(317, (1,))[0] != 1:
        raise DependencyError("only 8-bit TIFF files in plain or deflated strips are read")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
    meta = {}
    if 33550 in tags and 33922 in tags:
        (sx, sy), (i, j, _, x, y) = tags[33550][:2], tags[33922][:5]
        meta["geotransform"] = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
    elif 34264 in tags:
        m = tags[34264]
        meta["geotransform"] = [m[3], m[0], m[1], m[7], m[4], m[5]]
    return np.frombuffer(raw, np.uint8)[: width * height * bands].reshape(height, width, bands), meta


_UNREAD = {b"\xff\xd8\xff": "JPEG", b"GIF8": "GIF", b"RIFF": "WEBP"}


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """(height, width, bands) of a PGM, PPM, PNG, BMP or TIFF file, and its metadata."""
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _netpbm(data), {}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data), {}
    if data[:2] == b"BM":
        return _bmp(data), {}
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(data)
    for start, name in _UNREAD.items():
        if data.startswith(start):
            raise DependencyError(f"there is no decoder for {name} files")
    raise DependencyError("no decoder for this file")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bands as a file's header states them, without decoding a pixel."""
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        numbers = re.sub(rb"#[^\n]*", b" ", data[2:4096]).split()[:2]
        return int(numbers[0]), int(numbers[1]), 3 if data[1:2] in b"36" else 1
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height = struct.unpack(">II", data[16:24])
        return width, height, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(data[25], 1)
    if data[:2] == b"BM":
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height), 3
    if data[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(e + "I", data[4:8])[0]
        tags = {}
        for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
            tag, kind = struct.unpack(e + "HH", data[at + 2 + 12 * i : at + 6 + 12 * i])
            if tag in (256, 257, 277):
                tags[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), data[at + 10 + 12 * i : at + 10 + 12 * i + (2 if kind == 3 else 4)])[0]
        return tags[256], tags[257], tags.get(277, 1)
    raise DependencyError("no header that is known")


def preflight(data: bytes, name: str, max_pixels: int, max_bytes: int) -> None:
    """Refuses a file by what its header states, before anything is inflated."""
    try:
        width, height, bands = header(data)
    except (struct.error, KeyError, IndexError, ValueError) as error:
        raise DependencyError(f"{name}: the header can't be read") from error
    if width * height > max_pixels or width * height * bands > max_bytes:
        raise ConfigurationError(f"{name}: {width} x {height} pixels of {bands} bands are more than {max_pixels} pixels or {max_bytes} bytes; reduce it by {max(1.0, (width * height / max_pixels) ** 0.5):.2f}")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, bands`` of the files under ``path``, from their headers; nulls where there is none that is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, *header(bytes(content))))
                except (DependencyError, struct.error, KeyError, IndexError, ValueError):
                    rows.append((name, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "bands"]).astype({c: "Int32" for c in ("width", "height", "bands")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, bands int")


def _existing(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if found is None or len(found) == 0:
        raise ConfigurationError(f"there is no file {path}")


def read_tiles(spark: SparkSession, path: str, tile: int = TILE, max_pixels: int = 500_000_000, max_bytes: int = 16 << 30) -> DataFrame:
    """Files under ``path`` as grayscale tiles; a file is decoded in one task, and refused by its header beyond ``max_pixels`` or
    ``max_bytes``. A path without files is a ``ConfigurationError``."""
    _existing(spark, path)
    size = tile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                if not data.startswith(tuple(_UNREAD)):
                    preflight(data, name, max_pixels, max_bytes)
                image, _ = decode(data)
                one = image[:, :, 0] if image.shape[2] == 1 else None
                if one is None:
                    f = image.astype(np.float64)
                    blue = f[:, :, 2] * 0.114 if image.shape[2] > 2 else 0.0
                    one = np.rint(f[:, :, 0] * 0.299 + f[:, :, 1] * 0.587 + blue).clip(0, 255).astype(np.uint8)
                for y in range(0, one.shape[0], size):
                    for x in range(0, one.shape[1], size):
                        part = np.ascontiguousarray(one[y : y + size, x : x + size])
                        yield pd.DataFrame([(name, y // size, x // size, y, x, *part.shape, part.tobytes())], columns=[c.split()[0] for c in TILE_SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TILE_SCHEMA)


def read_raster(spark: SparkSession, source, **options) -> DataFrame:
    """Grayscale pixels of a pixel DataFrame, a path, a matrix or a mapping with ``pixels``."""
    if isinstance(source, DataFrame):
        return gray(source) if "bands" in source.columns else source
    if isinstance(source, str):
        return from_tiles(read_tiles(spark, source, **options))
    if isinstance(source, Mapping) and "pixels" in source:
        return gray(from_matrix(spark, source["pixels"], source.get("source_name") or source.get("name") or "matrix"))
    if isinstance(source, Sequence):
        return gray(from_matrix(spark, source))
    raise ConfigurationError(f"{type(source).__name__} is no raster source")
