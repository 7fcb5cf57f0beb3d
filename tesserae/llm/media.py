"""Media columns: texts stored as WAV samples, read back by the wave module, and fingerprinted.

A payload (bytes) becomes a mono WAV file with 8-bit samples, which keep every byte. Features come from the samples
that are read back: a short-time Fourier transform, the strongest bin of each of four bands where it stands out in
time, and pairs of such peaks. A fingerprint is one long per pair, ``time << 32 | bin1 << 16 | bin2 << 8 | delay``,
so an array of them is ordered by time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .rolling import slices

RATE, UNIT = 8000, 64
FRAME, HOP, FAN, REACH = 256, 128, 3, 15
BANDS = ((1, 8), (8, 24), (24, 56), (56, 128))
_HANN = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)
_BLOCK = 4096  # frames transformed at once, which bounds memory for a payload of any length


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono samples")
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by time and then bin.

    In each frame and band the strongest bin (the lower one of equals) by rounded magnitude; it is a peak if
    that magnitude is positive, no less than the band's in the frame before and greater than in the frame after.
    """
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    whole = np.full(FRAME + (n - 1) * HOP, 128, np.uint8)
    whole[: len(samples)] = samples
    best, level = np.empty((n, len(BANDS)), np.int64), np.empty((n, len(BANDS)), np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(whole, FRAME)[::HOP]
    for a in range(0, n, _BLOCK):
        part = (frames[a : a + _BLOCK].astype(np.float32) - 128) * _HANN
        size = np.rint(np.abs(np.fft.rfft(part, axis=1))).astype(np.int32)
        for k, (low, high) in enumerate(BANDS):
            best[a : a + _BLOCK, k] = low + size[:, low:high].argmax(axis=1)
            level[a : a + _BLOCK, k] = size[:, low:high].max(axis=1)
    earlier, later = np.zeros_like(level), np.zeros_like(level)
    earlier[1:], later[:-1] = level[:-1], level[1:]
    t, k = np.nonzero((level > 0) & (level >= earlier) & (level > later))
    return t, best[t, k]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Pairs of each peak with the next three within 15 frames, as time-coded longs in order."""
    t, f = band_peaks(samples)
    found = []
    for j in range(1, FAN + 1):
        if len(t) > j:
            delay = t[j:] - t[:-j]
            code = t[:-j] << 32 | f[:-j] << 16 | f[j:] << 8 | delay
            found.append(code[delay <= REACH])
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b in slices(texts, 4 << 20):
            data = [(x.as_py() or "").encode() for x in texts[a:b]]
            yield pa.RecordBatch.from_arrays(
                [ids[a:b], pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(pad(x)) for x in data], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(2):
            media = x.as_py()
            payload = from_wav(media)
            codes = fingerprint(np.frombuffer(payload, np.uint8))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), codes))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        flat = np.concatenate([np.empty(0, np.int64), *cols[5]])
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in cols[5]])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(cols[0], pa.int64()),
                pa.array(cols[1], pa.string()),
                pa.array(cols[2], pa.int64()),
                pa.array(cols[3], pa.int64()),
                pa.array(cols[4], pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"],
        )


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a WAV file. A null text counts as empty; other columns are not read."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame) -> DataFrame:
    """What the stored files hold: sizes, digests and ``fingerprint array<long>``.

    Row by row without a shuffle: repeated rows give repeated results, an empty table gives none, and
    a payload of any length is transformed in blocks of 4,096 frames.
    """
    return df.select("doc_id", "n_bytes", "media").mapInArrow(
        _read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>",
    )


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored, read back and fingerprinted; ``feature`` digests the time-coded array ``fingerprint``."""
    small_batches(spark)
    done = read_media(write_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.lit("pairs"), F.size("fingerprint"), F.sha2(F.array_join("fingerprint", ","), 256))
    return done.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "fingerprint"
    )
