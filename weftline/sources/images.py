"""Image bytes: sizes, perceptual hashes and pixels.

PNG headers are read in SQL; pixels come from Spark's own image decoder, which yields width -1
for bytes it can't decode.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes looked at for a size, and for an analysis.
PROBE_BYTES, MOST_BYTES = 512_000, 4_000_000


def read_bytes(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """``(url, content)``, content cut at ``most`` bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.expr(f"substring(content, 1, {most})").alias("content"))


def png_size(content: Column) -> Column:
    """``struct<width, height>`` from a PNG's header, null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """``(url, width, height, channels, data)`` of the files that decode."""
    got = spark.read.format("image").load(path).select("image.*")
    return got.where("width > 0").select(F.col("origin").alias("url"), "width", "height", "nChannels", "data")


def _pixels(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return x[:, :, 2::-1] if channels >= 3 else np.repeat(x[:, :, :1], 3, axis=2)


def _shrunk(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over a grid of cells."""
    rows = np.array_split(np.arange(x.shape[0]), height) if x.shape[0] >= height else [[int(i * x.shape[0] / height)] for i in range(height)]
    columns = np.array_split(np.arange(x.shape[1]), width) if x.shape[1] >= width else [[int(i * x.shape[1] / width)] for i in range(width)]
    tall = np.stack([x[r].mean(axis=0) for r in rows])
    return np.stack([tall[:, c].mean(axis=1) for c in columns], axis=1)


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits: the low frequencies of a 32 x 32 grey image above their median."""
    grey = _shrunk(pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114]), 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ grey @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    out = int("".join("1" if b else "0" for b in bits), 2)
    return out - (1 << 64) if out >> 63 else out


def hashes(images: DataFrame) -> DataFrame:
    """``(url, width, height, phash)`` of decoded images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("data", "width", "height", "nChannels")))
            yield pa.RecordBatch.from_arrays([b.column("url"), b.column("width"), b.column("height"), pa.array([perceptual_hash(_pixels(*r)) for r in rows], pa.int64())], names=["url", "width", "height", "phash"])

    return images.mapInArrow(run, "url string, width int, height int, phash bigint")


def _thumbnail(x: np.ndarray, side: int, border: float) -> np.ndarray:
    """At most ``side`` wide and high, without its border if enough is left."""
    scale = min(1.0, side / max(x.shape[:2]))
    x = x.astype(np.float64)
    x = _shrunk(x, max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))) if scale < 1 else x
    dy, dx = int(x.shape[0] * border), int(x.shape[1] * border)
    if x.shape[0] - 2 * dy >= 8 and x.shape[1] - 2 * dx >= 8:
        x = x[dy : x.shape[0] - dy, dx : x.shape[1] - dx]
    return x


def thumbnails(images: DataFrame, side: int = 96, border: float = 0.15) -> DataFrame:
    """``(url, width, height, rgb)``: small pictures without their borders, as rows of bytes."""

    def run(batches):
        for b in batches:
            out = []
            for url, *picture in zip(*(b.column(c).to_pylist() for c in ("url", "data", "width", "height", "nChannels"))):
                x = np.rint(_thumbnail(_pixels(*picture), side, border)).astype(np.uint8)
                out.append((url, x.shape[1], x.shape[0], x.tobytes()))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["url", "width", "height", "rgb"])

    return images.mapInArrow(run, "url string, width int, height int, rgb binary")


def png_bytes(x: np.ndarray) -> bytes:
    """An RGB picture as a PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(x, dtype=np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def model_uris(images: DataFrame, longest: int = 768) -> DataFrame:
    """``(url, data_uri)`` of decoded images for a model request, none wider or higher than ``longest``; as PNG, which needs no library."""

    def run(batches):
        for b in batches:
            out = [png_bytes(np.rint(_thumbnail(_pixels(*p), longest, 0.0))) for p in zip(*(b.column(c).to_pylist() for c in ("data", "width", "height", "nChannels")))]
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array(["data:image/png;base64," + base64.b64encode(x).decode() for x in out], pa.string())], names=["url", "data_uri"])

    return images.mapInArrow(run, "url string, data_uri string")


def colours(images: DataFrame, side: int = 96, border: float = 0.15, levels: int = 16) -> DataFrame:
    """``(url, r, g, b, n)``: pixels of the inner part of a thumbnail by colour, in ``levels`` steps a channel."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for url, data, w, h, n in zip(*(b.column(c).to_pylist() for c in ("url", "data", "width", "height", "nChannels"))):
                x = _thumbnail(_pixels(data, w, h, n), side, border)
                step = 256 // levels
                q = np.minimum((x.reshape(-1, 3) // step) * step + step // 2, 255).astype(np.int64)
                kinds, counts = np.unique(q, axis=0, return_counts=True)
                out += [(url, *c, k) for c, k in zip(kinds.tolist(), counts.tolist())]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:4]), pa.array(columns[4], pa.int64())], names=["url", "r", "g", "b", "n"])

    return images.mapInArrow(run, "url string, r int, g int, b int, n bigint")
