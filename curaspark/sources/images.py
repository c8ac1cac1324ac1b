"""Decoded images (PNG, JPEG, TIFF) and their gray levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height (-1 if not decodable), width, nChannels, data (rows of BGR or gray bytes)."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return raw.selectExpr("regexp_replace(image.origin, '^file:/+', 'file:/') AS path", "image.height", "image.width", "image.nChannels", "image.data")


def to_gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0]
    b, g, r = (x[:, :, k].astype(np.float64) for k in range(3))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]
