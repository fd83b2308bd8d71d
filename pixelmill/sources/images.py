"""Images from files and buffers to pixel rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import dimension_error, sniff_kind, valid_buffer

PIXELS = "image_id string, y int, x int, r int, g int, b int, a int"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind and content of files; the kind is read from the content."""
    return spark.read.format("binaryFile").load(path).select("path", sniff_kind(F.col("content")).alias("kind"), "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the images that Spark's image source decodes (PNG, JPEG, GIF and BMP); too large ones are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("image_id"), "image.*")
    rows = raw.where(dimension_error(F.col("width"), F.col("height")).isNull()).select("image_id", "width", "height", F.col("nChannels").alias("channels"), "data")
    return _unpacked(rows, bgr=True)


def from_buffers(buffers: DataFrame) -> DataFrame:
    """Pixels of RGBA buffers (image_id, width, height, data); buffers of a wrong length are left out."""
    rows = buffers.where(valid_buffer(F.col("data"), F.col("width"), F.col("height"))).select(F.col("image_id").cast("string").alias("image_id"), "width", "height", F.lit(4).alias("channels"), "data")
    return _unpacked(rows, bgr=False)


def _unpacked(rows: DataFrame, bgr: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, w, h, n, data = (batch.column(k)[i].as_py() for k in range(5))
                p = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int32)
                colour = p[:, [0] * 3] if n == 1 else p[:, [2, 1, 0]] if bgr else p[:, :3]
                alpha = p[:, 3] if n == 4 else np.full(h * w, 255, np.int32)
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                yield pa.RecordBatch.from_arrays([pa.array([name] * (h * w)), *map(pa.array, (y, x, *colour.T.copy(), alpha))], names=["image_id", "y", "x", "r", "g", "b", "a"])

    return rows.mapInArrow(run, PIXELS)


def constant(spark: SparkSession, width: int, height: int, rgba: tuple[int, int, int, int] = (0, 0, 0, 0), image_id: str = "constant") -> DataFrame:
    at = spark.range(width * height)
    return at.select(F.lit(image_id).alias("image_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), *(F.lit(v).alias(c) for v, c in zip(rgba, "rgba")))


def from_array(spark: SparkSession, rgba: np.ndarray, image_id: str = "image") -> DataFrame:
    h, w = rgba.shape[:2]
    if rgba.shape[2] == 3:
        rgba = np.dstack([rgba, np.full((h, w), 255)])
    data = bytearray(np.clip(np.floor(rgba + 0.5), 0, 255).astype(np.uint8).tobytes())
    return from_buffers(spark.createDataFrame([(image_id, w, h, data)], "image_id string, width int, height int, data binary"))
