"""Whole-image operators on rows (image_id, width, height, pixels): each image alone, in Arrow batches, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "image_id bigint, width int, height int, pixels array<int>"
TYPES = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int32()))])


def mosaic(tiles: DataFrame, key: Column, place: Column, pixels: str, side: int, across: int) -> DataFrame:
    """Images of across by across square tiles; a tile that is missing is grey (128). ``place`` counts tiles from 0, by rows."""
    width = side * across
    grouped = tiles.groupBy(key.alias("image_id")).agg(F.map_from_entries(F.collect_list(F.struct(place, pixels))).alias("t"))
    grey = F.array_repeat(F.lit(128), side * side)
    rows = [
        F.flatten(F.array(*(F.slice(F.coalesce(F.try_element_at("t", F.lit(ty * across + tx).cast("bigint")), grey), y * side + 1, side) for tx in range(across))))
        for ty in range(across) for y in range(side)
    ]
    return grouped.select("image_id", F.lit(width).alias("width"), F.lit(width).alias("height"), F.flatten(F.array(*rows)).alias("pixels"))


def map_images(images: DataFrame, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The images as ``run`` makes them of their (height, width) arrays; sides may change."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            made = [run(np.array(p, np.int64).reshape(h, w)) for w, h, p in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            columns = [b.column(0), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([m.shape[0] for m in made], pa.int32()), pa.array([m.ravel() for m in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=TYPES)

    return images.select("image_id", "width", "height", "pixels").mapInArrow(batches, IMAGE)


def measure_images(images: DataFrame, run: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows image_id and what ``run`` gives, any number an image; ``schema`` names bigint, string or double columns."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.strip().split() for f in schema.split(",")]
    types = pa.schema([("image_id", pa.int64()), *((n, kinds[t]) for n, t in fields)])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows = [(i, *r) for i, w, h, p in zip(*(b.column(k).to_pylist() for k in range(4))) for r in run(np.array(p, np.int64).reshape(h, w))]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return images.select("image_id", "width", "height", "pixels").mapInArrow(batches, f"image_id bigint, {schema}")


def summary(images: DataFrame) -> DataFrame:
    """image_id, width, height, total, digest of the pixels."""
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, x: s + x)
    return images.select("image_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), total.alias("total"), F.md5(F.array_join("pixels", ",").cast("binary")).alias("digest"))
