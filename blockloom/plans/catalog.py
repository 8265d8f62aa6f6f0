"""All queries of the block, signal and raster operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytes as byte_plans
from . import codecs as codec_plans
from . import mosaics as mosaic_plans
from . import raster as raster_plans

PLANS = [byte_plans, raster_plans, codec_plans, mosaic_plans]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_plans.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
