"""Tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stihora.shipping import ship
from stihora.storage import shared_dir, written

__all__ = ["shared_dir", "table", "written"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")
