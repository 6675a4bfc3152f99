"""The tables of a data folder, read lazily, and the guard on required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """`Tables(spark, folder).orders` reads folder/orders.parquet; Spark prunes columns and pushes filters into the scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fails before any aggregation if a column is missing, which would otherwise count as zeros."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
