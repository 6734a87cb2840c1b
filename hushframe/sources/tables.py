"""Readers of the driver tables; every path goes through Spark, never through open()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, before work that is costly for each row: a small file, or a row group, is read by one task whatever it holds."""
    return rows.repartition(4 * max(8, rows.sparkSession.sparkContext.defaultParallelism))
