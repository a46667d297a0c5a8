"""Parallel import of database tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def import_options(url: str, dbtable: str, credentials: Mapping[str, str],
                   partition_column: str | None = None,
                   bounds: tuple[int, int] | None = None, num_partitions: int = 8,
                   fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options; ``credentials`` (user, password, driver) come from configuration."""
    options = {"url": url, "dbtable": dbtable, "fetchsize": str(fetch_size), **credentials}
    if partition_column:
        if bounds is None or bounds[0] > bounds[1]:
            raise ValueError("a partition column needs ordered lower and upper bounds")
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(num_partitions)}
    return options


def import_jdbc(spark: SparkSession, options: Mapping[str, str], target: str) -> DataFrame:
    """Copy one database table to Parquet and return the copy."""
    spark.read.format("jdbc").options(**options).load().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
