"""Standardised indices over a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import gamma_index
from lodestar.operators.windows import zscore


def spi(panel: DataFrame, value: str, entity: str, name: str = "spi") -> DataFrame:
    """Precipitation-style index: overall score, gamma quantile, score within the entity."""
    stats = panel.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    mean, sd = stats.select("m").scalar(), stats.select("s").scalar()
    base = panel.withColumn("__g", gamma_index((F.col(value) - mean) / sd, mean, sd))
    return zscore(base, "__g", [entity], name).drop("__g")
