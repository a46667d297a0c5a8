"""Written intermediate tables, checked broadcasts and Arrow batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import cut_lineage

#: Most rows of a narrow table (ids, counts) that may be broadcast: about 10 MB.
BROADCAST_ROWS = 300_000
#: Most rows of an Arrow batch, so that a batch of long texts fits into a Python worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` where it is larger or without bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def maybe_broadcast(written: DataFrame) -> DataFrame:
    """Hint a broadcast of a narrow written table when its counted rows are few; else leave the join to Spark."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


written = cut_lineage


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
