"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot join keys even where that costs one more shuffle further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the operators rely on."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    path = tempfile.mkdtemp(prefix="lodestar-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/lodestar/{uuid.uuid4().hex}/{label}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and continue from the written table.

    Unlike a checkpointed plan, a fresh scan carries no inferred constraints
    from round to round (they multiply in loops), and it knows its size, so
    later joins can pick a broadcast by measured bytes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _CUT[out] = path
    return out


#: Paths of the tables that ``cut_lineage`` wrote, as long as their DataFrames are in use.
_CUT: WeakKeyDictionary = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote and nothing reads any more; others are left alone."""
    for df in tables:
        path = _CUT.pop(df, None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Read ``path`` when it was saved before, else save ``df`` there and read it."""
    spark = df.sparkSession
    if not saved(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle partition count of the session, the unit for chunk counts."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
