"""Readers, writers and key checks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             null_value: str = "") -> DataFrame:
    """CSV with a header; blanks become null. Types are inferred only without a schema."""
    reader = spark.read.option("header", True).option("nullValue", null_value)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def prefixed_names(prefixes: Sequence[str], attributes: Sequence[str]) -> list[str]:
    """Column names ``prefix_attribute``, prefixes outermost."""
    return [f"{p}_{a}" for p, a in product(prefixes, attributes)]


def read_csv_named(spark: SparkSession, path: str, names: Sequence[str],
                   types: Sequence[str] | None = None) -> DataFrame:
    """Headerless CSV whose column names are given; doubles unless ``types`` says else."""
    types = types or ["double"] * len(names)
    ddl = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
    return spark.read.schema(ddl).csv(path)


def read_wide_matrix(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Delimited rows ``id, v1, v2, ...`` as one id and one vector of doubles per row."""
    parts = F.split("value", f"\\Q{sep}\\E")
    return spark.read.text(path).select(
        parts.getItem(0).cast("bigint").alias("id"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1),
                    lambda v: v.cast("double")).alias("vector"))


def load_quoted(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Quoted CSV with a header row; an empty string in any column is null."""
    raw = (spark.read.schema(schema).option("header", True).option("quote", '"')
           .option("escape", '"').option("multiLine", False).csv(path))
    return raw.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name)
                        if f.dataType.simpleString() == "string" else F.col(f.name)
                        for f in raw.schema.fields])


def external_table(spark: SparkSession, name: str, schema_ddl: str, location: str,
                   sep: str = ",", header: bool = False) -> DataFrame:
    """Unmanaged delimited table over a location."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema_ddl}) USING csv "
              f"OPTIONS (sep '{sep}', header '{str(header).lower()}') LOCATION '{location}'")
    return spark.table(name)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-delimited text with declared types."""
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def read_edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Text lines ``src dst`` as an edge table."""
    parts = F.split("value", f"\\Q{sep}\\E")
    return spark.read.text(path).select(parts.getItem(0).alias("src"),
                                        parts.getItem(1).alias("dst"))


def adjacency(edges: DataFrame, block: Column) -> DataFrame:
    """Adjacency lists in blocks: one row per (src, block), never one row per hub."""
    return (edges.groupBy("src", block.alias("block"))
            .agg(F.array_sort(F.collect_list("dst")).alias("dsts")))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON directory; the schema is inferred when none is given."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_csv(df: DataFrame, path: str, null_value: str = "NA") -> None:
    """CSV with a header and ``NA`` for null."""
    df.write.option("header", True).option("nullValue", null_value).csv(path)


def normalize(df: DataFrame, dims: dict[str, tuple[str, Sequence[str]]]) -> dict[str, DataFrame]:
    """Split a wide table: ``dims[name] = (key, attributes)``; the rest is the ``fact`` table."""
    out = {name: df.select(key, *attrs).distinct() for name, (key, attrs) in dims.items()}
    moved = [a for _, attrs in dims.values() for a in attrs]
    out["fact"] = df.drop(*moved)
    return out


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (no rows: the key holds)."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def check_foreign_key(child: DataFrame, parent: DataFrame, child_key: str,
                      parent_key: str) -> DataFrame:
    """Child rows without a parent (no rows: the reference holds)."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def spine(bounds: DataFrame, start: str, end: str, step: str, name: str) -> DataFrame:
    """Regular date or number series between two columns of a one-row DataFrame."""
    step_col = F.expr(step) if not step.lstrip("-").isdigit() else F.lit(int(step))
    return bounds.select(F.explode(F.sequence(F.col(start), F.col(end), step_col)).alias(name))
