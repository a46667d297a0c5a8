"""Functions that SQL text can call, registered on a session.

They are SQL functions: Spark inlines their bodies, so calls cost no Python and
are optimized with the query around them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = (
    # one row per out-link of an adjacency block: the part of the rank that it carries, over the node's whole out-degree
    """create or replace temporary function contributions(links array<string>, rank double, degree bigint)
       returns table(link string, contribution double)
       return select l.col, rank / degree from explode(links) as l""",
    # concentration index of shares in percent, from the sum of squares and the sum of a group's weights
    """create or replace temporary function hhi(squares double, total double) returns double
       return case when total <> 0 then 10000 * squares / (total * total) end""",
)


def register(spark: SparkSession) -> SparkSession:
    """Make ``contributions`` (a table function) and ``hhi`` callable in SQL text of this session."""
    for text in FUNCTIONS:
        spark.sql(text)
    return spark
