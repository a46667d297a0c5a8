"""Queries written in SQL text over the registered functions."""

from pyspark.sql import functions as F

from lodestar.functions import sql
from lodestar.functions.columns import r
from lodestar.plans.registry import query
from lodestar.session import cut_lineage


@query("J2 D22", """
    with a as (select l_suppkey as s, l_partkey as p, sum(l_extendedprice::decimal(18, 2))::double as w from lineitem group by 1, 2)
    select s, round(10000 * sum(w * w) / pow(sum(w), 2), 4) as hhi, count(*)::bigint as parts from a group by 1""")
def supplier_part_concentration(t):
    """Concentration of every supplier's sales over parts, through the SQL function."""
    t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice").createOrReplaceTempView("lodestar_sales")
    return sql.register(t.spark).sql("""
        with a as (select l_suppkey as s, l_partkey as p, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as w
                   from lodestar_sales group by 1, 2)
        select s, hhi(sum(w * w), sum(w)) as hhi, count(*) as parts from a group by s""").withColumn("hhi", r("hhi", 4))


@query("J1 L8 A8", """
    with e as (select distinct o_custkey as x, l_suppkey as y from orders join lineitem on o_orderkey = l_orderkey),
    n as (select x, count(*) as degree from e group by 1)
    select y::varchar as link, round(sum(100.0 / degree), 6)::double as received from e join n using (x) group by 1""")
def rank_received_by_suppliers(t):
    """A rank of 100 for every customer, handed on over their suppliers in blocks of links."""
    t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_custkey", "l_suppkey").distinct().createOrReplaceTempView("lodestar_ties")
    blocks = t.spark.sql("""
        select o_custkey as node, l_suppkey div 64 as block, collect_list(cast(l_suppkey as string)) as links,
          any_value(degree) as degree
        from lodestar_ties join (select o_custkey as c, count(*) as degree from lodestar_ties group by 1) on o_custkey = c
        group by 1, 2""")
    cut_lineage(blocks).createOrReplaceTempView("lodestar_blocks")
    return sql.register(t.spark).sql("""
        select c.link, sum(c.contribution) as received
        from lodestar_blocks b, lateral contributions(b.links, 100D, b.degree) c group by c.link""").withColumn(
            "received", r("received"))
