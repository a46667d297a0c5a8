"""Queries over filters, joins, sorts and set operations."""

from pyspark.sql import functions as F

from lodestar.functions.columns import day_text, r, year
from lodestar.operators import relational as rel
from lodestar.plans.registry import query

def net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def order_lines(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))


def customer_lines(t):
    return t.customer.join(order_lines(t), F.col("c_custkey") == F.col("o_custkey"))


@query("B1", "select p_partkey as id, p_type as category, p_name as name, p_retailprice as price from part")
def projected_parts(t):
    return t.part.select("p_partkey", "p_type", "p_name", "p_retailprice").withColumnsRenamed(
        {"p_partkey": "id", "p_type": "category", "p_name": "name", "p_retailprice": "price"})


@query("B2", "select l_orderkey, l_linenumber, l_quantity from lineitem "
       "where l_quantity >= 10 and (l_discount < 0.03 or l_returnflag <> 'R') and l_shipdate < timestamp '1997-01-01'")
def filtered_lines(t):
    return t.lineitem.filter((F.col("l_quantity") >= 10)
                             & ((F.col("l_discount") < 0.03) | (F.col("l_returnflag") != "R"))
                             & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
                             ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("B3 H17", "select count(*) filter (where nullif(o_orderstatus, 'O') is null)::bigint as unshipped, "
       "count(*) filter (where nullif(o_orderstatus, 'O') is not null)::bigint as shipped from orders")
def null_tests(t):
    ship = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    return t.orders.agg(F.count_if(ship.isNull()).alias("unshipped"),
                        F.count_if(ship.isNotNull()).alias("shipped"))


@query("B4", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY') "
       "and c_nationkey not in (1, 2, 3)")
def in_list_filter(t):
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
                             & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("B5", """
    select page_id, case when contains(url, '/fr/') or contains(url, 'ref=') or contains(url, '#top')
      then 1 else 0 end as tagged from pages where url <> ''
    union all select page_id, null from pages where url = '' or url is null""")
def url_pattern_flag(t):
    return t.pages.select("page_id", rel.match_any(F.col("url"), ["/fr/", "ref=", "#top"]).alias("tagged"))


@query("B6", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then "
       "case when p_retailprice > 1500 then 'mid-dear' else 'mid' end else 'large' end as size_class from part")
def size_classes(t):
    size = F.col("p_size")
    mid = F.when(F.col("p_retailprice") > 1500, "mid-dear").otherwise("mid")
    return t.part.select("p_partkey", F.when(size < 10, "small").when(size < 30, mid)
                         .otherwise("large").alias("size_class"))


@query("B7", "select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) as net, "
       "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge from lineitem")
def computed_amounts(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r(net(), 4).alias("net"),
                             r(net() * (1 + F.col("l_tax")), 6).alias("charge"))


@query("B8", "select s_suppkey, s_nationkey from supplier")
def dropped_columns(t):
    return t.supplier.drop("s_name", "s_acctbal")


@query("B9", "select l_orderkey, l_linenumber, l_tax from lineitem where l_tax <> 0 and l_discount <> 0")
def complete_cases(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
                             F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return rel.drop_nulls(rows, ["l_tax", "d"]).drop("d")


@query("B10", "select l_orderkey, l_partkey, case when l_discount = 0 then 1e-7 else l_discount end as l_discount, "
       "case when l_returnflag = 'N' then 0.0 else l_tax end as l_tax from lineitem")
def values_replaced(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_discount", "l_tax", "l_returnflag")
    rows = rel.replace_where(rows, F.col("l_discount") == 0, "l_discount", 1e-7)
    return rel.replace_where(rows, F.col("l_returnflag") == "N", "l_tax", 0.0).drop("l_returnflag")


@query("B11", """
    with e as (select event_id, case when event_type <> 'error' then value end as value from events)
    select event_id, round(coalesce(value, (select avg(case when value > 0 then value end) from e)), 6) as value
    from e""")
def mean_filled_values(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rel.fill_mean(rows, "value", F.col("value") > 0).withColumn("value", r("value"))


@query("B12", "select distinct p_brand, p_type from part")
def distinct_rows(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("B13 E5", """
    select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over
      (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def latest_order_per_customer(t):
    return rel.first_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]
                             ).select("o_custkey", "o_orderkey", "o_totalprice")


@query("B14", 'select s_suppkey as "suppkey.inv", s_nationkey as "nationkey.inv" from supplier')
def renamed_by_pattern(t):
    rows = rel.rename_regex(t.supplier.select("s_suppkey", "s_nationkey"), r"^s_(.*)$", r"\1.x")
    return rel.rename_regex(rows, r"\.x$", ".inv")


@query("C1 F1", "select n_name, c_name, c_acctbal from nation join customer on n_nationkey = c_nationkey "
       "order by 1, 2")
def customers_by_nation(t):
    return (t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
            .select("n_name", "c_name", "c_acctbal").orderBy("n_name", "c_name"))


@query("C2", "select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey "
       "where l_shipdate = o_orderdate")
def same_day_lines(t):
    return order_lines(t).filter(F.col("l_shipdate") == F.col("o_orderdate")).select(
        "o_orderkey", "l_linenumber", "l_partkey")


@query("C3", """
    select c_name, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, p_name, l_extendedprice, l_discount, l_quantity
    from customer, orders, lineitem, part
    where c_custkey = o_custkey and o_orderkey = l_orderkey and l_partkey = p_partkey
    order by c_name, o_orderdate, p_name""")
def order_details(t):
    rows = customer_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("c_name", day_text("o_orderdate").alias("o_orderdate"), "p_name", "l_extendedprice",
                       "l_discount", "l_quantity").orderBy("c_name", "o_orderdate", "p_name")


@query("C4", """
    with a as (select l_partkey as k, l_suppkey as s, sum(l_quantity) as bought from lineitem group by 1, 2),
    b as (select l_partkey as k, l_suppkey as s, sum(l_quantity) as returned from lineitem
          where l_returnflag = 'R' group by 1, 2)
    select k, s, bought, returned from a join b using (k, s)""")
def bought_and_returned(t):
    keys = [F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s")]
    bought = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("bought"))
    back = t.lineitem.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_quantity").alias("returned"))
    return bought.join(back, ["k", "s"])


@query("C5", """
    select d.doc_id, d.source, l.quality from documents d left join labels l on d.doc_id = l.doc_id""")
def documents_with_labels(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "source", "quality")


@query("C6", """
    with a as (select c_nationkey as k, count(*)::bigint as customers from customer where c_acctbal > 9800 group by 1),
    b as (select s_nationkey as k, count(*)::bigint as suppliers from supplier where s_acctbal > 3000 group by 1)
    select coalesce(a.k, b.k) as k, customers, suppliers from a full join b on a.k = b.k""")
def nations_full_join(t):
    a = t.customer.filter("c_acctbal > 9800").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.count(F.lit(1)).alias("customers"))
    b = t.supplier.filter("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("k")).agg(
        F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("C7 D4", """
    select p_partkey, p_retailprice from part where p_retailprice in
      (select p_retailprice from part group by 1 having count(*) > 1)""")
def repeated_prices(t):
    repeated = t.part.groupBy("p_retailprice").count().filter("count > 1")
    return rel.semi(t.part.select("p_partkey", "p_retailprice"), repeated, ["p_retailprice"])


@query("C7 D4", """
    select c_custkey, c_acctbal from customer where c_acctbal in
      (select c_acctbal from customer group by 1 having count(*) = 1)""")
def unique_balances(t):
    single = t.customer.groupBy("c_acctbal").count().filter("count = 1")
    return rel.semi(t.customer.select("c_custkey", "c_acctbal"), single, ["c_acctbal"])


@query("C8", """
    select c_custkey, c_name from customer where not exists
      (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""")
def customers_without_urgent(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.anti(t.customer.select("c_custkey", "c_name"), urgent, ["c_custkey"])


@query("C9", """
    with a as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'),
    b as (select distinct o_custkey as k from orders where o_orderpriority = '5-LOW')
    select coalesce(a.k, b.k) as k, (a.k is not null)::int as in_a, (b.k is not null)::int as in_b
    from a full join b on a.k = b.k where a.k is null or b.k is null""")
def in_one_list_only(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    low = t.orders.filter("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("k"))
    return rel.exclusive_keys(urgent, low, "k")


@query("C12", """
    with ev as (select c_nationkey as entity, o_orderpriority as k, o_orderdate as tm, o_orderkey as id
                from orders join customer on o_custkey = c_custkey),
    links as (select a.n_nationkey as entity, b.n_nationkey as other from nation a join nation b
              on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey)
    select id, (exists (select 1 from links l join ev o on o.entity = l.other
       where l.entity = ev.entity and o.k = ev.k and o.tm < ev.tm))::int as seen_nearby from ev""")
def seen_nearby_before(t):
    ev = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("entity"), F.col("o_orderpriority").alias("k"),
        F.col("o_orderdate").alias("tm"), F.col("o_orderkey").alias("id"))
    return rel.exists_before(ev, nation_links(t), ev, "entity", "other", "k", "tm", "seen_nearby"
                             ).select("id", "seen_nearby")


def nation_links(t):
    """Nations of one region; the nation table has a fixed size."""
    a = t.nation.select(F.col("n_nationkey").alias("entity"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("other"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("entity <> other").select("entity", "other")


@query("C13", """
    with y as (select distinct c_nationkey as k, year(o_orderdate)::bigint as yr
               from orders join customer on o_custkey = c_custkey),
    e as (select distinct c_nationkey as k, year(o_orderdate)::bigint as ev
          from orders join customer on o_custkey = c_custkey where o_totalprice > 490000)
    select y.k, y.yr, (select min(ev) from e where e.k = y.k and e.ev >= y.yr) as ev from y""")
def next_large_order_year(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("k"), year("o_orderdate").alias("yr"), "o_totalprice")
    events = rows.filter("o_totalprice > 490000").select("k", F.col("yr").alias("ev"))
    return rel.asof_next(rows.select("k", "yr").distinct(), events, ["k"], "yr", "ev")


@query("C14", """
    with span as (select c_nationkey as k, min(year(o_orderdate))::bigint as lo, max(year(o_orderdate))::bigint as hi
                  from orders join customer on o_custkey = c_custkey where o_totalprice > 495000 group by 1),
    p as (select s_nationkey as k, year(l_shipdate)::bigint as yr, count(*)::bigint as n
          from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)
    select p.k, p.yr, p.n, coalesce((p.yr between lo and hi)::int, 0) as active
    from p left join span on p.k = span.k""")
def within_active_span(t):
    span = (t.orders.filter("o_totalprice > 495000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("k"))
            .agg(F.min(year("o_orderdate")).alias("lo"), F.max(year("o_orderdate")).alias("hi")))
    panel = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy(F.col("s_nationkey").alias("k"), year("l_shipdate").alias("yr"))
             .agg(F.count(F.lit(1)).alias("n")))
    return rel.interval_flag(panel, span, "k", "yr", "lo", "hi", "active")


@query("C15 J3", """
    with s as (select l_suppkey as k, year(l_shipdate)::bigint as yr, sum(l_quantity) as q
               from lineitem group by 1, 2),
    spine as (select distinct yr as y from s)
    select y, k, sum(q) as q from spine join s on s.yr < y group by 1, 2""")
def cumulative_snapshots(t):
    yearly = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), year("l_shipdate").alias("yr")).agg(
        F.sum("l_quantity").alias("q"))
    lo, hi = year_bounds(t)
    return (rel.snapshots(yearly, "yr", lo, hi, "y").groupBy("y", "k").agg(F.sum("q").alias("q")))


def year_bounds(t):
    span = t.lineitem.agg(F.min(year("l_shipdate")).alias("lo"), F.max(year("l_shipdate")).alias("hi"))
    return span.select("lo").scalar(), span.select("hi").scalar()


@query("C15", """
    with s as (select l_suppkey as k, year(l_shipdate)::bigint as yr, sum(l_quantity) as q
               from lineitem group by 1, 2),
    spine as (select distinct yr as y from s)
    select y, k, sum(q) as q from spine join s on s.yr <= y and s.yr > y - 3 group by 1, 2""")
def sliding_snapshots(t):
    yearly = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), year("l_shipdate").alias("yr")).agg(
        F.sum("l_quantity").alias("q"))
    lo, hi = year_bounds(t)
    return (rel.snapshots(yearly, "yr", lo, hi, "y", width=3).groupBy("y", "k").agg(F.sum("q").alias("q")))


@query("C17", "select p_partkey, p_retailprice from part where p_retailprice > (select avg(p_retailprice) from part)")
def above_average_price(t):
    return t.part.filter(F.col("p_retailprice") > t.part.agg(F.avg("p_retailprice").alias("a")).scalar()
                         ).select("p_partkey", "p_retailprice")


@query("C17 C21", """
    with a as (select n_name, c_acctbal from customer join nation on c_nationkey = n_nationkey where c_acctbal >= 5000)
    select n_name, round(sum(c_acctbal) / (select sum(c_acctbal) from a), 8) as share, count(*)::bigint as n
    from a group by n_name having count(*) >= 10""")
def share_of_large_balances(t):
    large = (t.customer.filter("c_acctbal >= 5000")
             .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_acctbal"))
    total = large.agg(F.sum("c_acctbal").alias("s")).scalar()
    return (large.groupBy("n_name").agg(F.sum("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
            .filter("n >= 10").select("n_name", r(F.col("s") / total, 8).alias("share"), "n"))


@query("C18 C21", """
    with a as (select o_custkey, o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as total
               from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
    b as (select o_custkey, max(total) as total from a group by 1)
    select a.o_custkey, a.o_orderkey, a.total from a join b on a.o_custkey = b.o_custkey and a.total = b.total""")
def largest_order_per_customer(t):
    totals = order_lines(t).groupBy("o_custkey", "o_orderkey").agg(r(F.sum(net()), 4).alias("total"))
    return rel.argmax_per_group(totals, ["o_custkey"], "total")


@query("C19", """
    with v as (select c_nationkey as entity, year(o_orderdate)::bigint as yr, avg(o_totalprice) as x
               from orders join customer on o_custkey = c_custkey group by 1, 2),
    links as (select a.n_nationkey as entity, b.n_nationkey as other from nation a join nation b
              on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey)
    select l.entity, v.yr, round(avg(v.x), 4) as near from links l join v on v.entity = l.other group by 1, 2""")
def neighbour_average(t):
    values = nation_year_average(t)
    return rel.neighbour_mean(values, nation_links(t), "entity", "other", "yr", "x", "near"
                              ).withColumn("near", r("near", 4))


def nation_year_average(t):
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("entity"), year("o_orderdate").alias("yr"))
            .agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("x")))


@query("C20 M8", """
    select o_orderkey, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3
      else 0 end as code from orders""")
def priority_codes(t):
    codes = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
    return rel.map_values(t.orders, "o_orderpriority", codes, "code", 0).select("o_orderkey", "code")


@query("F2 D7", """
    with a as (select n_name, c_acctbal from customer join nation on c_nationkey = n_nationkey)
    select n_name, round(avg((c_acctbal >= 5000)::int), 8) as share, count(*)::bigint as n
    from a group by 1 having count(*) filter (where c_acctbal >= 5000) >= 10 order by share, n_name limit 3""")
def lowest_shares_of_rich(t):
    from lodestar.operators.aggregates import share_over
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    shares = share_over(rows, ["n_name"], F.col("c_acctbal") >= 5000, min_n=10)
    shares = shares.select("n_name", r("share", 8).alias("share"), "n")
    return rel.top_n(shares, 3, [F.asc("share"), F.asc("n_name")])


@query("F3 B7", """
    with x as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(l_tax / nullif(l_discount, 0), 6) as ratio from lineitem)
    (select 'max' as side, * from x where ratio is not null
       order by ratio desc, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity limit 1)
    union all
    (select 'min', * from x where ratio is not null
       order by ratio, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity limit 1)""")
def extreme_ratios(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    rows = t.lineitem.select(*keys, r(F.try_divide("l_tax", "l_discount")).alias("ratio"))
    high = rel.extreme_row(rows, "ratio", keys, desc=True).select(F.lit("max").alias("side"), "*")
    low = rel.extreme_row(rows, "ratio", keys, desc=False).select(F.lit("min").alias("side"), "*")
    return high.union(low)


@query("F4", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def head_of_ranking(t):
    return rel.top_n(t.orders.select("o_orderkey", "o_totalprice"), 25,
                     [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("F5", """
    with m as (select p_size as k, round(avg(abs(p_retailprice - 1200)), 6) as metric from part group by 1)
    select k, metric from m order by metric, k limit 1""")
def best_size_by_error(t):
    errors = t.part.groupBy(F.col("p_size").alias("k")).agg(
        r(F.avg(F.abs(F.col("p_retailprice") - 1200))).alias("metric"))
    return rel.argmin(errors, "metric", "k")


@query("G1", """
    select 'SHIPPED' as ship_status, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders where o_orderstatus <> 'O'
    union select 'NOT SHIPPED', o_custkey, strftime(o_orderdate, '%Y-%m-%d') from orders where o_orderstatus = 'O'""")
def shipping_status(t):
    def branch(label, cond):
        return t.orders.filter(cond).select(F.lit(label).alias("ship_status"), "o_custkey",
                                            day_text("o_orderdate").alias("d"))
    return rel.union_distinct(branch("SHIPPED", "o_orderstatus <> 'O'"),
                              branch("NOT SHIPPED", "o_orderstatus = 'O'")).orderBy("d", "o_custkey")


@query("G2", """
    select c_custkey as id, c_name as name, c_acctbal as balance from customer
    union all select s_suppkey, s_name, s_acctbal from supplier""")
def all_accounts(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.col("c_acctbal").alias("balance"))
    return rel.union_all(a, t.supplier, {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})


@query("G3", """
    with e as (select distinct l_suppkey as src, o_custkey as dst from lineitem join orders on l_orderkey = o_orderkey)
    select src, dst from e union select dst, src from e""")
def symmetric_edges(t):
    return rel.symmetrize(order_lines(t).select(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst")))


@query("D1 D3 D4 C3 F1", """
    select c_name, count(distinct o_orderkey)::bigint as n_orders, round(sum(l_extendedprice * (1 - l_discount)), 4) as net
    from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
    group by c_name having count(distinct o_orderkey) > 1 order by net desc""")
def customer_order_totals(t):
    """Customers with more than one order: distinct orders and net total, largest first.

    Lines are summed per order before the customer join, so the distinct count
    is a plain count.
    """
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(net()).alias("net"))
    per_customer = (t.orders.select("o_orderkey", "o_custkey")
                    .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
                    .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("net").alias("net"))
                    .filter("n_orders > 1"))
    named = per_customer.join(t.customer.select("c_custkey", "c_name"),
                              F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_name", "n_orders", r("net", 4).alias("net")).orderBy(F.desc("net"))
