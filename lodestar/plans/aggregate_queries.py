"""Queries over profiles, counts and reshaping."""

from pyspark.sql import functions as F

from lodestar.functions.columns import day_text, n_rows, r, year
from lodestar.operators import aggregates as agg
from lodestar.operators.ordered import order_statistic, quantiles
from lodestar.plans.registry import query
from lodestar.plans.relational_queries import net, order_lines



@query("D1", """
    select p_type, count(*)::bigint as n, max(p_retailprice) as highest, min(p_retailprice) as lowest,
      round(avg(p_retailprice), 6) as mean, round(sum(p_retailprice), 4) as total from part group by 1""")
def part_type_summary(t):
    price = F.col("p_retailprice")
    return t.part.groupBy("p_type").agg(
        n_rows().alias("n"), F.max(price).alias("highest"), F.min(price).alias("lowest"),
        r(F.avg(price)).alias("mean"), r(F.sum(price), 4).alias("total"))


@query("D2", "select sum(o_orderkey)::bigint as key_sum, count(*)::bigint as n from orders")
def global_sum(t):
    return t.orders.agg(F.sum("o_orderkey").alias("key_sum"), n_rows().alias("n"))


@query("D3 D4", """
    select o_custkey, count(distinct l_partkey)::bigint as n_parts from orders join lineitem on o_orderkey = l_orderkey
    group by 1 having count(distinct l_partkey) > 1""")
def distinct_parts_per_customer(t):
    return (order_lines(t).groupBy("o_custkey").agg(F.count_distinct("l_partkey").alias("n_parts"))
            .filter("n_parts > 1"))


@query("D5", """
    select round(o_totalprice / 1000, 0)::bigint as band from orders group by 1
    having max(o_orderdate) <> min(o_orderdate)""")
def bands_with_varied_dates(t):
    rows = t.orders.select(F.round(F.col("o_totalprice") / 1000).cast("bigint").alias("band"), "o_orderdate")
    return agg.groups_with_variation(rows, ["band"], "o_orderdate")


@query("D6", """
    with a as (select o_custkey, c_acctbal, max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as urgent
               from orders join customer on o_custkey = c_custkey group by 1, 2)
    select urgent, round(avg(c_acctbal), 6) as mean_balance from a group by 1""")
def balance_by_urgency(t):
    any_urgent = t.orders.groupBy("o_custkey").agg(
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    rows = any_urgent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("urgent").agg(r(F.avg("c_acctbal")).alias("mean_balance"))


@query("D6", """
    with a as (select l_partkey, max((l_returnflag = 'R')::int) as returned from lineitem group by 1)
    select returned, round(avg(l_partkey), 6) as mean_key from a group by 1""")
def key_mean_by_flag(t):
    return agg.mean_by_flag(t.lineitem.select("l_partkey", F.col("l_partkey").alias("k"), "l_returnflag"),
                            "l_partkey", "k", F.col("l_returnflag") == "R", "returned", "mean_key"
                            ).withColumn("mean_key", r("mean_key"))


def _profile_sql(table, cols):
    return " union all ".join(f"""
        select '{c}' as "column", count({c})::bigint as nobs, min({c})::double as min, max({c})::double as max,
          round(avg({c}), 6) as mean, round(var_samp({c}), 4) as variance,
          round(avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5), 6) as skewness, round(kurtosis_pop({c}), 6) as kurtosis
        from {table}, (select avg({c}) as m from {table})""" for c in cols)


@query("D8 J4", _profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def numeric_profile(t):
    out = agg.profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumns({"mean": r("mean"), "variance": r("variance", 4), "skewness": r("skewness"),
                            "kurtosis": r("kurtosis")})


def _describe_sql(table, cols):
    return " union all ".join(f"""
        select '{c}' as "column", count({c})::bigint as count, round(avg({c}), 6) as mean,
          round(stddev_samp({c}), 6) as std, min({c})::double as min, max({c})::double as max,
          round(quantile_cont({c}, 0.25), 6)::double as q25, round(quantile_cont({c}, 0.5), 6)::double as median,
          round(quantile_cont({c}, 0.75), 6)::double as q75 from {table}""" for c in cols)


@query("D9", _describe_sql("orders", ["o_totalprice", "o_custkey"]))
def described_orders(t):
    out = agg.describe(t.orders, ["o_totalprice", "o_custkey"])
    return out.withColumns({c: r(c) for c in ("mean", "std", "q25", "median", "q75")})


@query("D10", """
    with j as (select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id)
    select 'doc_id' as "column", count(*) filter (where doc_id is null)::bigint as nulls,
      (count(*) filter (where doc_id is null) > 0)::int as any_null from j
    union all select 'source', count(*) filter (where source is null)::bigint, (count(*) filter (where source is null) > 0)::int from j
    union all select 'quality', count(*) filter (where quality is null)::bigint, (count(*) filter (where quality is null) > 0)::int from j
    union all select 'toxic', count(*) filter (where toxic is null)::bigint, (count(*) filter (where toxic is null) > 0)::int from j""")
def null_counts_per_column(t):
    return agg.null_counts(t.documents.join(t.labels, "doc_id", "left")
                           .select("doc_id", "source", "quality", "toxic"))


@query("D11", """
    select 'p_brand' as "column", p_brand as value, count(*)::bigint as n from part group by 2
    union all select 'p_type', p_type, count(*)::bigint from part group by 2
    union all select 'p_size', p_size::varchar, count(*)::bigint from part group by 2""")
def value_frequencies(t):
    return agg.value_counts(t.part, ["p_brand", "p_type", "p_size"])


@query("D12", """
    select p_type, count(*) filter (where l_returnflag <> 'R')::bigint as n0,
      count(*) filter (where l_returnflag = 'R')::bigint as n1,
      round(avg((l_returnflag = 'R')::int), 8) as share1 from lineitem join part on l_partkey = p_partkey group by 1""")
def returns_by_part_type(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_type", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return agg.crosstab(rows, "p_type", "returned").withColumn("share1", r("share1", 8))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("D13", " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def correlation_pairs(t):
    return agg.corr_matrix(t.lineitem, _CORR).withColumn("corr", r("corr"))


@query("D13", " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from customer join nation on c_nationkey = n_nationkey"
    for a in ["c_acctbal"] for b in ["c_custkey", "n_regionkey"]))
def correlation_block(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.corr_matrix(rows, ["c_acctbal"], against=["c_custkey", "n_regionkey"]).withColumn("corr", r("corr"))


@query("D14", """
    select round(quantile_cont(l_extendedprice, 0.75), 4)::double as q75, round(quantile_cont(l_extendedprice, 0.9), 4)::double as q90
    from lineitem""")
def price_quantiles(t):
    out = quantiles(t.lineitem, "l_extendedprice", {"q75": 0.75, "q90": 0.9})
    return out.select(r("q75", 4).alias("q75"), r("q90", 4).alias("q90"))


@query("D14", """
    select x from (select l_extendedprice as x, row_number() over (order by l_extendedprice) as rn from lineitem)
    where rn = (select ceil(0.9 * count(*)) from lineitem)""")
def price_order_statistic(t):
    return order_statistic(t.lineitem, "l_extendedprice", 0.9, "x")


@query("D15", """
    with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
    select least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19)::bigint as bin, count(*)::bigint as n,
      round(any_value(lo) + least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19) * (any_value(hi) - any_value(lo)) / 20, 4) as left_edge
    from orders, b group by 1, least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19)""")
def price_histogram(t):
    return agg.histogram(t.orders, "o_totalprice", 20).withColumn("left_edge", r("left_edge", 4))


@query("D16", """
    with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
    select o_orderpriority, least(floor((o_totalprice - lo) * 10 / (hi - lo)), 9)::bigint as bin, count(*)::bigint as n
    from orders, b group by 1, 2""")
def price_histogram_by_priority(t):
    return agg.histogram(t.orders, "o_totalprice", 10, by=["o_orderpriority"]).drop("left_edge")


@query("D17", """
    with c as (select unnest(quantile_cont(l_quantity, [0.25, 0.5, 0.75])) as centre from lineitem),
    x as (select rowid_, arg_min(centre, abs(q - centre) + centre * 1e-12) as centre, any_value(y) as y from
       (select row_number() over () as rowid_, l_quantity as q, l_extendedprice as y from lineitem), c group by 1)
    select centre::double as centre, round(avg(y), 4) as mean, count(*)::bigint as n from x group by 1""")
def price_by_quantity_bin(t):
    return agg.binned_mean(t.lineitem, "l_quantity", "l_extendedprice", 3).withColumn("mean", r("mean", 4))


_SIGNAL_COLS = ["event_type", "user_id", "k"]


@query("D18", " union all ".join(f"""
    select '{c}' as "column", count(*)::bigint as categories, round(var_samp(m), 8) as signal from
      (select {x} as v, avg(value) as m from events group by 1)""" for c, x in
    [("event_type", "event_type"), ("user_id", "user_id"), ("k", "json_extract_string(props, '$.k')")]))
def category_signal_of_value(t):
    rows = t.events.select("event_type", "user_id", F.get_json_object("props", "$.k").alias("k"), "value")
    return agg.category_signal(rows, _SIGNAL_COLS, "value").withColumn("signal", r("signal", 8))


@query("D19", " union all ".join(f"""
    select '{c}' as "column", count(*)::bigint as categories, count(*) filter (where n >= 0.015 * total)::bigint as frequent
    from (select {c}, count(*) as n from part group by 1), (select count(*) as total from part)"""
    for c in ["p_brand", "p_type", "p_size"]))
def frequent_category_counts(t):
    return agg.category_counts(t.part, ["p_brand", "p_type", "p_size"], 0.015)


@query("D20", """
    select user_id, count(*) filter (where event_type = 'view')::bigint as "view",
      count(*) filter (where event_type = 'click')::bigint as click,
      count(*) filter (where event_type = 'signup')::bigint as signup,
      count(*) filter (where event_type = 'error')::bigint as error,
      count(*) filter (where event_type = 'purchase')::bigint as purchase from events group by 1""")
def event_counts_wide(t):
    return agg.pivot(t.events, ["user_id"], "event_type")


@query("D20", """
    select l_suppkey, max((l_returnflag = 'A')::int)::bigint as "A", max((l_returnflag = 'N')::int)::bigint as "N",
      max((l_returnflag = 'R')::int)::bigint as "R" from lineitem group by 1""")
def flag_presence_wide(t):
    return agg.pivot(t.lineitem, ["l_suppkey"], "l_returnflag", presence=True)


@query("D21", """
    select l_orderkey, l_linenumber, l_partkey, 'l_discount' as "column", l_discount as value from lineitem
    union all select l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax from lineitem""")
def rates_long(t):
    return agg.unpivot(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax"),
                       ["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"])


@query("D22 J2", """
    with a as (select l_suppkey as s, year(l_shipdate)::bigint as yr, p_type, sum(l_extendedprice) as w
               from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)
    select s, yr, round(sum(pow(100 * w / tot, 2)), 4) as hhi
    from (select *, sum(w) over (partition by s, yr) as tot from a) group by 1, 2""")
def supplier_concentration(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("s"), year("l_shipdate").alias("yr"), "p_type", "l_extendedprice")
    return agg.hhi(rows, ["s", "yr"], "p_type", F.col("l_extendedprice")).withColumn("hhi", r("hhi", 4))


@query("D23", """
    select l_suppkey, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 8) as rate
    from lineitem group by 1""")
def effective_discount(t):
    return agg.ratio_of_sums(t.lineitem, ["l_suppkey"], F.col("l_extendedprice") * F.col("l_discount"),
                             F.col("l_extendedprice"), "rate").withColumn("rate", r("rate", 8))


@query("D24 E6", """
    select event_id, count(*) over (partition by user_id)::bigint as n,
      round(sum(value) over (partition by user_id), 4) as total from events""")
def events_with_user_totals(t):
    out = agg.with_group_agg(t.events.select("event_id", "user_id", "value"), ["user_id"],
                             [n_rows().alias("n"), r(F.sum("value"), 4).alias("total")])
    return out.select("event_id", "n", "total")


@query("D25", """
    with top as (select p_brand from part where p_brand <> '' group by 1 order by count(*) desc, p_brand limit 10)
    select p_partkey, (p_brand in (select p_brand from top))::int as top_brand from part""")
def top_brand_flag(t):
    return agg.top_categories(t.part.select("p_partkey", "p_brand"), "p_brand", 10, "top_brand").drop("p_brand")


@query("D26", """
    select o_custkey, round(1 - 1 / (1 + sum(l_discount) / count(*)), 8) as diversity
    from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def customer_diversity(t):
    return agg.diversification(order_lines(t), ["o_custkey"], F.col("l_discount"), "diversity"
                               ).withColumn("diversity", r("diversity", 8))


@query("D27", """
    with a as (select user_id, event_type, avg(value) as m from events group by 1, 2)
    select user_id, round(avg(m), 6) as mean from a group by 1""")
def user_mean_of_means(t):
    return agg.mean_of_means(t.events, ["user_id"], ["event_type"], "value", "mean").withColumn("mean", r("mean"))


@query("D28", """
    select l_suppkey as node, round(sum(l_extendedprice * (1 - l_discount)), 4) as total from lineitem group by 1""")
def contributions_by_key(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(r(F.sum(net()), 4).alias("total"))


@query("D29", """
    select year(l_shipdate)::bigint as yr, round(avg(l_quantity) filter (where l_returnflag = 'A'), 6) as "A",
      round(avg(l_quantity) filter (where l_returnflag = 'N'), 6) as "N",
      round(avg(l_quantity) filter (where l_returnflag = 'R'), 6) as "R" from lineitem group by 1""")
def yearly_mean_by_flag(t):
    rows = t.lineitem.select(year("l_shipdate").alias("yr"), "l_returnflag", "l_quantity")
    out = agg.mean_by_type(rows, "yr", "l_returnflag", "l_quantity")
    return out.withColumns({c: r(c) for c in out.columns if c != "yr"})


@query("D1", """
    select strftime(o_orderdate, '%Y-%m-%d') as d, count(*)::bigint as n, round(sum(o_totalprice), 4) as total
    from orders group by 1""")
def daily_order_totals(t):
    return t.orders.groupBy(day_text("o_orderdate").alias("d")).agg(
        n_rows().alias("n"), r(F.sum("o_totalprice"), 4).alias("total"))
