"""Queries over time gaps, running values, scores and spans."""

from pyspark.sql import functions as F

from lodestar.functions.columns import day_text, n_rows, r, year
from lodestar.operators import windows as win
from lodestar.operators.ordered import neighbours, running_sums
from lodestar.plans.registry import query
from lodestar.plans.relational_queries import nation_year_average



@query("E1", """
    select event_id, lag(value) over (partition by user_id order by ts, event_id) as prev_value,
      lag(event_type) over (partition by user_id order by ts, event_id) as prev_type from events""")
def previous_event(t):
    out = neighbours(t.events.select("event_id", "user_id", "ts", "value", "event_type"), ["user_id"],
                     ["ts", "event_id"], lags={"prev_value": "value", "prev_type": "event_type"})
    return out.select("event_id", "prev_value", "prev_type")


@query("E1", """
    with p as (select c_nationkey as entity, year(o_orderdate)::bigint as yr, sum(o_totalprice::decimal(18, 2))::double / count(*) as x
               from orders join customer on o_custkey = c_custkey group by 1, 2)
    select entity, yr, x, lag(x, 1) over w as x_lag1, lag(x, 2) over w as x_lag2
    from p window w as (partition by entity order by yr)""")
def panel_with_lags(t):
    out = win.panel_lags(nation_year_average(t), ["entity"], "yr", ["x"], [1, 2])
    return out.select("entity", "yr", "x", "x_lag1", "x_lag2")


@query("E2", """
    with d as (select strftime(ts, '%Y-%m-%d') as d, count(*)::bigint as n from events group by 1)
    select d, n, lag(n) over (order by d) as prev from d""")
def daily_counts_with_previous(t):
    days = t.events.groupBy(day_text("ts").alias("d")).agg(n_rows().alias("n"))
    return win.panel_lags(days, [], "d", ["n"]).withColumnRenamed("n_lag1", "prev")


@query("E3", """
    select o_orderkey, datediff('day', o_orderdate, lead(o_orderdate) over
      (partition by o_custkey order by o_orderdate, o_orderkey))::bigint as gap from orders""")
def days_to_next_order(t):
    out = win.gap_to_next(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"],
                          ["o_orderdate", "o_orderkey"], lambda nxt, cur: F.datediff(nxt, cur).cast("bigint"), "gap")
    return out.select("o_orderkey", "gap")


@query("E4", """
    with p as (select l_suppkey as s, year(l_shipdate)::bigint as yr, sum(l_extendedprice) as v from lineitem group by 1, 2)
    select s, yr, round(lead(v) over (partition by s order by yr) / nullif(v, 0), 6) as growth from p""")
def value_growth(t):
    panel = t.lineitem.groupBy(F.col("l_suppkey").alias("s"), year("l_shipdate").alias("yr")).agg(
        F.sum("l_extendedprice").alias("v"))
    return win.lead_ratio(panel, ["s"], "yr", "v", "growth").select("s", "yr", r("growth").alias("growth"))


@query("E7", """
    select o_orderkey, round(sum(o_totalprice) over w, 4) as running,
      round(sum(o_totalprice) over w - o_totalprice, 4) as prior
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def running_totals(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = running_sums(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       {"running": F.col("o_totalprice")})
    return out.select("o_orderkey", r("running", 4).alias("running"),
                      r(F.col("running") - F.col("o_totalprice"), 4).alias("prior"))


@query("E8", """
    select event_id, round(sum((event_type = 'click')::int) over w / (sum(value::decimal(18, 2)) over w)::double, 8) as ratio,
      (sum(value::decimal(18, 2)) over w)::double / count(*) over w as mean
    from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def running_ratios(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    out = running_sums(rows, ["user_id"], ["ts", "event_id"],
                       {"clicks": (F.col("event_type") == "click").cast("int"), "total": F.col("value").cast("decimal(18,2)"),
                        "n": F.lit(1)})
    total = F.col("total").cast("double")
    return out.select("event_id", r(F.try_divide(F.col("clicks").cast("double"), total), 8).alias("ratio"),
                      (total / F.col("n")).alias("mean"))


@query("E9", """
    with p as (select l_suppkey as s, strftime(l_shipdate, '%Y-%m') as m, sum(l_extendedprice) as v from lineitem group by 1, 2)
    select s, m, round(avg(v) over (partition by s order by m rows between 9 preceding and current row), 6) as trail from p""")
def trailing_mean(t):
    panel = t.lineitem.groupBy(F.col("l_suppkey").alias("s"), F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(
        F.sum("l_extendedprice").alias("v"))
    return win.rolling_mean(panel, ["s"], "m", "v", 10, "trail").select("s", "m", r("trail", 6).alias("trail"))


@query("E10", """
    select c_custkey, round(coalesce((c_acctbal - avg(c_acctbal) over (partition by c_nationkey))
      / nullif(stddev_samp(c_acctbal) over (partition by c_nationkey), 0), c_acctbal), 6) as z from customer""")
def balance_zscore(t):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return win.zscore(rows, "c_acctbal", ["c_nationkey"], "z").select("c_custkey", r("z").alias("z"))


@query("E11", """
    with s as (select p_partkey, 1 - p_retailprice / (select max(p_retailprice) from part) as x from part)
    select p_partkey, round((x - (select avg(x) from s)) / (select stddev_samp(x) from s), 6) as z from s""")
def similarity_score(t):
    return win.similarity_z(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "z").select(
        "p_partkey", r("z").alias("z"))


@query("E12", """
    with q as (select year(o_orderdate)::bigint as yr, quantile_cont(o_totalprice, 0.9) as cut from orders group by 1)
    select o_orderkey, (o_totalprice > cut)::int as top_decile from orders join q on year(o_orderdate) = yr""")
def top_decile_orders(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", year("o_orderdate").alias("yr"))
    return win.above_group_quantile(rows, ["yr"], "o_totalprice", 0.9, "top_decile").select("o_orderkey", "top_decile")


@query("E13", """
    with p as (select distinct l_suppkey as s, l_partkey as k, year(l_shipdate)::bigint as yr from lineitem)
    select s, k, yr, (yr < min(yr) over (partition by s, k) + 3)::int as is_new from p""")
def new_part_for_supplier(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k"),
                             year("l_shipdate").alias("yr")).distinct()
    return win.novelty(rows, ["s", "k"], "yr", 3, "is_new")


@query("E14 E15", """
    select o_orderkey, (year(o_orderdate) - min(year(o_orderdate)) over (partition by o_custkey))::bigint as age,
      (year(o_orderdate) = min(year(o_orderdate)) over (partition by o_custkey))::int as is_first from orders""")
def customer_age_at_order(t):
    rows = t.orders.select("o_orderkey", "o_custkey", year("o_orderdate").alias("yr"))
    return win.age(rows, ["o_custkey"], "yr", "age", "is_first").select("o_orderkey", "age", "is_first")


@query("E16", """
    select o_orderkey, coalesce(min(case when o_totalprice > 400000 then year(o_orderdate) end) over w,
      min(year(o_orderdate)) over w)::bigint as start_year from orders window w as (partition by o_custkey)""")
def earliest_large_year(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", year("o_orderdate").alias("yr"))
    return win.earliest_valid(rows, ["o_custkey"], "yr", F.col("o_totalprice") > 400000, "start_year").select(
        "o_orderkey", "start_year")


@query("E17", """
    with e as (select min(year(o_orderdate)) as lo, max(year(o_orderdate)) as hi from orders),
    s as (select o_custkey, min(year(o_orderdate)) - lo + 1 as j, max(year(o_orderdate)) - lo + 2 as l, hi - lo + 1 as last
          from orders, e group by o_custkey, lo, hi)
    select o_custkey, j::bigint as "join", (case when l > last then l - 1 else l end)::bigint as "leave" from s""")
def customer_span(t):
    rows = t.orders.select("o_custkey", year("o_orderdate").alias("yr"))
    out = win.activity_span(rows, "o_custkey", "yr")
    return out.select("o_custkey", F.col("join").cast("bigint"), F.col("leave").cast("bigint"))


@query("E18", " union all ".join(f"""
    select '{c}' as "column", v as value, n, row_number() over (order by n desc, v)::bigint as rank from
      (select {x} as v, count(*)::bigint as n from events group by 1)""" for c, x in
    [("event_type", "event_type"), ("user_id", "user_id::varchar"), ("k", "json_extract_string(props, '$.k')")]))
def category_frequency_rank(t):
    rows = t.events.select("event_type", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return win.frequency_rank(rows, ["event_type", "user_id", "k"])


@query("E19", """
    with a as (select time_bucket(interval 15 minutes, ts) as w, event_type as gt, count(*) as n from events
               where event_type in ('click', 'view') group by 1, 2),
    b as (select w, gt, n - lag(n) over (partition by w order by gt) as d, count(*) over (partition by w) as c,
               row_number() over (partition by w order by gt desc) as rn from a)
    select strftime(w, '%Y-%m-%d %H:%M') as start,
      case when coalesce(d, 1) < 0 then 'yes' when c = 1 and gt = 'click' then 'yes' else 'no' end as recommend_standing
    from b where rn = 1""")
def standing_advice_per_window(t):
    out = win.standing_advice(t.events, "ts", "event_type", "click", "view")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("E20 D27 E2", """
    with a as (select time_bucket(interval 15 minutes, ts) as w, event_type, avg(value) as x,
                 avg(json_extract_string(props, '$.k')::double) as y, avg(length(props)::double) as z
               from events group by 1, 2),
    b as (select w, avg(x) as x, avg(y) as y, avg(z) as z from a group by 1),
    c as (select w, round(sqrt(pow(x - lag(x) over o, 2) + pow(y - lag(y) over o, 2) + pow(z - lag(z) over o, 2)), 6) as dist
          from b window o as (order by w))
    select strftime(w, '%Y-%m-%d %H:%M') as start, dist,
      case when dist < lag(dist) over (order by w) then 'yes' else 'no' end as recommend_moving from c""")
def movement_advice_per_window(t):
    rows = t.events.select("ts", "event_type", F.col("value").alias("x"),
                           F.get_json_object("props", "$.k").cast("double").alias("y"),
                           F.length("props").cast("double").alias("z"))
    out = win.movement_advice(rows, "ts", "event_type", ["x", "y", "z"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), r("dist").alias("dist"),
                      "recommend_moving")
