"""Queries over Column helpers."""

from pyspark.sql import functions as F

from lodestar.functions import columns as fn
from lodestar.functions.columns import day_text, r, year
from lodestar.operators.indices import spi
from lodestar.operators.relational import expand_grid, outer_match_totals
from lodestar.plans.registry import query
from lodestar.plans.relational_queries import order_lines

WEEKDAYS = {1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat", 0: "Sun"}


@query("H1", """
    select c_custkey, length(c_name)::bigint as len, right(c_name, 4) as tail,
      concat('XXXX-XXXX-XXXX-', right(c_name, 4)) as masked from customer""")
def masked_numbers(t):
    name = F.col("c_name")
    return t.customer.select("c_custkey", F.length(name).cast("bigint").alias("len"),
                             F.right(name, F.lit(4)).alias("tail"), fn.mask_tail(name).alias("masked"))


@query("H2 H3", """
    select p_partkey, format('{:,.1f}', round(p_retailprice, 1)) as shown, round(p_retailprice)::bigint as whole from part""")
def formatted_prices(t):
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", fn.format_thousands(price, 1).alias("shown"),
                         fn.to_int_rounded(price).alias("whole"))


@query("H4", """
    select event_id, strftime(ts, '%Y-%m-%d') as d, strftime(ts, '%Y-%m') as ym, strftime(ts, '%H:%M:%S') as tm from events""")
def date_parts(t):
    return t.events.select("event_id", fn.date_part_text(F.to_date("ts"), "yyyy-MM-dd").alias("d"),
                           fn.date_part_text(F.col("ts"), "yyyy-MM").alias("ym"),
                           fn.date_part_text(F.col("ts"), "HH:mm:ss").alias("tm"))


@query("H5", """
    select o_orderkey, round(o_totalprice * 1.000777, 3) as up, round(o_custkey / 4.0 + 0.13, 1)::double as quarter from orders""")
def rounded_values(t):
    return t.orders.select("o_orderkey", fn.round_to(F.col("o_totalprice") * 1.000777, 3).alias("up"),
                           fn.round_to(F.col("o_custkey") / 4.0 + 0.13, 1).alias("quarter"))


@query("H6", "select o_orderkey, strftime(o_orderdate - interval 2 month, '%Y-%m-%d') as d from orders")
def two_months_earlier(t):
    return t.orders.select("o_orderkey", day_text(fn.minus_months(F.col("o_orderdate").cast("date"), 2)).alias("d"))


@query("H7", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders")
def repaired_dates(t):
    text = F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yy")).otherwise(
        F.date_format("o_orderdate", "yyyy/M/d"))
    return t.orders.select("o_orderkey", day_text(fn.parse_mixed_date(text)).alias("d"))


@query("H8", "select o_orderkey, year(o_orderdate)::int as y50, "
       "(case when year(o_orderdate) % 100 > 19 then 1900 else 2000 end + year(o_orderdate) % 100)::int as y19 from orders")
def two_digit_years(t):
    text = F.date_format("o_orderdate", "dd-MMM-yy")
    return t.orders.select("o_orderkey", fn.century_year(text).alias("y50"), fn.century_year(text, 19).alias("y19"))


@query("H9 H10", """
    select l_orderkey, l_linenumber, l_partkey, year(l_shipdate)::int as y,
      floor(year(l_shipdate) + (month(l_shipdate) - 0.5) / 12)::bigint as fl from lineitem""")
def years_from_text(t):
    frac = F.year("l_shipdate") + (F.month("l_shipdate") - F.lit(0.5)) / 12
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             fn.year_from_text(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("y"),
                             fn.floor_year(frac).alias("fl"))


@query("H11", """
    select o_orderkey, l_linenumber, l_partkey, datediff('day', o_orderdate, l_shipdate)::bigint as days,
      datediff('month', o_orderdate, l_shipdate)::bigint as months,
      strftime(last_day(o_orderdate), '%Y-%m-%d') as month_end
    from orders join lineitem on o_orderkey = l_orderkey""")
def date_differences(t):
    start, end = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    months = F.months_between(F.trunc(end, "month"), F.trunc(start, "month"))
    return order_lines(t).select("o_orderkey", "l_linenumber", "l_partkey", fn.days_between(end, start).alias("days"),
                                 F.round(months).cast("bigint").alias("months"),
                                 day_text(fn.month_end(start)).alias("month_end"))


@query("H12 C20", """
    with p as (select event_id, strftime(ts, '%y%m%d%H')::bigint as packed from events)
    select event_id, packed % 100 as hour_of_day, (packed // 100) % 100 as day,
      case ((packed // 100) % 100) when 1 then 'Mon' when 2 then 'Tue' when 3 then 'Wed' when 4 then 'Thu'
       when 5 then 'Fri' when 6 then 'Sat' end as weekday from p""")
def unpacked_hours(t):
    packed = F.date_format("ts", "yyMMddHH").cast("bigint")
    names = {d: w for d, w in WEEKDAYS.items() if d > 0}
    return t.events.select("event_id", *[c.alias(n) for n, c in fn.unpack_hour(packed, names).items()])


@query("H13", "select s_suppkey, concat_ws(' ', upper(s_name), 'of', n_name) as label "
       "from supplier join nation on s_nationkey = n_nationkey")
def upper_and_paste(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", F.concat_ws(" ", F.upper("s_name"), F.lit("of"), "n_name").alias("label"))


@query("H14", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def exploded_names(t):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("H15", """
    select l_orderkey, l_partkey, l_linenumber, round(ln(l_quantity + 1), 8) as lg, round(sqrt(l_quantity), 8) as sq,
      round(exp(l_tax), 8) as ex, round(pow(l_quantity, 1.0 / 3), 8) as cb, abs(l_tax - l_discount) as gap,
      ceil(l_extendedprice)::bigint as ce, l_partkey % 7 as md from lineitem""")
def math_functions(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", r(fn.log_shift(q), 8).alias("lg"), r(F.sqrt(q), 8).alias("sq"),
        r(F.exp("l_tax"), 8).alias("ex"), r(F.pow(q, F.lit(1 / 3)), 8).alias("cb"),
        F.abs(F.col("l_tax") - F.col("l_discount")).alias("gap"),
        F.ceil("l_extendedprice").cast("bigint").alias("ce"), (F.col("l_partkey") % 7).alias("md"))


@query("H16", """
    select l_orderkey, l_partkey, l_linenumber, round(l_tax / (l_quantity + 1e-11), 8) as shifted,
      round(l_tax / nullif(l_discount, 0), 8) as plain from lineitem""")
def safe_ratios(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        r(fn.safe_ratio(F.col("l_tax"), F.col("l_quantity"), 1e-11), 8).alias("shifted"),
        r(fn.safe_ratio(F.col("l_tax"), F.col("l_discount")), 8).alias("plain"))


@query("H18 K1", """
    with n as (select least(c_nationkey, s_nationkey) as a, greatest(c_nationkey, s_nationkey) as b
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join supplier on l_suppkey = s_suppkey)
    select a, b, count(*)::bigint as n from n group by 1, 2""")
def canonical_nation_pairs(t):
    rows = (order_lines(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    a, b = fn.canonical_pair(F.col("c_nationkey"), F.col("s_nationkey"))
    return rows.groupBy(a.alias("a"), b.alias("b")).agg(fn.n_rows().alias("n"))


@query("H19", """
    select p_partkey, (case when p_size < 10 then 5 when p_size < 25 then 17 when p_size < 40 then 32 else 45 end)::int as snapped
    from part""")
def snapped_sizes(t):
    return t.part.select("p_partkey", fn.snap(F.col("p_size"), [10, 25, 40], [5, 17, 32, 45]).alias("snapped"))


@query("H20", """
    with p as (select c_nationkey as e, strftime(o_orderdate, '%Y-%m') as m, sum(o_totalprice) as v
               from orders join customer on o_custkey = c_custkey group by 1, 2),
    s as (select avg(v) as mu, stddev_samp(v) as sd from p),
    g as (select e, m, case when 1 - 1 / (9 * pow(mu / sd, 2)) + ((v - mu) / sd) / (3 * sqrt(pow(mu / sd, 2))) >= 0
      then pow(mu / sd, 2) * (sd * sd / mu)
        * pow(1 - 1 / (9 * pow(mu / sd, 2)) + ((v - mu) / sd) / (3 * sqrt(pow(mu / sd, 2))), 3) end as g from p, s)
    select e, m, round((g - avg(g) over (partition by e)) / stddev_samp(g) over (partition by e), 6) as spi from g""")
def standardised_index(t):
    panel = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_nationkey").alias("e"), F.date_format("o_orderdate", "yyyy-MM").alias("m"))
             .agg(F.sum("o_totalprice").alias("v")))
    return spi(panel, "v", "e").select("e", "m", r("spi").alias("spi"))


@query("H21", """
    with p as (select l_orderkey, l_partkey, l_linenumber, l_suppkey, (o_custkey % 120) - 60.0 as a1, (o_custkey % 300) - 150.0 as o1,
      (l_suppkey % 120) - 60.0 as a2, (l_suppkey % 300) - 150.0 as o2 from orders join lineitem on o_orderkey = l_orderkey)
    select l_orderkey, l_partkey, l_linenumber, l_suppkey, round(2 * 6371000.0 * asin(sqrt(least(
      pow(sin(radians(a2 - a1) / 2), 2) + cos(radians(a1)) * cos(radians(a2)) * pow(sin(radians(o2 - o1) / 2), 2), 1.0))), 2) as metres
    from p""")
def tie_distances(t):
    def place(key, width, half):
        return (F.col(key) % width) - F.lit(half)
    metres = fn.geo_distance(place("o_custkey", 120, 60.0), place("o_custkey", 300, 150.0),
                             place("l_suppkey", 120, 60.0), place("l_suppkey", 300, 150.0))
    return order_lines(t).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", r(metres, 2).alias("metres"))


@query("H22 I2", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at from events")
def epoch_times(t):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 123
    rows = t.events.select("event_id", ns.alias("ns"))
    return rows.select("event_id", F.date_format(fn.epoch_ns_to_ts(F.col("ns")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("H23", """
    with p as (select l_orderkey, l_partkey, l_linenumber, l_suppkey, case when c_acctbal > 4500 then 1 else -1 end as a,
        case when s_acctbal > 4500 then 1 else -1 end as b, case when c_mktsegment = 'MACHINERY' then 2 else 1 end as ta,
        case when c_nationkey < 12 then 2 else 1 end as ba, case when s_nationkey % 2 = 0 then 2 else 1 end as tb,
        case when s_nationkey < 12 then 2 else 1 end as bb
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join supplier on l_suppkey = s_suppkey)
    select l_orderkey, l_partkey, l_linenumber, l_suppkey, ((a * b + 1) / 2)::int as same, (ta * bb + ba * tb >= 4)::int as complements from p""")
def matches_along_ties(t):
    rows = (order_lines(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    sign = lambda cond: F.when(cond, 1).otherwise(-1)
    has = lambda cond: F.when(cond, 2).otherwise(1)
    same = fn.match_pair(sign(F.col("c_acctbal") > 4500), sign(F.col("s_acctbal") > 4500))
    comp = fn.complement(has(F.col("c_mktsegment") == "MACHINERY"), has(F.col("c_nationkey") < 12),
                         has(F.col("s_nationkey") % 2 == 0), has(F.col("s_nationkey") < 12))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", same.alias("same"), comp.alias("complements"))


@query("C16 H23", """
    select c_custkey, sum((case when c_acctbal > 4500 then 1 else -1 end) * (case when s_acctbal > 4500 then 1 else -1 end) + 1)::bigint // 2 as matches
    from customer, supplier group by 1""")
def outer_match_row_sums(t):
    sign = lambda c: F.when(F.col(c) > 4500, 1).otherwise(-1)
    a = t.customer.select("c_custkey", sign("c_acctbal").alias("code"))
    b = t.supplier.select(sign("s_acctbal").alias("code"))
    return outer_match_totals(a, b, "code", "code", "matches").select("c_custkey", "matches")


@query("C16", """
    with g as (select s.size, f.flag from (select unnest([10, 20, 30, 40]) as size) s, (select unnest(['A', 'N', 'R']) as flag) f)
    select g.size, g.flag, count(l_quantity)::bigint as n from g left join lineitem on l_returnflag = g.flag and floor(l_quantity / 10) * 10 = g.size
    group by 1, 2""")
def counts_on_a_grid(t):
    grid = expand_grid(t.spark, {"size": [10, 20, 30, 40], "flag": ["A", "N", "R"]})
    counts = t.lineitem.groupBy((F.floor(F.col("l_quantity") / 10) * 10).cast("int").alias("size"),
                                F.col("l_returnflag").alias("flag")).agg(fn.n_rows().alias("n"))
    return grid.join(counts, ["size", "flag"], "left").na.fill(0, ["n"])


@query("H10", "select year(o_orderdate)::bigint as y, count(*)::bigint as n from orders group by 1")
def orders_per_year(t):
    return t.orders.groupBy(year("o_orderdate").alias("y")).agg(fn.n_rows().alias("n"))
