"""Queries over panel, count, survival and smoothing models."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows, r, year
from lodestar.operators import panel as pa
from lodestar.operators.relational import expand_grid
from lodestar.plans.registry import query
from lodestar.plans.relational_queries import order_lines
from lodestar.session import cut_lineage


def shown(table, digits=5):
    return table.select(*[c for c in table.columns if c not in ("estimate", "se", "stat", "p")],
                        *[r(c, digits).alias(c) for c in ("estimate", "se", "stat", "p")])


def supplier_panel(t):
    """Supplier and year: lines, average price and discount, returned lines."""
    out = t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), year("l_shipdate").alias("yr")).agg(
        n_rows().alias("n"), F.avg(F.col("l_extendedprice") / 1000).alias("price"), F.avg("l_quantity").alias("quantity"),
        (100 * F.avg("l_discount")).alias("discount"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return cut_lineage(out)


PANEL = """
    p as (select l_suppkey as entity, year(l_shipdate)::bigint as yr, avg(l_extendedprice / 1000) as price,
      100 * avg(l_discount) as discount from lineitem group by 1, 2)"""


def _within_sql(by):
    return f"""
    with {PANEL}, d as (select price - avg(price) over (partition by {by}) as y, discount - avg(discount) over (partition by {by}) as x, {by} as g from p),
    s as (select sum(x * y) / sum(x * x) as b, sum(x * x) as xx, count(*) as n, count(distinct g) as k from d),
    e as (select b, sqrt(sum(pow(y - b * x, 2)) / (any_value(n) - any_value(k) - 1) / any_value(xx)) as se from d, s group by b)
    select 'discount' as term, round(b, 5) as estimate, round(se, 5) as se, round(b / se, 5) as stat from e"""


@query("P1", _within_sql("entity"))
def entity_effects(t):
    return shown(pa.within(supplier_panel(t), "price", ["discount"], entity="entity")).drop("p")


@query("P2", _within_sql("yr"))
def time_effects(t):
    return shown(pa.within(supplier_panel(t), "price", ["discount"], time="yr")).drop("p")


def _two_way_sql(sweeps=40):
    """Both effects swept out in turn, then the normal equations of two terms."""
    steps = []
    for k in range(2 * sweeps):
        by = ("entity", "yr")[k % 2]
        steps.append(f"d{k + 1} as materialized (select entity, yr, " + ", ".join(
            f"{c} - avg({c}) over (partition by {by}) as {c}" for c in ("y", "u", "v")) + f" from d{k})")
    last = f"d{2 * sweeps}"
    return f"""
    with d0 as materialized (select l_suppkey as entity, year(l_shipdate)::bigint as yr, avg(l_extendedprice / 1000) as y,
      100 * avg(l_discount) as u, avg(l_quantity) as v from lineitem group by 1, 2), {", ".join(steps)},
    s as (select sum(u * u) as uu, sum(v * v) as vv, sum(u * v) as uv, sum(u * y) as uy, sum(v * y) as vy,
      count(*) - count(distinct entity) - count(distinct yr) + 1 - 2 as dof from {last}),
    b as (select *, uu * vv - uv * uv as det, (vv * uy - uv * vy) / (uu * vv - uv * uv) as b1,
      (uu * vy - uv * uy) / (uu * vv - uv * uv) as b2 from s),
    e as (select b1, b2, sqrt(vv / det * r / dof) as s1, sqrt(uu / det * r / dof) as s2
      from b, (select sum(pow(y - b1 * u - b2 * v, 2)) as r from {last}, b))
    select 'discount' as term, round(b1, 5) as estimate, round(s1, 5) as se, round(b1 / s1, 5) as stat from e
    union all select 'quantity', round(b2, 5), round(s2, 5), round(b2 / s2, 5) from e"""


@query("P3", _two_way_sql())
def two_way_effects(t):
    return shown(pa.within(supplier_panel(t), "price", ["discount", "quantity"], entity="entity", time="yr")).drop("p")


@query("P4")
def returned_poisson(t):
    return shown(pa.poisson_fe(supplier_panel(t), "returned", ["price", "discount"], "entity", "yr"))


@query("P5")
def returned_poisson_by_type(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    panel = cut_lineage(rows.groupBy(F.col("l_suppkey").alias("entity"), year("l_shipdate").alias("yr"), "p_type").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.avg("l_quantity").alias("quantity")))
    return shown(pa.poisson_fe_by(panel, "returned", ["quantity"], "entity", "p_type"))


@query("P6")
def returned_negative_binomial(t):
    panel = supplier_panel(t)
    terms = {"price": F.col("price"), "discount": F.col("discount"), **pa.dummies(panel, "yr")}
    table, theta = pa.neg_binomial(panel, "returned", terms, exposure=F.col("n"))
    return shown(table, 4).withColumn("overdispersed", F.lit(int(theta < pa.MAX_THETA)))


def daily_purchases(t):
    """Purchases of every user on every day, days without any included, with the user's views and level."""
    days = t.events.select("user_id").distinct().withColumn(
        "day", F.explode(F.sequence(F.lit(1), F.lit(30))))
    daily = t.events.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("bought"))
    level = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "view") / 30).alias("views"),
                                            (F.avg("value") / 50).alias("level"))
    return days.join(daily, ["user_id", "day"], "left").na.fill(0, ["bought"]).join(level, "user_id")


@query("P7")
def purchases_zero_inflated(t):
    """Daily purchases per user on the user's other activity."""
    terms = {"views": F.col("views"), "level": F.col("level")}
    return shown(pa.zero_inflated_poisson(daily_purchases(t), "bought", terms, {}, alpha=None), 4)


@query("P7")
def purchases_zero_inflated_selected(t):
    """The terms of daily purchases with p below 0.05."""
    terms = {"views": F.col("views"), "level": F.col("level")}
    return shown(pa.zero_inflated_poisson(daily_purchases(t), "bought", terms, {}), 4)


@query("P8")
def shipping_hazard(t):
    """Days between a line's order and its shipping; lines that are not final are censored at their day."""
    days = F.abs(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")))
    rows = order_lines(t).select(days.alias("days"), (F.col("l_linestatus") == "F").cast("int").alias("event"),
                                 (F.col("l_quantity") / 50).alias("quantity"), (10 * F.col("l_discount")).alias("discount"))
    return shown(pa.cox(rows, "days", "event", ["quantity", "discount"], ties="efron"), 4)


@query("P9 E8")
def share_logit(t):
    panel = supplier_panel(t).withColumn("share", F.col("returned") / F.col("n"))
    w = Window.partitionBy("entity").orderBy("yr")
    panel = panel.withColumns({"lag_price": F.lag("price").over(w), "lag_discount": F.lag("discount").over(w)}).na.drop()
    panel = cut_lineage(pa.mundlak(panel, "entity", "yr", ["lag_price", "lag_discount"]))
    terms = {"lag_price": F.col("lag_price"), "lag_discount": F.col("lag_discount"), "mundlak": F.col("mundlak"),
             **pa.dummies(panel, "yr")}
    table, _ = pa.fractional_logit(panel, "share", terms)
    return shown(table, 4)


@query("P10", """
    with m as (select avg(p_size) as mu, count(*) as n from part),
    k as (select mu, n, sum(pow(p_size - mu, 2)) as a, sum(pow(p_size - mu, 3)) as b, sum(pow(p_size - mu, 4)) as c from part, m group by 1, 2)
    select p_partkey, round((p_size - mu) / sqrt(a), 8) as p1,
      round((pow(p_size - mu, 2) - b / a * (p_size - mu) - a / n) / sqrt(c - b * b / a - a * a / n), 8) as p2 from part, k""")
def orthogonal_terms(t):
    out = pa.ortho_poly(t.part.select("p_partkey", "p_size"), "p_size")
    return out.select("p_partkey", r("p_size_p1", 8).alias("p1"), r("p_size_p2", 8).alias("p2"))


@query("P11 P10 C16 N7")
def fitted_surface(t):
    """Price fitted on two orthogonal polynomials and their interaction, on a 10 x 11 grid."""
    size, disc = pa.OrthoPoly.fit(t.lineitem, "l_quantity"), pa.OrthoPoly.fit(t.lineitem, "l_discount")

    def terms(a, b):
        (a1, a2), (b1, b2) = size.columns(a), disc.columns(b)
        return {"q1": a1, "q2": a2, "d1": b1, "d2": b2, "q1:d1": a1 * b1}

    fit = pa.ols(t.lineitem, "l_extendedprice", terms(F.col("l_quantity"), F.col("l_discount")))
    estimates = {row["term"]: row["estimate"] for row in fit.collect()}  # one row per term
    grid = expand_grid(t.spark, {"quantity": [float(5 * i) for i in range(1, 11)], "discount": [i / 100 for i in range(11)]})
    return pa.surface(grid, terms(F.col("quantity"), F.col("discount")), estimates).withColumn("fitted", r("fitted", 2))


@query("P12", """
    with b as (select min(p_size)::double as lo, max(p_size)::double as hi from part),
    g as (select i as point, lo + i * (hi - lo) / 49 as x0, 0.3 * (hi - lo) as h from b, range(50) t(i)),
    w as (select point, x0, p_size - x0 as u, p_retailprice as y, pow(1 - pow(abs(p_size - x0) / h, 3), 3) as w
          from g join part on abs(p_size - x0) < h),
    s as (select point, x0, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * y) as t0, sum(w * y * u) as t1 from w group by 1, 2)
    select point::bigint as point, round(x0, 6) as x, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 5) as fitted from s""")
def smoothed_price(t):
    return pa.local_smooth(t.part, "p_size", "p_retailprice", 0.3).withColumns({"x": r("x"), "fitted": r("fitted", 5)})
