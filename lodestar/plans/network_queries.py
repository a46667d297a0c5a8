"""Queries over networks derived from orders and lines.

Supplier transitions link the suppliers of consecutive deliveries of a part;
the trade network links supplier and customer nations.
"""

from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows, r, year
from lodestar.operators import centrality as cen
from lodestar.operators import networks as net
from lodestar.operators import pairs as pr
from lodestar.operators import windows as win
from lodestar.operators.ordered import neighbours
from lodestar.operators.relational import snapshots
from lodestar.plans.registry import query
from lodestar.plans.relational_queries import order_lines
from lodestar.session import cut_lineage


TRANSITIONS = """
    tr as (select l_suppkey as src, lead(l_suppkey) over (partition by l_partkey
             order by l_shipdate, l_orderkey, l_linenumber, l_suppkey) as dst from lineitem),
    e as (select src, dst, count(*)::double as weight from tr where dst is not null and src <> dst group by 1, 2)"""

TRADE = """
    v as (select s_nationkey as src, c_nationkey as dst, sum(l_extendedprice::decimal(18, 2))::double as v
          from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey
          join customer on o_custkey = c_custkey where s_nationkey <> c_nationkey group by 1, 2),
    e as (select src, dst, 1e6 / (v - (select min(v) from v) + 1e4) as weight from v)"""

# shortest distances by repeated min-plus products: paths of up to 32 arcs
CLOSURE = """,
    nodes as (select src as x from {e} union select dst from {e}),
    d0 as (select src as i, dst as j, weight as d from {e} union all select x, x, 0.0 from nodes)""" + "".join(f""",
    d{k + 1} as materialized (select a.i, b.j, min(a.d + b.d) as d from d{k} a join d{k} b on a.j = b.i group by 1, 2)"""
                                                                                           for k in range(5))


def transitions(t):
    rows = t.lineitem.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return net.transition_edges(rows, "l_partkey", "l_suppkey",
                                ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"])


def trade_values(t):
    rows = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .filter("s_nationkey <> c_nationkey"))
    return cut_lineage(rows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v")))


def trade(t):
    """Nation network; the length of an arc falls with the value traded."""
    values = trade_values(t)
    low = values.agg(F.min("v").alias("m")).scalar()
    return cut_lineage(values.select("src", "dst", (1e6 / (F.col("v") - low + 1e4)).alias("weight")))


def customer_parts(t):
    """Customer and part of all lines: a two-mode network."""
    return order_lines(t).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                                 F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def _label_rounds(n):
    """Least label of a node and its neighbours, ``n`` times."""
    return "".join(f""",
    c{k} as materialized (select node, min(comp) as comp from (select * from c{k - 1}
      union all select a.dst, o.comp from a join c{k - 1} o on o.node = a.src) group by 1)""" for k in range(1, n + 1))


# the labels settle after about half as many rounds: a path from the least node needs one round a step
COMPONENTS = f"""
    e as materialized (select distinct 'c' || o_custkey as src, 'p' || l_partkey as dst from orders join lineitem on o_orderkey = l_orderkey),
    a as materialized (select src, dst from e union all select dst, src from e),
    c0 as (select src as node, min(src) as comp from a group by 1){_label_rounds(16)}"""


def part_lines(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


@query("K1 L1", """
    with e as (select s_nationkey as src, c_nationkey as dst, count(*) as w from lineitem
         join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
         group by 1, 2)
    select n_nationkey as node, round((select count(*) from e where dst = n_nationkey) / 24.0, 8)::double as in_degree,
      round((select count(*) from e where src = n_nationkey) / 24.0, 8)::double as out_degree from nation""")
def degrees_with_isolates(t):
    rows = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    ties = rows.groupBy("s_nationkey", "c_nationkey").agg(n_rows().alias("w"))
    vertices, edges = net.graph(ties, "s_nationkey", "c_nationkey", "w", t.nation.select("n_nationkey"))
    inn = cen.degree(edges, vertices, "in").withColumnRenamed("degree", "in_degree")
    out = cen.degree(edges, vertices, "out").withColumnRenamed("degree", "out_degree")
    return inn.join(out, "node").select("node", r("in_degree", 8).alias("in_degree"), r("out_degree", 8).alias("out_degree"))


@query("K2 C10 C11", """
    with m as (select distinct l_orderkey as g, l_suppkey as s from lineitem)
    select a.s as l_suppkey, count(b.s)::bigint as strength from m a left join m b on a.g = b.g and a.s <> b.s group by 1""")
def projection_strengths(t):
    return net.projection_strength(t.lineitem, "l_orderkey", "l_suppkey")


@query("K2 C10", """
    with m as (select distinct l_orderkey as g, l_suppkey as s from lineitem)
    select count(*)::bigint as ties from m a join m b on a.g = b.g and a.s < b.s""")
def projection_tie_count(t):
    return net.projection_ties(t.lineitem, "l_orderkey", "l_suppkey")


@query("K2 C11 C19", """
    with m as (select distinct l_orderkey as g, l_suppkey as s from lineitem)
    select a.s as l_suppkey, round(sum(coalesce(s_acctbal, 0)), 2) as partner_balance
    from m a left join m b on a.g = b.g and a.s <> b.s left join supplier on b.s = s_suppkey group by 1""")
def projection_partner_balance(t):
    values = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return net.projection_sum(t.lineitem, "l_orderkey", "l_suppkey", values, "s_acctbal", "partner_balance"
                              ).withColumn("partner_balance", r("partner_balance", 2))


@query("C10 K2", """
    with m as (select distinct l_orderkey as g, p_type as c from lineitem join part on l_partkey = p_partkey)
    select x.c as a, y.c as b, count(*)::bigint as n_ab from m x join m y on x.g = y.g and x.c < y.c group by 1, 2""")
def type_pairs_in_orders(t):
    return pr.co_occurrence(part_lines(t), ["l_orderkey"], "p_type").select("a", "b", "n_ab")


@query("C11 K2", """
    with m as (select distinct l_orderkey as g, p_type as c from lineitem join part on l_partkey = p_partkey)
    select x.c as a, y.c as b, count(*)::bigint as n_ab from m x join m y on x.g = y.g and x.c <> y.c group by 1, 2""")
def ordered_type_pairs(t):
    return pr.ordered_pairs(pr.co_occurrence(part_lines(t), ["l_orderkey"], "p_type"))


@query("K3", """
    select year(l_shipdate)::bigint as period, s_nationkey as sender, p_brand as receiver, 1 as tie
    from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1, 2, 3""")
def bipartite_ties(t):
    rows = (part_lines(t).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .withColumn("yr", year("l_shipdate")))
    return net.bipartite_panel(rows, "s_nationkey", "p_brand", "yr")


@query("K3", """
    with p as (select distinct year(l_shipdate)::bigint as period, s_nationkey as sender, p_brand
               from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey)
    select y.period, n_nationkey as sender, count(p.p_brand)::bigint as ties from nation, (select distinct period from p) y
    left join p on p.period = y.period and p.sender = n_nationkey group by 1, 2""")
def bipartite_sender_totals(t):
    return net.bipartite_totals(bipartite_ties(t), t.nation, "n_nationkey")


@query("K4", """
    with l as (select distinct o_custkey as a, l_suppkey as b, o_orderdate as d from orders join lineitem on o_orderkey = l_orderkey),
    now as (select max(d) + interval 1 day as now from l),
    g as (select datediff('day', d, lead(d) over (partition by a, b order by d)) as gap from l),
    cut as (select gap from (select gap, row_number() over (order by gap) as rn from g where gap is not null)
            where rn = (select ceil(0.9 * count(gap)) from g))
    select a, b, strftime(max(d), '%Y-%m-%d') as d, min(datediff('day', d, now))::int as age from l, now
    where datediff('day', d, now) <= (select gap from cut) group by 1, 2""")
def decayed_ties(t):
    links = order_lines(t).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"),
                                  F.col("o_orderdate").cast("date").alias("d")).distinct()
    now = F.date_add(t.orders.agg(F.max("o_orderdate").cast("date").alias("m")).scalar(), 1)
    out = net.decay_ties(links, "a", "b", "d", now)
    return out.withColumn("d", F.date_format("d", "yyyy-MM-dd"))


_DECAYED = """
    l as (select distinct o_custkey as a, l_suppkey as b, o_orderdate as d from orders join lineitem on o_orderkey = l_orderkey),
    s as (select y, a, b, d from (select distinct year(d)::bigint as y from l) ys join l on year(l.d) < ys.y),
    g as (select y, datediff('day', d, lead(d) over (partition by y, a, b order by d)) as gap from s),
    cut as (select y, gap from (select y, gap, row_number() over (partition by y order by gap) as rn, count(*) over (partition by y) as n
            from g where gap is not null) where rn = ceil(0.9 * n))"""
_AGES = """select s.y, a, b, min(datediff('day', d, make_date(s.y, 1, 1)))::int as age from s join cut on cut.y = s.y
    where datediff('day', d, make_date(s.y, 1, 1)) <= gap group by 1, 2, 3"""


@query("K4 C15 J3", f"with {_DECAYED} {_AGES}")
def decayed_ties_by_year(t):
    """One network per year: ties before it, trimmed by the renewals known then."""
    links = order_lines(t).select(
        F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("o_orderdate").cast("date").alias("d")).distinct()
    span = t.orders.agg(F.min(year("o_orderdate")).alias("lo"), F.max(year("o_orderdate")).alias("hi"))
    rows = snapshots(links.withColumn("yr", year("d")), "yr", span.select("lo").scalar(), span.select("hi").scalar(), "y")
    now = F.make_date(F.col("y").cast("int"), F.lit(1), F.lit(1))
    return net.decay_ties(rows, "a", "b", "d", now, by=["y"]).select("y", "a", "b", "age")


@query("K5", """
    with l as (select distinct o_custkey as a, l_suppkey as b, year(o_orderdate)::bigint as yr
               from orders join lineitem on o_orderkey = l_orderkey),
    g as (select *, lead(yr) over (partition by a, b order by yr) - yr as gap from l)
    select a, b, yr from g where gap is null or gap <= 2""")
def ties_renewed_in_time(t):
    links = order_lines(t).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"),
                                  year("o_orderdate").alias("yr")).distinct()
    return net.decay_fixed(links, ["a", "b"], ["yr"], 2)


@query("K6", f"""
    with {TRANSITIONS}
    select src, dst, weight, case when weight > (select avg(weight) from e) then 'Strong' else 'Weak' end as strength from e""")
def tie_strength_labels(t):
    return net.label_strength(cut_lineage(transitions(t)))


@query("K7", """
    select l_orderkey, l_partkey, l_linenumber, l_suppkey,
      round(case when datediff('day', l_shipdate, timestamp '2001-06-30') = 0 then 1e-7
        when l_extendedprice * 100 / datediff('day', l_shipdate, timestamp '2001-06-30') > 0
        then l_extendedprice * 100 / datediff('day', l_shipdate, timestamp '2001-06-30') else 1e-7 end, 8) as weight from lineitem""")
def recency_weights(t):
    age = F.datediff(F.lit("2001-06-30").cast("date"), F.col("l_shipdate").cast("date"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey",
                             r(net.recency_weight(F.col("l_extendedprice"), age), 8).alias("weight"))


@query("K8", f"with {COMPONENTS} select node, comp from c16")
def connected_components(t):
    return net.components(customer_parts(t))


@query("K8 L6", f"""
    with {COMPONENTS}
    select (sum(n) * sum(n) - sum(n * n))::bigint as unreachable from (select comp, count(*) as n from c16 group by 1)""")
def unreachable_pair_count(t):
    return net.unreachable_pairs(net.components(customer_parts(t)))


@query("K9", f"""
    with {TRANSITIONS},
    s as (select distinct least(src, dst) as src, greatest(src, dst) as dst from e where weight > (select avg(weight) from e)),
    a as (select src, dst from s union select dst, src from s),
    bad as (select x.src as i, x.dst as p, y.dst as q from a x join a y on x.src = y.src and x.dst < y.dst
            where not exists (select 1 from a z where z.src = x.dst and z.dst = y.dst))
    select least(i, p) as src, greatest(i, p) as dst from bad union select least(i, q), greatest(i, q) from bad""")
def closure_violations(t):
    edges = net.label_strength(cut_lineage(transitions(t)))
    return net.stc_violations(edges.filter("strength = 'Strong'"))


@query("K10", """
    with m as (select distinct year(o_orderdate)::bigint as yr, o_custkey as g, p_type as c
               from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey),
    n as (select yr, c, count(*) as n from m group by 1, 2),
    p as (select x.yr, x.c as a, y.c as b, count(*) as n from m x join m y on x.yr = y.yr and x.g = y.g and x.c < y.c group by 1, 2, 3)
    select p.yr, a, b, round(1 - p.n / (na.n + nb.n - p.n), 8) as distance from p
    join n na on na.yr = p.yr and na.c = a join n nb on nb.yr = p.yr and nb.c = b""")
def type_jaccard_by_year(t):
    return type_distances(t).select("yr", "a", "b", r("distance", 8).alias("distance"))


def customer_year_lines(t):
    rows = order_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(year("o_orderdate").alias("yr"), "o_custkey", "p_type")


def type_distances(t):
    return pr.set_distance(pr.co_occurrence(customer_year_lines(t), ["yr", "o_custkey"], "p_type", by=["yr"]))


def brand_distances(t, kind="jaccard"):
    return pr.set_distance(pr.co_occurrence(part_lines(t), ["l_orderkey"], "p_brand", complete=True), kind)


@query("K10", """
    with m as (select distinct l_orderkey as g, p_brand as c from lineitem join part on l_partkey = p_partkey),
    n as (select c, count(*) as n from m group by 1),
    p as (select x.c as a, y.c as b, count(*) as n from m x join m y on x.g = y.g and x.c < y.c group by 1, 2)
    select least(na.c, nb.c) as a, greatest(na.c, nb.c) as b, round(sqrt(na.n + nb.n - 2 * coalesce(p.n, 0)), 8) as distance
    from n na join n nb on na.c < nb.c left join p on p.a = na.c and p.b = nb.c""")
def brand_row_distance(t):
    out = brand_distances(t, "euclid")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), r("distance", 8).alias("distance"))


@query("K11 D26", """
    with m as (select distinct year(o_orderdate)::bigint as yr, o_custkey as g, p_type as c
               from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey),
    n as (select yr, c, count(*) as n from m group by 1, 2),
    p as (select x.yr, x.c as a, y.c as b, count(*) as n from m x join m y on x.yr = y.yr and x.g = y.g and x.c < y.c group by 1, 2, 3),
    d as (select p.yr, a, b, 1 - p.n / (na.n + nb.n - p.n) as d from p
          join n na on na.yr = p.yr and na.c = a join n nb on nb.yr = p.yr and nb.c = b)
    select m.yr, m.g as o_custkey, round(avg(d.d), 8) as distance, round(1 - 1 / (1 + avg(d.d)), 8) as diversity from m
    left join m o on o.yr = m.yr and o.g = m.g and m.c < o.c left join d on d.yr = m.yr and d.a = m.c and d.b = o.c group by 1, 2""")
def partner_distance(t):
    out = pr.avg_partner_distance(customer_year_lines(t), ["yr", "o_custkey"], "p_type", ["yr"], "distance")
    return out.select("yr", "o_custkey", r("distance", 8).alias("distance"),
                      r(1 - 1 / (1 + F.col("distance")), 8).alias("diversity"))


@query("K12", """
    with g as (select l_orderkey, count(*)::bigint as members, count(*) filter (where s_acctbal > 5000)::bigint as n_central
               from lineitem join supplier on l_suppkey = s_suppkey group by 1)
    select *, case when members = 1 and n_central = 1 then 'solo_central' when members = 1 then 'solo_peripheral'
      when n_central = members then 'joint_central' when n_central = 0 then 'joint_peripheral' else 'joint_hybrid' end as kind from g""")
def collaboration_kinds(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return net.collab_type(rows, "l_orderkey", F.col("s_acctbal") > 5000)


@query("K13 E13", """
    with m as (select distinct o_orderkey as g, datediff('month', timestamp '1995-01-01', o_orderdate)::bigint as mon, p_brand as c
               from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey),
    f1 as (select c, min(mon) as f from m group by 1),
    f2 as (select x.c as a, y.c as b, min(x.mon) as f from m x join m y on x.g = y.g and x.c < y.c group by 1, 2),
    s as (select g, any_value(mon) as mon, sum((mon < f + 3)::int)::bigint as new_members from m join f1 on m.c = f1.c group by 1),
    q as (select x.g, sum((x.mon < f + 3)::int)::bigint as new_pairs from m x join m y on x.g = y.g and x.c < y.c
          join f2 on f2.a = x.c and f2.b = y.c group by 1)
    select s.g as o_orderkey, s.mon, new_members, coalesce(new_pairs, 0)::bigint as new_pairs from s left join q on s.g = q.g""")
def novel_brand_pairs(t):
    months = F.round(F.months_between(F.trunc(F.col("o_orderdate").cast("date"), "month"),
                                      F.lit("1995-01-01").cast("date"))).cast("bigint")
    rows = order_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("mon", months)
    return pr.novel_counts(rows, ["o_orderkey"], "p_brand", "mon", 3)


@query("K13", """
    with m as (select distinct o_orderkey as g, year(o_orderdate)::bigint as yr, p_type as c
               from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey)
    select x.c as a, y.c as b, min(x.yr)::bigint as first_time from m x join m y on x.g = y.g and x.c < y.c group by 1, 2""")
def first_year_of_type_pairs(t):
    rows = order_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("yr", year("o_orderdate"))
    return pr.first_seen_pairs(rows, ["o_orderkey"], "p_type", "yr")


@query("L1 L2", f"""
    with {TRANSITIONS}, n as (select count(*) as n from supplier)
    select s_suppkey as node, round((select count(*) from e where dst = s_suppkey) / (n - 1.0), 8)::double as degree,
      round(coalesce((select sum(weight) from e where src = s_suppkey), 0) / (n - 1), 8)::double as strength from supplier, n""")
def supplier_degree_strength(t):
    edges = cut_lineage(transitions(t))
    nodes = t.supplier.select("s_suppkey")
    return cen.degree(edges, nodes, "in").join(cen.strength(edges, nodes, "out"), "node").select(
        "node", r("degree", 8).alias("degree"), r("strength", 8).alias("strength"))


@query("L6", f"with {TRADE}{CLOSURE.format(e='e')} select i as source, j as node, round(d, 8) as dist from d5")
def trade_distances(t):
    edges = trade(t)
    sources = cen.nodes_of(edges).select(F.col("node").alias("source"))
    return cen.distances(edges, sources).withColumn("dist", r("dist", 8))


@query("L3", f"with {TRADE}{CLOSURE.format(e='e')} select i as node, round(1 / nullif(sum(d), 0), 8) as closeness from d5 group by 1")
def trade_closeness(t):
    edges = trade(t)
    sources = cen.nodes_of(edges).select(F.col("node").alias("source"))
    return cen.closeness(cen.distances(edges, sources)).withColumn("closeness", r("closeness", 8))


@query("L4", f"""
    with {TRADE}, u as (select least(src, dst) as a, greatest(src, dst) as b, sum(weight) as weight from e group by 1, 2),
    ue as (select a as src, b as dst, weight from u union all select b, a, weight from u){CLOSURE.format(e='ue')},
    hit as (select k.x as node, count(*) as n from d5 st join nodes k on k.x <> st.i and k.x <> st.j
      join d5 a on a.i = st.i and a.j = k.x join d5 b on b.i = k.x and b.j = st.j
      where st.i <> st.j and abs(a.d + b.d - st.d) <= 1e-9 * (1 + st.d) group by 1)
    select x as node, round(coalesce(n, 0) / (((select count(*) from nodes) - 1) * ((select count(*) from nodes) - 2))::double, 8) as betweenness
    from nodes left join hit on node = x""")
def trade_betweenness(t):
    edges = cut_lineage(net.undirected(trade(t)))
    return cen.betweenness(edges).withColumn("betweenness", r("betweenness", 8))


@query("L5", f"""
    with {TRADE}{CLOSURE.format(e='e')}
    select e.src, e.dst, count(st.d)::double as betweenness from e
    join d5 a on a.j = e.src join d5 b on b.i = e.dst
    left join d5 st on st.i = a.i and st.j = b.j and st.i <> st.j and abs(a.d + e.weight + b.d - st.d) <= 1e-9 * (1 + st.d)
    group by 1, 2""")
def trade_edge_betweenness(t):
    return cen.edge_betweenness(trade(t)).withColumn("betweenness", r("betweenness", 8))


def _rank_rounds(n):
    out = ""
    for k in range(1, n + 1):
        out += f""",
    r{k} as materialized (select n.node, 0.15 / c.n + 0.85 * (coalesce(sum(p.p * q.rank), 0)
        + coalesce((select sum(q2.rank) from r{k - 1} q2 where q2.node not in (select src from e)), 0) / c.n) as rank
      from nodes n cross join c left join p on p.dst = n.node left join r{k - 1} q on q.node = p.src group by n.node, c.n)"""
    return out


@query("L7", f"""
    with {TRANSITIONS}, nodes as (select src as node from e union select dst from e), c as (select count(*)::double as n from nodes),
    p as (select src, dst, weight / sum(weight) over (partition by src) as p from e),
    r0 as (select node, 1 / c.n as rank from nodes, c){_rank_rounds(60)} select node, round(rank, 8) as rank from r60""")
def supplier_pagerank(t):
    return cen.pagerank(cut_lineage(transitions(t)), 0.85).withColumn("rank", r("rank", 8))


DAMPINGS = (0.15, 0.5, 0.85)
ROUNDS = (1, 5, 10, 20)


def _simple_rounds(n):
    return "".join(f""",
    r{k} as materialized (select p.dst as node, {', '.join(f"{d} * sum(q.a{i} / p.o) + 1 - {d} as a{i}" for i, d in enumerate(DAMPINGS))}
      from p join r{k - 1} q on q.node = p.src group by 1)""" for k in range(1, n + 1))


@query("L8 J1 D28", f"""
    with {TRANSITIONS}, p as (select src, dst, count(*) over (partition by src) as o from e),
    r0 as (select s_suppkey as node, {', '.join(f"1 + s_acctbal / 10000 as a{i}" for i in range(3))} from supplier){_simple_rounds(ROUNDS[-1])}
    select node, {', '.join(f"round(r{k}.a{i}, 8) as rank_d{round(d * 100)}_i{k}" for k in ROUNDS for i, d in enumerate(DAMPINGS))}
    from {' join '.join([f"r{ROUNDS[0]}", *[f"r{k} using (node)" for k in ROUNDS[1:]]])}""")
def supplier_pagerank_simple(t):
    start = t.supplier.select(F.col("s_suppkey").alias("node"), (1 + F.col("s_acctbal") / 10000).alias("rank"))
    out = cen.pagerank_simple(cut_lineage(transitions(t)), start, DAMPINGS, ROUNDS)
    return out.select("node", *[r(c, 8).alias(c) for c in out.columns if c != "node"])


def _power_sql(arcs, n=40):
    """Power steps on A + I, scaled down by a constant per step."""
    steps = "".join(f""",
    x{k} as materialized (select a.dst as node, sum(a.weight * x.v) / 1000 as v from a join x{k - 1} x on x.node = a.src group by 1)"""
                    for k in range(1, n + 1))
    return f"""with {TRANSITIONS}, nodes as (select src as node from e union select dst from e),
    a as materialized ({arcs} union all select node, node, 1.0 from nodes), x0 as (select node, 1.0 as v from nodes){steps}
    select node, round(v / (select max(v) from x{n}), 6) as eigen from x{n}"""


@query("L9", _power_sql("select src, dst, weight from e union all select dst, src, weight from e"))
def supplier_eigen(t):
    return cen.eigen_centrality(net.undirected(cut_lineage(transitions(t)))).withColumn("eigen", r("eigen"))


@query("L10", _power_sql("select src, dst, weight from e"))
def supplier_eigen_directed(t):
    return cen.eigen_centrality(cut_lineage(transitions(t)), is_directed=True).withColumn("eigen", r("eigen"))


ROUNDS_OF_CORES = 40


def _core_rounds(n):
    return "".join(f""",
    c{k} as materialized (select yr, node, least(any_value(core), max(least(value, rk)))::bigint as core from
      (select a.yr, a.src as node, m.core, o.core as value, row_number() over (partition by a.yr, a.src order by o.core desc) as rk
       from a join c{k - 1} o on o.yr = a.yr and o.node = a.dst join c{k - 1} m on m.yr = a.yr and m.node = a.src) group by 1, 2)"""
                   for k in range(1, n + 1))


@query("L11 J3", f"""
    with e as materialized (select distinct year(o_orderdate)::bigint as yr, 'c' || o_custkey as x, 's' || l_suppkey as y
               from orders join lineitem on o_orderkey = l_orderkey),
    a as materialized (select yr, x as src, y as dst from e union all select yr, y, x from e),
    c0 as (select yr, src as node, count(*) as core from a group by 1, 2){_core_rounds(ROUNDS_OF_CORES)}
    select yr, count(*)::bigint as nodes, max(core)::bigint as top, round(avg(core), 6) as mean from c{ROUNDS_OF_CORES} group by 1""")
def yearly_mean_coreness(t):
    rows = order_lines(t).select(
        year("o_orderdate").alias("yr"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    cores = cen.coreness(rows, by=["yr"])
    return cores.groupBy("yr").agg(n_rows().alias("nodes"), F.max("core").alias("top"), r(F.avg("core")).alias("mean"))


@query("L11 K4 C15", f"""
    with {_DECAYED}, ages as ({_AGES}),
    e as materialized (select y as yr, 'c' || a as x, 's' || b as y from ages),
    a as materialized (select yr, x as src, y as dst from e union all select yr, y, x from e),
    c0 as (select yr, src as node, count(*) as core from a group by 1, 2){_core_rounds(ROUNDS_OF_CORES)}
    select yr, count(*)::bigint as nodes, max(core)::bigint as top, round(avg(core), 6) as mean from c{ROUNDS_OF_CORES} group by 1""")
def coreness_of_decayed_ties(t):
    """Core numbers in the network of each year that is left after old ties have decayed."""
    ties = decayed_ties_by_year(t).select(F.col("y").alias("yr"), F.concat(F.lit("c"), F.col("a").cast("string")).alias("src"),
                                          F.concat(F.lit("s"), F.col("b").cast("string")).alias("dst"))
    cores = cen.coreness(ties, by=["yr"])
    return cores.groupBy("yr").agg(n_rows().alias("nodes"), F.max("core").alias("top"), r(F.avg("core")).alias("mean"))


def _yearly_eigen_sql(n=40):
    steps = "".join(f""",
    x{k} as materialized (select a.yr, a.dst as node, sum(a.weight * x.v) / 1000 as v
      from a join x{k - 1} x on x.node = a.src and x.yr = a.yr group by 1, 2)""" for k in range(1, n + 1))
    return f"""tr as (select l_suppkey as src, lead(l_suppkey) over w as dst, lead(year(l_shipdate)) over w as t from lineitem
             window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey)),
    e as materialized (select s.yr, least(src, dst) as x, greatest(src, dst) as y, count(*)::double as weight
      from tr join (select distinct t as yr from tr where t is not null) s on tr.t <= s.yr where src <> dst group by 1, 2, 3),
    nodes as (select yr, x as node from e union select yr, y from e),
    a as materialized (select yr, x as src, y as dst, weight from e union all select yr, y, x, weight from e
      union all select yr, node, node, 1.0 from nodes), x0 as (select yr, node, 1.0 as v from nodes){steps},
    eigen as (select yr::bigint as yr, node, round(v / max(v) over (partition by yr), 6) as eigen from x{n})"""


def yearly_eigen(t):
    """(yr, node, eigen): scores of suppliers in the transitions seen up to each year."""
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", year("l_shipdate").alias("t"))
    moves = neighbours(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"],
                       leads={"dst": "l_suppkey", "at": "t"}).filter("l_suppkey <> dst")
    ties = cut_lineage(moves.groupBy("at", F.least("l_suppkey", "dst").alias("src"), F.greatest("l_suppkey", "dst").alias("dst"))
                       .agg(n_rows().cast("double").alias("n")))
    return cen.growing_eigen_centrality(ties.withColumnRenamed("n", "weight"), "at", "yr").withColumn("eigen", r("eigen"))


@query("L9 L14", f"""
    with {_yearly_eigen_sql()},
    m as (select yr, avg(eigen) as mu, stddev_pop(eigen) as sd, count(*)::double as n from eigen group by 1),
    t as (select yr, row_number() over w as p, sum(eigen) over (w rows unbounded preceding) as top from eigen
          window w as (partition by yr order by eigen desc, node))
    select yr, p::bigint as p, case when sd > 0 then round((top - p * mu) / n / (sd * sqrt(p / n * (1 - p / n))), 5) end as corr
    from t join m using (yr) where p < n""")
def yearly_concentration_curves(t):
    """How far each year's eigenvector scores fall apart into a core of p suppliers and the rest."""
    return cen.core_curve(yearly_eigen(t), "eigen", "node", by=["yr"]).withColumn("corr", r("corr", 5))


@query("L9 E9 E12", f"""
    with {_yearly_eigen_sql()},
    m as (select *, round(avg(eigen) over (partition by node order by yr rows 9 preceding), 8) as ten_mean from eigen),
    q as (select yr, quantile_cont(ten_mean, 0.75) as cut from m group by 1)
    select yr, node, eigen, ten_mean, (ten_mean >= cut)::int as central from m join q using (yr)""")
def lasting_central_suppliers(t):
    """Suppliers whose mean score of up to ten years reaches the upper quarter of a year."""
    means = win.rolling_mean(yearly_eigen(t), ["node"], "yr", "eigen", 10, "ten_mean").withColumn("ten_mean", r("ten_mean", 8))
    return win.above_group_quantile(cut_lineage(means), ["yr"], "ten_mean", 0.75, "central", reach=True).select(
        "yr", "node", "eigen", "ten_mean", "central")


@query("L12")
def nation_power(t):
    """Rows only: the scores solve a linear system over the trade ties."""
    power, residual = cen.power_centrality(trade_values(t), 0.75, tol=1e-9)
    return power.select("node", r("power").alias("power"), F.lit(int(residual < 1e-6)).alias("settled"))


@query("L13", f"""
    with {TRANSITIONS}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e),
    d as (select x as node, count(*)::double as degree from (select a as x from u union all select b from u) group by 1)
    select round((max(degree) * count(*) - sum(degree)) / ((count(*) - 1) * (count(*) - 2)), 8) as centralization from d""")
def degree_centralization(t):
    ties = cut_lineage(net.undirected(transitions(t)))
    scores = cen.degree(ties, cen.nodes_of(ties), "all", normalized=False)
    return cen.centralization(scores, "degree", "degree").withColumn("centralization", r("centralization", 8))


@query("L14", """
    with s as (select s_suppkey, s_acctbal as v from supplier),
    m as (select avg(v) as mu, stddev_pop(v) as sd, count(*)::double as n from s),
    t as (select row_number() over w as p, sum(v) over w as top from s window w as (order by v desc, s_suppkey))
    select p::bigint as p, round((top - p * mu) / n / (sd * sqrt(p / n * (1 - p / n))), 6) as corr from t, m where p < n""")
def concentration_curve(t):
    return cen.core_curve(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").withColumn("corr", r("corr"))


def _axis(matrix, k, squarings=14):
    """First axis of a symmetric matrix by repeated squaring, scaled by the root of its value; and the rest of the matrix."""
    out = f""",
    s{k}_0 as materialized (select * from {matrix})"""
    for i in range(squarings):
        out += f""",
    s{k}_{i + 1} as materialized (with p as (select a.i, b.j, sum(a.b * b.b) as b from s{k}_{i} a join s{k}_{i} b on a.j = b.i group by 1, 2)
      select i, j, b / (select max(abs(b)) from p) as b from p)"""
    last = f"s{k}_{squarings}"
    return out + f""",
    v{k} as materialized (select i, b / sqrt(sum(b * b) over ()) as v from {last}
      where j = (select j from {last} where i = j order by b desc, j limit 1)),
    l{k} as materialized (select sum(x.v * m.b * y.v) as l from {matrix} m join v{k} x on x.i = m.i join v{k} y on y.i = m.j),
    y{k} as materialized (select i, v * sqrt(l) as y from v{k}, l{k}),
    m{k} as materialized (select m.i, m.j, m.b - x.y * y.y as b from {matrix} m join y{k} x on x.i = m.i join y{k} y on y.i = m.j),
    z{k} as materialized (select i, y * case when (select arg_max(y, {{'a': round(abs(y), 9), 'i': i}}) from y{k}) >= 0 then 1 else -1 end as y from y{k})"""


@query("L15", f"""
    with m as (select distinct l_orderkey as g, p_brand as c from lineitem join part on l_partkey = p_partkey),
    n as (select c, count(*) as n from m group by 1),
    p as (select x.c as a, y.c as b, count(*) as n from m x join m y on x.g = y.g and x.c <> y.c group by 1, 2),
    d as materialized (select na.c as i, nb.c as j, case when na.c = nb.c then 0
        else pow(1 - coalesce(p.n, 0) / (na.n + nb.n - coalesce(p.n, 0)), 2) end as d
      from n na, n nb left join p on p.a = na.c and p.b = nb.c),
    e as (select i, avg(d) as m from d group by 1),
    m0 as materialized (select d.i, d.j, -0.5 * (d - x.m - y.m + (select avg(d) from d)) as b from d join e x on x.i = d.i join e y on y.i = d.j)
    {_axis("m0", 1)}{_axis("m1", 2)}
    select z1.i as node, round(z1.y, 6) as dim1, round(z2.y, 6) as dim2 from z1 join z2 on z1.i = z2.i""")
def brand_map(t):
    """Two axes of scaling; every brand is a landmark."""
    out = cen.mds(cut_lineage(brand_distances(t)))
    return out.select("node", r("dim1").alias("dim1"), r("dim2").alias("dim2"))


@query("L16")
def brand_medoids(t):
    """Rows only: labels of the best number of medoids by mean silhouette."""
    full = cut_lineage(cen.full_distances(brand_distances(t)))
    best = None
    for k in (2, 3, 4):
        _, labels = cen.kmedoids(full, k)
        widths = cut_lineage(cen.silhouette(full, labels))
        score = widths.agg(F.avg("width")).first()[0]
        if best is None or score > best[0]:
            best = (score, widths)
    return best[1].withColumn("width", r("width"))


@query("L16", """
    with m as (select distinct l_orderkey as g, p_brand as c from lineitem join part on l_partkey = p_partkey),
    n as (select c, count(*) as n from m group by 1),
    p as (select x.c as a, y.c as b, count(*) as n from m x join m y on x.g = y.g and x.c <> y.c group by 1, 2),
    d as (select p.a as i, p.b as j, 1 - p.n / (na.n + nb.n - p.n) as d from p join n na on na.c = p.a join n nb on nb.c = p.b),
    lab as (select c, (substr(c, 7)::int % 3)::int as label from n),
    sz as (select label, count(*) as size from lab group by 1),
    mm as (select d.i, x.label as own, y.label, sum(d) as s from d join lab x on x.c = d.i join lab y on y.c = d.j group by 1, 2, 3),
    ab as (select i, own, max(case when label = own then s / (size - 1) end) as a, min(case when label <> own then s / size end) as b
           from mm join sz using (label) group by 1, 2)
    select i as node, own as label, round((b - a) / greatest(a, b), 6) as width from ab""")
def brand_silhouette(t):
    full = cen.full_distances(brand_distances(t))
    labels = t.part.select(F.col("p_brand").alias("node")).distinct().withColumn(
        "label", (F.substring("node", 7, 3).cast("int") % 3))
    return cen.silhouette(full, labels).withColumn("width", r("width"))
