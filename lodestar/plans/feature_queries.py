"""Queries over splits, scaling, encoding, sampling and nearest neighbours."""

from pyspark.sql import functions as F

from lodestar.functions.columns import r
from lodestar.operators import features as fe
from lodestar.operators import neighbors as nn
from lodestar.plans.registry import query
from lodestar.session import cut_lineage


def _u(key, seed):
    return f"(('0x' || substr(md5({key}::varchar || ':{seed}'), 1, 13))::bigint / pow(16, 13))"


@query("M1", f"select o_orderkey, ({_u('o_orderkey', 42)} < 0.3)::int as is_test from orders")
def random_split(t):
    train, test = fe.split(t.orders.select("o_orderkey"), "o_orderkey", 0.3)
    return train.withColumn("is_test", F.lit(0)).union(test.withColumn("is_test", F.lit(1)))


@query("M2", f"""
    select o_orderkey, (row_number() over (partition by o_orderpriority order by {_u('o_orderkey', 42)}, o_orderkey)
      <= ceil(0.25 * count(*) over (partition by o_orderpriority)))::int as is_test from orders""")
def stratified_split_by_priority(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return fe.stratified_split(rows, "o_orderkey", "o_orderpriority", 0.25).drop("o_orderpriority")


@query("M3", f"""
    with p as (select o_orderkey, row_number() over (order by {_u('o_orderkey', 42)}, o_orderkey) as pos, count(*) over () as n from orders)
    select o_orderkey, (pos > ceil(0.5 * n))::int + (pos > ceil(0.75 * n))::int as part from p""")
def three_way_split(t):
    return fe.split3(t.orders.select("o_orderkey"), "o_orderkey", [0.5, 0.25, 0.25])


@query("M4", f"""
    select c_custkey, ((row_number() over (order by {_u('c_custkey', 42)}, c_custkey) - 1) % 5)::int as fold from customer""")
def five_folds(t):
    return fe.assign_fold(t.customer.select("c_custkey"), "c_custkey", 5)


@query("M4", "select c_custkey, " + ", ".join(
    f"({_u('c_custkey', 42 + i)} < 0.2)::int as test_{i}" for i in range(3)) + " from customer")
def shuffle_split_flags(t):
    return fe.shuffle_splits(t.customer.select("c_custkey"), "c_custkey", 3, 0.2)


_SPLIT = f"{_u('l_orderkey', 7)} < 0.5"


@query("M5", f"""
    with s as (select avg(l_extendedprice) as m1, stddev_pop(l_extendedprice) as s1, avg(l_quantity) as m2, stddev_pop(l_quantity) as s2
               from lineitem where not {_SPLIT})
    select l_orderkey, l_partkey, l_linenumber, l_suppkey, round((l_extendedprice - m1) / s1, 8) as price,
      round((l_quantity - m2) / s2, 8) as quantity, round(l_extendedprice, 4) as back from lineitem, s where {_SPLIT}""")
def standardised_test_rows(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("price"),
                             F.col("l_quantity").alias("quantity"))
    train, test = fe.split(rows, "l_orderkey", 0.5, seed=7)
    params = fe.fit_standard(train, ["price", "quantity"])
    scaled = fe.apply_standard(test, params)
    back = fe.invert_standard(scaled.withColumn("back", F.col("price")), {"back": params["price"]})
    return back.withColumns({"price": r("price", 8), "quantity": r("quantity", 8), "back": r("back", 4)})


@query("M6", f"""
    with s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem where not {_SPLIT})
    select l_orderkey, l_partkey, l_linenumber, l_suppkey, round((l_extendedprice - lo) / (hi - lo), 10) as price
    from lineitem, s where {_SPLIT}""")
def min_max_test_rows(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("price"))
    train, test = fe.split(rows, "l_orderkey", 0.5, seed=7)
    return fe.apply_min_max(test, fe.fit_min_max(train, ["price"])).withColumn("price", r("price", 10))


@query("M7", """
    select p_partkey, p_size, round(pow(p_size, 2), 4)::double as p_size_2, round(pow(p_size, 3), 4)::double as p_size_3,
      round(p_retailprice / (p_size + 1e-11), 6) as price_per_size, (p_size > 25)::int as is_large from part""")
def powers_and_ratios(t):
    out = fe.add_powers(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size"], 3)
    return out.select("p_partkey", "p_size", "p_size_2", "p_size_3",
                      r(F.col("p_retailprice") / (F.col("p_size") + 1e-11)).alias("price_per_size"),
                      (F.col("p_size") > 25).cast("int").alias("is_large"))


PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


@query("M8", """
    select o_orderkey, substr(o_orderpriority, 1, 1)::int as code, o_orderpriority as back from orders""")
def encoded_and_decoded(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("code"))
    coded = fe.encode(rows, {"code": PRIORITY}).withColumn("back", F.col("code"))
    return fe.decode(coded, {"back": PRIORITY})


@query("M8", """
    select p_partkey, case when p_size > 40 then 41 when p_size < 5 then 0 else p_size end::double as level from part""")
def parsed_levels(t):
    text = F.when(F.col("p_size") > 40, ">40").when(F.col("p_size") < 5, "<5").otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", fe.parse_level(text, {">40": 41, "<5": 0}).alias("level"))


@query("M9", """
    select c_custkey, (c_mktsegment = 'BUILDING')::int as "c_mktsegment_BUILDING", (c_mktsegment = 'FURNITURE')::int as "c_mktsegment_FURNITURE",
      (c_mktsegment = 'HOUSEHOLD')::int as "c_mktsegment_HOUSEHOLD", (c_mktsegment = 'MACHINERY')::int as "c_mktsegment_MACHINERY" from customer""")
def one_hot_segments(t):
    return fe.one_hot(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("M10", "select l_orderkey, l_partkey, l_linenumber, l_suppkey, (l_returnflag = 'R')::int as label from lineitem")
def binarised_flag(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return fe.binarize(rows, "l_returnflag", "R").drop("l_returnflag")


@query("M12", f"""
    with n as (select min(n) as n from (select count(*) as n from labels group by toxic)),
    p as (select doc_id, toxic, row_number() over (partition by toxic order by {_u('doc_id', 42)}, doc_id) as pos from labels)
    select doc_id, toxic from p, n where pos <= n.n""")
def balanced_labels(t):
    return fe.downsample(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


@query("M12", f"select o_orderkey from orders order by {_u('o_orderkey', 42)}, o_orderkey limit 500")
def sampled_orders(t):
    return fe.sample_n(t.orders.select("o_orderkey"), "o_orderkey", 500)


@query("M13 D19 E18", f"""
    with ev as (select event_id, user_id, json_extract_string(props, '$.k') as k from events),
    tr as (select * from ev where not {_u('event_id', 42)} < 0.3),
    cu as (select user_id::varchar as v, row_number() over (order by count(*) desc, user_id::varchar) as code from tr group by user_id
           having count(*) >= 0.01 * (select count(*) from tr)),
    ck as (select k as v, row_number() over (order by count(*) desc, k) as code from tr group by k
           having count(*) >= 0.01 * (select count(*) from tr))
    select event_id, coalesce(cu.code, 0)::int as user_id, coalesce(ck.code, 0)::int as k from ev
    left join cu on cu.v = ev.user_id::varchar left join ck on ck.v = ev.k where {_u('event_id', 42)} < 0.3""")
def rare_categories_bucketed(t):
    rows = t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    train, test = fe.split(rows, "event_id", 0.3)
    codes = fe.fit_rare(train, ["user_id", "k"], 0.01)
    return fe.apply_rare(test, codes, ["user_id", "k"])


def _skew(x):
    return f"(avg(pow({x}, 3)) - 3 * avg({x}) * avg(pow({x}, 2)) + 2 * pow(avg({x}), 3)) / pow(var_pop({x}), 1.5)"


@query("M14", "with s as (" + " union all ".join(
    f"select '{c}' as \"column\", '{n}' as transform, {_skew(e.format(c=c))} as skewness from lineitem"
    for c in ("l_extendedprice", "l_quantity")
    for n, e in (("identity", "{c}"), ("log", "ln({c} + 1)"), ("sqrt", "sqrt({c})"), ("cbrt", "cbrt({c})"))) + """)
    select "column", arg_min(transform, abs(skewness)) as transform, round(arg_min(skewness, abs(skewness)), 5) as skewness from s group by 1""")
def least_skewed_transform(t):
    return fe.best_transform(t.lineitem, ["l_extendedprice", "l_quantity"]).withColumn("skewness", r("skewness", 5))


# every customer with three scaled measures; two of them have gaps
_FEATURES = """
    raw as (select c_custkey as id, case when c_mktsegment <> 'BUILDING' then c_acctbal end as x1,
      case when c_mktsegment <> 'MACHINERY' then avg(o_totalprice) end as x2, max(o_totalprice) as x3
      from customer join orders on c_custkey = o_custkey group by c_custkey, c_acctbal, c_mktsegment),
    st as (select avg(x1) as m1, stddev_pop(x1) as s1, avg(x2) as m2, stddev_pop(x2) as s2, avg(x3) as m3, stddev_pop(x3) as s3 from raw),
    f as (select id, (x1 - m1) / s1 as x1, (x2 - m2) / s2 as x2, (x3 - m3) / s3 as x3 from raw, st)"""


def _imputed(col):
    terms = " + ".join(f"coalesce(pow(a.{c} - b.{c}, 2), 0)" for c in ("x1", "x2", "x3"))
    present = " + ".join(f"(a.{c} is not null and b.{c} is not null)::int" for c in ("x1", "x2", "x3"))
    return f"""
    p_{col} as (select a.id, b.id as donor, b.{col} as v, sqrt(3.0 / ({present}) * ({terms})) as d
      from f a join f b on a.{col} is null and b.{col} is not null and ({present}) > 0),
    i_{col} as (select id, case when min(d) = 0 then avg(case when d = 0 then v end)
        else sum(v / nullif(d, 0)) / sum(1 / nullif(d, 0)) end as v from
      (select *, row_number() over (partition by id order by d, donor) as rk from p_{col}) where rk <= 5 group by id)"""


@query("M11 M5", f"""
    with {_FEATURES},{_imputed('x1')},{_imputed('x2')}
    select f.id, round(coalesce(f.x1, i_x1.v), 6) as x1, round(coalesce(f.x2, i_x2.v), 6) as x2, round(f.x3, 6) as x3
    from f left join i_x1 on i_x1.id = f.id left join i_x2 on i_x2.id = f.id""")
def imputed_customers(t):
    out = nn.knn_impute(customer_measures(t), "id", ["x1", "x2", "x3"])
    return out.select("id", *[r(c).alias(c) for c in ("x1", "x2", "x3")])


def customer_measures(t):
    spend = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.max("o_totalprice").alias("x3"))
    rows = t.customer.join(spend, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("x1"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("m")).alias("x2"), "x3")
    rows = cut_lineage(rows)
    return fe.apply_standard(rows, fe.fit_standard(rows, ["x1", "x2", "x3"]))


_KNN = """
    d as (select a.vec_id as q, b.vec_id as id, b.label, list_distance(a.embedding::double[], b.embedding::double[]) as d
          from embeddings a join embeddings b on a.vec_id <> b.vec_id),
    k as (select *, row_number() over (partition by q order by d, id) as rk from d)"""


@query("N4", f"""
    with {_KNN}, v as (select q, label, count(*) as w from k where rk <= 7 group by 1, 2)
    select q, (arg_max(label, w * 1000 - label))::int as predicted, round(max(w) / 7.0, 8)::double as share from v group by 1""")
def nearest_label_vote(t):
    rows = t.embeddings.select("vec_id", "embedding", "label")
    out = nn.knn_classify(rows, rows.select(F.col("vec_id").alias("q"), "embedding"), "vec_id", "q", "embedding",
                          "label", 7, exclude_same=True)
    return out.withColumn("share", r("share", 8))


@query("N4", f"""
    with d as (select a.vec_id as q, b.vec_id as id, b.label,
        list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: abs(z[1] - z[2]))) as d
        from embeddings a join embeddings b on a.vec_id <> b.vec_id),
    k as (select *, row_number() over (partition by q order by d, id) as rk from d),
    v as (select q, label, sum(1 / d) as w from k where rk <= 5 group by 1, 2)
    select q, (arg_max(label, w))::int as predicted, round(max(w) / sum(w), 8) as share from v group by 1""")
def nearest_label_vote_weighted(t):
    rows = t.embeddings.select("vec_id", "embedding", "label")
    out = nn.knn_classify(rows, rows.select(F.col("vec_id").alias("q"), "embedding"), "vec_id", "q", "embedding",
                          "label", 5, p=1, weights="distance", exclude_same=True)
    return out.withColumn("share", r("share", 8))


@query("N5 O5", f"""
    with {_KNN}, p as (select k.q, k.rk, avg(k.label) over (partition by k.q order by k.rk) as p from k where rk <= 40)
    select rk::int as k, round(sqrt(avg(pow(p.p - e.label, 2))), 6) as rmse from p join embeddings e on e.vec_id = p.q group by 1""")
def neighbour_count_sweep(t):
    rows = t.embeddings.select("vec_id", "embedding", "label")
    out = nn.knn_regress(rows, rows.select(F.col("vec_id").alias("q"), "embedding"), "vec_id", "q", "embedding",
                         "label", range(1, 41), exclude_same=True)
    truth = rows.select(F.col("vec_id").alias("q"), "label")
    return (out.join(truth, "q").groupBy("k")
            .agg(r(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("label"), 2)))).alias("rmse")))


@query("N4 N5", f"""
    with {_FEATURES}, g as (select id, x1, x2, x3 from f where x1 is not null and x2 is not null),
    d as (select a.id as q, b.id, sqrt(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)) as d, b.x3 from g a join g b on a.id <> b.id),
    k as (select *, row_number() over (partition by q order by d, id) as rk from d)
    select q, round(avg(x3), 6) as predicted from k where rk <= 10 group by 1""")
def largest_order_by_neighbours(t):
    rows = customer_measures(t).filter("x1 is not null and x2 is not null").withColumn("v", F.array("x1", "x2"))
    out = nn.knn_regress(rows, rows.select(F.col("id").alias("q"), "v"), "id", "q", "v", "x3", [10], exclude_same=True)
    return out.select("q", r("predicted").alias("predicted"))


_SEARCH = """
    d as (select a.vec_id as q, a.vec_id % 5 as fold, a.label as truth, b.vec_id as id, b.label, x.p, case when x.p = 2
                 then list_distance(a.embedding::double[], b.embedding::double[])
                 else list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: abs(z[1] - z[2]))) end as d
          from embeddings a join embeddings b on a.vec_id % 5 <> b.vec_id % 5, (select unnest([{ps}]) as p) x),
    n as (select *, row_number() over (partition by p, q order by d, id) as rk, min(d) over (partition by p, q) as least from d),
    w as (select *, 'uniform' as weights, 1.0::double as w from n
          union all select *, 'distance', case when least = 0 then (d = 0)::int::double else 1 / d end from n),
    v as (select w.*, x.k from w join (select unnest([{ks}]) as k) x on w.rk <= x.k)"""


@query("N4 O7", f"""
    with {_SEARCH.format(ps="1, 2", ks="1, 3, 5, 7, 9, 11, 13, 15")},
    l as (select p, weights, k, fold, q, truth, label, sum(w) as w from v group by all),
    c as (select p, weights, k, fold, q, truth, first(label order by round(w, 9) desc, label) as a from l group by all),
    f as (select p, weights, k, fold, avg((a = truth)::int) as score from c group by all)
    select (row_number() over (order by round(avg(score), 12) desc, k, weights, p))::int as rank, p::int as p, weights, k::int as k,
           round(avg(score), 6) as mean, round(stddev_pop(score), 6) as sd from f group by p, weights, k""")
def neighbour_vote_search(t):
    """Cross-validated accuracy of every number of neighbours, weighting and distance."""
    rows = t.embeddings.select("vec_id", "embedding", "label", (F.col("vec_id") % 5).alias("fold"))
    out = nn.knn_search(rows, "vec_id", "embedding", "label", "fold", range(1, 16, 2), ps=[1, 2])
    return out.withColumns({"mean": r("mean"), "sd": r("sd")})


@query("N5 O7", f"""
    with {_SEARCH.format(ps="2", ks="2, 4, 8, 16, 32")},
    c as (select p, weights, k, fold, q, truth, sum(w * label) / sum(w) as a from v group by all),
    f as (select p, weights, k, fold, sqrt(avg(pow(a - truth, 2))) as score from c group by all)
    select (row_number() over (order by round(avg(score), 12), k, weights, p))::int as rank, weights, k::int as k,
           round(avg(score), 6) as mean, round(stddev_pop(score), 6) as sd from f group by p, weights, k""")
def neighbour_mean_search(t):
    """Cross-validated error of the mean over neighbours."""
    rows = t.embeddings.select("vec_id", "embedding", "label", (F.col("vec_id") % 5).alias("fold"))
    out = nn.knn_search(rows, "vec_id", "embedding", "label", "fold", [2, 4, 8, 16, 32], metric="rmse")
    return out.select("rank", "weights", "k", r("mean").alias("mean"), r("sd").alias("sd"))
