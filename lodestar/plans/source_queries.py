"""Queries over readers, writers and key checks. Files are written from the given tables."""

from pyspark.sql import functions as F

from lodestar.functions.columns import day_text, n_rows, r
from lodestar.plans.registry import query
from lodestar.session import materialize, scratch_path
from lodestar.sources import files

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("A1", "select p_partkey, p_name, p_brand, nullif(p_type, 'ECONOMY') as p_type, p_size, "
       "p_retailprice from part")
def csv_with_header(t):
    path = scratch_path(t.spark, "part_csv")
    part = t.part.withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    part.write.option("header", True).option("nullValue", "").csv(path)
    return files.read_csv(t.spark, path, PART)


@query("A2", "select l_extendedprice as item_price, l_discount as item_discount, "
       "l_quantity as sold_quantity, l_tax as sold_tax from lineitem")
def csv_headerless_named(t):
    path = scratch_path(t.spark, "items_csv")
    t.lineitem.select("l_extendedprice", "l_discount", "l_quantity", "l_tax").write.csv(path)
    names = [n for p, attrs in (("item", ["price", "discount"]), ("sold", ["quantity", "tax"]))
             for n in files.prefixed_names([p], attrs)]
    return files.read_csv_named(t.spark, path, names)


@query("A3", "select vec_id as id, len(embedding)::bigint as width, "
       "round(list_sum(embedding::double[]), 4) as total from embeddings")
def wide_matrix_rows(t):
    path = scratch_path(t.spark, "wide")
    cells = F.transform("embedding", lambda v: v.cast("double").cast("string"))
    t.embeddings.select(F.concat_ws("|", F.col("vec_id").cast("string"), cells)).write.text(path)
    rows = files.read_wide_matrix(t.spark, path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v)
    return rows.select("id", F.size("vector").cast("bigint").alias("width"), r(total, 4).alias("total"))


@query("A4", "select c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') as c_mktsegment "
       "from customer")
def quoted_bulk_load(t):
    path = scratch_path(t.spark, "quoted")
    blank = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment"))
    (t.customer.select("c_custkey", "c_name", "c_acctbal", blank.alias("c_mktsegment"))
     .write.option("header", True).option("quoteAll", True).csv(path))
    return files.load_quoted(
        t.spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("A5", "select distinct l_suppkey as supplier, l_returnflag as flag, l_quantity as quantity "
       "from lineitem where l_quantity > 45")
def external_delimited_table(t):
    path = scratch_path(t.spark, "external")
    t.lineitem.select("l_suppkey", "l_returnflag", "l_quantity").write.csv(path)
    name = "external_" + path.split("/")[-2]
    rows = files.external_table(t.spark, name, "supplier bigint, flag string, quantity double", path)
    return rows.filter("quantity > 45").distinct()


@query("A6", "select s_suppkey, s_name, s_acctbal from supplier")
def tab_delimited_load(t):
    path = scratch_path(t.spark, "tsv")
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.option("sep", "\t").csv(path)
    return files.read_tsv(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


BLOCK_LINKS = 16


@query("A8", """
    with e as (select distinct o_custkey as src, l_suppkey as dst
               from orders join lineitem on o_orderkey = l_orderkey)
    select src::varchar as src, (dst % ceil(degree / 16))::bigint as block, count(*)::bigint as n,
           string_agg(dst::varchar, ',' order by dst::varchar) as dsts
    from (select *, count(*) over (partition by src) as degree from e) group by 1, 2""")
def adjacency_blocks(t):
    path = scratch_path(t.spark, "edges")
    edges = (t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
             .select("o_custkey", "l_suppkey").distinct())
    edges.select(F.concat_ws(" ", F.col("o_custkey").cast("string"),
                             F.col("l_suppkey").cast("string"))).write.text(path)
    ties = files.read_edge_list(t.spark, path)
    ties = ties.join(ties.groupBy("src").agg(n_rows().alias("degree")), "src")
    blocks = F.ceil(F.col("degree") / BLOCK_LINKS)  # a hub has as many blocks as its links need
    lists = files.adjacency(ties, F.col("dst").cast("bigint") % blocks)
    return lists.select("src", "block", F.size("dsts").cast("bigint").alias("n"),
                        F.array_join("dsts", ",").alias("dsts"))


@query("A9", "select event_id, event_type, user_id, value from events")
def json_directory(t):
    path = scratch_path(t.spark, "json")
    t.events.select("event_id", "event_type", "user_id", "value").write.json(path)
    return files.read_json(t.spark, path)


@query("A12", "select o_orderkey::varchar as o_orderkey, o_orderstatus, "
       "case when o_orderstatus = 'O' then 'NA' else strftime(o_orderdate, '%Y-%m-%d') end as shipped "
       "from orders")
def csv_written_with_na(t):
    path = scratch_path(t.spark, "na_csv")
    shipped = F.when(F.col("o_orderstatus") != "O", day_text("o_orderdate"))
    files.write_csv(t.orders.select("o_orderkey", "o_orderstatus", shipped.alias("shipped")), path)
    return t.spark.read.option("header", True).csv(path)


@query("A13", "select p_brand, count(*)::bigint as n from part group by p_brand")
def saved_intermediate(t):
    path = scratch_path(t.spark, "saved")
    counts = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    materialize(counts, path)
    return materialize(counts, path)


@query("A14", """
    select 'nation' as part, count(*)::bigint as n_rows, sum(n_nationkey)::bigint as key_sum
    from nation where n_nationkey in (select c_nationkey from customer)
    union all select 'fact', count(*)::bigint, sum(c_custkey)::bigint from customer
    union all select 'region', count(distinct n_regionkey)::bigint,
      (select sum(k) from (select distinct n_regionkey as k from nation
       where n_nationkey in (select c_nationkey from customer)))::bigint
    from nation where n_nationkey in (select c_nationkey from customer)""")
def wide_table_normalized(t):
    wide = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).drop("r_regionkey"))
    parts = files.normalize(wide, {"nation": ("c_nationkey", ["n_name"]),
                                   "region": ("n_regionkey", ["r_name"])})
    keys = {"nation": "c_nationkey", "region": "n_regionkey", "fact": "c_custkey"}
    out = None
    for name, key in keys.items():
        row = parts[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"),
                              F.sum(key).cast("bigint").alias("key_sum"))
        out = row if out is None else out.union(row)
    return out


@query("A15", "select l_orderkey, l_linenumber, count(*)::bigint as n from lineitem "
       "group by 1, 2 having count(*) > 1")
def duplicate_keys(t):
    return files.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("A15", "select d.doc_id, d.lang from documents d where not exists "
       "(select 1 from labels l where l.doc_id = d.doc_id)")
def missing_parents(t):
    return files.check_foreign_key(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "doc_id")


@query("A16", """
    with b as (select date_trunc('month', min(o_orderdate)) as lo, max(o_orderdate) as hi from orders),
    m as (select unnest(generate_series(lo, hi, interval 1 month)) as d from b)
    select strftime(last_day(d), '%Y-%m-%d') as month_end,
           (row_number() over (order by d))::bigint as idx from m""")
def month_end_spine(t):
    bounds = t.orders.agg(F.trunc(F.min("o_orderdate").cast("date"), "month").alias("lo"),
                          F.max("o_orderdate").cast("date").alias("hi"))
    months = files.spine(bounds, "lo", "hi", "interval 1 month", "d")
    first = bounds.select("lo").scalar()
    return months.select(day_text(F.last_day("d")).alias("month_end"),
                         (F.round(F.months_between("d", first)) + 1).cast("bigint").alias("idx"))
