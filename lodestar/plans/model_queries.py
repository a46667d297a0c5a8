"""Queries over models and their evaluation.

Document features come from whole texts; line features from all lines.
"""

from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows, r
from lodestar.operators import evaluation as ev
from lodestar.operators import features as fe
from lodestar.operators import models as mo
from lodestar.plans.registry import query
from lodestar.session import cut_lineage

DOC = ["log_chars", "words_per_line", "digit_share", "upper_share"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def documents_labelled(t):
    """Text measures of every labelled document."""
    text = F.col("text")
    chars = F.greatest(F.length(text), F.lit(1))
    words, lines = F.size(F.split(text, r"\s+")), F.size(F.split(text, "\n"))
    rows = t.labels.join(t.documents, "doc_id").select(
        "doc_id", F.col("quality"), F.log(chars).alias("log_chars"), (words / lines).alias("words_per_line"),
        (F.length(F.regexp_replace(text, r"[^0-9]", "")) / chars).alias("digit_share"),
        (F.length(F.regexp_replace(text, r"[^A-Z]", "")) / chars).alias("upper_share"))
    return cut_lineage(fe.assign_fold(rows, "doc_id", 3))


def doc_frame(t):
    return cut_lineage(mo.assemble(documents_labelled(t), DOC, "quality").drop("quality"))


def lines(t, label):
    return mo.assemble(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", *LINE,
                                         (F.col("l_returnflag") == "R").cast("int").alias("returned")), LINE, label)


@query("N1 O11")
def quality_tree(t):
    """Importances of a decision tree with its size."""
    model = mo.tree(depth=4, min_leaf=5).fit(doc_frame(t))
    size = mo.tree_summary(model)
    return mo.importances(model, DOC, t.documents).select(
        "rank", "feature", r("importance").alias("importance"), F.lit(size["leaves"]).alias("leaves"))


@query("N2 N13 O5")
def price_tree_error(t):
    rows = mo.assemble(t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"),
                       ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    train, test = fe.split(rows, "l_orderkey", 0.3)
    scored = mo.tree_regressor(depth=4).fit(train).transform(test)
    return ev.rmse(scored, "label", "prediction").withColumn("rmse", r("rmse", 3))


@query("N3 O4 O3")
def quality_forest(t):
    rows = doc_frame(t)
    scored = mo.forest(trees=20, depth=5).fit(rows.filter("fold <> 0")).transform(rows.filter("fold = 0"))
    scored = scored.withColumn("p1", mo.positive_probability(scored))
    loss = ev.log_loss(scored, "label", "p1")
    return ev.auc(scored, "label", "p1").select(r("auc").alias("auc"), r(loss.scalar()).alias("log_loss"))


@query("N6")
def return_logistic(t):
    rows = lines(t, "returned")
    model = mo.logistic(rows.count(), c=1.0).fit(rows)
    return mo.coefficients(model, LINE, t.lineitem).withColumn("estimate", r("estimate", 4))


@query("N6")
def quality_logistic_l1(t):
    rows = doc_frame(t)
    model = mo.logistic(rows.count(), c=10.0, penalty="l1").fit(rows)
    return mo.coefficients(model, DOC, t.documents).withColumn("estimate", r("estimate", 4))


@query("N7", """
    select '(intercept)' as term, round(regr_intercept(l_extendedprice, l_quantity), 4) as estimate from lineitem
    union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) from lineitem""")
def price_on_quantity(t):
    model = mo.linear().fit(mo.assemble(t.lineitem.select("l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice"))
    return mo.coefficients(model, ["l_quantity"], t.lineitem).withColumn("estimate", r("estimate", 4))


@query("N7", """
    with s as (select covar_pop(l_quantity, l_quantity) as aa, covar_pop(l_discount, l_discount) as bb, covar_pop(l_quantity, l_discount) as ab,
      covar_pop(l_quantity, l_extendedprice) as ay, covar_pop(l_discount, l_extendedprice) as by_, avg(l_quantity) as ma, avg(l_discount) as mb,
      avg(l_extendedprice) as my from lineitem),
    c as (select (bb * ay - ab * by_) / (aa * bb - ab * ab) as b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) as b2, ma, mb, my from s)
    select '(intercept)' as term, round(my - b1 * ma - b2 * mb, 3) as estimate from c
    union all select 'l_quantity', round(b1, 3) from c union all select 'l_discount', round(b2, 3) from c""")
def price_on_two(t):
    x = ["l_quantity", "l_discount"]
    model = mo.linear().fit(mo.assemble(t.lineitem.select(*x, "l_extendedprice"), x, "l_extendedprice"))
    return mo.coefficients(model, x, t.lineitem).withColumn("estimate", r("estimate", 3))


@query("N8")
def price_lasso_and_ridge(t):
    x = ["l_quantity", "l_discount", "l_tax"]
    rows = mo.assemble(t.lineitem.select(*x, "l_extendedprice"), x, "l_extendedprice")
    lasso = mo.coefficients(mo.lasso(50.0).fit(rows), x, t.lineitem).select(F.lit("lasso").alias("model"), "term", r("estimate", 2).alias("estimate"))
    n, sd = rows.agg(n_rows(), F.stddev_pop("label")).first()
    ridge = mo.coefficients(mo.ridge(50.0, n, sd).fit(rows), x, t.lineitem)
    return lasso.union(ridge.select(F.lit("ridge"), "term", r("estimate", 2)))


@query("N9")
def quality_stepwise(t):
    terms, path = mo.stepwise_logistic(documents_labelled(t), DOC, "quality")
    rows = [(i, step, round(aic, 4), " + ".join(terms) if i == len(path) - 1 else None) for i, (step, aic) in enumerate(path)]
    return t.spark.createDataFrame(rows, "step int, move string, aic double, chosen string")


@query("N10 M6")
def quality_nets(t):
    """A wide and a deep net; rounds chosen on the validation fold."""
    rows = documents_labelled(t)
    params = fe.fit_min_max(rows.filter("fold = 0"), DOC)
    frame = cut_lineage(mo.assemble(fe.apply_min_max(rows, params), DOC, "quality"))
    train, val, test = (frame.filter(F.col("fold") == k) for k in range(3))
    out = None
    for name, hidden in (("wide", [20]), ("deep", [5, 5, 5, 5])):
        model, rounds = mo.fit_mlp(train, val, len(DOC), hidden, (20, 60))
        row = ev.class_metrics(model.transform(test), "label", "prediction", 1.0).select(
            F.lit(name).alias("net"), F.lit(rounds).alias("rounds"), "n", r("accuracy").alias("accuracy"))
        out = row if out is None else out.union(row)
    return out


@query("N11 N13 O4 M13 H12")
def click_embedding_model(t):
    """Log loss of the category model on held-out events."""
    rows = t.events.select("event_id", (F.col("event_type") == "click").cast("int").alias("click"), "user_id",
                           F.get_json_object("props", "$.k").alias("k"), F.hour("ts").alias("hour"))
    train, test = fe.split(rows, "event_id", 0.3)
    model = mo.fit_category_fm(cut_lineage(train), ["user_id", "k", "hour"], "click", pct=0.005, max_iter=15)
    return ev.log_loss(model.transform(test), "click", "p1").withColumn("log_loss", r("log_loss", 4))


@query("N12")
def embedding_components(t):
    """Variance shares of the components and the error of the rebuild from 20 of them."""
    comp = mo.pca(t.embeddings.select("vec_id", "embedding"), "embedding")
    back = comp.rebuild(comp.project(t.embeddings, "embedding", 20), "scores")
    gap = F.aggregate(F.zip_with("embedding", "rebuilt", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda s, v: s + v)
    error = back.agg(F.avg(gap).alias("e")).first()[0]
    share = comp.share()
    rows = [(i + 1, round(float(v), 8), round(float(share[i]), 8), comp.needed(0.85), round(error, 8))
            for i, v in enumerate(comp.values)]
    return t.spark.createDataFrame(rows, "component int, eigenvalue double, cumulated double, needed_85 int, error_20 double")


@query("N12")
def brand_size_components(t):
    """Few wide rows: brands as rows, part keys with their sold quantity as positions."""
    sold = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(
        F.sum("l_quantity").alias("q"))
    values, _, scores = mo.pca_wide(cut_lineage(sold), "p_brand", "l_suppkey", "q", 3)
    return scores.select("p_brand", *[r(F.col("scores")[k], 3).alias(f"score{k + 1}") for k in range(3)],
                         F.lit(round(float(values[0]), 3)).alias("top_value"))


@query("O1", """
    with p as (select l_returnflag as label, case when l_quantity > 33 then 'R' when l_quantity > 16 then 'N' else 'A' end as pred from lineitem)
    select label, pred, count(*)::bigint as n, round(count(*) / sum(count(*)) over (partition by label), 8) as share from p group by 1, 2""")
def flag_confusion(t):
    q = F.col("l_quantity")
    rows = t.lineitem.select(F.col("l_returnflag").alias("label"),
                             F.when(q > 33, "R").when(q > 16, "N").otherwise("A").alias("pred"))
    return ev.confusion(rows, "label", "pred", normalize=True).withColumn("share", r("share", 8))


@query("O2 M10", f"""
    with p as (select (l_returnflag = 'R')::int as y, (l_quantity > 25)::int as p,
      case when ('0x' || substr(md5(l_orderkey::varchar || ':42'), 1, 13))::bigint / pow(16, 13) < 0.3 then 'out' else 'in' end as part from lineitem),
    c as (select part, count(*)::bigint as n, count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp,
      count(*) filter (where y = 1 and p = 0) as fn, avg((y = p)::int) as acc from p group by 1)
    select part, n, round(acc, 8) as accuracy, round(1 - acc, 8) as error, round(tp / (tp + fp), 8) as precision,
      round(tp / (tp + fn), 8) as recall, round(2 * tp / (2 * tp + fp + fn), 8) as f1 from c""")
def in_and_out_of_sample(t):
    part = F.when(fe.uniform("l_orderkey", 42) < 0.3, "out").otherwise("in")
    rows = t.lineitem.select(part.alias("part"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
                             (F.col("l_quantity") > 25).cast("int").alias("p"))
    out = ev.class_metrics(rows, "y", "p", 1, by=["part"])
    return out.select("part", "n", *[r(c, 8).alias(c) for c in ("accuracy", "error", "precision", "recall", "f1")])


@query("O3", """
    with s as (select l_quantity as threshold, count(*) filter (where l_returnflag = 'R') as pos, count(*) filter (where l_returnflag <> 'R') as neg
               from lineitem group by 1)
    select threshold, round(sum(pos) over w / (select sum(pos) from s), 8)::double as tpr, round(sum(neg) over w / (select sum(neg) from s), 8)::double as fpr
    from s window w as (order by threshold desc)""")
def return_roc(t):
    rows = t.lineitem.select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return ev.roc(rows, "y", "l_quantity").select("threshold", r("tpr", 8).alias("tpr"), r("fpr", 8).alias("fpr"))


@query("O3", """
    with s as (select l_extendedprice as x, count(*) filter (where l_returnflag = 'R') as pos, count(*) filter (where l_returnflag <> 'R') as neg
               from lineitem group by 1),
    c as (select neg * (sum(pos) over (order by x desc) - pos / 2.0) as a, pos, neg from s)
    select round(sum(a)::double / (sum(pos)::double * sum(neg)), 8) as auc from c""")
def return_auc(t):
    rows = t.lineitem.select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return ev.auc(rows, "y", "l_extendedprice").withColumn("auc", r("auc", 8))


@query("O4", """
    select round(avg(-case when l_returnflag = 'R' then ln(greatest(1e-15, least(l_quantity / 50, 1 - 1e-15)))
      else ln(1 - greatest(1e-15, least(l_quantity / 50, 1 - 1e-15))) end), 6) as log_loss from lineitem""")
def return_log_loss(t):
    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return ev.log_loss(rows, "y", "p").withColumn("log_loss", r("log_loss"))


@query("O5", """
    select l_returnflag, round(sqrt(avg(pow(l_extendedprice - (exp(10 + l_quantity / 50) - 1), 2))), 4) as rmse from lineitem group by 1""")
def error_after_back_transform(t):
    rows = t.lineitem.select("l_returnflag", "l_extendedprice", (10 + F.col("l_quantity") / 50).alias("pred"))
    return ev.rmse(rows, "l_extendedprice", "pred", lambda c: F.exp(c) - 1, by=["l_returnflag"]).withColumn("rmse", r("rmse", 4))


@query("O6")
def quality_cv_scores(t):
    out = ev.cv_scores(mo.tree(depth=3), doc_frame(t), "fold")
    return out.select("metric", r("mean").alias("mean"), r("sd").alias("sd"))


@query("O6 N6", """
    with m as (select f.fold, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a
               from lineitem join (select unnest(range(5)) as fold) f on l_orderkey % 5 <> f.fold group by 1),
    s as (select fold, sqrt(avg(pow(l_extendedprice - a - b * l_quantity, 2))) as rmse,
                 avg(abs(l_extendedprice - a - b * l_quantity)) as mae,
                 1 - avg(pow(l_extendedprice - a - b * l_quantity, 2)) / var_pop(l_extendedprice) as r2
          from lineitem join m on l_orderkey % 5 = fold group by 1),
    l as (unpivot s on rmse, mae, r2 into name metric value score)
    select metric, round(avg(score), 4) as mean, round(stddev_pop(score), 4) as sd from l group by 1""")
def price_cv_errors(t):
    """Errors of a line through prices by quantity, on held-out orders."""
    rows = mo.assemble(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    rows = cut_lineage(rows.withColumn("fold", (F.col("l_orderkey") % 5).cast("int")))
    out = ev.cv_scores(mo.linear(), rows, "fold", ev.ERROR_METRICS)
    return out.select("metric", r("mean", 4).alias("mean"), r("sd", 4).alias("sd"))


@query("O7")
def quality_grid_search(t):
    table, _, _ = ev.grid_search(mo.tree(), doc_frame(t), {"maxDepth": [2, 4], "impurity": ["gini", "entropy"]}, "fold", "f1")
    return table.select("rank", F.col("params")["maxDepth"].alias("depth"), F.col("params")["impurity"].alias("impurity"),
                        r("mean").alias("mean"), r("sd").alias("sd"))


@query("O8")
def quality_nested_cv(t):
    rows = cut_lineage(fe.assign_fold(doc_frame(t), "doc_id", 2, seed=7, name="outer_fold"))
    out = ev.nested_cv(mo.tree(), rows, {"maxDepth": [2, 4]}, "outer_fold", "fold", "precision")
    return out.select("fold", F.col("params")["maxDepth"].alias("depth"), r("inner").alias("inner_score"), r("outer").alias("outer_score"))


@query("O9")
def quality_learning_curve(t):
    rows = doc_frame(t).withColumn("is_test", (F.col("fold") == 0).cast("int"))
    out = ev.learning_curve(mo.tree(depth=4), rows, "doc_id", "is_test", [0.25, 0.5, 1.0], "accuracy")
    return out.select("size", r("train").alias("train"), r("test").alias("test"))


@query("O10")
def quality_validation_curve(t):
    out = ev.validation_curve(mo.tree(), doc_frame(t), "fold", "maxDepth", [1, 3], "f1")
    return out.select("value", r("train").alias("train"), r("valid").alias("valid"))


@query("O11 N6")
def coefficient_ranking(t):
    rows = lines(t, "returned")
    model = mo.logistic(rows.count(), c=1.0).fit(rows)
    return mo.importances(model, LINE, t.lineitem).withColumn("importance", r("importance", 4))


@query("O12", """
    with s as (select o_orderpriority as model, year(o_orderdate)::bigint as run, round(avg(o_totalprice), 4) as score from orders group by 1, 2),
    k as (select *, row_number() over (partition by model order by score desc, run)::int as rank from s)
    select rank, """ + ", ".join(f"""max(score) filter (where model = '{m}') as "{m}\"""" for m in (
        "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " from k group by 1")
def scores_by_rank(t):
    scores = t.orders.groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("run")).agg(
        r(F.avg("o_totalprice"), 4).alias("score"))
    return ev.rank_scores(scores, "model", "run", "score")


@query("D1", "select quality, count(*)::bigint as n from labels group by 1")
def class_frequencies(t):
    return t.labels.groupBy("quality").agg(n_rows().alias("n"))
