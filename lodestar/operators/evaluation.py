"""Metrics, curves, cross-validation and search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows
from lodestar.operators.aggregates import categories
from lodestar.operators.features import uniform
from lodestar.operators.ordered import desc, running_sums
from lodestar.session import cut_lineage


def confusion(df: DataFrame, label: str, pred: str, normalize: bool = False) -> DataFrame:
    """Counts per (label, prediction); shares within the label with ``normalize``."""
    counts = df.groupBy(label, pred).agg(n_rows().alias("n"))
    if normalize:
        counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))
    return counts


def _rates(label: str, pred: str, positive) -> dict[str, Column]:
    y, p = F.col(label) == positive, F.col(pred) == positive
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    accuracy = F.count_if(F.col(label) == F.col(pred)) / n_rows()
    return {"n": n_rows(), "accuracy": accuracy, "error": 1 - accuracy, "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)}


def class_metrics(df: DataFrame, label: str, pred: str, positive, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, error, precision, recall and F1 of the positive class in one pass."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _rates(label, pred, positive).items()])


def _score_steps(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """One row per distinct score, highest first, with running counts of both classes."""
    hit = F.col(label) == positive
    steps = cut_lineage(df.groupBy(F.col(score).cast("double").alias("threshold"))
                        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")))
    return running_sums(steps, [], [desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")})


def roc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """True and false positive rate at every distinct score."""
    steps = _score_steps(df, label, score, positive)
    n = df.agg(F.count_if(F.col(label) == positive).alias("p"), F.count_if(F.col(label) != positive).alias("q"))
    return steps.select("threshold", (F.col("tp") / n.select("p").scalar()).alias("tpr"),
                        (F.col("fp") / n.select("q").scalar()).alias("fpr"))


def auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores count half."""
    s = _score_steps(df, label, score, positive)
    area = F.sum((F.col("neg") * (F.col("tp") - F.col("pos") / 2)).cast("double"))
    return s.agg((area / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


def log_loss(df: DataFrame, label: str, p: str, eps: float = 1e-15) -> DataFrame:
    """Mean negative log-likelihood of 0/1 labels, probabilities clamped."""
    q = F.greatest(F.lit(eps), F.least(F.col(p), F.lit(1 - eps)))
    return df.agg(F.avg(-F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))


def rmse(df: DataFrame, y: str, pred: str, inverse: Callable[[Column], Column] = lambda c: c,
         by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error, after undoing a transform of the prediction."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(y) - inverse(F.col(pred)), 2))).alias("rmse"))


CLASS_METRICS = ("accuracy", "precision", "recall", "f1")
ERROR_METRICS = ("rmse", "mae", "r2")


def error_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row with ``rmse``, ``mae`` and ``r2`` (1 - squared errors / squared distances from the mean; null for a constant ``y``)."""
    off = F.col(y) - F.col(pred)
    return df.agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"),
                  (1 - F.try_divide(F.avg(off * off), F.var_pop(y))).alias("r2"))


def fold_scores(est: Estimator, df: DataFrame, fold: str, metrics: Sequence[str] = CLASS_METRICS,
                positive: float = 1.0) -> list[tuple[int, str, float]]:
    """Scores on every held-out fold: one model and one aggregate row per fold.

    ``metrics`` are all of ``CLASS_METRICS`` or all of ``ERROR_METRICS`` (for numbers);
    a class metric without a value counts as 0, an error metric as null.
    """
    errors = set(metrics) <= set(ERROR_METRICS)
    if not errors and not set(metrics) <= set(CLASS_METRICS):
        raise ValueError(f"metrics must come from {CLASS_METRICS} or from {ERROR_METRICS}")
    rows = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        model = est.fit(df.filter(F.col(fold) != k))
        scored = model.transform(df.filter(F.col(fold) == k))
        row = (error_metrics(scored, "label", "prediction") if errors
               else class_metrics(scored, "label", "prediction", positive)).first()
        rows += [(int(k), m, float(row[m]) if row[m] is not None else None if errors else 0.0) for m in metrics]
    return rows


def cv_scores(est: Estimator, df: DataFrame, fold: str, metrics: Sequence[str] = CLASS_METRICS) -> DataFrame:
    """Mean and population standard deviation over the folds, per metric."""
    rows = df.sparkSession.createDataFrame(fold_scores(est, df, fold, metrics), "fold int, metric string, score double")
    return rows.groupBy("metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))


def _evaluator(metric: str, positive: float = 1.0):
    names = {"accuracy": "accuracy", "f1": "fMeasureByLabel", "precision": "precisionByLabel", "recall": "recallByLabel"}
    if metric in names:
        return MulticlassClassificationEvaluator(metricName=names[metric], metricLabel=positive)
    return RegressionEvaluator(metricName=metric)


def grid_search(est: Estimator, df: DataFrame, grid: Mapping[str, Sequence], fold: str, metric: str,
                parallelism: int = 4) -> tuple[DataFrame, dict, float]:
    """All parameter combinations, ranked by their mean score over given folds."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    ev = _evaluator(metric)
    k = df.select(fold).distinct().count()
    cv = CrossValidator(estimator=est, estimatorParamMaps=builder.build(), evaluator=ev, numFolds=k, foldCol=fold,
                        parallelism=parallelism)
    found = cv.fit(df)
    sign = 1 if ev.isLargerBetter() else -1
    tried = [({p.name: v for p, v in pm.items()}, float(m), float(s)) for pm, m, s in
             zip(found.getEstimatorParamMaps(), found.avgMetrics, found.stdMetrics)]
    tried.sort(key=lambda t: (-sign * round(t[1], 12), str(sorted(t[0].items()))))
    rows = [(i + 1, {a: str(b) for a, b in p.items()}, m, s) for i, (p, m, s) in enumerate(tried)]
    table = df.sparkSession.createDataFrame(rows, "rank int, params map<string,string>, mean double, sd double")
    return table, tried[0][0], tried[0][1]


def nested_cv(est: Estimator, df: DataFrame, grid: Mapping[str, Sequence], outer: str, inner: str, metric: str) -> DataFrame:
    """Score of a searched model on every outer fold; the search sees only the other folds."""
    ev, rows = _evaluator(metric), []
    for k in sorted(r[0] for r in df.select(outer).distinct().collect()):
        train, test = df.filter(F.col(outer) != k), df.filter(F.col(outer) == k)
        _, best, inside = grid_search(est, train, grid, inner, metric)
        chosen = est.copy({est.getParam(n): v for n, v in best.items()})
        rows.append((int(k), {n: str(v) for n, v in best.items()}, inside, float(ev.evaluate(chosen.fit(train).transform(test)))))
    return df.sparkSession.createDataFrame(rows, "fold int, params map<string,string>, inner double, outer double")


def learning_curve(est: Estimator, df: DataFrame, key: str, test: str, sizes: Sequence[float], metric: str,
                   seed: int = 42) -> DataFrame:
    """Training and test score against the share of training rows; samples are nested by hash."""
    ev, rows = _evaluator(metric), []
    train_all, held = df.filter(F.col(test) == 0), df.filter(F.col(test) == 1)
    for size in sizes:
        train = train_all.filter(uniform(key, seed) < size)
        model = est.fit(train)
        rows.append((float(size), float(ev.evaluate(model.transform(train))), float(ev.evaluate(model.transform(held)))))
    return df.sparkSession.createDataFrame(rows, "size double, train double, test double")


def validation_curve(est: Estimator, df: DataFrame, fold: str, param: str, values: Sequence, metric: str) -> DataFrame:
    """Mean training and validation score against one parameter."""
    ev, rows = _evaluator(metric), []
    folds = [r[0] for r in df.select(fold).distinct().collect()]
    for v, k in product(values, folds):
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        model = est.copy({est.getParam(param): v}).fit(train)
        rows.append((float(v), float(ev.evaluate(model.transform(train))), float(ev.evaluate(model.transform(test)))))
    scores = df.sparkSession.createDataFrame(rows, "value double, train double, valid double")
    return scores.groupBy("value").agg(F.avg("train").alias("train"), F.avg("valid").alias("valid"))


def rank_scores(scores: DataFrame, model: str, run: str, score: str, models: Sequence[str] | None = None) -> DataFrame:
    """Scores of every model sorted from best to worst, side by side by rank (one row per run)."""
    models = categories(scores, model) if models is None else models
    rank = F.row_number().over(Window.partitionBy(model).orderBy(F.desc(score), run))
    ranked = scores.withColumn("rank", rank)
    return ranked.groupBy("rank").agg(*[F.max(F.when(F.col(model) == m, F.col(score))).alias(m) for m in models])
