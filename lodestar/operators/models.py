"""Classification, regression and component models on Spark ML.

Estimators work on a ``features`` vector and a ``label`` column (see
``assemble``). Only parameters and one row per model column reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    FMClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows
from lodestar.operators.evaluation import log_loss
from lodestar.operators.features import apply_rare, fit_rare
from lodestar.session import cut_lineage


def assemble(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Add the ``features`` vector and, when named, a double ``label``; incomplete rows drop out."""
    rows = df.na.drop(subset=[*features, *([label] if label else [])])
    if label:
        rows = rows.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def tree(depth: int = 5, min_leaf: int = 1, impurity: str = "gini", min_gain: float = 0.0,
         min_fraction: float = 0.0, seed: int = 42) -> Estimator:
    """Decision tree classifier; ``min_fraction`` is the least share of rows per node."""
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_leaf, impurity=impurity,
                                  minInfoGain=min_gain, minWeightFractionPerNode=min_fraction, seed=seed)


def tree_regressor(depth: int = 5, min_leaf: int = 1, seed: int = 42) -> Estimator:
    return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)


def forest(trees: int = 100, depth: int = 5, impurity: str = "entropy", min_leaf: int = 1, seed: int = 42) -> Estimator:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, impurity=impurity, minInstancesPerNode=min_leaf, seed=seed)


def logistic(n: int, c: float = 1.0, penalty: str = "l2", fit_intercept: bool = True, max_iter: int = 200) -> Estimator:
    """Logistic regression whose ``c`` weighs the summed loss of ``n`` rows against the penalty."""
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                              standardization=False, fitIntercept=fit_intercept, maxIter=max_iter, tol=1e-9)


def linear() -> Estimator:
    return LinearRegression(solver="normal")


def lasso(alpha: float) -> Estimator:
    """Minimises RSS / (2 n) + alpha * |b|."""
    return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-10)


def ridge(alpha: float, n: int, label_sd: float) -> Estimator:
    """Minimises RSS + alpha * b^2 over ``n`` rows.

    Spark divides the penalty by the (population) deviation of the label, which
    is undone here.
    """
    return LinearRegression(solver="normal", regParam=alpha / n * label_sd, elasticNetParam=0.0, standardization=False)


def perceptron(inputs: int, hidden: Sequence[int], classes: int = 2, max_iter: int = 100, seed: int = 42) -> Estimator:
    """Feed-forward net with sigmoid hidden layers and a softmax output."""
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], maxIter=max_iter, seed=seed)


def tree_summary(model) -> dict[str, int]:
    """Depth, nodes and leaves of a (binary) tree."""
    return {"depth": model.depth, "nodes": model.numNodes, "leaves": (model.numNodes + 1) // 2}


def importances(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """Feature importances or absolute coefficients, ranked; ``df`` only lends its session."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    pairs = sorted(((abs(float(v)), n) for n, v in zip(names, values.toArray())), key=lambda p: (-round(p[0], 12), p[1]))
    return df.sparkSession.createDataFrame([(i + 1, n, v) for i, (v, n) in enumerate(pairs)],
                                           "rank int, feature string, importance double")


def coefficients(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """Intercept and coefficients as rows."""
    rows = [("(intercept)", float(model.intercept)), *[(n, float(v)) for n, v in zip(names, model.coefficients.toArray())]]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def positive_probability(scored: DataFrame, col: str = "probability") -> Column:
    """Probability of class 1."""
    return vector_to_array(F.col(col))[1]


def score(model: Model, df: DataFrame, key: str) -> DataFrame:
    """Prediction (and class-1 probability where there is one) per key."""
    out = model.transform(df)
    cols = [key, "prediction"]
    if "probability" in out.columns:
        out = out.withColumn("p1", positive_probability(out))
        cols.append("p1")
    return out.select(*cols)


def stepwise_logistic(df: DataFrame, candidates: Sequence[str], label: str) -> tuple[list[str], list[tuple[str, float]]]:
    """Terms chosen by AIC, both directions from the full model, with the path of steps."""

    def aic(terms):
        if not terms:
            row = df.agg(n_rows().alias("n"), F.sum(F.col(label).cast("double")).alias("s")).first()
            p = row["s"] / row["n"]
            return 2 - 2 * (row["s"] * np.log(p) + (row["n"] - row["s"]) * np.log(1 - p))
        glm = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50)
        return glm.fit(assemble(df, terms, label)).summary.aic

    terms = list(candidates)
    best = aic(terms)
    path = [("start", float(best))]
    while True:
        moves = [("-" + c, [t for t in terms if t != c]) for c in terms]
        moves += [("+" + c, [*terms, c]) for c in candidates if c not in terms]
        scored = [(aic(t), name, t) for name, t in moves]
        top = min(scored, key=lambda s: (s[0], s[1]))
        if top[0] >= best - 1e-9:
            return terms, path
        best, terms = top[0], top[2]
        path.append((top[1], float(best)))


def fit_mlp(train: DataFrame, val: DataFrame, inputs: int, hidden: Sequence[int], iters: Sequence[int],
            seed: int = 42) -> tuple[Model, int]:
    """Net with the number of training rounds that does best on the validation rows."""
    best = None
    for it in iters:
        model = perceptron(inputs, hidden, max_iter=it, seed=seed).fit(train)
        scored = model.transform(val)
        loss = log_loss(scored.withColumn("__p", positive_probability(scored)), "label", "__p").first()[0]
        if best is None or loss < best[0]:
            best = (loss, model, it)
    return best[1], best[2]


FACTOR_RULES = {"sqrt": lambda n: n ** 0.5, "fourth_root": lambda n: n ** 0.25, "half_up_to_50": lambda n: min(50, n / 2)}


class CategoryModel:
    """Rare-category codes and a factorization machine that learns a vector per category."""

    def __init__(self, codes: DataFrame, cats: Sequence[str], model: Model):
        self.codes, self.cats, self.model = codes, list(cats), model

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(apply_rare(df, self.codes, self.cats))
        return out.withColumn("p1", positive_probability(out))


def fit_category_fm(df: DataFrame, cats: Sequence[str], label: str, pct: float = 0.01, factor_rule: str = "fourth_root",
                    max_iter: int = 30, step: float = 0.05, seed: int = 42) -> CategoryModel:
    """Click model over categories: rare ones share a code, each code gets a learned vector."""
    codes = cut_lineage(fit_rare(df, cats, pct))
    rows = cut_lineage(apply_rare(df, codes, cats).withColumn("label", F.col(label).cast("double")).select(*cats, "label"))
    levels = codes.count() + len(cats)
    size = max(1, round(FACTOR_RULES[factor_rule](levels)))
    stages = [OneHotEncoder(inputCols=list(cats), outputCols=[f"{c}__v" for c in cats], dropLast=False, handleInvalid="keep"),
              VectorAssembler(inputCols=[f"{c}__v" for c in cats], outputCol="features"),
              FMClassifier(factorSize=size, maxIter=max_iter, stepSize=step, seed=seed)]
    return CategoryModel(codes, cats, Pipeline(stages=stages).fit(rows))


MAX_GRAM = 4_096


def gramian(df: DataFrame, vector: str, width: int) -> np.ndarray:
    """Sum of v v' over all rows: one partial matrix per partition, then a sum by cell."""
    if width > MAX_GRAM:
        raise ValueError(f"a {width} x {width} matrix exceeds the limit of {MAX_GRAM}; use top_components")

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(float)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    parts = df.select(vector).mapInPandas(partial, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for i, j, v in cells.collect():  # width x width numbers
        out[i, j] = v
    return out


def mean_vector(df: DataFrame, vector: str) -> list[float]:
    """Mean per position (the mean image)."""
    cells = df.select(F.posexplode(vector).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"))
    return [r["m"] for r in cells.orderBy("j").collect()]  # one number per position


class Components:
    """Principal axes of a vector column, with the share of variance they explain."""

    def __init__(self, mean: np.ndarray, values: np.ndarray, axes: np.ndarray, total: float | None = None):
        self.mean, self.values, self.axes = mean, values, axes
        self.total = total  # whole variance, where only some components were taken

    def share(self) -> np.ndarray:
        return np.cumsum(self.values) / (self.values.sum() if self.total is None else self.total)

    def needed(self, share: float) -> int:
        """Components for a share of the variance."""
        return int(np.searchsorted(self.share(), share - 1e-12) + 1)

    def project(self, df: DataFrame, vector: str, d: int, name: str = "scores") -> DataFrame:
        mean, axes = self.mean, self.axes[:, :d]

        @F.pandas_udf("array<double>")
        def scores(v: pd.Series) -> pd.Series:
            if v.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list((np.stack(v.to_numpy()).astype(float) - mean) @ axes))

        return df.withColumn(name, scores(F.col(vector)))

    def rebuild(self, df: DataFrame, scores: str, name: str = "rebuilt") -> DataFrame:
        mean, axes = self.mean, self.axes

        @F.pandas_udf("array<double>")
        def back(s: pd.Series) -> pd.Series:
            if s.empty:
                return pd.Series([], dtype=object)
            y = np.stack(s.to_numpy()).astype(float)
            return pd.Series(list(y @ axes[:, :y.shape[1]].T + mean))

        return df.withColumn(name, back(F.col(scores)))


def _signed(axes: np.ndarray) -> np.ndarray:
    top = np.abs(axes).argmax(axis=0)
    return axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1, 1)


def pca(df: DataFrame, vector: str) -> Components:
    """Principal components for many rows of moderate width (a width x width matrix)."""
    mean = np.array(mean_vector(df, vector))
    n = df.count()
    centred = df.select(F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]),
                                   lambda v, m: v.cast("double") - m).alias("__v"))
    values, axes = np.linalg.eigh(gramian(centred, "__v", len(mean)) / (n - 1))
    return Components(mean, values[::-1].clip(min=0), _signed(axes[:, ::-1]))


#: Columns of a block of partial sums, bytes of vectors that a task holds at once, and spare directions of the iteration.
BLOCK_COLUMNS, BATCH_BYTES, SPARE = 4_096, 32 << 20, 10


def top_components(df: DataFrame, vector: str, d: int, tol: float = 1e-10, max_iter: int = 300,
                   seed: int = 7) -> Components:
    """The first ``d`` principal components of vectors of any width, by subspace iteration.

    A round multiplies the centred rows, and their transpose, with d + ``SPARE``
    directions; tasks send their sums in blocks of columns. The driver holds
    width x (d + ``SPARE``) numbers and never a width x width matrix. Rows are
    read once a round. Raises where the values have not settled after ``max_iter`` rounds.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null"))
    head = rows.select(F.size("v").alias("w")).agg(F.max("w").alias("most"), F.min("w").alias("least"), n_rows().alias("n")).first()
    if not head.n or head.most != head.least:
        raise ValueError("vectors must be there and have one width")
    width, n, d = head.most, head.n, min(d, head.most)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(10_000, BATCH_BYTES // (8 * width)))))
    shared = spark.sparkContext.broadcast

    def block_sums(task, columns: int) -> np.ndarray:
        """Sum over all tasks of ``task(batches of rows)``, a width x columns array."""
        def run(batches):
            total = task(np.stack(b.column(0).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)
            if total is not None:
                for at in range(0, width, BLOCK_COLUMNS):
                    yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total[at:at + BLOCK_COLUMNS].tobytes()], pa.binary())],
                                          names=["at", "part"])

        def add(parts: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p.as_buffer(), np.float64) for p in parts.column("part"))
            return pa.table({"at": parts.column("at").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((width, columns))
        for r in rows.mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").collect():
            block = np.frombuffer(r.part).reshape(-1, columns)  # width x columns numbers in all
            out[r["at"]:r["at"] + len(block)] = block
        return out

    def added(batches, term):
        total = None
        for x in batches:
            part = term(x)
            total = part if total is None else total + part
        return total

    try:
        moments = block_sums(lambda bs: added(bs, lambda x: np.stack([x.sum(axis=0), (x * x).sum(axis=0)], axis=1)), 2)
        mean = moments[:, 0] / n
        k = min(d + SPARE, width)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, k)))[0]
        old = None
        for _ in range(max_iter):
            now = shared((mean, basis))

            def term(x, now=now):
                centre, q = now.value
                x = x - centre
                return x.T @ (x @ q)

            image = block_sums(lambda bs, term=term: added(bs, term), k)
            now.unpersist()
            inner = basis.T @ image
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            values, axes = values[::-1].clip(min=0) / (n - 1), (basis @ turn)[:, ::-1]
            if old is not None and np.all(np.abs(values[:d] - old) <= tol * max(values[0], 1e-300)):
                total = float((moments[:, 1] - n * mean * mean).sum() / (n - 1))
                return Components(mean, values[:d], _signed(axes[:, :d]), total)
            old, basis = values[:d], np.linalg.qr(image)[0]
    finally:
        spark.conf.set(key, before)
    raise RuntimeError("components did not settle; raise max_iter")


def pca_wide(long: DataFrame, row: str, position: str, value: str, d: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Components for few very wide rows given as (row, position, value).

    Works on the rows x rows matrix: each position is one vector over all rows,
    and the axes come back as (position, axis values), so nothing as wide as a
    row is ever held in one place. Absent positions are zero. Returns the
    eigenvalues / (n - 1), the axes and the scores per row.
    """
    ids = [r[0] for r in long.select(row).distinct().orderBy(row).limit(MAX_GRAM + 1).collect()]
    n = len(ids)
    if n > MAX_GRAM:
        raise ValueError(f"more than {MAX_GRAM} rows; use pca")
    index = long.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"`{row}` {dict(long.dtypes)[row]}, k int")
    columns = (long.join(index, row).groupBy(position)
               .agg(F.collect_list(F.struct("k", F.col(value).cast("double").alias("v"))).alias("e")))

    @F.pandas_udf("array<double>")
    def spread(k: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros((len(k), n))
        for i, (at, x) in enumerate(zip(k, v)):
            out[i, at] = x
        return pd.Series(list(out - out.mean(axis=1, keepdims=True)))

    columns = cut_lineage(columns.select(position, spread(F.col("e.k"), F.col("e.v")).alias("v")))
    values, vecs = np.linalg.eigh(gramian(columns, "v", n))
    values, vecs = values[::-1].clip(min=0), _signed(vecs[:, ::-1])
    scale = np.sqrt(np.where(values[:d] > 1e-9, values[:d], np.inf))
    weights = vecs[:, :d] / scale

    @F.pandas_udf("array<double>")
    def loading(v: pd.Series) -> pd.Series:
        if v.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(v.to_numpy()) @ weights))

    axes = columns.select(position, loading("v").alias("axis"))
    scores = long.sparkSession.createDataFrame(
        [(i, [float(x) for x in vecs[k, :d] * np.sqrt(values[:d])]) for k, i in enumerate(ids)],
        f"`{row}` {dict(long.dtypes)[row]}, scores array<double>")
    return values / (n - 1), axes, scores

