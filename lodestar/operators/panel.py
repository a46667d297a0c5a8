"""Panel, count, survival and smoothing models.

Every fit sums cross products on the executors and solves a system whose side
is the number of model terms. Results are term tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import digamma, falling_sums, n_rows, trigamma
from lodestar.functions.stats import normal_p, t_p
from lodestar.operators.ordered import Ranges, desc, null_safe_join
from lodestar.session import cut_lineage

ONE = "(intercept)"


def _sums(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, float]:
    """Named sums over all rows in one pass."""
    row = df.agg(*[F.sum(e.cast("double")).alias(f"s{i}") for i, e in enumerate(exprs.values())]).first()
    return {k: float(row[i] or 0.0) for i, k in enumerate(exprs)}


MAX_DIRECT = 6


def cross_products(df: DataFrame, xs: Sequence[Column], w: Column, zs: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'WZ.

    A few terms are summed cell by cell in one pass. With more terms every row
    is spread to its terms and each term sums its own matrix row map-side.
    """
    k, m = len(xs), len(zs)
    # compute weight, terms and responses once per row before they are multiplied
    df = df.select(w.cast("double").alias("__cw"), *[x.cast("double").alias(f"__cx{i}") for i, x in enumerate(xs)],
                   *[z.cast("double").alias(f"__cz{j}") for j, z in enumerate(zs)])
    w, xs, zs = F.col("__cw"), [F.col(f"__cx{i}") for i in range(k)], [F.col(f"__cz{j}") for j in range(m)]
    if k <= MAX_DIRECT:
        cells = {f"{i},{j}": w * xs[i] * xs[j] for i in range(k) for j in range(i, k)}
        cells |= {f"{i}|{j}": w * xs[i] * zs[j] for i in range(k) for j in range(m)}
        s = _sums(df, cells)
        a = np.array([[s[f"{min(i, j)},{max(i, j)}"] for j in range(k)] for i in range(k)])
        return a, np.array([[s[f"{i}|{j}"] for j in range(m)] for i in range(k)])
    rows = df.select(w.alias("w"), F.array(*xs, *zs).alias("v")).select(
        "w", "v", F.posexplode(F.slice("v", 1, k)).alias("i", "x")).filter("x <> 0")
    parts = rows.groupBy("i").agg(*[F.sum(F.col("w") * F.col("x") * F.get("v", F.lit(j))).alias(f"c{j}")
                                    for j in range(k + m)])
    a, b = np.zeros((k, k)), np.zeros((k, m))
    for row in parts.collect():  # one row per term
        values = [float(row[f"c{j}"] or 0.0) for j in range(k + m)]
        a[row["i"]], b[row["i"]] = values[:k], values[k:]
    return a, b


def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inv = np.linalg.pinv(a, hermitian=True)
    return inv @ b, inv


def term_table(df: DataFrame, terms: Sequence[str], est: np.ndarray, se: np.ndarray, dof: float | None = None) -> DataFrame:
    """Rows (term, estimate, se, stat, p): normal, or Student's t with ``dof``."""
    rows = []
    for name, b, s in zip(terms, est, se):
        stat = float(b / s) if s > 0 else float("nan")
        p = float("nan") if s <= 0 else (normal_p(stat) if dof is None else t_p(stat, dof))
        rows.append((name, float(b), float(s), stat, p))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, stat double, p double")


def _dot(xs: Sequence[Column], beta: Sequence[float]) -> Column:
    return sum((x * F.lit(float(b)) for x, b in zip(xs, beta)), F.lit(0.0))


def dummies(df: DataFrame, col: str) -> dict[str, Column]:
    """0/1 terms for all levels but the first, e.g. years."""
    levels = sorted(r[0] for r in df.select(col).distinct().collect())
    return {f"{col}={v}": (F.col(col) == v).cast("double") for v in levels[1:]}


def demean(df: DataFrame, cols: Sequence[str], effects: Sequence[str], weight: Column | None = None,
           tol: float = 1e-10, max_sweeps: int = 500) -> DataFrame:
    """Subtract (weighted) effect means; several effects are swept in turn until nothing moves.

    Means are aggregated and joined back, so a large entity is summed map-side.
    """
    w = weight if weight is not None else F.lit(1.0)
    out = df.withColumn("__w", w.cast("double")).withColumns({c: F.col(c).cast("double") for c in cols})

    def sweep(rows: DataFrame, effect: str) -> DataFrame:
        means = rows.groupBy(effect).agg(
            *[(F.sum(F.col("__w") * F.col(c)) / F.sum("__w")).alias(f"__m_{c}") for c in cols])
        joined = null_safe_join(rows, means, [effect])
        return joined.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])

    if len(effects) == 1:
        return sweep(out, effects[0]).drop("__w")
    scale = None
    for _ in range(max_sweeps):
        before = out.withColumns({f"__b_{c}": F.col(c) for c in cols})
        for effect in effects:
            before = sweep(before, effect)
        moved = cut_lineage(before)
        row = moved.agg(*[F.max(F.abs(F.col(c) - F.col(f"__b_{c}"))) for c in cols],
                        *[F.max(F.abs(F.col(f"__b_{c}"))) for c in cols]).first()
        change, size = row[:len(cols)], row[len(cols):]
        scale = scale or [max(v or 0.0, 1e-300) for v in size]
        out = moved.drop(*[f"__b_{c}" for c in cols])
        if all((c or 0.0) <= tol * s for c, s in zip(change, scale)):
            return out.drop("__w")
    raise RuntimeError("demeaning did not settle; raise max_sweeps")


def _absorbed(df: DataFrame, effects: Sequence[str]) -> int:
    """Number of free effect levels; two effects share one level."""
    row = df.agg(*[F.count_distinct(e) for e in effects]).first()
    return sum(row) - (len(effects) - 1)


MAX_DUMMIES = 60


def _with_effects(rows: DataFrame, xs: Sequence[str], entity: str | None, time: str | None):
    """Rows, terms and effects to sweep out. The few levels of a second effect become terms."""
    effects = [e for e in (entity, time) if e]
    if len(effects) == 2:
        levels = sorted(r[0] for r in rows.select(time).distinct().limit(MAX_DUMMIES + 1).collect())
        if len(levels) <= MAX_DUMMIES:
            flags = {f"__d{i}": (F.col(time) == v).cast("double") for i, v in enumerate(levels[1:])}
            return rows.withColumns(flags), [*xs, *flags], [entity]
    return rows, list(xs), effects


def within(df: DataFrame, y: str, xs: Sequence[str], entity: str | None = None, time: str | None = None) -> DataFrame:
    """Fixed-effects regression by entity, by time, or both (unbalanced panels too)."""
    base = cut_lineage(df.na.drop(subset=[y, *xs]).select(y, *xs, *[e for e in (entity, time) if e]))
    rows, all_xs, effects = _with_effects(base, xs, entity, time)
    free = cut_lineage(demean(rows, [y, *all_xs], effects))
    terms = [F.col(x) for x in all_xs]
    a, b = cross_products(free, terms, F.lit(1.0), [F.col(y)])
    est, inv = _solve(a, b[:, 0])
    dof = base.count() - _absorbed(base, [e for e in (entity, time) if e]) - len(xs)
    rss = _sums(free, {"r": F.pow(F.col(y) - _dot(terms, est), 2)})["r"]
    k = len(xs)
    return term_table(df, xs, est[:k], np.sqrt(np.diag(inv)[:k] * rss / dof), dof)


def ols(df: DataFrame, y: str, terms: Mapping[str, Column]) -> DataFrame:
    """Least squares on Column terms with an intercept."""
    xs = [F.lit(1.0), *terms.values()]
    a, b = cross_products(df, xs, F.lit(1.0), [F.col(y)])
    est, inv = _solve(a, b[:, 0])
    s = _sums(df, {"r": F.pow(F.col(y) - _dot(xs, est), 2), "n": F.lit(1)})
    dof = s["n"] - len(xs)
    return term_table(df, [ONE, *terms], est, np.sqrt(np.diag(inv) * s["r"] / dof), dof)


def poisson_fe(df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str | None = None,
               tol: float = 1e-9, max_iter: int = 100) -> DataFrame:
    """Poisson regression with entity (and time) effects; entities with only zeros drop out.

    Weighted least squares steps in which the entity means are swept out of the
    working response and the terms, so no entity dummy is ever built. ``y`` may
    be any non-negative number (quasi-likelihood).
    """
    keys = [e for e in (entity, time) if e]
    rows = df.na.drop(subset=[y, *xs]).select(F.col(y).cast("double").alias("__y"), *xs, *keys)
    for effect in keys:
        alive = rows.groupBy(effect).agg(F.sum("__y").alias("s")).filter("s > 0").select(effect)
        rows = rows.join(alive, effect, "left_semi")
    rows, all_xs, effects = _with_effects(cut_lineage(rows), xs, entity, time)
    mean = rows.agg(F.avg("__y").alias("m")).first()[0]
    state = rows.withColumn("__eta", F.log((F.col("__y") + F.lit(mean)) / 2))
    beta, k = None, len(xs)
    for _ in range(max_iter):
        mu = F.exp("__eta")
        work = state.withColumn("__mu", mu).withColumn("__z0", F.col("__eta") + F.col("__y") / F.col("__mu") - 1)
        work = work.withColumn("__z", F.col("__z0")).withColumns({f"__x_{x}": F.col(x).cast("double") for x in all_xs})
        cols = ["__z", *[f"__x_{x}" for x in all_xs]]
        free = cut_lineage(demean(work, cols, effects, F.col("__mu"), tol=1e-8))
        terms = [F.col(f"__x_{x}") for x in all_xs]
        a, b = cross_products(free, terms, F.col("__mu"), [F.col("__z")])
        new, inv = _solve(a, b[:, 0])
        # fitted value: working response minus its residual after terms and effects
        eta = F.col("__z0") - (F.col("__z") - _dot(terms, new))
        state = free.select("__y", *all_xs, *keys, eta.alias("__eta"))
        done = beta is not None and np.max(np.abs(new - beta)) <= tol * (1 + np.max(np.abs(new)))
        beta = new
        if done:
            return term_table(df, xs, beta[:k], np.sqrt(np.diag(inv)[:k]))
    raise RuntimeError("Poisson fit did not settle; raise max_iter")


def poisson_fe_by(df: DataFrame, y: str, xs: Sequence[str], entity: str, category: str, time: str | None = None) -> DataFrame:
    """The same fit for every category."""
    cats = sorted(r[0] for r in df.select(category).distinct().collect())
    out = None
    for c in cats:
        fit = poisson_fe(df.filter(F.col(category) == c), y, xs, entity, time).select(F.lit(c).alias(category), "*")
        out = fit if out is None else out.unionByName(fit)
    return out


def _irls(df: DataFrame, xs: Sequence[Column], weight_and_z, start: np.ndarray, tol: float = 1e-10, max_iter: int = 100):
    """Weighted least squares steps; ``weight_and_z(eta)`` gives the step's weight and response."""
    beta = start
    for _ in range(max_iter):
        w, z = weight_and_z(_dot(xs, beta))
        a, b = cross_products(df, xs, w, [z])
        new, inv = _solve(a, b[:, 0])
        if np.max(np.abs(new - beta)) <= tol * (1 + np.max(np.abs(new))):
            return new, inv
        beta = new
    raise RuntimeError("fit did not settle; raise max_iter")


MAX_THETA = 1e5  # beyond this the fit is Poisson


def neg_binomial(df: DataFrame, y: str, terms: Mapping[str, Column], exposure: Column | None = None,
                 tol: float = 1e-8, max_iter: int = 50) -> tuple[DataFrame, float]:
    """Negative binomial regression (variance mu + mu^2 / theta) and its theta.

    Alternates the term fit with Newton steps on theta. A theta beyond
    ``MAX_THETA`` says that the counts are no more spread than a Poisson's.
    """
    offset = F.log(exposure) if exposure is not None else F.lit(0.0)
    names = [ONE, *terms]
    rows = df.select(F.col(y).cast("bigint").alias("__y"), offset.cast("double").alias("__o"),
                     F.lit(1.0).alias("t0"), *[c.cast("double").alias(f"t{i + 1}") for i, c in enumerate(terms.values())])
    rows = cut_lineage(rows.na.drop())
    xs = [F.col(f"t{i}") for i in range(len(names))]
    y_, o = F.col("__y"), F.col("__o")
    s = _sums(rows, {"y": y_, "e": F.exp(o), "n": F.lit(1)})
    beta = np.array([np.log(s["y"] / s["e"]), *[0.0] * len(terms)])
    theta, n = MAX_THETA, s["n"]

    def step(eta):
        mu = F.exp(eta + o)
        return mu / (1 + mu / theta), eta + (y_ - mu) / mu

    beta, inv = _irls(rows, xs, step, beta)
    mu = F.exp(_dot(xs, beta) + o)
    m = _sums(rows, {"v": F.pow((y_ - mu) / mu, 2)})
    theta = max(n / m["v"], 1e-3)
    counts = cut_lineage(rows.groupBy(y_.cast("double").alias("y")).agg(n_rows().alias("n")))
    for _ in range(max_iter):
        old = theta
        mu = F.exp(_dot(xs, beta) + o)
        known = cut_lineage(rows.select(y_.cast("double").alias("y"), mu.alias("mu")))
        yy, m_ = F.col("y"), F.col("mu")
        for _ in range(50):
            th = F.lit(theta)
            g = _sums(known, {
                "d1": F.log(th / (th + m_)) + 1 - (yy + th) / (m_ + th),
                "d2": 1 / th - 2 / (m_ + th) + (yy + th) / F.pow(m_ + th, 2)})
            # the gamma series depend on the count alone
            own = _sums(counts, {"d1": F.col("n") * (digamma(yy + th) - digamma(th)),
                                 "d2": F.col("n") * (trigamma(yy + th) - trigamma(th))})
            first, second = g["d1"] + own["d1"], g["d2"] + own["d2"]
            move = first / abs(second) if second else 0.0
            nxt = theta + move
            nxt = min(max(nxt, theta / 4), theta * 4)
            close = abs(nxt - theta) <= tol * theta
            theta = nxt
            if close or theta > MAX_THETA:
                break
        new, inv = _irls(rows, xs, step, beta)
        close = abs(theta - old) <= 1e-6 * theta and np.max(np.abs(new - beta)) <= 1e-6
        beta = new
        if close or theta > MAX_THETA:
            return term_table(df, names, beta, np.sqrt(np.diag(inv))), float(theta)
    raise RuntimeError("fit did not settle; raise max_iter")


def _newton(value_grad_hess, start: np.ndarray, tol: float = 1e-9, max_iter: int = 100):
    """Newton ascent with step halving; the callback returns value, gradient and Hessian."""
    beta = start
    value, grad, hess = value_grad_hess(beta)
    for _ in range(max_iter):
        step = -np.linalg.pinv(hess, hermitian=True) @ grad
        if grad @ step < 0:  # not uphill: fall back to the gradient direction
            step = grad / (1 + np.linalg.norm(hess))
        size = 1.0
        while True:
            trial = value_grad_hess(beta + size * step)
            if np.isfinite(trial[0]) and trial[0] >= value - 1e-10 * (1 + abs(value)) or size < 1e-6:
                break
            size /= 2
        beta = beta + size * step
        value, grad, hess = trial
        if np.max(np.abs(size * step)) <= tol * (1 + np.max(np.abs(beta))):
            return beta, value, hess
    raise RuntimeError("fit did not settle; raise max_iter")


#: Information on the log-odds of extra zeros below which they count as absent.
FLAT = 1e-6


def zero_inflated_poisson(df: DataFrame, y: str, terms: Mapping[str, Column], zero_terms: Mapping[str, Column] | None = None,
                          alpha: float | None = 0.05) -> DataFrame:
    """Poisson counts with a logit share of extra zeros; keeps terms with p below ``alpha``.

    Newton steps on the joint likelihood, whose row derivatives are Columns. Where
    the counts have no extra zeros their share runs to 0 (or 1): the likelihood is
    flat there, so the errors of the zero terms are infinite and their p is 1.
    """
    zero_terms = terms if zero_terms is None else zero_terms
    rows = df.select(F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("x0"),
                     *[c.cast("double").alias(f"x{i + 1}") for i, c in enumerate(terms.values())], F.lit(1.0).alias("z0"),
                     *[c.cast("double").alias(f"z{i + 1}") for i, c in enumerate(zero_terms.values())])
    rows = cut_lineage(rows.na.drop())
    xs = [F.col(f"x{i}") for i in range(len(terms) + 1)]
    zs = [F.col(f"z{i}") for i in range(len(zero_terms) + 1)]
    y_, k = F.col("__y"), len(xs)
    cols, side = [*xs, *zs], ["c"] * len(xs) + ["z"] * len(zs)

    def at(beta):
        lin = rows.withColumns({"__l": F.exp(_dot(xs, beta[:k])), "__p": 1 / (1 + F.exp(-_dot(zs, beta[k:])))})
        lam, p = F.col("__l"), F.col("__p")
        lin = lin.withColumn("__q", (1 - p) * F.exp(-lam))
        q = F.col("__q")
        lin = lin.withColumn("__p0", p + q)
        p0, zero = F.col("__p0"), y_ == 0
        d_c, d_z = -lam * q / p0, (p * (1 - p) - p * q) / p0
        lin = lin.withColumns({
            "__v": F.when(zero, F.log(p0)).otherwise(F.log(1 - p) + y_ * F.log(lam) - lam),
            "__c": F.when(zero, d_c).otherwise(y_ - lam), "__z": F.when(zero, d_z).otherwise(-p),
            "__cc": F.when(zero, lam * q * (lam - 1) / p0 - d_c * d_c).otherwise(-lam),
            "__cz": F.when(zero, lam * p * q / p0 - d_c * d_z).otherwise(0.0),
            "__zz": F.when(zero, p * (1 - 2 * p) * (1 - p - q) / p0 - d_z * d_z).otherwise(-p * (1 - p))})
        cells = {"v": F.col("__v")}
        cells |= {f"g{i}": F.col(f"__{side[i]}") * c for i, c in enumerate(cols)}
        cells |= {f"h{i},{j}": F.col(f"__{side[i]}{side[j]}") * cols[i] * cols[j]
                  for i in range(len(cols)) for j in range(i, len(cols))}
        s = _sums(lin, cells)
        m = len(cols)
        return (s["v"], np.array([s[f"g{i}"] for i in range(m)]),
                np.array([[s[f"h{min(i, j)},{max(i, j)}"] for j in range(m)] for i in range(m)]))

    s = _sums(rows, {"y": y_, "zero": (y_ == 0).cast("int"), "n": F.lit(1)})
    start = np.zeros(len(cols))
    start[0] = np.log(max(s["y"], 1e-9) / max(s["n"] - s["zero"] / 2, 1))
    share = min(max(s["zero"] / s["n"] / 2, 0.02), 0.9)
    start[k] = np.log(share / (1 - share))
    beta, _, hess = _newton(at, start)
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(-hess, hermitian=True)), 0, None))
    if -hess[k, k] < FLAT:
        se[k:] = np.inf
    names = [f"count:{t}" for t in (ONE, *terms)] + [f"zero:{t}" for t in (ONE, *zero_terms)]
    out = term_table(df, names, beta, se)
    return out.filter(F.col("p") < alpha) if alpha is not None else out


def cox(df: DataFrame, duration: str, event: str, xs: Sequence[str], ties: str = "efron") -> DataFrame:
    """Proportional hazards. Rows are summed per distinct duration before the risk sets.

    Risk sets are running sums from the longest duration down. ``ties`` is
    ``breslow`` or ``efron``; for the latter the sums over the tied events of a
    time are closed forms, so a time has one row however many events it holds.
    """
    rows = cut_lineage(df.na.drop(subset=[duration, event, *xs]).select(
        F.col(duration).cast("double").alias("__t"), F.col(event).cast("int").alias("__e"),
        *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]))
    k = len(xs)
    cols = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = cut_lineage(Ranges(rows, [], [desc("__t")]).number(rows, "__c"))
    inside = Window.partitionBy("__c").orderBy(F.desc("__t")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    died = F.col("__e") == 1

    r = F.col("__r")
    parts = {"0": r, **{f"1_{i}": r * cols[i] for i in range(k)}, **{f"2_{i}_{j}": r * cols[i] * cols[j] for i, j in pairs}}
    at_risk = [F.sum(v).alias(f"s{n}") for n, v in parts.items()]
    tied = [F.count_if(died).cast("double").alias("d"), F.sum(F.when(died, F.col("__lp"))).alias("lp"),
            *[F.sum(F.when(died, c)).alias(f"ex{i}") for i, c in enumerate(cols)],
            *[F.sum(F.when(died, v)).alias(f"e{n}") for n, v in parts.items()]]
    longer = [F.coalesce(F.sum(f"s{n}").over(before), F.lit(0.0)).alias(f"o{n}") for n in parts]
    cumulated = {f"r{n}": F.sum(f"s{n}").over(inside) + F.col(f"o{n}") for n in parts}
    d, E, R = F.col("d"), {n: F.col(f"e{n}") for n in parts}, {n: F.col(f"r{n}") for n in parts}
    if ties == "efron":
        # over l < d: R(n) - l / d * E(n), beside R(0) - l / d * E(0) = E(0) / d * (a - l)
        logs, first, second = falling_sums("__a", "d")
        scale = d / E["0"]
        given = {"__log": logs - d * F.log(scale), "__s1": first * scale, "__s2": second * scale * scale,
                 **{f"m{n}": E[n] / E["0"] for n in parts}, **{f"u{n}": R[n] - R["0"] * E[n] / E["0"] for n in parts}}
        share, rest = {n: F.col(f"m{n}") for n in parts}, {n: F.col(f"u{n}") for n in parts}
        log_sum, s1, s2 = F.col("__log"), F.col("__s1"), F.col("__s2")
        mean = {n: d * share[n] + rest[n] * s1 for n in parts}
        square = {(i, j): d * share[f"1_{i}"] * share[f"1_{j}"]
                  + (share[f"1_{i}"] * rest[f"1_{j}"] + share[f"1_{j}"] * rest[f"1_{i}"]) * s1
                  + rest[f"1_{i}"] * rest[f"1_{j}"] * s2 for i, j in pairs}
    else:
        given, log_sum = {}, d * F.log(R["0"])
        mean = {n: d * R[n] / R["0"] for n in parts}
        square = {(i, j): mean[f"1_{i}"] * mean[f"1_{j}"] / d for i, j in pairs}
    cells = {"v": F.col("lp") - log_sum, **{f"g{i}": F.col(f"ex{i}") - mean[f"1_{i}"] for i in range(k)},
             **{f"h{i},{j}": square[i, j] - mean[f"2_{i}_{j}"] for i, j in pairs}}

    def at(beta):
        risk = rows.withColumn("__lp", _dot(cols, beta)).withColumn("__r", F.exp("__lp"))
        ranges = risk.groupBy("__c").agg(*at_risk).select("__c", *longer)
        cum = (risk.groupBy("__c", "__t").agg(*tied, *at_risk).join(F.broadcast(ranges), "__c")
               .withColumns(cumulated).filter("d > 0").withColumn("__a", d * R["0"] / E["0"]).withColumns(given))
        s = _sums(cum, cells)
        return (s["v"], np.array([s[f"g{i}"] for i in range(k)]),
                np.array([[s[f"h{min(i, j)},{max(i, j)}"] for j in range(k)] for i in range(k)]))

    beta, _, hess = _newton(at, np.zeros(k))
    return term_table(df, xs, beta, np.sqrt(np.diag(np.linalg.pinv(-hess, hermitian=True))))


def mundlak(panel: DataFrame, entity: str, time: str, cols: Sequence[str], name: str = "mundlak") -> DataFrame:
    """Running mean over an entity's periods of the mean of several predictors."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    mean = sum((F.col(c).cast("double") for c in cols), F.lit(0.0)) / len(cols)
    return panel.withColumn(name, F.avg(mean).over(w))


def fractional_logit(df: DataFrame, y: str, terms: Mapping[str, Column]) -> tuple[DataFrame, float]:
    """Logit regression of a share with quasi-binomial errors, and its dispersion."""
    names = [ONE, *terms]
    rows = cut_lineage(df.select(F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("t0"), *[
        c.cast("double").alias(f"t{i + 1}") for i, c in enumerate(terms.values())]).na.drop())
    xs, y_ = [F.col(f"t{i}") for i in range(len(names))], F.col("__y")

    def step(eta):
        mu = 1 / (1 + F.exp(-eta))
        w = mu * (1 - mu)
        return w, eta + (y_ - mu) / w

    mean = rows.agg(F.avg("__y")).first()[0]
    beta, inv = _irls(rows, xs, step, np.array([np.log(mean / (1 - mean)), *[0.0] * len(terms)]))
    mu = 1 / (1 + F.exp(-_dot(xs, beta)))
    s = _sums(rows, {"c": F.pow(y_ - mu, 2) / (mu * (1 - mu)), "n": F.lit(1)})
    dof = s["n"] - len(names)
    dispersion = s["c"] / dof
    return term_table(df, names, beta, np.sqrt(np.diag(inv) * dispersion), dof), dispersion


class OrthoPoly:
    """Orthogonal polynomial basis of degree 2 fitted to a column: columns sum to 0 with unit length."""

    def __init__(self, mean: float, shift: float, norm1: float, norm2: float):
        self.mean, self.shift, self.norm1, self.norm2 = mean, shift, norm1, norm2

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> "OrthoPoly":
        """Centred recurrence from moments; two passes keep the moments accurate."""
        x = F.col(col).cast("double")
        row = df.filter(x.isNotNull()).agg(F.avg(x).alias("m"), n_rows().alias("n")).first()
        mean, n = row["m"], row["n"]
        c = x - F.lit(mean)
        m = df.agg(*[F.sum(F.pow(c, p)) for p in (2, 3, 4)]).first()
        shift = m[1] / m[0]
        norm2 = m[2] - m[1] * shift - m[0] * m[0] / n
        return cls(mean, shift, m[0] ** 0.5, norm2 ** 0.5 if norm2 > 0 else float("nan")).with_level(m[0] / n)

    def with_level(self, level: float) -> "OrthoPoly":
        self.level = level
        return self

    def columns(self, x: Column) -> tuple[Column, Column]:
        """First and second basis column, also for new values."""
        c = x.cast("double") - self.mean
        return c / self.norm1, (c * c - self.shift * c - self.level) / self.norm2


def ortho_poly(df: DataFrame, col: str) -> DataFrame:
    """Add ``col_p1`` and ``col_p2``."""
    p1, p2 = OrthoPoly.fit(df, col).columns(F.col(col))
    return df.withColumns({f"{col}_p1": p1, f"{col}_p2": p2})


def surface(grid: DataFrame, terms: Mapping[str, Column], estimates: Mapping[str, float], name: str = "fitted") -> DataFrame:
    """Fitted value at every grid point, from the same terms that were fitted."""
    value = sum((F.lit(float(estimates[t])) * c for t, c in terms.items()), F.lit(float(estimates.get(ONE, 0.0))))
    return grid.withColumn(name, value)


def local_smooth(df: DataFrame, x: str, y: str, bandwidth: float, points: int = 50) -> DataFrame:
    """Local linear fit at evenly spaced points, tricube weights over a share of the range.

    Rows are first summed per distinct x; each x then feeds only the points
    within reach, and the sums are combined map-side.
    """
    base = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("__x")).agg(
        n_rows().alias("__n"), F.sum(F.col(y).cast("double")).alias("__y"))
    lo, hi = base.agg(F.min("__x"), F.max("__x")).first()
    h, step = bandwidth * (hi - lo), (hi - lo) / (points - 1)
    first = F.greatest(F.ceil((F.col("__x") - F.lit(h) - F.lit(lo)) / F.lit(step)), F.lit(0).cast("bigint"))
    last = F.least(F.floor((F.col("__x") + F.lit(h) - F.lit(lo)) / F.lit(step)), F.lit(points - 1).cast("bigint"))
    near = base.filter(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    near = near.withColumn("__u", F.col("__x") - (F.lit(lo) + F.col("point") * F.lit(step)))
    w = F.pow(1 - F.pow(F.least(F.abs(F.col("__u")) / F.lit(h), F.lit(1.0)), 3), 3)
    u, n = F.col("__u"), F.col("__n")
    s = near.groupBy("point").agg(F.sum(w * n).alias("s0"), F.sum(w * n * u).alias("s1"), F.sum(w * n * u * u).alias("s2"),
                                  F.sum(w * F.col("__y")).alias("t0"), F.sum(w * F.col("__y") * u).alias("t1"))
    fit = F.coalesce(F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"),
                                  F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")),
                     F.try_divide("t0", "s0"))
    return s.select("point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), fit.alias("fitted"))
