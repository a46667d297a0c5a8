"""Splits, folds, scaling, encoding, sampling and transform choice.

Every random step hashes a key, so results do not depend on partitioning and
can be replayed elsewhere. Positions by hash use chunks of the hash range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.columns import n_rows
from lodestar.operators.aggregates import value_counts
from lodestar.operators.ordered import null_safe_join, row_numbers
from lodestar.operators.relational import first_per_key, map_values
from lodestar.session import partitions

HASH_DIGITS = 13


def uniform(key: str | Column, seed: int) -> Column:
    """Number in [0, 1) from a hash of the key and a seed."""
    text = F.concat_ws(":", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")
    return head / F.lit(float(16 ** HASH_DIGITS))


def hash_positions(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """1-based position by hash, per ``by``; chunks cut the hash range evenly."""
    marked = df.withColumn("__u", uniform(key, seed))
    chunk = F.floor(F.col("__u") * (4 * partitions(df)))
    return row_numbers(marked, by, ["__u", key], name, chunk).drop("__u")


def split(df: DataFrame, key: str, test_size: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by hash; sizes are right in expectation."""
    u = uniform(key, seed)
    return df.filter(u >= test_size), df.filter(u < test_size)


def stratified_split(df: DataFrame, key: str, label: str, test_size: float, seed: int = 42,
                     name: str = "is_test") -> DataFrame:
    """Flag exactly ``ceil(test_size * n)`` rows of every class for the test set."""
    sizes = df.groupBy(label).agg(n_rows().alias("__n"))
    rows = null_safe_join(hash_positions(df, key, seed, [label], "__pos"), sizes, [label])
    return rows.withColumn(name, (F.col("__pos") <= F.ceil(test_size * F.col("__n"))).cast("int")).drop("__pos", "__n")


def split3(df: DataFrame, key: str, fractions: Sequence[float], seed: int = 42, name: str = "part") -> DataFrame:
    """Shuffle by hash and cut at the ceilings of the cumulated fractions: parts 0, 1, 2, ..."""
    n = df.agg(n_rows().alias("n")).scalar()
    rows = hash_positions(df, key, seed, name="__pos")
    part, done = F.lit(0), 0.0
    for f in fractions[:-1]:
        done += f
        part = part + (F.col("__pos") > F.ceil(F.round(F.lit(done) * n, 6))).cast("int")
    return rows.withColumn(name, part).drop("__pos")


def assign_fold(df: DataFrame, key: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds 0..k-1 of equal size."""
    rows = hash_positions(df, key, seed, name="__pos")
    return rows.withColumn(name, ((F.col("__pos") - 1) % k).cast("int")).drop("__pos")


def shuffle_splits(df: DataFrame, key: str, rounds: int, test_size: float, seed: int = 42) -> DataFrame:
    """Independent random splits: one 0/1 test column per round."""
    return df.withColumns({f"test_{i}": (uniform(key, seed + i) < test_size).cast("int") for i in range(rounds)})


def fit_standard(train: DataFrame, cols: Sequence[str], population: bool = True) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation per column of the training rows."""
    sd = F.stddev_pop if population else F.stddev_samp
    row = train.agg(*[f(c) for c in cols for f in (F.avg, sd)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}


def apply_standard(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / (s or 1.0) for c, (m, s) in params.items()})


def invert_standard(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * (s or 1.0) + m for c, (m, s) in params.items()})


def fit_min_max(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[f(c).cast("double") for c in cols for f in (F.min, F.max)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}


def apply_min_max(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Scale by the training range; other sets may leave [0, 1]."""
    return df.withColumns({c: (F.col(c) - lo) / ((hi - lo) or 1.0) for c, (lo, hi) in params.items()})


def add_powers(df: DataFrame, cols: Sequence[str], degree: int) -> DataFrame:
    return df.withColumns({f"{c}_{d}": F.pow(F.col(c), d) for c in cols for d in range(2, degree + 1)})


def encode(df: DataFrame, mappings: Mapping[str, Mapping]) -> DataFrame:
    """Replace values by their codes; unknown values become null."""
    for col, mapping in mappings.items():
        df = map_values(df, col, mapping, col)
    return df


def decode(df: DataFrame, mappings: Mapping[str, Mapping]) -> DataFrame:
    return encode(df, {c: {v: k for k, v in m.items()} for c, m in mappings.items()})


def parse_level(col: Column, special: Mapping[str, float]) -> Column:
    """Number in text, with named levels such as ``>20``; other text is null."""
    pairs = [F.lit(x) for k, v in special.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col.try_cast("double"))


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True) -> DataFrame:
    """0/1 column per level in alphabetical order."""
    for c in cols:
        levels = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect()]
        levels = sorted(levels)[1:] if drop_first else sorted(levels)
        df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in levels}).drop(c)
    return df


def binarize(df: DataFrame, label: str, positive, name: str = "label") -> DataFrame:
    return df.withColumn(name, (F.col(label) == positive).cast("int"))


def downsample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Equal class sizes: every class keeps as many rows as the smallest one, chosen by hash."""
    smallest = df.groupBy(label).agg(n_rows().alias("n")).agg(F.min("n").alias("n")).scalar()
    return hash_positions(df, key, seed, [label], "__pos").filter(F.col("__pos") <= smallest).drop("__pos")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows chosen by hash."""
    return hash_positions(df, key, seed, name="__pos").filter(F.col("__pos") <= n).drop("__pos")


def fit_rare(train: DataFrame, cols: Sequence[str], pct: float) -> DataFrame:
    """Codes (column, value, code) of the categories with at least ``pct`` of the rows.

    Codes are frequency ranks, ties by value. A column has at most 1 / pct of them.
    """
    need = F.lit(pct) * train.agg(n_rows().alias("n")).scalar()
    kept = value_counts(train, cols).filter((F.col("n") >= need) & F.col("value").isNotNull())
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return kept.select("column", "value", rank.alias("code"))


def apply_rare(df: DataFrame, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace categories by their training codes; rare and unseen ones become 0."""
    for c in cols:
        own = codes.filter(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias("__code"))
        df = (df.join(own, F.col(c).cast("string") == F.col("__v"), "left")
              .withColumn(c, F.coalesce("__code", F.lit(0))).drop("__v", "__code"))
    return df


TRANSFORMS = {"identity": lambda c: c, "log": lambda c: F.log(c + 1), "sqrt": F.sqrt, "cbrt": F.cbrt}


def best_transform(df: DataFrame, cols: Sequence[str], candidates: Mapping = TRANSFORMS) -> DataFrame:
    """Per column the transform with the smallest absolute skewness; one pass over the data."""
    pairs = [(c, n) for c in cols for n in candidates]
    one = df.agg(*[F.skewness(candidates[n](F.col(c).cast("double"))).alias(f"s{i}") for i, (c, n) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("transform"), F.col(f"s{i}").alias("skewness"))
                      for i, (c, n) in enumerate(pairs)])
    skews = one.select(F.explode(items).alias("s")).select("s.*")
    order = [F.round(F.abs("skewness"), 9), F.col("transform")]
    return first_per_key(skews, ["column"], order)
