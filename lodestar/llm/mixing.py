"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import free_name, maybe_broadcast, written
from lodestar.session import discard

MARGINS = ("source", "lang", "topic")
#: Largest error of a margin, as a share of all tokens, at which the fit has settled.
TOLERANCE = 1e-5
#: Rounds between two looks at the error, and looks that must halve it, or the targets count as contradictory.
ROUNDS, PATIENCE = 4, 2
#: Cells up to this number are fitted in one task, without shuffles between the steps; the result is the same.
SMALL = 100_000
#: Parts of the own shares that are mixed into targets until they no longer contradict each other; 1 always fits.
EASE = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Tempered target: a value's target share is proportional to its token share to this power.
TEMPER = 0.7
#: Share of all tokens that the sample holds in expectation.
BUDGET = 0.8
#: Decimals of a rate.
DIGITS = 5
UNKNOWN = "unknown"
WORD = r"[^\x20\x09-\x0D]+"

#: Topics, and the patterns in a text that name them, first match first.
TOPICS = (
    ("legal", "[Ll]icen[cs]e"),
    ("table", r" \| "),
    ("marked", "[#*$%&]{3}"),
    ("loud", "[A-Z]{2}[A-Z ,.!]{20}"),
)
PROSE = "prose"


def topic(text: Column, rules: Sequence[tuple[str, str]] = TOPICS) -> Column:
    """Name of the first pattern that a text holds, else ``prose``."""
    out = F.lit(PROSE)
    for name, pattern in reversed(rules):
        out = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(out)
    return out


def unit(column: Column) -> Column:
    """Number in [0, 1) from the MD5 of a value, the same on every machine."""
    digits = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              lang_col: str = "lang") -> DataFrame:
    """Id as ``id``, the margins and ``n_tokens`` (words) of each document."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit(UNKNOWN)).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), topic(text).alias("topic"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """(margin, target): tokens of each value to a power; only the proportions matter."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("own")).filter("own > 0")
    return own.select(margin, F.pow("own", F.lit(power)).alias("target"))


def reachable(cells: DataFrame, targets: dict[str, DataFrame], budget: float, ease: float = 0.0) -> DataFrame:
    """(margin, value, own, target, wanted): tokens, target share and the tokens that a sample of the budget shall hold.

    A value cannot give more tokens than it has: what its target share of the
    budget exceeds them by goes to the other values of the margin in proportion
    to their targets. A value that a target table does not list wants none.
    ``ease`` is the part of the own shares that is mixed into the target shares.
    """
    rows = None
    for m, target in targets.items():
        own = cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").cast("double").alias("own"))
        part = own.join(target.select(F.col(m).alias("value"), F.col("target").cast("double")), "value", "left").select(
            F.lit(m).alias("margin"), "value", "own", F.when(F.col("own") > 0, F.coalesce("target", F.lit(0.0))).otherwise(0.0).alias("target"))
        rows = part if rows is None else rows.unionByName(part)
    every = Window.partitionBy("margin")
    share = F.coalesce(F.try_divide("target", F.sum("target").over(every)), F.lit(0.0))
    eased = share if not ease else (1 - ease) * share + ease * F.try_divide("own", F.sum("own").over(every))
    rows = written(rows.select("margin", "value", "own", share.alias("asked"), eased.alias("target")))
    # per margin the largest scale at which no line of sum(least(own, scale * target)) passes the budget
    sums = {r.margin: r for r in rows.groupBy("margin").agg(F.sum("own").alias("own"), F.sum("target").alias("target")).collect()}
    scales = {m: budget * r.own / r.target if r.target else 0.0 for m, r in sums.items()}
    scale = lambda: F.element_at(F.create_map(*[F.lit(x) for kv in scales.items() for x in kv]), F.col("margin"))
    while scales:
        full = F.col("own") <= F.col("target") * scale()
        now = rows.groupBy("margin").agg(F.sum(F.when(full, F.col("own")).otherwise(0.0)).alias("spent"),
                                         F.sum(F.when(full, 0.0).otherwise(F.col("target"))).alias("rest")).collect()
        new = {r.margin: max(scales[r.margin], (budget * sums[r.margin].own - r.spent) / r.rest) if r.rest else scales[r.margin]
               for r in now}
        if all(v <= scales[m] * (1 + 1e-15) for m, v in new.items()):
            break
        scales = new
    wanted = F.least("own", F.col("target") * scale()) if scales else F.lit(0.0)
    return rows.select("margin", "value", "own", F.col("asked").alias("target"), wanted.alias("wanted"))


def _step(state: DataFrame, margin: str) -> DataFrame:
    """``state`` with the weights of each value of a margin scaled so that the kept tokens are those wanted.

    The kept tokens f = sum(least(tokens, scale * weight)) are the least of the
    lines that count the first cells by tokens / weight as kept whole, so the
    scale is the largest at which one of these lines reaches what is wanted.
    """
    value = Window.partitionBy(margin)
    order = value.orderBy("__full", *MARGINS)
    weight, wanted = F.col("weight"), F.col(f"t_{margin}")
    rest = F.sum(weight).over(order.rowsBetween(1, Window.unboundedFollowing))
    spent = F.sum(F.when(weight > 0, F.col("tokens")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = (state.withColumn("__full", F.when(weight > 0, F.col("tokens") / weight).otherwise(float("inf")))
             .withColumns({"__line": F.try_divide(wanted - spent, rest), "__all": F.try_divide(wanted, F.sum(weight).over(value))}))
    scale = F.greatest("__all", F.max("__line").over(value))
    return lines.withColumn("weight", weight * F.coalesce(scale, F.lit(0.0))).drop("__full", "__line", "__all")


def _error(state: DataFrame) -> float:
    """Largest gap between kept and wanted tokens over all values of all margins."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v"), F.col(f"t_{m}").alias("t")) for m in MARGINS]))
    gaps = (state.select(F.least("tokens", "weight").alias("kept"), cells.alias("x"))
            .groupBy("x.m", "x.v").agg(F.abs(F.sum("kept") - F.max("x.t")).alias("gap")))
    return float(gaps.agg(F.max("gap")).first()[0] or 0.0)


def rake(cells: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """``cells`` (margins, tokens) with ``rate``, the share of a cell's tokens to keep; None where the margins contradict each other.

    Tokens are raked to the wanted tokens of each margin in turn, no cell above
    its tokens, until all margins are met.
    """
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        own = wanted.filter(F.col("margin") == m).select(F.col("value").alias(m), F.col("wanted").alias(f"t_{m}"))
        state = state.join(own, m)
    state = written(state)
    size = state.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    total = size.tokens
    errors: list[float] = []
    while True:
        new = state.coalesce(1) if size.n <= SMALL else state
        for m in MARGINS * ROUNDS:
            new = _step(new, m)
        new = written(new)
        discard(state)
        state = new
        errors.append(_error(state))
        if errors[-1] <= TOLERANCE * total:
            kept = F.least(F.col("tokens").cast("double"), F.col("weight"))
            return state.select(*cells.columns, F.when(F.col("tokens") > 0, F.round(kept / F.col("tokens"), DIGITS))
                                .otherwise(0.0).alias("rate"))
        if len(errors) > PATIENCE and errors[-1] > 0.5 * errors[-1 - PATIENCE]:
            return None


def _rated(rows: DataFrame, targets: dict[str, DataFrame] | None, budget: float) -> tuple[DataFrame, DataFrame]:
    """(margins, tokens, rate) of the cells of ``rows``, and the ``reachable`` table that the rates meet."""
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    targets = targets or {m: tempered(cells, m) for m in MARGINS}
    for ease in EASE:
        wanted = written(reachable(cells, targets, budget, ease))
        rated = rake(cells, wanted)
        if rated is not None:
            return written(rated), wanted
    raise RuntimeError("raking did not settle")  # own shares are met by one rate for all


def shares(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
           text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(margin, value, target, reachable, reached): shares of the tokens that a value shall, can and is expected to have."""
    rows = described(docs.withColumn(free_name("__id", docs), F.lit(0)), docs.columns[0], text_col, source_col, lang_col)
    rated, wanted = _rated(written(rows), targets, budget)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS]))
    kept = (rated.select((F.col("tokens") * F.col("rate")).alias("kept"), cells.alias("x"))
            .groupBy("x.margin", "x.value").agg(F.sum("kept").alias("kept")))
    of = lambda c: F.try_divide(c, F.sum(c).over(Window.partitionBy("margin")))
    return wanted.join(kept, ["margin", "value"]).select(
        "margin", "value", "target", of("wanted").alias("reachable"), of("kept").alias("reached"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        lang_col: str = "lang") -> DataFrame:
    """Sample documents so that source, language and topic take their target shares of the tokens as far as these can be met.

    Tokens (words) are summed per (source, language, topic); iterative
    proportional fitting rakes the sums, none above a cell's tokens, to the
    ``reachable`` targets of the three margins (default: ``tempered``) until all
    are met. Where they contradict each other, the input's own shares are mixed
    into them by quarters (``EASE``), in the end entirely, which one rate for all
    documents meets. A document stays with its cell's rate, decided by a hash of
    its id; ``shares`` lists targets beside what can be and is reached.

    Returns per input row: the id, ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``rate`` and ``kept``. A null source or language is ``unknown``; a null or
    empty text is ``prose`` with no tokens and stays with its cell's rate (0 in a
    cell without tokens); rows with equal ids share one draw, and null ids share
    one too; other columns are not read; an empty table gives no rows.
    """
    rows = written(described(docs, id_col, text_col, source_col, lang_col))
    rated = maybe_broadcast(_rated(rows, targets, budget)[0].select(*MARGINS, "rate"))
    return rows.join(rated, list(MARGINS)).select(
        F.col("id").alias(id_col), *MARGINS, "n_tokens", "rate", (unit(F.col("id")) < F.col("rate")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns."""
    cells = described(docs, id_col, text_col, source_col, lang_col)
    names = {m: free_name(f"__{m}", docs) for m in MARGINS}
    rate = free_name("__rate", docs)
    rated = maybe_broadcast(_rated(cells, targets, budget)[0].select(
        *[F.col(m).alias(names[m]) for m in MARGINS], F.col("rate").alias(rate)))
    marked = docs.withColumns({
        names["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit(UNKNOWN)),
        names["lang"]: F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)),
        names["topic"]: topic(F.col(text_col).cast("string"))})
    return marked.join(rated, list(names.values())).filter(unit(F.col(id_col)) < F.col(rate)).select(*docs.columns)
