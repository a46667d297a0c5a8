"""Toxicity scores from gradient-boosted trees over dense text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lodestar.llm import words
from lodestar.llm.repeats import members
from lodestar.llm.tables import maybe_broadcast, small_batches, written

#: Most labelled texts that are learned from, in expectation, per class.
TOXIC_TEXTS, CLEAN_TEXTS = 4_000, 8_000
#: Most lexicon terms, the ones with the strongest evidence.
TERMS = 5_000
LEAST_RATIO, LEAST_TEXTS, LEAST_SHARE = 8.0, 3, 0.004
PARTS = 4  # folds of the labelled texts; the last one calibrates
STEMS = (4, 5, 6)  # bytes
NEAR = 5  # words between a lexicon word and a second person
#: Second-person words of the corpus languages.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta vous votre "
                 "tú ti usted ustedes vosotros")
#: Signs that stand for letters.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ("density", "weight", "strongest", "hits", "kinds", "second_person", "near_second_person", "capitals",
            "shouted", "punctuation", "exclamations", "disguised", "masked", "stretched", "length")

_PLAIN = words.PLAIN
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_DISGUISED = _FOLD.copy()
for _sign, _letter in DISGUISE.items():
    _DISGUISED[ord(_sign)] = ord(_letter)
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) < 91)
_ASCII_LETTER = _CAPITAL | ((np.arange(256) >= 97) & (np.arange(256) < 123))
_POINT = ~((np.arange(256) & 0xC0) == 0x80)
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"'(),-.:;?[]{}")] = True


@dataclass
class Lexicon:
    terms: np.ndarray  # sorted hashes of words and stems
    weights: np.ndarray

    def weigh(self, terms: list[np.ndarray]) -> np.ndarray:
        """Largest weight of any term of each word; 0 where none is listed."""
        out = np.zeros(len(terms[0]))
        if len(self.terms):
            for values in terms:
                at = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
                out = np.maximum(out, np.where(self.terms[at] == values, self.weights[at], 0.0))
        return out


def _terms(cut: words.Words) -> list[np.ndarray]:
    """Hashes of each word and of its stems; the word itself in place of a stem that is not shorter."""
    whole = cut.hashes()
    size = cut.ends - cut.starts
    return [whole, *(np.where(size > k, cut.hashes(k) + np.uint64(k), whole) for k in STEMS)]


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


_YOU = np.unique(words.cut(pa.array([SECOND_PERSON]), _PLAIN, True).hashes())


def features(texts, lexicon: Lexicon) -> np.ndarray:
    """The dense ``FEATURES`` of each text."""
    cut = words.cut(texts, _PLAIN, True)
    data, offsets, n = cut.data, cut.offsets, len(cut.offsets) - 1
    count = np.maximum(cut.counts(), 1)
    terms = _terms(cut)
    weight = lexicon.weigh(terms)
    hit = weight > 0
    doc = cut.doc_of()
    strongest = np.zeros(n)
    np.maximum.at(strongest, doc[hit], weight[hit])
    kinds = np.bincount(np.unique(np.stack([doc[hit].astype(np.uint64), terms[0][hit]]), axis=1)[0].astype(np.int64),
                        minlength=n)
    you = members(terms[0], _YOU)
    near = np.zeros(len(hit), bool)
    for step in range(1, NEAR + 1):
        near[step:] |= you[:-step] & (doc[step:] == doc[:-step])
        near[:-step] |= you[step:] & (doc[step:] == doc[:-step])
    masked = words.cut(texts, _PLAIN, _DISGUISED)
    disguised = _sum(lexicon.weigh(_terms(masked)) > 0, masked.bounds) - _sum(hit, cut.bounds)
    letter, capital = _ASCII_LETTER[data], _CAPITAL[data]
    star = data == ord("*")
    hidden = np.zeros(len(data), bool)
    hidden[1:-1] = star[1:-1] & (letter[:-2] | star[:-2]) & (letter[2:] | star[2:]) if len(data) > 2 else False
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & letter[2:]
    shout = np.zeros(len(data) + 1, np.int64)
    np.cumsum(capital, out=shout[1:])
    size = cut.ends - cut.starts
    loud = (shout[cut.ends] - shout[cut.starts] == size) & (size > 1)
    chars, letters = np.maximum(_sum(_POINT[data], offsets), 1), np.maximum(_sum(letter, offsets), 1)
    per_word = lambda values: 100 * _sum(values, cut.bounds) / count
    return np.column_stack([
        per_word(hit), per_word(weight), strongest, np.log1p(_sum(hit, cut.bounds)), kinds, per_word(you),
        per_word(hit & near), 100 * _sum(capital, offsets) / letters, per_word(loud),
        100 * _sum(_MARK[data], offsets) / chars, 100 * _sum(data == ord("!"), offsets) / chars,
        100 * np.maximum(disguised, 0) / count, 100 * _sum(hidden, offsets) / chars,
        100 * _sum(triple, offsets) / chars, np.log1p(cut.counts())])


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, part, toxic, clean): in how many texts of each part and class a word or stem stands."""

    def count(batches):
        seen: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for piece in words.slices(batch, "text"):
                cut = words.cut(piece.column("text"), _PLAIN, True)
                terms = _terms(cut)
                label, part = piece.column("label").to_pylist(), piece.column("part").to_pylist()
                for i, (a, b) in enumerate(zip(cut.bounds[:-1], cut.bounds[1:])):
                    if b > a:
                        seen.setdefault((part[i], label[i]), []).append(np.unique(np.concatenate([t[a:b] for t in terms])))
        for (part, label), found in seen.items():
            term, n = np.unique(np.concatenate(found), return_counts=True)
            full = pa.array(n, pa.int64())
            none = pa.array(np.zeros(len(n), np.int64))
            yield pa.record_batch([pa.array(term.view(np.int64)), pa.array([part] * len(n), pa.int32()),
                                   full if label else none, none if label else full],
                                  names=["term", "part", "toxic", "clean"])

    return (labelled.select("text", "label", "part").mapInArrow(count, "term long, part int, toxic long, clean long")
            .groupBy("term", "part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def lexicons(labelled: DataFrame, sizes: dict[tuple[int, int], int]) -> dict[int | None, Lexicon]:
    """Lexicon learned without each part, and (under None) from all; ``sizes`` counts texts by (part, label)."""
    counts = term_counts(labelled).groupBy("term").agg(
        *[F.sum(F.when(F.col("part") != p, F.col(c)).otherwise(0)).alias(f"{c}_{p}")
          for p in range(PARTS) for c in ("toxic", "clean")],
        F.sum("toxic").alias("toxic_all"), F.sum("clean").alias("clean_all"))
    kept, chosen = {}, []
    for key in [*range(PARTS), None]:
        total = {c: sum(n for (p, label), n in sizes.items() if label == c and p != key) for c in (0, 1)}
        name = "all" if key is None else str(key)
        t, c = F.col(f"toxic_{name}"), F.col(f"clean_{name}")
        weight = F.log((t + 0.5) / (total[1] + 1.0)) - F.log((c + 0.5) / (total[0] + 1.0))
        enough = (t >= max(LEAST_TEXTS, LEAST_SHARE * total[1])) & (weight >= float(np.log(LEAST_RATIO)))
        kept[key] = f"w_{name}"
        chosen.append(F.when(enough, weight).alias(f"w_{name}"))
    listed = (counts.select("term", "toxic_all", *chosen)
              .filter(" or ".join(f"{w} is not null" for w in kept.values()))
              .orderBy(F.desc(F.greatest(*kept.values()) * F.log1p("toxic_all")), "term").limit(TERMS))
    rows = listed.collect()
    out = {}
    for key, w in kept.items():
        own = sorted((np.uint64(r.term & (2 ** 64 - 1)), r[w]) for r in rows if r[w] is not None)
        out[key] = Lexicon(np.array([t for t, _ in own], np.uint64), np.array([x for _, x in own], float))
    return out


def with_features(rows: DataFrame, chosen: dict[int | None, Lexicon], keep: list[str], part: bool) -> DataFrame:
    """``keep`` and the array ``features``; with ``part``, by the lexicon learned without the row's part."""
    columns = [*keep, "part"] if part else keep
    fields = [StructField(c, rows.schema[c].dataType) for c in keep]

    def run(batches):
        for batch in batches:
            for piece in words.slices(batch, "text"):
                if part:
                    own = np.array(piece.column("part").to_pylist())
                    found = np.zeros((len(own), len(FEATURES)))
                    for p in np.unique(own):
                        at = np.flatnonzero(own == p)
                        found[at] = features(piece.column("text").take(pa.array(at)), chosen[int(p)])
                else:
                    found = features(piece.column("text"), chosen[None])
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(found.ravel()))
                yield pa.record_batch([*[piece.column(c) for c in keep], values], names=[*keep, "features"])

    return rows.select(*dict.fromkeys([*columns, "text"])).mapInArrow(
        run, StructType([*fields, StructField("features", ArrayType(DoubleType()))]))


@dataclass
class Toxicity:
    """A fitted scorer; ``trees`` is None when the labels had one class only, and ``base`` is the score then."""

    lexicon: Lexicon
    trees: Model | None
    calibration: Model | None
    base: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=(),
              name: str = "score") -> DataFrame:
        """Toxicity of each whole text.

        Returns per input row: the id, the columns ``keep`` and ``score`` (0 to 1,
        under ``name``). A null, empty or wordless text has all-zero features and
        is scored like any other; repeated rows are scored each; null ids stay
        null; other columns are not read; an empty table gives no rows.
        """
        small_batches(docs.sparkSession)
        others = [c for c in keep if c != text_col]
        rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{c}") for c in others],
                           F.col(text_col).cast("string").alias("text"))
        held = with_features(rows, {None: self.lexicon},
                             ["id", *[f"kept_{c}" for c in others], *(["text"] if text_col in keep else [])], part=False)
        return _scored(held, self).select(
            F.col("id").alias(id_col), *[F.col("text" if c == text_col else f"kept_{c}").alias(c) for c in keep],
            F.col("score").alias(name))


def _margin(rows: DataFrame, trees: Model) -> DataFrame:
    return (trees.transform(rows.withColumn("vector", array_to_vector("features")))
            .withColumn("margin", vector_to_array("probability")[1])
            .drop("vector", "probability", "rawPrediction", "prediction"))


def _scored(rows: DataFrame, model: Toxicity) -> DataFrame:
    if model.trees is None:
        return rows.withColumn("score", F.lit(model.base))
    out = _margin(rows, model.trees)
    calibrated: Column = F.col("margin")
    if model.calibration is not None:
        out = model.calibration.transform(out)
        # a hundredth of the margin keeps the order inside a step of the isotonic fit
        calibrated = 0.99 * F.col("calibrated") + 0.01 * F.col("margin")
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), calibrated)))


def sample(labels: DataFrame, label_col: str, toxic: int = TOXIC_TEXTS, clean: int = CLEAN_TEXTS,
           id_col: str = "doc_id") -> DataFrame:
    """Ids to learn from (id, label, weight): at most ``toxic`` and ``clean`` of each class in expectation.

    Picked by a hash of the id; weight is how many labelled ids one stands for.
    An id with several labels has the largest; null labels and ids are left out.
    """
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    n = dict(known.groupBy("label").count().collect())  # one row per class
    rate = {1: min(1.0, toxic / max(1, n.get(1, 0))), 0: min(1.0, clean / max(1, n.get(0, 0)))}
    share = F.when(F.col("label") == 1, rate[1]).otherwise(rate[0])
    return known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000 < share).withColumn("weight", 1 / share)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text") -> Toxicity:
    """Learn a scorer from the labelled texts.

    A lexicon of words and stems that are much commoner in toxic texts is
    learned by log-odds; each of ``PARTS`` parts of the texts gets its features
    from a lexicon learned without it, so the trees see honest densities. The
    last part is kept from the trees and calibrates them by isotonic regression.
    """
    small_batches(docs.sparkSession)
    picked = written(sample(labels, label_col, id_col=id_col))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = written(texts.join(maybe_broadcast(picked), "id").withColumn(
        "part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")))
    sizes = {(r.part, r.label): r["count"] for r in labelled.groupBy("part", "label").count().collect()}
    total = {c: sum(n for (_, label), n in sizes.items() if label == c) for c in (0, 1)}
    chosen = lexicons(labelled, sizes)
    base = total[1] / max(1, total[0] + total[1])
    rows = written(with_features(labelled, chosen, ["label", "weight", "part"], part=True))
    fitted = [sum(n for (p, label), n in sizes.items() if label == c and p < PARTS - 1) for c in (0, 1)]
    if not min(fitted):
        return Toxicity(chosen[None], None, None, base)
    learn = rows.filter(F.col("part") < PARTS - 1).withColumn("vector", array_to_vector("features"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxDepth=3, maxIter=20,
                          stepSize=0.2, minInstancesPerNode=3, seed=7).fit(learn)
    rest = _margin(rows.filter(F.col("part") == PARTS - 1), trees).withColumn("label", F.col("label").cast("double"))
    calibration = None
    if min(sizes.get((PARTS - 1, c), 0) for c in (0, 1)) >= 5:
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight",
                                         predictionCol="calibrated").fit(rest)
    return Toxicity(chosen[None], trees, calibration, base)
