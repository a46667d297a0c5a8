"""Quality rules under weak supervision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm import words
from lodestar.llm.tables import small_batches, written

LINES = words.table([0x0A])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters",
          "n_stops")


def _bytes(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode())] = True
    return out


_SYMBOLS, _STOPS = _bytes("#*$%&|<>"), _bytes(".!?")
_CAPITALS = _bytes("".join(map(chr, range(65, 91))))
_LETTERS = _CAPITALS | _bytes("".join(map(chr, range(97, 123))))
_LETTERS[0xC0:] = True  # first bytes of letters beyond ASCII
_POINTS = np.ones(256, bool)  # every byte that begins a code point
_POINTS[0x80:0xC0] = False


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks in order of the keys: equal to another of its text, equal to an earlier one of its text."""
    keys = words.mix(keys + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return shared, later


def measures(texts) -> dict[str, np.ndarray]:
    """The counts ``COUNTS`` of each text of a string array."""
    cut = words.cut(texts)
    hashes, doc, data = cut.hashes(), cut.doc_of(), cut.data
    blank = _per_text(~words.BLANKS[data], cut.offsets)
    inside = words.window_starts(cut.bounds, 3)
    at = np.flatnonzero(inside)
    repeats = at[_again(words.windows(hashes, 3)[at], doc[at])[0]]
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[repeats + j] = True
    lines = words.cut(texts, LINES)
    full = np.searchsorted(cut.starts, lines.starts) < np.searchsorted(cut.starts, lines.ends)
    line_doc = lines.doc_of()[full]
    later = _again(lines.hashes()[full], line_doc)[1]
    n = len(cut.offsets) - 1
    return {
        "n_words": cut.counts(),
        "word_chars": _per_text(_POINTS[data], cut.offsets) - blank,
        "n_symbols": _per_text(_SYMBOLS[data], cut.offsets),
        "n_dup_lines": np.bincount(line_doc[later], minlength=n),
        "n_repeat_words": _per_text(covered, cut.bounds),
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_capitals": _per_text(_CAPITALS[data], cut.offsets),
        "n_letters": _per_text(_LETTERS[data], cut.offsets),
        "n_stops": _per_text(_STOPS[data[cut.ends - 1]], cut.bounds),
    }


#: Rules over ``COUNTS``: (name, votes for bad, votes for good); a rule abstains where neither holds.
RULES = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words",
     "word_chars >= 4 * n_words and word_chars <= 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("symbol_chars", "100 * n_symbols > 2 * word_chars", "200 * n_symbols <= word_chars"),
    ("letters", "100 * n_letters < 85 * word_chars", "100 * n_letters >= 93 * word_chars"),
    ("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    ("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    ("capitals", "10 * n_capitals > 3 * n_letters", "5 * n_capitals <= n_letters"),
    ("sentences", "300 * n_stops < n_words or 2 * n_stops > n_words",
     "50 * n_stops >= n_words and 3 * n_stops <= n_words"),
)
#: What is expected of a rule before any vote is counted: shares of (bad, abstains, good) votes on good and on bad
#: texts. It weighs as much as PRIOR_WEIGHT of all texts, at any corpus size.
PRIOR = np.array([[0.05, 0.25, 0.7], [0.5, 0.3, 0.2]])
PRIOR_WEIGHT, PRIOR_GOOD = 0.05, 0.7
ROUNDS, TOLERANCE = 1_000, 1e-10


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how often each occurs.

    Given the class, rules vote or abstain independently. Returns the vote
    shares (class good, bad; vote -1, 0, 1; rule), from which a rule's accuracy
    on a class follows, the share of good texts, and each pattern's posterior
    probability of being good.
    """
    cast = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    weight = PRIOR_WEIGHT * counts.sum()
    shares = np.repeat(PRIOR[:, :, None], votes.shape[1], axis=2)
    good, share = np.full(len(votes), PRIOR_GOOD), PRIOR_GOOD
    for _ in range(ROUNDS):
        like = np.einsum("vpr,cvr->cp", cast, np.log(shares))
        new = 1 / (1 + np.exp(np.clip(np.log(1 - share) - np.log(share) + like[1] - like[0], -700, 700)))
        moved, good = np.max(np.abs(new - good), initial=0.0), new
        for c, w in enumerate((counts * good, counts * (1 - good))):
            shares[c] = (np.einsum("p,vpr->vr", w, cast) + weight * PRIOR[c][:, None]) / max(w.sum() + weight, 1e-12)
        share = float((counts @ good + 1) / (counts.sum() + 2))
        if moved < TOLERANCE:
            break
    return shares, share, good


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Posterior probability that a text is good, from rules that vote or abstain.

    The counts ``COUNTS`` of every whole text decide each rule's vote. How often
    each vote pattern occurs is counted over all texts (at most 3 ** rules
    patterns), expectation-maximisation estimates the rules' accuracies on good
    and on bad texts, and each text gets its pattern's posterior.

    Words are ``[^\\x20\\x09-\\x0D]+``. Returns per input row: the id, ``COUNTS``,
    ``votes`` (name to vote) and ``posterior``. A null, empty or blank text has
    zero counts and is voted on like any other; repeated rows count each; null ids
    stay null; other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in words.slices(batch, "text"):
                found = measures(piece.column("text"))
                yield pa.record_batch([piece.column("id"), *[pa.array(found[c], pa.int64()) for c in COUNTS]],
                                      names=["id", *COUNTS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *[StructField(c, LongType()) for c in COUNTS]])
    ballots = [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, bad, good in rules]
    code = sum(((b + 1) * 3 ** i for i, b in enumerate(ballots)), F.lit(0))
    counted = written(rows.mapInArrow(run, schema).withColumn("pattern", code))
    seen = counted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    codes = np.array([r.pattern for r in seen], np.int64)
    votes = codes[:, None] // 3 ** np.arange(len(rules)) % 3 - 1
    _, _, good = estimate(votes, np.array([r.n for r in seen], float))
    known = docs.sparkSession.createDataFrame(
        list(zip(codes.tolist(), good.tolist())), "pattern int, posterior double")
    named = F.create_map(*[x for (name, _, _), b in zip(rules, ballots) for x in (F.lit(name), b)])
    return counted.join(F.broadcast(known), "pattern").select(
        F.col("id").alias(id_col), *COUNTS, named.alias("votes"), "posterior")
