"""Secret scans with a trigram index; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tables import written


def either_case(word: str) -> str:
    """Pattern for an ASCII word with letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap; group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_KEYS = "|".join([*(either_case(w) for w in ("password", "passwd", "secret", "token")),
                  either_case("api") + "_?" + either_case("key")])
#: The base rules in their order, then the formats of common services.
RULES = (
    Rule("assign", "(" + _KEYS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "sk_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)
#: Kind whose span is the header line of a PEM block, the end mark, and words of the block.
KEY_HEADER = "private_key"
KEY_END = "-----END [A-Z ]*PRIVATE KEY-----"
KEY_BEGIN = "-----BEGIN "
KEY_FIELD = "^(Proc-Type:|4,ENCRYPTED|DEK-Info:|[A-Z0-9-]+,[0-9A-Fa-f]+)$"
KEY_LINE, KEY_TAIL = "^[A-Za-z0-9+/]{16,}={0,2}$", "^([A-Za-z0-9+/]{4})*[A-Za-z0-9+/]{2}[A-Za-z0-9+/=]{2}$"
MOST_STRINGS = 16  # alternatives of one literal stretch, of one query


def _letters(members) -> set[str] | None:
    """Lower-cased characters of a small class; None for any other."""
    out: set[str] = set()
    for op, value in members:
        if str(op) == "LITERAL":
            out.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS else None


def _both(x: list[frozenset], y: list[frozenset]) -> list[frozenset]:
    joined = {a | b for a, b in product(x, y)}
    if len(joined) > MOST_STRINGS:  # the more selective half alone is still mandatory
        return max(x, y, key=lambda q: min(map(len, q)))
    return [q for q in joined if not any(p < q for p in joined)]


def _walk(nodes) -> list[frozenset]:
    query, run = [frozenset()], {""}

    def close() -> list[frozenset]:
        return _both(query, [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run])

    for op, value in nodes:
        kind = str(op)
        letters = ({chr(value).lower()} if kind == "LITERAL" else _letters(value) if kind == "IN" else None)
        if letters and len(run) * len(letters) <= MOST_STRINGS:
            run = {s + c for s in run for c in letters}
            continue
        query, run = close(), {""}
        if kind == "SUBPATTERN":
            query = _both(query, _walk(value[-1]))
        elif kind == "BRANCH":
            query = _both(query, [q for branch in value[1] for q in _walk(branch)])
        elif kind == "MAX_REPEAT" and value[0] > 0:
            query = _both(query, _walk(value[2]))
    return close()


def trigram_query(pattern: str) -> list[frozenset]:
    """Boolean trigram query of a pattern, as an OR of ANDs over lower-cased text.

    Every text with a match holds all trigrams of one of the sets. An empty set
    means that nothing is mandatory: the rule scans fully.
    """
    query = _walk(_parser.parse(pattern))
    return [frozenset()] if frozenset() in query else sorted(set(query), key=sorted)


def postings(docs: DataFrame, grams: Sequence[str], key: str = "key", text: str = "text") -> DataFrame:
    """Inverted index (gram number, key) of the lower-cased texts for the given trigrams."""
    low = docs.select(key, F.lower(text).alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])
    return low.select(key, F.explode(F.array_compact(held)).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], key: str = "key", text: str = "text") -> DataFrame:
    """(key, rules): numbers of the rules whose trigram query the text answers; full scans are not listed."""
    wanted = [(i, j, q) for i, rule in enumerate(rules)
              for j, q in enumerate(trigram_query(rule.pattern)) if q]
    grams = sorted({g for _, _, q in wanted for g in q})
    terms = ", ".join(f"({grams.index(g)}, {i}, {j}, {1 << k}L, {(1 << len(q)) - 1}L)"
                      for i, j, q in wanted for k, g in enumerate(sorted(q)))
    queries = docs.sparkSession.sql(f"select * from values {terms} as t(gram, rule, conj, bit, full)")
    answered = (postings(docs, grams, key, text).join(F.broadcast(queries), "gram")
                .groupBy(key, "rule", "conj").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full"))
                .filter("bits = full"))
    return answered.groupBy(key).agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, end, kind) of the rule's matches, from the texts between them."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    sizes = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(found, F.char_length).alias("size"), F.transform(value, F.char_length).alias("value"))
    one = "struct<start:int,rank:int,end:int,kind:string>"
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + x["size"]).alias("at"),
        F.when(x["value"] >= rule.least, F.array_append(s["out"], F.struct(
            (s["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"),
            (s["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind")))).otherwise(s["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out"))
    # the last gap has no match behind it
    whole = F.aggregate(F.filter(sizes, lambda x: x["size"].isNotNull()), start, step, lambda s: s["out"])
    return F.when(F.regexp_like(text, pattern), whole).otherwise(F.array().cast(f"array<{one}>"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rules: Sequence[Rule] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """Id as ``id``, the columns ``keep``, ``text`` (null: empty) and ``spans``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[F.col(c).alias(f"kept_{c}") for c in keep])
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    full = {i for i, rule in enumerate(rules) if frozenset() in trigram_query(rule.pattern)}
    if len(full) < len(rules):
        asked = written(candidates(rows.select("key", "text"), rules))
        rows = rows.join(asked, "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = [_spans(F.col("text"), rule, i) if i in full else
             F.when(F.array_contains("rules", i), _spans(F.col("text"), rule, i)).otherwise(nothing)
             for i, rule in enumerate(rules)]
    return rows.select("id", *[f"kept_{c}" for c in keep], "text",
                       F.array_sort(F.concat(*parts)).alias("spans"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: Sequence[Rule] = RULES) -> DataFrame:
    """Spans of all rules in whole texts.

    From each rule's regex a Boolean trigram query is derived; an inverted index
    of the trigrams that the rules ask for is built over all texts, postings are
    intersected per rule, and a rule runs only on its candidates. Rules without a
    mandatory trigram run on every text.

    Returns per input row the id and ``spans``: (start, rank, end, kind) in code
    points, end exclusive, sorted by start and then by the rules' order. Matches
    of one rule do not overlap; those of different rules may. A null or empty
    text has no spans; repeated rows are scanned each; null ids stay null; other
    columns are not read; an empty table gives none.
    """
    return with_spans(docs, id_col, text_col, rules).select(F.col("id").alias(id_col), "spans")


def _body_size(rest: Column) -> Column:
    """Characters of the key at the start of ``rest``, the text behind a header.

    Up to the end mark that comes before the next header; without one, the base64
    words (blanks and written-out line ends between) and the short one that ends them.
    """
    own = F.split(rest, KEY_BEGIN, 2)[0]
    parts = F.split(own, KEY_END, 2)
    words = F.split(F.regexp_replace(own, r"\\[nr]", "  "), r"\s", -1)
    start = F.struct(*[F.lit(0).alias(c) for c in ("at", "end", "state")])  # state: before, in, behind the body

    def step(s, x):
        size = F.char_length(x)
        line = (s["state"] < 2) & F.regexp_like(x, F.lit(KEY_LINE))
        tail = (s["state"] == 1) & F.regexp_like(x, F.lit(KEY_TAIL))
        skip = (size == 0) | ((s["state"] == 0) & F.regexp_like(x, F.lit(KEY_FIELD)))
        return F.struct(
            (s["at"] + size + 1).alias("at"), F.when(line | tail, s["at"] + size).otherwise(s["end"]).alias("end"),
            F.when(line, 1).when(skip, s["state"]).otherwise(2).alias("state"))

    open_ = F.aggregate(words, start, step, lambda s: s["end"])
    return F.when(F.size(parts) == 2, F.char_length(own) - F.char_length(parts[1])).otherwise(open_)


def with_key_bodies(text: Column, spans: Column) -> Column:
    """The spans, those of private-key headers drawn out over the key itself; starts and order stay."""
    def drawn(x):
        body = _body_size(F.substring(text, x["end"] + 1, F.char_length(text)))
        end = F.when(x["kind"] == KEY_HEADER, x["end"] + body).otherwise(x["end"])
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), end.alias("end"), x["kind"].alias("kind"))

    return F.when(F.exists(spans, lambda x: x["kind"] == KEY_HEADER), F.transform(spans, drawn)).otherwise(spans)


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """Text with the union of the spans replaced, one mask for each stretch of overlapping spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(
        x["end"].alias("at"),
        F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask)).alias("out"))).otherwise(
        F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))
    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
                  ).otherwise(text)


def listing(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
