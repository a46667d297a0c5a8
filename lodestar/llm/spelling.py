"""Spelling variants: pairs of words one edit apart by composition of finite-state machines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import words
from lodestar.llm.runs import runs, strings
from lodestar.llm.tables import maybe_broadcast, small_batches, written
from lodestar.session import partitions

#: Bytes of text whose words are counted in one step.
SLICE = 4 << 20
#: Words that share an initial state; larger groups are parted further.
GROUP = 20_000
#: Words of one acceptor.
ACCEPTOR = 50_000
#: Words of more bytes are hashed one by one.
SHORT = 64

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def letters(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of A-Z, a-z and U+00C0 to U+00FF (0xC3 and the byte after it)."""
    out = _ASCII[data] | (data == 0xC3)
    out[1:] |= data[:-1] == 0xC3
    return out


def _apart(data: np.ndarray) -> np.ndarray:
    """Bytes before which a text may be cut without parting a word."""
    return (data < 0x80) & ~_ASCII[data]


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes after what the CRC ``before`` has read."""
    out = np.empty(len(starts), np.uint32)
    size = ends - starts
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(before[i]))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= SHORT]
    state, at = ~before[order], starts[order]
    long_enough = np.searchsorted(-size[order], -np.arange(SHORT + 2), side="right")
    for j in range(SHORT):
        n = long_enough[j + 1]
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def _counted(ids: list, texts: pa.Array, least: int, modulus: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of runs of letters of texts, with the planted deletions."""
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    for first, data, offsets, _ in runs(texts, _apart, SLICE):
        data = words._FOLD[data]
        inside = np.concatenate([[False], letters(data), [False]])
        begin = inside[1:-1] & ~inside[:-2]
        ends_ = inside[1:-1] & ~inside[2:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner] = inside[1:-1][inner]
        ends_[inner - 1] = inside[1:-1][inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(ends_) + 1
        leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
        size = ends - starts - (leads[ends] - leads[starts])  # code points
        keep = size >= least
        starts, ends, size = starts[keep], ends[keep], size[keep]
        doc = np.searchsorted(offsets, starts, side="right") - 1 + first
        h = crc32(data, starts, ends, seeds[doc])
        hit = h % np.uint32(modulus) == 0 if modulus else np.zeros(len(h), bool)
        cut = []
        for i in np.flatnonzero(hit & (size > least)).tolist():
            word = data[starts[i]:ends[i]].tobytes().decode()
            spot = int(h[i]) % len(word)
            cut.append(word[:spot] + word[spot + 1:])
        starts, ends = starts[~hit], ends[~hit]
        mask = np.zeros(len(data) + 1, np.int8)
        mask[starts] += 1
        mask[ends] -= 1
        whole = strings(data[np.cumsum(mask[:-1]) > 0], np.concatenate([[0], np.cumsum(ends - starts)]))
        found = pc.value_counts(pa.concat_arrays([whole, pa.array(cut, pa.string())]))
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame, least: int, modulus: int) -> DataFrame:
    """(word, n): words of ``least`` code points or more that occur twice or more."""

    def run(batches):
        for batch in batches:
            yield from _counted(batch.column("id").to_pylist(), batch.column("text").cast(pa.string()), least, modulus)

    return (docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter("n >= 2"))


def _regions(word: Column) -> Column:
    """First two regions of a word, as the shorter (or equal) and as the longer word of a pair.

    A pair belongs to the region lo <= i < hi of its first difference i, counted
    for a shorter word of ``short`` code points: both words agree before lo, and
    behind hi (one further in a longer word).
    """
    size = F.char_length(word)
    out = []
    for short in (size, size - 1):
        half = F.floor(short / 2).cast("int")
        for lo, hi in ((F.lit(0), half), (half, short + 1)):
            out.append(F.struct(short.alias("short"), lo.alias("lo"), hi.alias("hi")))
    return F.array(*out)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the beginning and end that all words of a group share, the part between, and whether a word is longer."""
    longer = (F.char_length("word") > F.col("short")).cast("int")
    return rows.withColumns({
        "longer": longer, "head": F.substring("word", F.lit(1), F.col("lo")),
        "tail": F.substring("word", F.col("hi") + longer + 1, F.char_length("word")),
        "part": F.substring("word", F.col("lo") + 1, F.col("hi") - F.col("lo") + longer),
    }).withColumn("group", F.xxhash64("short", "lo", "hi", "head", "tail"))


def _parted(vocab: DataFrame, most: int = GROUP) -> DataFrame:
    """Words by group; groups of more than ``most`` words are parted at the middle of their region.

    A region of one place is left whole: its words differ in one code point at
    one place, so that it has no more words than twice the alphabet.
    """
    rows = _placed(vocab.select("word", "n", F.explode(_regions(F.col("word"))).alias("at")).select("word", "n", "at.*"))
    ready = []
    while True:
        hot = written(rows.groupBy("group").count().filter(F.col("count") > most).select("group"))
        if hot.isEmpty():
            ready.append(rows)
            break
        hot = maybe_broadcast(hot)
        ready.append(rows.join(hot, "group", "left_anti"))
        large = rows.join(hot, "group", "left_semi")
        ready.append(large.filter("hi - lo = 1"))
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        rows = _placed(written(large.filter("hi - lo > 1").select("word", "n", "short", F.explode(halves).alias("at"))
                               .select("word", "n", "short", "at.*")))
    out = ready[0].select(*rows.columns)
    for part in ready[1:]:
        out = out.unionByName(part.select(*rows.columns))
    return out


class Acceptor:
    """Minimised acyclic acceptor; words are added in ascending order after an initial symbol of their own."""

    def __init__(self):
        self.steps: list[dict] = []  # per state: symbol -> state
        self.final: list[bool] = []
        self.known: dict = {}

    def _state(self, final: bool, steps: dict) -> int:
        key = (final, tuple(steps.items()))
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.steps)
            self.steps.append(steps)
            self.final.append(final)
        return state

    def initial(self, ascending: list[str]) -> int:
        """State that accepts exactly the given words; equal ends are shared with all words before."""
        path = [[False, {}]]  # open states along the last word
        last = ""
        for word in ascending:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._fold(path, last, same)
            path += [[False, {}] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._fold(path, last, 0)
        return self._state(*path[0])

    def _fold(self, path: list, word: str, depth: int) -> None:
        while len(path) > depth + 1:
            final, steps = path.pop()
            path[-1][1][word[len(path) - 1]] = self._state(final, steps)

    def common(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """Strings that both states accept and that do not start with ``but``."""
        path: list[str] = []
        stack = [(p, q, 0, "")]
        while stack:
            p, q, depth, symbol = stack.pop()
            if depth:
                del path[depth - 1:]
                path.append(symbol)
            if self.final[p] and self.final[q]:
                yield "".join(path)
            a, b = self.steps[p], self.steps[q]
            for symbol in a if len(a) <= len(b) else b:
                if symbol in a and symbol in b and (depth or symbol != but):
                    stack.append((a[symbol], b[symbol], depth + 1, symbol))

    def composed(self, p: int, q: int) -> Iterator[tuple[str, str]]:
        """Pairs that the acceptor, one edit and the acceptor accept from two initial states.

        Before the edit both sides read the same symbols. From equal states the
        edit replaces a symbol (each unordered pair once); from the states of
        shorter words (p) and longer words (q) it inserts one, at the last
        possible place. After the edit both sides read the same symbols again.
        """
        path: list[str] = []
        stack = [(p, q, 0, "")]
        replace = p == q
        while stack:
            p, q, depth, symbol = stack.pop()
            if depth:
                del path[depth - 1:]
                path.append(symbol)
            a, b = self.steps[p], self.steps[q]
            if replace:
                if len(a) > 1:
                    symbols = list(a)
                    for i, c in enumerate(symbols):
                        for d in symbols[i + 1:]:
                            for rest in self.common(a[c], a[d]):
                                before = "".join(path)
                                yield before + c + rest, before + d + rest
            else:
                for d, state in b.items():
                    for rest in self.common(p, state, but=d):
                        before = "".join(path)
                        yield before + rest, before + d + rest
            for c in a:
                if c in b:
                    stack.append((a[c], b[c], depth + 1, c))


def _pairs(groups: list[tuple[bool, list[tuple]]]) -> Iterator[tuple]:
    """(a, n of a, b, n of b) for near words of groups of rows (part, longer, head, tail, n).

    Each group says whether its region reaches the end of the words; where it
    does not, a symbol inserted behind the region is left to the next one.
    """
    acceptor, found = Acceptor(), {}
    starts = []
    for _, rows in groups:
        same = [r[0] for r in rows if not r[1]]
        longer = [r[0] for r in rows if r[1]]
        starts.append((acceptor.initial(same), acceptor.initial(longer) if longer else None))
    for (at_end, rows), (p, q) in zip(groups, starts):
        if (p, q) not in found:
            found[p, q] = [*acceptor.composed(p, p), *(() if q is None else acceptor.composed(p, q))]
        if found[p, q]:
            (_, _, head, tail, _), n = rows[0], {r[0]: r[4] for r in rows}
            for a, b in found[p, q]:
                if at_end or len(a) == len(b) or not b.startswith(a):
                    yield head + a + tail, n[a], head + b + tail, n[b]


def near_pairs(vocab: DataFrame, most: int = GROUP) -> DataFrame:
    """(a, a_n, b, b_n): unordered pairs of words that differ by one inserted, deleted or replaced code point, once each."""
    columns = ["part", "longer", "head", "tail", "n"]
    key = ["short", "lo", "hi", "head", "tail"]

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("short", "lo", "hi", *columns)])

        def answer(groups):
            out = list(zip(*_pairs(groups))) or [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64()) * 2)], ["a", "a_n", "b", "b_n"])

        groups, n = [], 0
        for (short, _, hi, _, _), own in groupby(rows(), key=lambda r: (r[0], r[1], r[2], r[5], r[6])):
            own = [r[3:] for r in own]
            if len(own) > 1 and not own[0][1]:  # one shorter word at least
                groups.append((hi > short, own))
                n += len(own)
                if n >= ACCEPTOR:
                    yield answer(groups)
                    groups, n = [], 0
        yield answer(groups)

    dealt = _parted(vocab, most).repartition(partitions(vocab), "group").sortWithinPartitions(
        "group", *key, "longer", "part")
    return dealt.select("short", "lo", "hi", *columns).mapInArrow(run, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a forest (word, form): the end of each word's chain, by doubling steps."""
    state = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(state.join(ahead, "root", "left"))
        state = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next is not null").isEmpty():
            return state


def spelling_variants(docs: DataFrame, least: int = 7, ratio: int = 10, modulus: int = 31, most: int = GROUP,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with the more frequent form that each may be a variant of.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where
    ``modulus`` divides the CRC-32 h of ``<id>:<word>``, the code point h % length
    is taken out (0: never). Kept are words of ``least`` code points or more that
    occur twice or more. Near words differ by one inserted, deleted or replaced
    code point. A word's form is its most frequent near word (ties: the least in
    code-point order) that occurs at least ``ratio`` times as often.

    The vocabulary is parted by the beginning or the end that two near words must
    share, so that every group starts at a state of its own in a minimised
    acceptor; the acceptor, a one-edit transducer and the acceptor again are
    composed from there. Groups of more than ``most`` words are parted further.

    Returns (word, form, root, n, n_near, form_n): ``root`` is the end of the
    chain of forms, the word itself without one; without near words ``n_near`` is
    0 and ``form`` null. Null, empty or blank texts have no words; a null id reads
    as an empty string; repeated rows count each; very long texts are read in
    runs, very long words whole; other columns are not read; an empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    vocab = written(vocabulary(texts, least, modulus))
    pairs = written(near_pairs(vocab, most))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"),
                                          F.col("a_n").alias("b_n")))
    near = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.when(F.col("b_n") >= ratio * F.col("a_n"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("form"))))
        .alias("best"))
    near = written(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))
    chains = roots(near.filter("form is not null"))
    return (vocab.join(near, "word", "left").join(chains, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
