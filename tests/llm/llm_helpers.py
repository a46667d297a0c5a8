"""Awkward rows and plain-Python reference helpers."""

import re

BLANK_WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def blank_words(text):
    return BLANK_WORD.findall(text or "")


PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees and count "
         "every falling leaf until the moon climbs above the silent hills where shepherds sing of distant rivers "
         "bright lanterns and the long road home that winds through meadows full of clover and drifting mist")
OTHER = ("morning markets open slowly as bakers carry warm bread past sleepy doorways and children chase pigeons "
         "between stalls of copper kettles painted fans dried figs and paper kites that tug at their strings "
         "whenever the harbour wind wakes and salt settles on the windows of every narrow house")

AWKWARD = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE.upper() + "  \n", "en", "a"),
    (4, OTHER, "en", "b"), (5, OTHER.replace("paper kites", "paper planes"), None, "b"),
    (6, None, "en", "b"), (7, "", None, None), (8, " \t\r\n\x0b\x0c ", "de", None),
    (9, "one two", "en", "c"), (10, "one two", "en", "c"), (11, "ONE two three four", "en", "c"),
    (12, "Übergrößen äöü ß ñandú 日本語 \U0001F600 end", "de", "c"),
    (13, "\n".join(["same line here"] * 5 + ["", "other"]), "en", "c"),
    (14, (PROSE + " ") * 60, "en", "d"),
    (15, "x" * 100_000 + " " + "ab " * 3_000, "en", "d"),
    (None, OTHER, "en", "b"), (None, "alone with no id", "en", "b"),
    (16, "a\x1cb\x85c\xa0d e", "fr", "d"),
    (4, OTHER, "en", "b"),
]


def tuples(df, *columns):
    """Rows as a sorted list of tuples, nulls last."""
    rows = [tuple(r) for r in df.select(*columns or df.columns).collect()]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
