"""Sum-of-squares online packing of token ids into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm.tables import small_batches
from lodestar.llm.token_ids import token_parts

WINDOW = 2048
#: Id that ends every document.
END = 1
#: Open windows that a task holds at most; at that number all are closed by cutting pieces.
OPEN = 8192
#: Rows of a batch of results.
ROWS = 10_000


@dataclass
class Piece:
    """A stretch of one document: its ids while its window is open."""

    doc: Doc
    start: int
    ids: np.ndarray


@dataclass
class Doc:
    """A document whose pieces are waiting for its length."""

    key: object
    tokens: int = 0
    complete: bool = False
    rows: list = field(default_factory=list)


class Levels:
    """Windows by fill level, and the level that each piece goes to.

    With n(h) windows filled to level h (0 < h < window), a piece of size s put
    into a window at level h changes the sum of squares of n by
    2 * (n(h + s) - n(h)) + 2, a new window by 2 * n(s) + 1, and a window that it
    fills by 1 - 2 * n(h). The least change wins; of equal ones the fullest window.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.windows: list[list[list]] = [[] for _ in range(window)]  # per level: windows, each a list of pieces
        self.open = 0

    def place(self, size: int) -> int:
        """Level of the window that takes a piece of ``size`` ids; 0 opens one."""
        n, w = self.counts, self.window
        change = 2 * (n[size:w + 1] - n[:w - size + 1]) + 2  # by level 0 to window - size; n[window] stays 0
        change[n[:w - size + 1] == 0] = np.iinfo(np.int64).max
        change[-1] -= n[w - size] > 0
        change[0] = 2 * n[size] + 1
        return w - size - int(np.argmin(change[::-1]))

    def put(self, piece) -> list | None:
        """Put a piece where it belongs; returns the window's pieces once they fill it."""
        size = len(piece.ids)
        level = self.place(size)
        if level:
            own = self.windows[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            own = []
        own.append(piece)
        if level + size == self.window:
            return own
        self.windows[level + size].append(own)
        self.counts[level + size] += 1
        self.open += 1
        return None

    def drain(self) -> list[tuple[int, list]]:
        """All open windows with their levels, the fullest first; none stay open."""
        out = [(level, own) for level in range(self.window - 1, 0, -1) for own in self.windows[level]]
        self.__init__(self.window)
        return out


def split(piece: Piece, at: int) -> tuple[Piece, Piece]:
    return Piece(piece.doc, piece.start, piece.ids[:at]), Piece(piece.doc, piece.start + at, piece.ids[at:])


def close(windows: list[tuple[int, list]], window: int = WINDOW) -> Iterator[list]:
    """Full windows from open ones: the emptiest give their pieces, cut where needed, to the fullest.

    What is left at the end, less than a window, is cut into powers of two.
    """
    left, right = 0, len(windows) - 1
    while left <= right:
        level, own = windows[left]
        while level < window and left < right:
            there, other = windows[right]
            piece = other.pop()
            if len(piece.ids) > window - level:
                piece, rest = split(piece, window - level)
                other.append(rest)
            own.append(piece)
            level += len(piece.ids)
            windows[right] = (there - len(piece.ids), other)
            if not other:
                right -= 1
        if level == window:
            yield own
        else:  # the last one
            size = window // 2
            while own:
                part, room = [], size
                if sum(len(p.ids) for p in own) >= size:
                    while room:
                        piece = own.pop(0)
                        if len(piece.ids) > room:
                            piece, rest = split(piece, room)
                            own.insert(0, rest)
                        part.append(piece)
                        room -= len(piece.ids)
                    yield part
                size //= 2
        left += 1


def pack_online(docs: DataFrame, vocabulary: str = "byte_bpe_50k", window: int = WINDOW, open_windows: int = OPEN,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of whole documents into sequences of at most ``window`` (a power of two) ids.

    A document is its ids and ``END``. Whole windows of a long document are
    sequences of their own; what is left goes, as it comes, into the fill level
    that minimises the sum of the squared counts of partially filled windows.
    Every scan partition packs its own rows, without a shuffle, and holds at most
    ``open_windows`` open windows; at that number, and at its end, they are closed
    by cutting pieces, so that only sequences of a power of two stay below
    ``window``, and none needs padding.

    Returns one row per piece: the id, ``start`` and ``length`` (in the document),
    ``ids_crc32`` (of its ids as little-endian 32-bit numbers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` (in the sequence). A null, empty or blank text
    has its own ids, if any, and the end mark; repeated rows and null ids are
    documents of their own; very long texts are encoded in runs; other columns are
    not read; an empty table gives no rows. Sequence numbers follow the scan's
    partitions: write the result once where it is read twice.
    """
    small_batches(docs.sparkSession)
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField("id", docs.schema[id_col].dataType),
                         *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens",
                                                                "sequence_id", "offset")]])

    def run(batches):
        levels, number, done = Levels(window), TaskContext.get().partitionId() << 32, []
        end = np.array([END], np.uint32)

        def emit(sequence):
            nonlocal number
            offset = 0
            for piece in sequence:
                doc, size = piece.doc, len(piece.ids)
                row = (piece.start, size, zlib.crc32(piece.ids.astype("<u4").tobytes()), number, offset)
                (done if doc.complete else doc.rows).append((doc, row))
                offset += size
            number += 1

        def flush():
            rows = [(doc.key, *row[:3], doc.tokens, *row[3:]) for doc, row in done]
            done.clear()
            columns = list(zip(*rows)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, keys.type if i == 0 else pa.int64()) for i, c in enumerate(columns)], schema.names)

        def close_all():
            for sequence in close(levels.drain(), window):
                emit(sequence)

        keys = None
        for batch in batches:
            keys = batch.column("id")
            doc, held = None, None
            for i, ids, last in token_parts(batch.column("text").cast(pa.string()), vocabulary):
                if doc is None:
                    doc, held = Doc(keys[i].as_py()), np.zeros(0, np.uint32)
                ids = np.concatenate([held, ids, end] if last else [held, ids])
                whole = len(ids) // window
                for k in range(whole):
                    emit([Piece(doc, doc.tokens + k * window, ids[k * window:(k + 1) * window])])
                doc.tokens += whole * window
                held = ids[whole * window:].copy()
                if last:
                    rest = Piece(doc, doc.tokens, held)
                    doc.tokens += len(held)
                    doc.complete = True
                    done.extend(doc.rows)
                    doc.rows = []
                    if len(held) and (full := levels.put(rest)):
                        emit(full)
                    if levels.open >= open_windows:
                        close_all()
                    if len(done) >= ROWS:
                        yield flush()
                    doc = None
        if keys is not None:
            close_all()
            yield flush()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
