"""Best-fit decreasing packing into windows, with a segment tree over remaining capacities.

Each task tokenises its own documents and packs them where they are: there is no
shuffle, no count and nothing staged.  A document longer than a window is first
cut into full windows, which are sequences of their own.  What remains of each
document is held until ``HELD`` remainders have come together (or the task's
input ends), and then placed:

1. longest first, each in the open window with the least capacity that still
   takes it; :class:`Capacities` finds that window in a number of steps that is
   the logarithm of the window's length;
2. documents may be cut, so gaps need not stay: the emptiest open windows are
   emptied into the gaps of the fullest (:func:`closed`), one cut a gap at most;
3. the one window that is left short is cut into lengths that are powers of two,
   which need no padding.

So nothing is padded, whatever the tables' partitions, and a piece is cut only
to fill a gap.  A task holds the ids of ``HELD`` remainders, each shorter than a
window, and of one document.

Defined results: a null or empty text is one piece of just the end id; repeated
rows, ties and null ids give their own pieces (of equal lengths the first read is
placed first); other columns, also of clashing names, are ignored; an empty table
gives no rows.  A very long text is one row: its ids, 4 bytes each, are held
whole in one task.  Numbers of sequences carry the number of the task's
partition, so they repeat where rows come back in the same partitions; stage an
input whose own order can change.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larder.llm.common import arrow_batches, text_of
from larder.llm.packing import _WORKER, END, WordIds, default_tokenizer
from larder.llm.words import parts

WINDOW = 1024
#: Remainders that are packed together: at most 4 KB of ids each.
HELD = 16_384
#: Pieces of an output batch, about.
OUT_ROWS = 20_000

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([pa.field(f.split()[0], pa.int64()) for f in PLACED.split(", ")])

#: A part of a remainder: (number of the remainder, first id, end).
Part = tuple[int, int, int]


class Capacities:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, at: int) -> None:
        self.windows[capacity].append(at)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that some window has, else -1."""
        count, node = self.count, least + self.leaves
        while not count[node]:
            # up until a right neighbour covers the next larger capacities
            while node & 1:
                node >>= 1
            if not node:
                return -1
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.leaves

    def take(self, capacity: int) -> int:
        node = capacity + self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.windows[capacity].pop()


def best_fit(lengths: Sequence[int], window: int) -> list[list[Part]]:
    """The windows' parts; the remainders are offered longest first."""
    opened, placed = Capacities(window), []
    for i in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable").tolist():
        n = lengths[i]
        capacity = opened.tightest(n)
        if capacity < 0:
            capacity, at = window, len(placed)
            placed.append([])
        else:
            at = opened.take(capacity)
        placed[at].append((i, 0, n))
        if capacity > n:
            opened.add(capacity - n, at)
    return placed


def split(of: list[Part], at: int) -> tuple[list[Part], list[Part]]:
    """The parts before and after the first ``at`` ids."""
    left: list[Part] = []
    for k, (i, lo, hi) in enumerate(of):
        if hi - lo > at:
            cut = [(i, lo, lo + at)] if at else []
            return left + cut, [(i, lo + at, hi), *of[k + 1 :]]
        left.append((i, lo, hi))
        at -= hi - lo
    return left, []


def filled(of: list[Part]) -> int:
    return sum(hi - lo for _, lo, hi in of)


def closed(placed: list[list[Part]], window: int) -> list[list[Part]]:
    """The same ids without windows that need padding."""
    done, short = [], []
    for of in placed:
        n = filled(of)
        (done if n == window or n & (n - 1) == 0 else short).append(of)
    short.sort(key=filled)
    while len(short) > 1:
        gap = window - filled(short[-1])
        moved, rest = split(short[0], gap)
        short[-1] = short[-1] + moved
        if rest:
            short[0] = rest
            done.append(short.pop())
            continue
        short.pop(0)
        if filled(short[-1]) == window:
            done.append(short.pop())
    for of in short:
        n = filled(of)
        while n:
            first, of = split(of, 1 << (n.bit_length() - 1))
            done.append(first)
            n = filled(of)
    return done


def packed(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, held: int = HELD) -> DataFrame:
    """doc_id, start, length, checksum, the document's ids, sequence and offset of each piece."""
    path = tokenizer_path or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _WORKER[path] if path in _WORKER else _WORKER.setdefault(path, WordIds(path))
        end = np.asarray([END], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rest: list[tuple] = []  # (doc_id, start, ids, the document's ids)

        def settle() -> None:
            nonlocal number
            for of in closed(best_fit([len(r[2]) // 4 for r in rest], window), window):
                at = 0
                for i, lo, hi in of:
                    doc, start, ids, n = rest[i]
                    rows.append((doc, start + lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), n, number, at))
                    at += hi - lo
                number += 1
            rest.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows), OUT_ROWS):
                columns = zip(*rows[lo : lo + OUT_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)
            rows.clear()

        for part in parts(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + end
                n = len(ids) // 4
                full = n - n % window
                for lo in range(0, full, window):
                    rows.append((doc, lo, window, zlib.crc32(ids[4 * lo : 4 * (lo + window)]), n, number, 0))
                    number += 1
                if full < n:
                    rest.append((doc, full, ids[4 * full :], n))
                if len(rest) >= held:
                    settle()
                if len(rows) >= OUT_ROWS:
                    yield from out()
        settle()
        yield from out()

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return arrow_batches(texts).mapInArrow(pack, PLACED)
