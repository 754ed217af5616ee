"""Word hashes of many texts at once, and batches of bounded size.

A word's hash is a polynomial over random letter values, read from prefix sums
over the text's bytes, so that no table of known words is kept in a worker.
Texts are read in steps of ``STEP`` bytes, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = 1 << 16
#: Rows and characters of a part of a batch.
PART_ROWS, PART_CHARS = 512, 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


INVERSE = pow(BASE, -1, 2**64)
_UP, _DOWN = powers(BASE, STEP), powers(INVERSE, STEP)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(BASE))

#: Bytes between words: ASCII white space.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words: all ASCII but letters and digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def runs(data: bytes, blank: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each run of bytes that are not ``blank``."""
    sums, downs, places = [], [], []
    total, lift, drop, before = _U(0), _U(1), _U(1), True
    for lo in range(0, len(data), STEP):
        part = np.frombuffer(data, dtype=np.uint8, count=min(STEP, len(data) - lo), offset=lo)
        gap = blank[part]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if gap[0] != before:
            edge = np.concatenate([[0], edge])
        before = bool(gap[-1])
        held = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[part] * _UP[: len(part)], out=held[1:], dtype=np.uint64)
        sums.append(held[edge] * lift + total)
        downs.append(_DOWN[edge] * drop)
        places.append(edge + lo)
        with np.errstate(over="ignore"):
            total = total + held[-1] * lift
            lift, drop = lift * _U(pow(BASE, STEP, 2**64)), drop * _U(pow(INVERSE, STEP, 2**64))
    if not sums:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at, down, place = np.concatenate(sums), np.concatenate(downs), np.concatenate(places)
    if not before:
        at = np.append(at, total)
    n = len(at) // 2
    return mix((at[1::2] - at[0::2]) * down[0 : 2 * n : 2]), place[0 : 2 * n : 2]


def hashed(texts: Sequence[str], blank: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one text after the other, and how many each text has."""
    data = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    words, places = runs(b" ".join(data), blank)
    return words, np.diff(np.searchsorted(places, ends), prepend=0).astype(np.int64)


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = PART_ROWS, chars: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that stay small even where texts are very long; nothing is copied."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(sizes), 0))
        lo, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > lo and (i - lo >= rows or held + n > chars):
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < len(sizes):
            yield batch.slice(lo)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()], schema=schema)
