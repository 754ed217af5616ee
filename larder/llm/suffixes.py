"""Sparse suffix arrays over token streams, sorted and compared by Spark.

A suffix is retained where its gram's hash is the least of some run of ``window``
grams (a minimiser), so the choice depends on the content alone and equal runs
retain equal suffixes.  A retained suffix is keyed by its first ``reach`` tokens.
Two streams that share ``window + gram - 1`` tokens retain a common suffix among
the first ``window`` of them.

:func:`repeated` sorts the suffixes of all streams by one range shuffle and
compares neighbours.  A key with very many suffixes spans several ranges; the
runs at a range's ends are settled by one aggregate over their keys, of which
there are at most two for each range, so that list may be broadcast.  So does
:func:`spread`, which counts the streams of each key.

Where every repeat of ``reach`` tokens counts, all suffixes are looked at in two
passes (:func:`every`): the least grams that occur in several streams, as a
:func:`bitmap`, leave few suffixes to sort, and no repeat is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import staged
from larder.llm.words import BASE, INVERSE, mix, powers

_U = np.uint64
_MAX = _U(2**64 - 1)


def run_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k tokens from each place on; one pass for any k."""
    n = len(tokens)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(tokens * powers(BASE, n), out=total[1:], dtype=np.uint64)
    return mix((total[k:] - total[:-k]) * powers(INVERSE, n - k + 1) + _U(k))


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each run of ``width`` values, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def retained(streams: list[np.ndarray], gram: int, window: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, place, key) of every retained suffix with at least ``reach`` tokens."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    n = int(sizes.sum())
    if n < max(reach, gram):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    tokens = np.concatenate(streams)
    stream = np.repeat(np.arange(len(streams)), sizes)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[stream] - place
    order = np.full(n + 2 * (window - 1), _MAX, dtype=np.uint64)
    grams = run_hashes(tokens, gram)
    inside = left[: len(grams)] >= gram
    order[window - 1 : window - 1 + len(grams)][inside] = grams[inside]
    least = sliding(order, window, np.minimum)
    best = sliding(least, window, np.maximum)
    keys = run_hashes(tokens, reach)
    own = order[window - 1 : window - 1 + len(keys)]
    at = np.flatnonzero((own == best[: len(keys)]) & (left[: len(keys)] >= reach))
    return stream[at], place[at], keys[at]


def every(streams: list[np.ndarray], gram: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stream, place, key, least) of every place with ``reach`` tokens: their hash, and the least hash of a gram in them.

    Equal runs of ``reach`` tokens have an equal least gram, and neighbouring
    places mostly share theirs: few least grams tell which places can be repeats.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    n = int(sizes.sum())
    if n < reach:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    tokens = np.concatenate(streams)
    stream = np.repeat(np.arange(len(streams)), sizes)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, least = run_hashes(tokens, reach), sliding(run_hashes(tokens, gram), reach - gram + 1, np.minimum)
    at = np.flatnonzero((sizes[stream] - place)[: len(keys)] >= reach)
    return stream[at], place[at], keys[at], least[at]


#: Bits of a bitmap of keys at most (32 MB), and bits for each key below that.
MOST_BITS, KEY_BITS = 1 << 28, 16


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap with each key's low bits set, of bounded size.

    Other keys may hit it by chance, the more the more keys there are, so it may
    spare rows but decides nothing.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (KEY_BITS * keys.count()).bit_length()))
    slot = F.expr(f"(key & {bits - 1}L) + 1")
    dealt = keys.select(F.bitmap_bucket_number(slot).alias("at"), F.bitmap_bit_position(slot).alias("bit")).repartition("at")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in dealt.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("set")).toLocalIterator():
        part = np.frombuffer(bytes(r["set"]), dtype=np.uint8)
        out[(r["at"] - 1) * len(part) :][: len(part)] = part
    return out


def hits(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the keys (unsigned) are, or seem to be, in a :func:`bitmap`."""
    slot = keys & _U(8 * len(held) - 1)
    return (held[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1


def spread(suffixes: DataFrame, name: str) -> DataFrame:
    """(who, pos, n): the rows of (key, who, pos) whose key occurs under several ``who``, and under how many."""
    schema = "key long, who long, pos long, n long"

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        key, who = rows["key"].to_numpy(), rows["who"].to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        n = np.add.reduceat((new | np.concatenate([[True], who[1:] != who[:-1]])).astype(np.int64), starts)
        edge = np.zeros(len(starts), dtype=bool)
        edge[[0, -1]] = True
        hit = ((n > 1) | edge)[run]
        # only the keys at a range's ends are looked at again
        yield rows.assign(key=rows["key"].astype("Int64").where(edge[run]), n=n[run])[hit]

    ordered = suffixes.select("key", "who", "pos").repartitionByRange("key", "who", "pos").sortWithinPartitions("key", "who")
    found = staged(ordered.mapInPandas(compare, schema), name)
    ends = found.where("key is not null").select("key", "who").distinct().groupBy("key").agg(F.count("*").alias("of_ends"))
    settled = found.join(F.broadcast(ends), "key", "left")
    return settled.select("who", "pos", F.coalesce("of_ends", "n").alias("n")).where("n > 1")


def repeated(suffixes: DataFrame, name: str) -> DataFrame:
    """The rows of (key, who, doc, pos) whose key occurs under several ``who``, with ``first``, the least of these.

    All four columns are long; doc may be null.
    """
    schema = "key long, who long, doc long, pos long, first long, edge boolean"

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        key, who = rows["key"].to_numpy(), rows["who"].to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        low, high = np.minimum.reduceat(who, starts), np.maximum.reduceat(who, starts)
        edge = np.zeros(len(starts), dtype=bool)
        edge[[0, -1]] = True
        hit = ((low != high) | edge)[run]
        yield rows.assign(first=low[run], edge=edge[run])[hit].astype({"doc": "Int64"})

    ordered = suffixes.select("key", "who", "doc", "pos").repartitionByRange("key", "who", "doc", "pos").sortWithinPartitions("key", "who")
    found = staged(ordered.mapInPandas(compare, schema), name)
    ends = found.where("edge").groupBy("key").agg(F.min("who").alias("low"), F.max("who").alias("high"))
    settled = found.join(F.broadcast(ends), "key", "left").where("not edge or low <> high")
    return settled.select("key", "who", "doc", "pos", F.when(F.col("edge"), F.col("low")).otherwise(F.col("first")).alias("first"))
